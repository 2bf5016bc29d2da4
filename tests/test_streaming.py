"""Streaming forms of the traffic operators against their batch forms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import traffic as batch
from tidemark.streaming import traffic as stream

SCHEMA = "event_id long, anon_id long, ts timestamp, src string, path string"
T0 = dt.datetime(2024, 1, 1, 12)


@pytest.fixture
def source(spark, tmp_path):
    events = [(i, i % 3, T0 + dt.timedelta(minutes=7 * i + (40 if i % 5 == 0 else 0)), "naver" if i % 2 else "direct", f"/c/{i % 4}") for i in range(60)]
    events.append((99, 9, T0 + dt.timedelta(days=3), "x", "/c/1"))  # moves the watermark past all others
    df = spark.createDataFrame(events, SCHEMA)
    for k, part in enumerate((df.where("event_id < 90"), df.where("event_id >= 90"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    return df.where("event_id < 90"), spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_sessions_equal_batch(source):
    rows, live = source
    want = sorted(tuple(r) for r in batch.sessions(rows, 30, ["anon_id"]).select("anon_id", "start", "end", "events").collect())
    assert sorted(tuple(r) for r in run(stream.sessions(live), "s1").where("anon_id < 9").collect()) == want


def test_daily_counts_equal_batch(source, spark):
    rows, live = source
    want = sorted(tuple(r) for r in rows.groupBy(batch.local_day(F.col("ts")).alias("day")).agg(F.count("*")).collect())
    assert sorted(tuple(r) for r in run(stream.daily_counts(live), "s2").where("day < '2024-01-04'").collect()) == want


def test_first_touch_equals_batch(source):
    rows, live = source
    want = {r["anon_id"]: (r["first_seen"], r["visits"]) for r in batch.first_touch(rows).collect()}
    got = {r["anon_id"]: (r["first_seen"], r["visits"]) for r in run(stream.first_touch(live), "s3", "complete").collect()}
    assert {k: v for k, v in got.items() if k != 9} == want


def test_repeats_are_dropped_and_bursts_found(source):
    rows, live = source
    assert run(stream.distinct_events(live, ["path"]), "s4").where("event_id < 90").count() == rows.select("path").distinct().count()
    assert run(stream.bursts(live, 1), "s5").count() > 0


def test_rate_limit_opens_windows_with_their_first_event(spark, tmp_path):
    rows = [(1, T0 + dt.timedelta(seconds=s)) for s in (0, 1, 2, 59, 60, 61)]
    spark.createDataFrame(rows, "anon_id long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/r")
    live = spark.readStream.schema("anon_id long, ts timestamp").parquet(f"{tmp_path}/r")
    got = run(stream.limited(live, 2), "s6").orderBy("ts").collect()
    assert [r["allowed"] for r in got] == [True, True, False, False, True, True]


def test_rate_limit_orders_events_over_arrow_batches(spark, tmp_path):
    """One visitor's events come in several Arrow batches, the later ones first."""
    rows = [(1, T0 + dt.timedelta(seconds=s)) for s in range(59, -1, -1)]
    spark.createDataFrame(rows, "anon_id long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/r")
    live = spark.readStream.schema("anon_id long, ts timestamp").parquet(f"{tmp_path}/r")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = run(stream.limited(live, 5), "s7").orderBy("ts").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r["allowed"] for r in got] == [True] * 5 + [False] * 55
