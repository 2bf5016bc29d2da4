"""Streams with own state, over many small batches, against the batch operators; stored tables with versions."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import traffic
from tidemark.sources.snapshots import SnapshotTable
from tidemark.streaming import stateful

T0 = dt.datetime(2024, 3, 1, 10)
SCHEMA = "event_id long, anon_id long, ts timestamp, src string, path string, user_agent string"


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.fixture
def log(spark, tmp_path):
    """Ten files of four days in order of arrival: up to 20 minutes late, and an end that moves the watermark past all."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(600):
        ts = T0 + dt.timedelta(minutes=9.6 * i)
        hot = i % 40 < 9
        rows.append((i, int(rng.integers(0, 60)) if not hot else i % 40 + 100, ts.replace(second=int(rng.integers(0, 60))) if not hot else (T0 + dt.timedelta(minutes=384 * (i // 40))).replace(second=i % 60), ["naver", "x", None][i % 3] if i % 7 else "naver.com", f"/c/{i % 3}" if hot or i % 2 else "/a", ["Mozilla", "iPhone", None][int(rng.integers(0, 12)) // 5]))
    late = {i: dt.timedelta(minutes=int(rng.integers(0, 20))) for i in range(600)}
    rows.sort(key=lambda r: r[2] + late[r[0]])
    end = (9999, -1, T0 + dt.timedelta(days=60), "x", "/c/end", "Mozilla")
    for k in range(10):
        spark.createDataFrame(rows[60 * k : 60 * (k + 1)], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k:02d}")
    spark.createDataFrame([end], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/99")
    live = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    return spark.createDataFrame(rows, SCHEMA), live, tmp_path


def run(out, mode, sink, tmp_path):
    q = out.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    assert len([p for p in q.recentProgress if p["numInputRows"]]) >= 10
    return q


def test_touches_of_ten_batches_equal_one(spark, log):
    rows, live, path = log
    table = SnapshotTable.create(spark, f"file://{path}/touches", stateful.TOUCHES, ["anon_id", "since"], 8)
    q = run(stateful.visitor_touches(live, "10 days"), "update", stateful.into_table(table, "touch"), path)
    got = {r["anon_id"]: (r["first_seen"], r["last_seen"], r["visits"]) for r in stateful.first_touch_of(table.read()).where("anon_id >= 0").collect()}
    want = {r["anon_id"]: (r["first_seen"], r["last_seen"], r["visits"]) for r in traffic.first_touch(rows.drop("user_agent")).collect()}
    assert got == want
    state = [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
    assert state[-1] < max(state)  # the end has passed everyone's age


def test_touches_are_added_up_before_the_state(spark, log):
    """The state is an aggregation's, so no row goes to Python; visitors of several spans have several rows."""
    _, live, path = log
    table = SnapshotTable.create(spark, f"file://{path}/touches", stateful.TOUCHES, ["anon_id", "since"], 8)
    q = run(stateful.visitor_touches(live, "1 day"), "update", stateful.into_table(table, "touch"), path)
    assert {s["operatorName"] for p in q.recentProgress for s in p["stateOperators"]} == {"stateStoreSave"}
    rows = table.read().where("anon_id >= 0")
    assert rows.agg(F.sum("visits")).first()[0] == 600 and rows.count() > rows.select("anon_id").distinct().count()


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    table = SnapshotTable.create(spark, f"file://{tmp_path}/t", "k long, v long", ["k"], 4)
    write = stateful.into_table(table, "q")
    rows = spark.createDataFrame([(1, 10), (2, 20)], "k long, v long")
    write(rows, 0)
    version = table.version
    write(rows.withColumn("v", F.col("v") * 100), 0)
    assert table.version == version and sorted(map(tuple, table.read().collect())) == [(1, 10), (2, 20)]


def test_verdicts_equal_batch_with_late_events(spark, log):
    rows, live, path = log
    found = []
    run(stateful.day_verdicts(live), "append", lambda b, _: found.extend(b.collect()), path)
    got = {(r["anon_id"], r["day"]): (r["events"], r["bot"]) for r in found if r["anon_id"] >= 0}
    assert len(got) == len([r for r in found if r["anon_id"] >= 0])
    days = traffic.local_day(F.col("ts"))
    want = {(r["anon_id"], r["day"]): (r["events"], r["bot"]) for r in traffic.day_verdicts(rows, days).collect()}
    assert got == want and len({b for _, b in want.values()}) == 2


def test_bursts_are_exact(spark, log):
    rows, live, path = log
    found = set()
    q = run(stateful.burst_visitors(live), "append", lambda b, _: found.update(r["anon_id"] for r in b.collect()), path)
    assert found == {r[0] for r in traffic.bursts(rows).collect()} and found
    state = [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
    assert state[-1] < max(state) and max(state) < 60 * 9  # minutes are forgotten, and hold few visitors


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = SnapshotTable.create(spark, f"file://{tmp_path}/t", "k long, s string, v long", ["k"], 16)
    first = spark.createDataFrame([(i, "a", i) for i in range(400)], "k long, s string, v long")
    assert table.upsert(first, "load") == 16 and table.upsert(first, "load") == 0
    before = table.folders()
    delta = spark.createDataFrame([(7, "b", -7), (9, "b", -9), (1000, "b", 1)], "k long, s string, v long")
    n = table.upsert(delta, "d1")
    after = table.folders()
    assert 1 <= n <= 3 and sum(before[b] != after[b] for b in before) == n
    want = {i: ("a", i) for i in range(400)} | {7: ("b", -7), 9: ("b", -9), 1000: ("b", 1)}
    assert {r["k"]: (r["s"], r["v"]) for r in table.read().collect()} == want
    again = SnapshotTable(spark, table.root)
    assert again.upsert(delta, "d1") == 0 and again.folders() == after and again.upsert(delta.limit(0), "d2") == 0
    assert again.insert_ignore(spark.createDataFrame([(7, "c", 0), (1001, "c", 0)], "k long, s string, v long")) >= 1
    assert again.update(spark.createDataFrame([(8, 80), (5000, 1)], "k long, v long"), frozenset({"v"})) >= 1
    with pytest.raises(ValueError, match="not derived"):
        again.update(spark.createDataFrame([(8, "x")], "k long, s string"), frozenset({"v"}))
    want |= {1001: ("c", 0), 8: ("a", 80)}
    assert {r["k"]: (r["s"], r["v"]) for r in again.read().collect()} == want
    assert again.vacuum() > 0 and {r["k"]: (r["s"], r["v"]) for r in again.read().collect()} == want


def test_of_two_writers_one_fails(spark, tmp_path):
    table = SnapshotTable.create(spark, f"file://{tmp_path}/t", "k long, v long", ["k"], 4)
    rows = spark.createDataFrame([(1, 1)], "k long, v long")

    def slow(old, new):
        SnapshotTable(spark, table.root).upsert(spark.createDataFrame([(2, 2)], "k long, v long"))
        return old.unionByName(new)

    with pytest.raises(RuntimeError, match="already written"):
        table.change(rows, slow)
    assert [tuple(r) for r in table.read().collect()] == [(2, 2)]


def test_the_last_rows_of_each_owner_stay(spark, tmp_path):
    table = SnapshotTable.create(spark, f"file://{tmp_path}/t", "owner string, at long", ["owner"], 4)
    for k in range(3):
        table.append_keep_last(spark.createDataFrame([(o, 10 * k + i) for o in "ab" for i in range(4)], "owner string, at long"), ["owner"], [F.desc("at")], 5, f"r{k}")
    assert sorted(map(tuple, table.read().collect())) == [(o, x) for o in "ab" for x in (13, 20, 21, 22, 23)]
