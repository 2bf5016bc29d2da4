"""Ranks, running totals and quantiles of large groups against window functions and plain sorting."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import large_groups as lg
from tidemark.sources import files


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows in one group, half of them with one value; null groups and null values."""
    rng = np.random.default_rng(4)
    out = []
    for i in range(6000):
        group = "hot" if i % 3 == 0 else (None if i % 11 == 0 else f"g{i % 40}")
        value = None if i % 17 == 0 else (5 if i % 2 else int(rng.integers(0, 100)))
        out.append((i, group, value, int(rng.integers(1, 9))))
    return files.staged(spark.createDataFrame(out, "id long, grp string, v int, w long").repartition(7), "rows")


def same(a, b):
    a, b = (sorted(map(tuple, x.collect()), key=repr) for x in (a, b))
    assert a == b and a


def test_row_numbers_and_totals_equal_window_functions(rows):
    w = Window.partitionBy("grp")
    order = [F.col("v").desc_nulls_last(), F.col("id")]
    same(lg.row_numbers(rows, ["grp"], order, "rn", "n").select("id", "rn", "n"), rows.select("id", F.row_number().over(w.orderBy(*order)).cast("long"), F.count("*").over(w)))
    before = F.coalesce(F.sum("w").over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same(lg.running(rows, ["grp"], order, F.col("w")).select("id", "before", "whole"), rows.select("id", before, F.sum("w").over(w)))
    same(lg.row_numbers(rows, [], [F.col("id")], "rn").select("id", "rn"), rows.select("id", F.col("id") + 1))


def test_a_hot_group_spans_ranges(spark, rows, monkeypatch):
    seen = []
    monkeypatch.setattr(lg, "staged", lambda df, label: seen.append(files.staged(df, label)) or seen[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lg.row_numbers(rows, ["grp"], [F.col("v").asc_nulls_first(), F.col("id")])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = {r["__part"]: r["n"] for r in seen[0].where("grp = 'hot'").groupBy("__part").agg(F.count("*").alias("n")).collect()}
    largest = seen[0].groupBy("__part").count().agg(F.max("count")).first()[0]
    assert len(parts) >= 2 and largest <= 2 * 6000 / 4


@pytest.mark.parametrize("descending", [False, True])
def test_ties_share_a_rank(rows, descending):
    order = F.col("v").desc_nulls_last() if descending else F.col("v").asc_nulls_first()
    w = Window.partitionBy("grp")
    want = rows.select("id", F.rank().over(w.orderBy(order)).cast("long"), F.count("*").over(Window.partitionBy("grp", "v")), F.count("*").over(w))
    same(lg.value_ranks(rows, ["grp"], "v", descending).select("id", "rank", "ties", "peers"), want)


def plain(values, share, kind):
    values = sorted(v for v in values if v is not None and math.isfinite(v))
    if not values:
        return None
    if kind == "disc":
        return float(values[max(0, math.ceil(len(values) * share) - 1)])
    at = (len(values) - 1) * share
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return float(low + (high - low) * (at - math.floor(at)))


@pytest.mark.parametrize(("bars", "few"), [(2048, 10_000), (4, 10), (3, 1)])
def test_quantiles_equal_sorting(spark, bars, few):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(3000):
        group = "hot" if i % 3 else f"g{i % 5}"
        v = [float(rng.normal()) * 10 ** int(rng.integers(-3, 6)), 7.0, None, float("nan"), float(rng.integers(0, 4)), 1e308, -1e308][int(rng.choice(7, p=[0.5, 0.2, 0.1, 0.02, 0.17, 0.005, 0.005]))]
        rows.append((group, v))
    rows += [("none", None), (None, 3.5), (None, 4.5), ("one", -2.0), ("same", 1.0), ("same", 1.0)]
    wanted = {"p99": (F.col("v"), 0.99, "cont"), "half": (F.col("v"), 0.5, "disc"), "positive": (F.when(F.col("v") > 0, F.col("v")), 0.25, "cont"), "least": (F.col("v"), 0.0, "disc"), "most": (F.col("v"), 1.0, "cont")}
    got = {r["g"]: r for r in lg.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], wanted, bars, few).collect()}
    assert set(got) == {g for g, _ in rows}
    for g, r in got.items():
        own = [v for k, v in rows if k == g]
        positive = [v for v in own if v is not None and v > 0]
        want = {"p99": plain(own, 0.99, "cont"), "half": plain(own, 0.5, "disc"), "positive": plain(positive, 0.25, "cont"), "least": plain(own, 0.0, "disc"), "most": plain(own, 1.0, "cont")}
        for k, v in want.items():
            assert r[k] is None if v is None else r[k] == pytest.approx(v, rel=1e-12), (g, k)


def test_quantiles_of_everything_and_of_nothing(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "v double")
    assert [tuple(r) for r in lg.quantiles(df, [], {"q": (F.col("v"), 0.5, "cont")}, bars=4, few=5).collect()] == [(50.0,)]
    assert lg.quantiles(df.where("v < 0"), ["v"], {"q": (F.col("v"), 0.5, "cont")}).count() == 0
