"""Data-quality suite: named checks over tables, each with its failures counted and a few of them shown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = 6


def failing(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """(check, k) of the rows that fail: all row checks of one table in one pass over it."""
    names = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]), lambda x: x.isNotNull())
    return df.select(F.explode(names).alias("check"), F.col(key).cast("string").alias("k"))


def run_checks(spark: SparkSession, levels: dict[str, str], *parts: DataFrame) -> DataFrame:
    """(check, level, failures, samples, passed) of the named checks from parts (check, k) of failing rows.

    One aggregate gives both counts and samples: the smallest key of each of 256 slices by a hash of the key, of which the
    smallest few are shown. So a task keeps 256 keys of a check at most, however many rows fail.
    """
    named = spark.createDataFrame([(n, None) for n in levels], "check string, k string")
    slices = reduce(DataFrame.unionByName, parts, named).groupBy("check", F.substring(F.md5(F.col("k").cast("binary")), 1, 2).alias("slice")).agg(F.count("k").alias("n"), F.min("k").alias("k"))
    shown = F.array_join(F.slice(F.sort_array(F.collect_list("k")), 1, SAMPLES), ",")
    level = F.create_map(*[F.lit(x) for pair in levels.items() for x in pair])
    out = slices.groupBy("check").agg(F.sum("n").alias("failures"), shown.alias("samples"))
    return out.select("check", level[F.col("check")].alias("level"), "failures", "samples", (F.col("failures") == 0).alias("passed"))
