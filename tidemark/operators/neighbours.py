"""Nearest rows of a group by the distance of their vectors, exact, without comparing all pairs."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.files import staged

#: Rows of a block, about.
BLOCK = 500


def blocks(points: DataFrame, group: str, dims: list[str], rows: int = BLOCK) -> DataFrame:
    """``points`` with ``block``: each group cut at quantiles of one coordinate after the other, into parts of about ``rows`` rows."""
    largest = points.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    cuts = max(1, math.ceil((largest / rows) ** (1 / len(dims)) - 1e-9))
    out = points.withColumn("block", F.lit(0))
    if cuts == 1:
        return out
    shares = [(i + 1) / cuts for i in range(cuts - 1)]
    for d in dims:
        at = out.groupBy(F.col(group).alias("__g"), F.col("block").alias("__b")).agg(F.percentile_approx(d, shares, 1000).alias("__cuts"))
        part = F.size(F.filter("__cuts", lambda c: F.col(d) > c))
        out = out.join(at, F.col(group).eqNullSafe(F.col("__g")) & (F.col("block") == F.col("__b"))).withColumn("block", F.col("block") * cuts + part).drop("__g", "__b", "__cuts")
    return out


def nearest_in_group(points: DataFrame, asking: Column, key: str, group: str, dims: list[str], k: int, rows: int = BLOCK) -> DataFrame:
    """(key, other, d): the ``k`` nearest other rows of the same group for the rows that are ``asking``, by the Euclidean
    distance ``d`` to nine digits, then by key. Keys must be unique, coordinates finite.

    Groups are cut into blocks of bounded size. The rows of its own block give each asking row a distance within which its
    neighbours lie; of the other blocks only those are read whose box comes that near. So no neighbour is missed.
    """
    flat = staged(blocks(points.select(key, group, *dims).where(F.col(group).isNotNull()), group, dims, rows), "neighbour-blocks")
    other = flat.select(group, "block", F.col(key).alias("other"), *[F.col(c).alias(f"__{c}") for c in dims])
    boxes = flat.groupBy(group, "block").agg(*[f(c).alias(f"{name}_{c}") for c in dims for name, f in (("low", F.min), ("high", F.max))])
    square = lambda terms: F.sqrt(reduce(lambda a, b: a + b, [F.pow(t, 2) for t in terms], F.lit(0.0)))
    asks = flat.where(asking)

    def ranked(pairs: DataFrame) -> DataFrame:
        met = pairs.join(other.hint("merge"), [group, "block"]).where(F.col(key) != F.col("other"))
        met = met.select(key, "other", F.round(square([F.col(c) - F.col(f"__{c}") for c in dims]), 9).alias("d"))
        return met.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("d", "other"))).where(F.col("rn") <= k)

    reach = ranked(asks).groupBy(key).agg(F.when(F.count("*") == k, F.max("d")).alias("reach"))
    outside = square([F.greatest(F.col(f"low_{c}") - F.col(c), F.col(c) - F.col(f"high_{c}"), F.lit(0.0)) for c in dims])
    near = asks.drop("block").join(reach, key, "left").join(boxes, group)
    near = near.where(F.col("reach").isNull() | (outside <= F.col("reach") + 1e-8)).select(key, group, "block", *dims)
    return ranked(near).drop("rn")
