"""Connected components of an edge table by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, staged

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, root) of every node that has an edge to another; root is the smallest node reachable.

    Each round hangs every neighbour on the smallest node of its star, so long chains shrink by a constant factor. Minima
    are aggregated with map-side combination and written before they are joined, so a node with very many edges is a
    skewed side of a plain join, which adaptive execution splits. Only counts reach the driver.
    """
    pairs = edges.where(F.col(a) != F.col(b))
    now = staged(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc-0")
    state = None
    for k in range(1, max_rounds + 1):
        both = now.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(now.select(F.col("v").alias("n"), F.col("u").alias("m")))
        before, smallest = now, staged(both.groupBy("n").agg(F.least(F.col("n"), F.min("m")).alias("r")), f"cc-large-{k}")
        large = staged(both.where(F.col("m") > F.col("n")).join(smallest, "n").select(F.col("m").alias("u"), F.col("r").alias("v")).distinct(), f"cc-hung-{k}")
        least = staged(large.groupBy("u").agg(F.min("v").alias("r")), f"cc-small-{k}")
        moved = large.join(least, "u").where(F.col("v") != F.col("r")).select(F.col("v").alias("u"), F.col("r").alias("v"))
        now = staged(moved.unionByName(least.select("u", F.col("r").alias("v"))).distinct(), f"cc-{k}")
        for table in (before, smallest, large, least):
            discard(table)
        got = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if (got["n"], got["s"]) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = (got["n"], got["s"])
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
