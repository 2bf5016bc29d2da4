"""Ranking, diversification, rotation and sampling. Orders are total: every function takes or adds a tie-breaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def stratified(df: DataFrame, strata: dict[str, tuple[Column, list[Column]]], n: int) -> DataFrame:
    """(stratum, all columns): the first n rows of each stratum in its own order, the same rows on every run."""
    parts = [df.where(where).orderBy(*order).limit(n).withColumn("stratum", F.lit(name)) for name, (where, order) in strata.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cap_per_key(df: DataFrame, key: Column, position: str, cap: int, drop: bool = False) -> DataFrame:
    """At most ``cap`` rows of a key keep their place; the rest follow in order, or go. Adds ``new_position``.

    The final number is global, so give this a list that a query has already limited.
    """
    own = df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(position)))
    if drop:
        return own.where(F.col("__n") <= cap).drop("__n")
    return own.withColumn("new_position", F.row_number().over(Window.orderBy((F.col("__n") > cap).cast("int"), position))).drop("__n")


def round_robin(df: DataFrame, group: Column, order: list[Column], group_order: Column, groups: Column | int, slot: int, cap: int) -> DataFrame:
    """One row of each group in turn, starting with another group in each slot; adds ``turn``. At most ``cap`` rows."""
    ranked = df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.withColumn("seat", F.pmod(group_order - F.lit(slot), groups)).orderBy("turn", "seat").limit(cap)


def rotate(df: DataFrame, key: str, offset: int, cap: int, slices: int = 1024) -> DataFrame:
    """A pool in the order of its whole-number ``key``, started ``offset`` places on, cut to ``cap``; adds ``place``.

    Rows are counted in slices of the key's range, which tells the slices that hold the wanted places; only their rows are
    numbered, each slice on its own. The driver gets the counts of ``slices`` slices.
    """
    span = df.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    if span["low"] is None:
        return df.withColumn("place", F.lit(0).cast("long"))
    width = max(1, -(-(span["high"] - span["low"] + 1) // slices))
    sliced = df.withColumn("__slice", F.floor((F.col(key) - F.lit(span["low"])) / width).cast("long"))
    counts = sorted((r["__slice"], r["count"]) for r in sliced.groupBy("__slice").count().collect() if r["__slice"] is not None)
    n, before, held = sum(c for _, c in counts), 0, []
    for number, count in counts:
        first = (before - offset) % n
        if first < cap or first + count > n:  # the slice begins within the wanted places, or runs over the end into them
            held.append((number, before))
        before += count
    starts = F.create_map(*[F.lit(x) for pair in held for x in pair])
    numbered = sliced.where(F.col("__slice").isin([h for h, _ in held])).withColumn("__at", F.row_number().over(Window.partitionBy("__slice").orderBy(key)) - 1)
    return numbered.withColumn("place", F.pmod(starts[F.col("__slice")] + F.col("__at") - F.lit(offset), F.lit(n))).where(F.col("place") < cap).drop("__slice", "__at")


def slot_of(epoch_ms: int, hours: int = 12, zone_hours: int = 9) -> int:
    """The rotation slot of a moment: slots start at local midnight and noon."""
    return (epoch_ms + zone_hours * 3_600_000) // (hours * 3_600_000)


def slice_offset(epoch_ms: int, minutes: int = 20, zone_minutes: int = 540) -> int:
    """Slices of the local day plus the day number."""
    local = epoch_ms // 60_000 + zone_minutes
    return local % 1440 // minutes + local // 1440


def reserve_recent(df: DataFrame, owner: str, position: str, eligible: Column, n: int = 6) -> DataFrame:
    """A sorted list with one of the first n places for an eligible row: if none has one, the first eligible row further
    down takes place n and the row from there goes to the end. Adds ``new_position``."""
    w = Window.partitionBy(owner)
    marked = df.withColumn("__e", F.coalesce(eligible, F.lit(False)))
    marked = marked.withColumn("__top", F.max(F.when(F.col("__e") & (F.col(position) <= n), 1)).over(w))
    marked = marked.withColumn("__pick", F.when(F.col("__top").isNull(), F.min(F.when(F.col("__e"), F.col(position))).over(w))).withColumn("__last", F.max(position).over(w))
    place = (
        F.when(F.col("__pick").isNull(), F.col(position))
        .when(F.col(position) == F.col("__pick"), F.lit(n))
        .when(F.col(position) == n, F.col("__last"))
        .when(F.col(position) > F.col("__pick"), F.col(position) - 1)
        .otherwise(F.col(position))
    )
    return marked.withColumn("new_position", place.cast("int")).drop("__e", "__top", "__pick", "__last")


def best_lift(df: DataFrame, group: str, axes: list[str], least_rows: int = 3, least: float = 0.05) -> DataFrame:
    """(best_axis, lift): the axis on which a row exceeds its group's mean most; none in groups under ``least_rows``."""
    w = Window.partitionBy(group)
    lifts = F.array(*[F.struct((F.col(a) - F.avg(a).over(w)).alias("lift"), F.lit(-i).alias("no"), F.lit(a).alias("axis")) for i, a in enumerate(axes)])
    best = F.array_max(lifts)
    ok = (F.count("*").over(w) >= least_rows) & (best["lift"] >= least)
    return df.select("*", F.when(ok, best["axis"]).alias("best_axis"), F.when(ok, best["lift"]).alias("lift"))


def since_last(df: DataFrame, key: str, at: list[str], breaks: Column) -> DataFrame:
    """The rows of each key that come after its last row that ``breaks``, by the columns ``at``, which should be total.

    Where a key's last break lies is an aggregate, so tasks combine rows before they are shuffled and no task has to hold a
    key's rows in order. Null keys are left out.
    """
    last = df.groupBy(key).agg(F.max(F.when(breaks, F.struct(*at))).alias("__last"))
    return df.join(last, key).where(F.col("__last").isNull() | (F.struct(*at) > F.col("__last"))).drop("__last")


def streak(df: DataFrame, key: str, at: list[str], value: Column, least: int) -> DataFrame:
    """(key, value, repeats): the run of equal values that ends with the latest row of each key by the columns ``at``; null is a
    value that breaks a run. Two aggregates and no window: a key may have any number of rows."""
    marked = df.select(key, *at, value.alias("v"))
    latest = marked.groupBy(key).agg(F.max_by("v", F.struct(*at)).alias("latest"))
    met = marked.join(latest.where("latest IS NOT NULL"), key)
    run = since_last(met, key, at, ~F.col("v").eqNullSafe(F.col("latest")))
    return run.groupBy(key, F.col("latest").alias("value")).agg(F.count("*").alias("repeats")).where(F.col("repeats") >= least)
