"""Ranks, running totals and quantiles of groups of any size: no task holds a whole group.

A running total has two levels. Rows are dealt by ranges of (group, order) and written with the number of their range, so a
large group spans several; each range adds up its own rows, and the totals of a group's earlier ranges, of which there are
no more than ranges, are added to them. Quantiles count in histograms whose ranges close in on the wanted places.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.files import staged

#: Bars of a histogram, and the rows of a range that are few enough to be sorted by one task.
BARS, FEW = 2048, 10_000
MAX_ROUNDS = 8


def _same(a: list[str], b: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(p).eqNullSafe(F.col(q)) for p, q in zip(a, b, strict=True)], F.lit(True))


def running(df: DataFrame, group: list[str], order: list[Column], amount: Column | int = 1, before: str = "before", whole: str = "whole") -> DataFrame:
    """``df`` with ``before``, the sum of ``amount`` over the rows of the group that come earlier, and ``whole``, over all of it.

    ``order`` should be total; rows that are equal in it are put in some order. Null groups are one group. Columns named
    ``__amount``, ``__part`` or ``__local`` are used while it works.
    """
    value = amount if isinstance(amount, Column) else F.lit(amount).cast("long")
    rows = df.withColumn("__amount", value)
    dealt = rows.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("__part", F.spark_partition_id())
    dealt = staged(dealt, "ranges")
    sums = dealt.groupBy(*group, "__part").agg(F.sum("__amount").alias("__sum"))
    parts = Window.partitionBy(*group)
    earlier = F.coalesce(F.sum("__sum").over(parts.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__part").alias("__p"), earlier.alias("__earlier"), F.sum("__sum").over(parts).alias("__whole"))
    own = Window.partitionBy("__part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("__local", F.coalesce(F.sum("__amount").over(own), F.lit(0)))
    met = local.join(sums, (F.col("__part") == F.col("__p")) & _same(group, [f"__g{i}" for i in range(len(group))]))
    return met.select(*df.columns, (F.col("__earlier") + F.col("__local")).alias(before), F.col("__whole").alias(whole))


def row_numbers(df: DataFrame, group: list[str], order: list[Column], number: str = "rn", whole: str | None = None) -> DataFrame:
    """``df`` with the place of each row in its group by a total ``order``, from 1, and with ``whole`` the group's rows."""
    out = running(df, group, order, 1, "__before", "__rows")
    out = out.withColumn(number, F.col("__before") + 1)
    return (out.withColumn(whole, F.col("__rows")) if whole else out).drop("__before", "__rows")


def value_ranks(df: DataFrame, group: list[str], value: str, descending: bool = False) -> DataFrame:
    """``df`` with ``rank`` (ties share the first place), ``ties`` (rows of the group with the same value) and ``peers`` (all its
    rows). Rows are counted by value before values are put in order, so many ties are one row there; nulls come first, last
    when descending."""
    counts = df.groupBy(*group, value).agg(F.count("*").alias("ties"))
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_first()
    placed = staged(running(counts, group, [order], F.col("ties"), "__before", "peers"), "value-ranks")
    names = [*group, value]
    placed = placed.select(*[F.col(c).alias(f"__v{i}") for i, c in enumerate(names)], "ties", (F.col("__before") + 1).alias("rank"), "peers")
    # a value that many rows share is the skewed side of a plain join, which adaptive execution splits
    return df.join(placed, _same(names, [f"__v{i}" for i in range(len(names))])).select(*df.columns, "rank", "ties", "peers")


def mid_rank_percentile(df: DataFrame, group: list[str], value: str, percentile: str = "percentile", at_most: str = "at_most") -> DataFrame:
    """``df`` with the percentile in the group, ties counted half, and the share of rows that are at most the row's own value."""
    out = value_ranks(df, group, value)
    below = F.col("rank") - 1
    return out.withColumn(percentile, (below + F.col("ties") / 2) / F.col("peers")).withColumn(at_most, (below + F.col("ties")) / F.col("peers")).drop("rank", "ties", "peers")


def quantiles(df: DataFrame, group: list[str], wanted: dict[str, tuple[Column, float, str]], bars: int = BARS, few: int = FEW) -> DataFrame:
    """(group..., one double for each of ``wanted``): exact quantiles of numbers; ``wanted`` maps names to (value, share, kind).

    Kind ``cont`` interpolates between neighbours, ``disc`` gives the first value whose share of rows is reached. Nulls, NaN and
    infinities do not count; a group without values has null. A histogram of each group's values tells the bar that holds the wanted
    place, whose least and largest value are the next histogram's range, until a bar has ``few`` rows or one value. Nothing but
    counts of bars is shuffled, after each task has added up its own. What is left is put in order by ranges, however much it
    is where ``MAX_ROUNDS`` histograms did not tell values apart.
    """
    stack = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("v")) for n, (v, _, _) in wanted.items()])).alias("x")
    keys = [f"__k{i}" for i in range(len(group))]
    values = df.select(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)], stack).select(*keys, "x.name", "x.v").where("v > double('-infinity') AND v < double('infinity')")
    share = F.create_map(*[F.lit(x) for n, (_, s, _) in wanted.items() for x in (n, float(s))])
    smooth = F.create_map(*[F.lit(x) for n, (_, _, k) in wanted.items() for x in (n, k == "cont")])
    known = values.groupBy(*keys, "name").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    place = F.when(smooth[F.col("name")], (F.col("n") - 1) * share[F.col("name")]).otherwise(F.greatest(F.ceil(F.col("n") * share[F.col("name")]) - 1, F.lit(0)).cast("double"))
    # both neighbours of a place between two rows are looked for on their own
    ends = F.explode(F.array(F.struct(F.lit(0).alias("end"), F.floor("place").alias("want")), F.struct(F.lit(1).alias("end"), F.ceil("place").alias("want")))).alias("e")
    state = known.withColumn("place", place).select(*keys, "name", "n", "low", "high", "place", ends)
    state = staged(state.select(*keys, "name", "place", "e.end", F.col("e.want").alias("want"), "low", "high", F.col("n").alias("inside")), "quantile-ranges")
    names = [*keys, "name"]

    def within(ranges: DataFrame) -> DataFrame:
        other = ranges.select(*[F.col(c).alias(f"__r{i}") for i, c in enumerate(names)], *[c for c in ranges.columns if c not in names])
        return values.join(other, _same(names, [f"__r{i}" for i in range(len(names))])).where("v >= low AND v <= high")

    for _ in range(MAX_ROUNDS):
        wide = state.where((F.col("inside") > few) & (F.col("low") < F.col("high")))
        if wide.isEmpty():
            break
        # bars of equal ratio while a range spans magnitudes, then of equal width
        level = lambda c: F.signum(c) * F.log1p(F.abs(c))
        part = lambda f: (f(F.col("v")) - f(F.col("low"))) / (f(F.col("high")) - f(F.col("low")))
        share_of = F.when(level(F.col("high")) - level(F.col("low")) > 1, part(level)).otherwise(part(lambda c: c))
        bar = F.least(F.floor(share_of * bars), F.lit(bars - 1)).cast("int")
        counted = within(wide).withColumn("bar", bar).groupBy(*names, "end", "place", "want", "bar").agg(F.count("*").alias("inside"), F.min("v").alias("low"), F.max("v").alias("high"))
        so_far = F.coalesce(F.sum("inside").over(Window.partitionBy(*names, "end").orderBy("bar").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        chosen = counted.withColumn("so_far", so_far).where("so_far <= want AND want < so_far + inside").select(*names, "place", "end", (F.col("want") - F.col("so_far")).alias("want"), "low", "high", "inside")
        state = staged(state.where((F.col("inside") <= few) | (F.col("low") == F.col("high"))).unionByName(chosen), "quantile-ranges")
    single = state.where("low = high").select(*names, "place", "end", F.col("low").alias("v"))
    counted = within(state.where("low < high")).groupBy(*names, "end", "place", "want", "v").agg(F.count("*").alias("c"))
    picked = running(counted, [*names, "end"], [F.col("v")], F.col("c")).where("before <= want AND want < before + c").select(*names, "place", "end", "v")
    lower, upper = F.max(F.when(F.col("end") == 0, F.col("v"))), F.max(F.when(F.col("end") == 1, F.col("v")))
    at = F.first("place")
    found = single.unionByName(picked).groupBy(*names).agg(F.when(lower == upper, lower).otherwise((F.ceil(at) - at) * lower + (at - F.floor(at)) * upper).alias("q"))
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("q"))).alias(n) for n in wanted])
    groups = df.select(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)]).distinct()
    if not keys:
        return wide
    other = wide.select(*[F.col(k).alias(f"__q{i}") for i, k in enumerate(keys)], *wanted)
    return groups.join(other, _same(keys, [f"__q{i}" for i in range(len(keys))]), "left").select(*[F.col(k).alias(g) for k, g in zip(keys, group, strict=True)], *wanted)
