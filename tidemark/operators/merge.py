"""Keyed merges and snapshot updates: an old table and a delta give a new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed_merge(old: DataFrame, new: DataFrame, key: Column, date: Column, owner: str | None = None, keep: int | None = None) -> DataFrame:
    """Union of two versions by key, the new one winning; newest dates first, undated rows last, at most ``keep`` rows of an owner.

    ``key`` and ``date`` are expressions over the common columns. Ties are broken by the key, so any partitioning agrees.
    """
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1))).withColumn("__key", key).withColumn("__date", date)
    own = [owner] if owner else []
    latest = Window.partitionBy(*own, "__key").orderBy(F.desc("__new"))
    merged = both.withColumn("__rn", F.row_number().over(latest)).where("__rn = 1")
    if keep is not None:
        order = Window.partitionBy(*own).orderBy(F.col("__date").desc_nulls_last(), F.col("__key"))
        merged = merged.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= keep)
    return merged.drop("__new", "__key", "__date", "__rn")


def evidence_key(link: Column, source: Column, title: Column, text: Column) -> Column:
    """The link, or where there is none source, title and text cut to 60 and 120 characters."""
    fallback = F.concat(F.lit("T:"), F.coalesce(source, F.lit("")), F.lit("|"), F.substring(F.coalesce(title, F.lit("")), 1, 60), F.lit("|"), F.substring(F.coalesce(text, F.lit("")), 1, 120))
    return F.when(F.coalesce(link, F.lit("")) != "", F.concat(F.lit("L:"), link)).otherwise(fallback)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with equal keys; others stay."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` are added where their key is unknown."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def not_in(df: DataFrame, key: str, values: DataFrame, value: str) -> DataFrame:
    """Rows of ``df`` as SQL's NOT IN gives them: none if the list holds a null, all if it is empty, else those with a key that it
    does not hold. One aggregate tells which; the rest is a plain anti join, so the list is never sent whole."""
    got = values.agg(F.count("*").alias("n"), F.count_if(F.col(value).isNull()).alias("nulls")).first()
    if got["nulls"]:
        return df.limit(0)
    if not got["n"]:
        return df
    return df.where(F.col(key).isNotNull()).join(values.select(F.col(value).alias("__value")), F.col(key) == F.col("__value"), "left_anti")


def update_columns(old: DataFrame, values: DataFrame, keys: list[str], allowed: frozenset[str]) -> DataFrame:
    """Bulk update of derived columns from a table of values; a column outside ``allowed`` is an error."""
    changed = [c for c in values.columns if c not in keys]
    if bad := [c for c in changed if c not in allowed]:
        raise ValueError(f"columns not derived: {bad}")
    renamed = values.select(*keys, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in changed])
    joined = old.join(renamed, keys, "left")
    return joined.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in old.columns])


def keep_last(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The last n rows of each key."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in the given order (a DISTINCT ON)."""
    return keep_last(df, key, order, 1)


def as_of(snapshots: DataFrame, key: str, date: str, value: str, on: Column) -> DataFrame:
    """(key, value): the value of the latest snapshot on or before a date; aggregated in one pass without a sort."""
    return snapshots.where(F.col(date) <= on).groupBy(key).agg(F.max_by(value, date).alias(value))


def blocked_shrinks(old: DataFrame, new: DataFrame, key: str, least: int = 10, ratio: float = 0.8) -> DataFrame:
    """Rows of a new version that would shrink a published entity with at least ``least`` items below ``ratio`` of them."""
    o = old.select(key, F.col("published").alias("__pub"), F.col("n").alias("prev_n"))
    return new.join(o, key).where(F.col("__pub") & (F.col("prev_n") >= least) & (F.col("n") < F.col("prev_n") * ratio)).select(key, "prev_n", "n")


def overlay(base: DataFrame, overrides: DataFrame, key: str = "key", item: str = "item") -> DataFrame:
    """A dictionary with additions and removals: (base and added) without removed."""
    added = overrides.where("op = 'add'").select(key, item)
    return base.select(key, item).union(added).distinct().join(overrides.where("op = 'remove'").select(key, item), [key, item], "left_anti")


def state_changes(prev: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """(key, kind, before, after): more reviews, a rank moved by two or more, new rivals."""
    p = prev.select(key, *[F.col(c).alias(f"p_{c}") for c in ("reviews", "rank", "rivals")])
    rows = F.array(
        F.when(F.col("reviews") > F.coalesce("p_reviews", F.lit(0)), F.struct(F.lit("review").alias("kind"), F.coalesce("p_reviews", F.lit(0)).cast("long").alias("before"), F.col("reviews").cast("long").alias("after"))),
        F.when((F.col("p_rank") > 0) & (F.col("rank") > 0) & (F.abs(F.col("rank") - F.col("p_rank")) >= 2), F.struct(F.lit("rank").alias("kind"), F.col("p_rank").cast("long").alias("before"), F.col("rank").cast("long").alias("after"))),
        F.when((F.col("p_rivals") > 0) & (F.col("rivals") > F.col("p_rivals")), F.struct(F.lit("rival").alias("kind"), F.col("p_rivals").cast("long").alias("before"), F.col("rivals").cast("long").alias("after"))),
    )
    return now.join(p, key, "left").select(key, F.explode(F.array_compact(rows)).alias("c")).select(key, "c.*")
