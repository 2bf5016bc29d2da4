"""Pages that are made from members: which ones a change of members touches, and their figures brought up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import merge

NOW, LATER = 1, 2


def page_index(members: DataFrame, key: str, pages: Column) -> DataFrame:
    """(key, page): the inverted index of members; ``pages`` is an array of page names, null ones and repeats do not count."""
    return members.select(key, F.explode(F.array_distinct(F.array_compact(pages))).alias("page"))


def pages_to_refresh(old: DataFrame, delta: DataFrame, key: str, pages: Column, urgent: list[str]) -> DataFrame:
    """(page, tier): every page that holds a changed member before or after ``delta``; ``NOW`` where one of the ``urgent`` columns
    of such a member changed or it is new, else ``LATER``. Only members of the delta are read from the index.

    ``delta`` has whole new rows of members, keys unique in both. Rows that are equal to the old ones touch nothing.
    """
    before = old.join(delta.select(key), key, "left_semi")
    rows = [c for c in old.columns if c != key]
    was = before.select(key, F.struct(*rows).alias("was"))
    met = delta.select(key, F.struct(*rows).alias("now")).join(was, key, "left").where(~F.col("was").eqNullSafe(F.col("now")))
    hurry = F.col("was").isNull()
    for c in urgent:
        hurry = hurry | ~F.col(f"was.{c}").eqNullSafe(F.col(f"now.{c}"))
    changed = met.select(key, F.when(hurry, NOW).otherwise(LATER).alias("tier"))
    both = page_index(before, key, pages).unionByName(page_index(delta, key, pages))
    return both.join(changed, key).groupBy("page").agg(F.min("tier").alias("tier"))


def page_figures(members: DataFrame, key: str, pages: Column, score: str) -> DataFrame:
    """(page, members, total, best, print): figures of every page; ``print`` tells which members it has, in whatever order."""
    flat = page_index(members.select("*"), key, pages).join(members.select(key, F.col(score).alias("__s")), key)
    return _figures(flat, key)


def _figures(flat: DataFrame, key: str) -> DataFrame:
    number = F.xxhash64(F.lit(1), key).cast("decimal(38,0)")
    return flat.groupBy("page").agg(F.count("*").alias("members"), F.sum("__s").alias("total"), F.max("__s").alias("best"), F.sum(number).alias("print"))


def refreshed(figures: DataFrame, old: DataFrame, delta: DataFrame, key: str, pages: Column, score: str) -> DataFrame:
    """``figures`` of the members after ``delta``: pages that it touches are made anew from their members, all others stay.

    Equal to ``page_figures`` of all members after the change. Pages that lose their last member go.
    """
    touched = pages_to_refresh(old, delta, key, pages, []).select("page")
    after = merge.upsert(old, delta, [key])
    own = page_index(after, key, pages).join(touched, "page", "left_semi").join(after.select(key, F.col(score).alias("__s")), key)
    return figures.join(touched, "page", "left_anti").unionByName(_figures(own, key))
