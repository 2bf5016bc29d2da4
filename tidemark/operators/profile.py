"""Profiles of places from their texts: menus, tourism, badges, identity, categories, surroundings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def menus(texts: DataFrame, owner: str, item: str, least: int = 2, top: int = 5, pool: int = 40) -> DataFrame:
    """(owner, item, texts): what at least ``least`` texts of an owner name by the pattern ``item``, the ``top`` most named.

    A name that lies within another one of the owner's first ``pool``, as often named or oftener, is left out.
    """
    named = texts.select(owner, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(item), F.lit(1)))).alias("item"))
    counted = named.groupBy(owner, "item").agg(F.count("*").alias("texts")).where(F.col("texts") >= least)
    first = counted.withColumn("rn", F.row_number().over(Window.partitionBy(owner).orderBy(F.desc("texts"), "item"))).where(F.col("rn") <= pool)
    lists = first.groupBy(owner).agg(F.sort_array(F.collect_list(F.struct("rn", "item", "texts"))).alias("all"))
    within = lambda x: F.exists("all", lambda y: (y["item"] != x["item"]) & y["item"].contains(x["item"]) & (y["texts"] >= x["texts"]))
    return lists.select(owner, F.explode(F.slice(F.filter("all", lambda x: ~within(x)), 1, top)).alias("m")).select(owner, "m.item", "m.texts")


def tourism(texts: DataFrame, area: str, away: str, homonym: str, sample: int = 5, rate: float = 0.35) -> DataFrame:
    """(area, texts, away, tourist): the share of texts that speak of a journey by the pattern ``away``, once names that only
    look like it (``homonym``) are taken out; areas with fewer than ``sample`` texts are none."""
    says = F.rlike(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), homonym, " "), F.lit(away))
    out = texts.groupBy(area).agg(F.count("*").alias("texts"), F.count_if(says).alias("away"))
    return out.withColumn("tourist", (F.col("texts") >= sample) & (F.col("away") / F.col("texts") >= rate))


def badges(texts: DataFrame, owner: str, kinds: dict[str, str], sample: int = 8, share: float = 0.2) -> DataFrame:
    """(owner, shares..., badges): the share of texts that each kind of visitor wrote, by pattern, and the kinds with at least ``share``, most first."""
    t = F.lower(F.coalesce("text", F.lit("")))
    means = [F.avg(F.rlike(t, F.lit(p)).cast("double")).alias(k) for k, p in kinds.items()]
    out = texts.groupBy(owner).agg(F.count("*").alias("texts"), *means)
    ranked = F.sort_array(F.filter(F.array(*[F.struct((-F.col(k)).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(kinds)]), lambda x: -x["s"] >= share))
    return out.withColumn("badges", F.when(F.col("texts") >= sample, F.array_join(F.transform(ranked, lambda x: x["k"]), ",")).otherwise("")).drop("texts")


def gate(rules: dict[str, tuple[Column, str, str]]) -> Column:
    """The first gate, in order, that keeps a place out: a column matched by a pattern, unless by another one; null for none."""
    out = F.lit(None).cast("string")
    for name, (column, pattern, unless) in reversed(rules.items()):
        shut = F.rlike(F.lower(column), F.lit(pattern))
        out = F.when(shut & ~F.rlike(F.lower(column), F.lit(unless)) if unless else shut, name).otherwise(out)
    return out


def identity(area: Column, traits: Column, texts: Column, grade: Column) -> Column:
    """One sentence on a place from its area, an array of traits, the number of its texts and its grade."""
    said = F.when(F.size(traits) == 0, "a place").when(F.size(traits) == 1, F.concat(F.lit("a place for "), F.get(traits, F.lit(0)))).otherwise(F.concat(F.lit("a place for "), F.get(traits, F.lit(0)), F.lit(" and "), F.get(traits, F.lit(1))))
    trust = F.when(grade == "verified", F.concat(F.lit("confirmed by "), texts, F.lit(" texts"))).when(texts > 0, F.concat(F.lit("after "), texts, F.lit(" texts")))
    return F.concat_ws(", ", F.concat(said, F.lit(" in "), area), trust)


def around(pairs: DataFrame, key: str, other: str, distance: str, aliases: DataFrame, most: int = 5) -> DataFrame:
    """(key, others): names of the ``most`` nearest others of pairs (key, other, distance), an alias counting as its own name.

    ``aliases`` has (alias, name); several places of one name count once, with the nearest."""
    resolved = pairs.join(aliases, pairs[other] == aliases["alias"], "left").select(key, F.coalesce("name", F.col(other)).alias("n"), F.round(distance, 3).alias("d"))
    nearest = resolved.groupBy(key, "n").agg(F.min("d").alias("d"))
    first = nearest.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("d", "n"))).where(F.col("rn") <= most)
    return first.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "n"))), lambda x: x["n"]), ",").alias("others"))


def legal_dong(name: Column, groups: dict[str, str]) -> Column:
    """A colloquial or administrative dong as its legal group: numbers before the ending go, then a dictionary of groups holds."""
    plain = F.regexp_replace(name, "제?[0-9]+(동|가)$", "$1")
    out = plain
    for alias, group in groups.items():
        out = F.when(plain == alias, group).otherwise(out)
    return out


def without_name(text: Column, words: Column) -> Column:
    """A text in lower case without the words of its place's own name, so that they are not counted as what it says."""
    return F.aggregate(words, F.lower(F.coalesce(text, F.lit(""))), lambda acc, w: F.replace(acc, F.lower(w), F.lit(" ")))


def in_scope(lat: Column, lng: Column, boxes: dict[str, tuple[float, float, float, float]]) -> Column:
    """The first service area, in order, whose box (south, west, north, east) holds a point; null outside of all."""
    out = F.lit(None).cast("string")
    for name, (south, west, north, east) in reversed(boxes.items()):
        out = F.when(lat.between(south, north) & lng.between(west, east), name).otherwise(out)
    return out


def interleaved(df: DataFrame, region: str, order: list[Column], regions: list[str], cap: int) -> DataFrame:
    """Rows of the listed regions in turn, each region's in order; adds ``turn``. A region gives ``cap`` rows at most."""
    seat = F.array_position(F.array(*[F.lit(r) for r in regions]), F.col(region))
    turned = df.where(F.col(region).isin(regions)).withColumn("turn", F.row_number().over(Window.partitionBy(region).orderBy(*order))).where(F.col("turn") <= cap)
    return turned.withColumn("__seat", seat).orderBy("turn", "__seat").limit(cap).drop("__seat")
