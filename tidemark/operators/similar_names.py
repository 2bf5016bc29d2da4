"""Names that differ in spelling or wording: brand overlap, near-duplicates, and a set-similarity self-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import dictionary, matching
from tidemark.sources.files import staged


def squeezed(name: Column) -> Column:
    """Lower case without blanks."""
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\s+", "")


def stripped(name: Column, spellings: list[tuple[str, str]], trade: str) -> Column:
    """A squeezed name in one spelling (patterns and what replaces them, in order) without the words of the ``trade`` pattern."""
    out = squeezed(name)
    for pattern, to in spellings:
        out = F.regexp_replace(out, pattern, to)
    return F.regexp_replace(out, trade, "")


def brand_overlap(name: Column, words: Column, other: Column, other_words: Column, venue_only: Column) -> Column:
    """Whether two names share a brand: an equal distinctive word, not a part of one.

    Names in a shared building (``venue_only``) and those with only words of up to two letters must also hold each other
    whole. So must names without a common word: brackets may glue two names together. ``words`` are distinctive words; an
    ``other`` name without any is searched for the first one's.
    """
    a, b = squeezed(name), squeezed(other)
    whole = (F.char_length(a) >= 2) & (F.contains(b, a) | F.contains(a, b))
    mine, theirs = F.transform(words, squeezed), F.transform(other_words, squeezed)
    shared = F.when(F.size(theirs) > 0, F.arrays_overlap(mine, theirs)).otherwise(F.exists(mine, lambda w: F.contains(b, w)))
    weak = venue_only | F.forall(mine, lambda w: F.char_length(w) <= 2)
    return F.when((F.size(mine) > 0) & shared & ~weak, True).otherwise(whole)


def near_duplicate(a: Column, b: Column, least: int = 4) -> Column:
    """Whether two stripped names are one: equal, or one of ``least`` letters or more inside the other. Under two letters never."""
    short = F.least(F.char_length(a), F.char_length(b))
    return (short >= 2) & ((a == b) | ((short >= least) & (F.contains(a, b) | F.contains(b, a))))


def near_duplicate_names(df: DataFrame, key: str, name: str, spellings: list[tuple[str, str]], trade: str, least: int = 4) -> tuple[DataFrame, DataFrame]:
    """(members, links): (key, plain) with the stripped name of each row, and (short, long) for every two different stripped
    names of which one holds the other.

    Equal names are one class from the start, so however many rows share a name it is matched once; names are found inside
    names by one automaton pass. Rows whose stripped name has under two letters are members without links.
    """
    members = staged(df.select(key, stripped(F.col(name), spellings, trade).alias("plain")), "name-members")
    plain = members.where(F.char_length("plain") >= least).select("plain").distinct()
    hits = dictionary.term_hits(plain, "plain", "plain", plain.select(F.col("plain").alias("term")))
    return members, hits.where(F.col("term") != F.col("plain")).select(F.col("term").alias("short"), F.col("plain").alias("long"))


def similar_sets(sets: DataFrame, key: str, items: str, least: float) -> DataFrame:
    """(a, b, shared, similarity): every two rows whose sets have a Jaccard similarity of ``least`` or more, a < b by key.

    Items are put in order of their frequency, rarest first. Two sets that must share n items share the first two of them
    among all but n - 2 of each, so these prefixes meet by pairs of items, which are far rarer than items; sets so small that
    one shared item is enough meet by it. Where two meet, their sizes and 128 bits of their items, which differ in no more
    places than the sets in items, must fit before the pair is kept and verified. Keys must be unique; empty sets pair with
    nothing. Give equal sets as one row.
    """
    if not 0 < least <= 1:
        raise ValueError("a similarity is over 0 and at most 1")
    own = sets.select(F.col(key).alias("key"), F.array_distinct(items).alias("items")).where("size(items) > 0")
    flat = own.select("key", F.explode("items").alias("item")).where("item IS NOT NULL")
    often = flat.groupBy("item").agg(F.count("*").alias("n"))
    ordered = flat.join(often, "item").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("s"))
    ordered = staged(ordered.select("key", F.transform("s", lambda x: x["item"]).alias("items")), "similar-sets")
    size = F.size("items")
    bits = lambda half: F.aggregate("items", F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(F.when(F.pmod(F.xxhash64(x), F.lit(2)) == half, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(F.xxhash64(x), 1), F.lit(64)).cast("int"))).otherwise(F.lit(0).cast("long"))))
    # floating shares are lowered a little, so that a whole number is never rounded over
    need = F.ceil(size * F.lit(least) - 1e-9).cast("int")
    own = ordered.select("key", size.alias("size"), need.alias("need"), bits(0).alias("even"), bits(1).alias("odd"), "items")
    first = lambda n: F.slice("items", F.lit(1), F.least(F.col("size"), F.col("size") - F.col("need") + n))
    ones = own.where(F.col("size") <= 1 / least**2 + 1e-9).select("key", "size", "need", "even", "odd", F.explode(first(1)).alias("met"))
    couples = F.flatten(F.transform(first(2), lambda x, i: F.transform(F.slice("items", F.lit(1), i), lambda y: F.xxhash64(y, x))))
    twos = own.where("need > 1").select("key", "size", "need", "even", "odd", F.explode(couples).alias("met"))

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("key").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("size", "need", "even", "odd")], "met")

    def meet(left: DataFrame, right: DataFrame, order: Column) -> DataFrame:
        # both sides grow with the sets: a sorted join at every size
        share = F.ceil((F.col("size_a") + F.col("size_b")) * F.lit(least / (1 + least)) - 1e-9)
        apart = F.bit_count(F.col("even_a").bitwiseXOR(F.col("even_b"))) + F.bit_count(F.col("odd_a").bitwiseXOR(F.col("odd_b")))
        fits = (F.col("need_a") <= F.col("size_b")) & (F.col("need_b") <= F.col("size_a")) & (apart <= F.col("size_a") + F.col("size_b") - 2 * share)
        return side(left, "a").join(side(right, "b").hint("merge"), "met").where(fits & order).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    small = meet(ones.where("need = 1"), ones, F.col("a") != F.col("b"))
    pairs = meet(twos, twos, F.col("a") < F.col("b")).unionByName(small).distinct()
    met = pairs.join(ordered.select(F.col("key").alias("a"), F.col("items").alias("x")).hint("merge"), "a").join(ordered.select(F.col("key").alias("b"), F.col("items").alias("y")).hint("merge"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    found = met.select("a", "b", shared.alias("shared"), (F.size("x") + F.size("y") - shared).alias("either"))
    return found.select("a", "b", "shared", (F.col("shared") / F.col("either")).alias("similarity")).where(F.col("similarity") >= least)


def similar_names(df: DataFrame, name: str, least: float) -> DataFrame:
    """(a, b, shared, similarity) of distinct normalised names by their two-character pieces."""
    names = df.select(matching.normal_name(F.col(name)).alias("plain")).where("plain <> ''").distinct()
    return similar_sets(names.select("plain", matching.bigrams(F.col("plain")).alias("pieces")), "plain", "pieces", least)

