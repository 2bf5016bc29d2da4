"""What of a text is shown, and in which order: predicates on quotes, cleanup, cautions, facilities, exposure ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.nested import bound
from tidemark.operators import large_groups

# ---------------------------------------------------------------- predicates


def info_dump(quote: Column, experience: str, info: str, tags: int = 3) -> Column:
    """A listing instead of an experience: no word of one, but opening hours and the like, or several hashtags."""
    q = F.coalesce(quote, F.lit(""))
    listing = F.rlike(q, F.lit(info)) | (F.regexp_count(q, F.lit(r"#[^ \t\r\n]+")) >= tags)
    return (F.trim(q) != "") & ~F.rlike(q, F.lit(experience)) & listing


def other_branch(quote: Column, mine: Column, mention: str) -> Column:
    """A quote of another branch: it names a place by the pattern ``mention`` (its first group is the token), and none of
    the own tokens. Tokens that hold each other are variants of one."""
    q = F.coalesce(quote, F.lit(""))
    others = F.filter(F.regexp_extract_all(q, F.lit(mention), F.lit(1)), lambda o: (F.char_length(o) >= 2) & ~F.exists(mine, lambda m: m.contains(o) | o.contains(m)))
    return (F.size(mine) > 0) & ~F.exists(mine, lambda m: q.contains(m)) & (F.size(others) > 0)


def display_quote(quote: Column, name_words: Column, trade: str, details: str) -> Column:
    """(text, empty) of a quote as shown: no leading brackets or signs, no hashtags, cut where ``details`` begin after the
    twelfth character; the quote itself where under eight characters would be left, an ellipsis where it is cut.

    ``empty`` where fewer than six letters remain beside the name's words and words of the ``trade``.
    """
    # longer runs of blanks alone: replacing each single blank by a blank is most of the time of a long text
    whole = F.trim(F.regexp_replace(F.coalesce(quote, F.lit("")), r"[ \t\r\n]{2,}|[\t\r\n]", " "))
    bare = lambda raw: F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"^ *[\[(][^\])]{0,24}[\])] *", ""), r"^[^\p{L}\p{N}]+", ""), r"#[^ #]+", " ")
    cut = lambda b: bound(F.get(F.split(b, details, 2), F.lit(0)), lambda ahead: F.when(F.char_length(ahead) > 12, ahead).otherwise(b))
    tidy = lambda raw: F.trim(F.regexp_replace(F.regexp_replace(bound(bare(raw), cut), r"(?<![ ,:|/-])[ ,:|/-]+$", ""), " {2,}", " "))

    def made(raw: Column, shown: Column) -> Column:
        rest = F.regexp_replace(F.aggregate(name_words, F.lower(shown), lambda acc, w: F.replace(acc, w, F.lit(" "))), trade, " ")
        letters = F.char_length(F.regexp_replace(rest, r"[^\p{L}]+", ""))
        return F.struct(F.when(F.char_length(shown) < F.char_length(raw) - 4, F.concat(shown, F.lit("…"))).otherwise(shown).alias("text"), (letters < 6).alias("empty"))

    return bound(whole, lambda raw: bound(bound(tidy(raw), lambda t: F.when(F.char_length(t) < 8, raw).otherwise(t)), lambda shown: made(raw, shown)))


def scrubbed(quotes: Column) -> Column:
    """An array of quotes without contacts; quotes that are left without words go."""
    return F.filter(F.transform(quotes, lambda q: tx.without_contacts(q)), lambda q: F.rlike(q, F.lit(r"\p{L}")))


# ---------------------------------------------------------------- evidence


def first_mention(low: Column, words: tuple[str, ...], flip: str, before: int = 40, after: int = 45) -> Column:
    """The surroundings of the first mention of a word, in order of the words, after which the pattern ``flip`` does not
    follow within ten characters; null without one. They reach back to an earlier mention at most."""
    found = []
    for w in words:
        parts = F.split(low, rf"\Q{w}\E")
        places = F.transform(parts, lambda p, i: F.struct(i.alias("i"), p.alias("p")))
        place = F.get(F.filter(places, lambda s: (s["i"] > 0) & ~F.rlike(F.left(s["p"], F.lit(10)), F.lit(flip))), F.lit(0))
        around = F.concat(F.right(F.get(parts, place["i"] - 1), F.lit(before)), F.lit(w), F.left(place["p"], F.lit(after)))
        found.append(F.when(place.isNotNull(), F.trim(F.regexp_replace(around, r"[ \t\r\n]+", " "))))
    return F.coalesce(*found)


def cautions(texts: DataFrame, owner: str, order: str, rules: dict[str, tuple[str, ...]], flip: str, info: str, least: int = 2, sample: int = 6, top: int = 4) -> DataFrame:
    """(owner, label, count, quote): what several texts of an owner warn of, with the words of one of them.

    Owners with fewer than ``sample`` texts are not judged. The quote is the one of the first text by ``order`` that does
    not read as a listing (``info``), else of the first.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    labels = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(label).alias("label"), first_mention(low, words, flip).alias("quote")) for i, (label, words) in enumerate(rules.items())])
    own = texts.where(low != "")
    enough = own.groupBy(owner).agg(F.count("*").alias("texts")).where(F.col("texts") >= sample)
    said = own.select(owner, F.col(order).alias("at"), F.explode(labels).alias("l")).select(owner, "at", "l.*").where("quote IS NOT NULL")
    first = F.min_by("quote", F.struct(F.rlike("quote", F.lit(info)), F.col("at")))
    counted = said.join(enough.select(owner), owner).groupBy(owner, "no", "label").agg(F.count("*").alias("count"), first.alias("quote")).where(F.col("count") >= least)
    place = F.row_number().over(Window.partitionBy(owner).orderBy(F.desc("count"), "no"))
    return counted.withColumn("place", place).where(F.col("place") <= top).select(owner, "label", "count", "quote")


def facility_statements(texts: DataFrame, owner: str, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """(owner, label, yes, no): texts that say a facility is there, and texts that say it is not.

    ``rules`` maps a label to its patterns of affirmation and denial; a text counts once, by what it says more often, and
    as a denial at ties.
    """
    t = F.coalesce("text", F.lit(""))
    marks = F.array(*[F.struct(F.lit(label).alias("label"), F.regexp_count(t, F.lit(yes)).alias("y"), F.regexp_count(t, F.lit(no)).alias("n")) for label, (yes, no) in rules.items()])
    said = texts.select(owner, F.explode(marks).alias("m")).select(owner, "m.*").where("y + n > 0")
    return said.groupBy(owner, "label").agg(F.count_if(F.expr("y > n")).alias("yes"), F.count_if(F.expr("y <= n")).alias("no"))


# ---------------------------------------------------------------- order

#: The keys of the order in which texts of a place are shown, the first one first; a missing key makes no difference.
EXPOSURE = ("confident", "own_branch", "same_business", "tier", "not_ad", "not_campaign", "readable", "not_info", "sentence", "depth", "day", "accuracy")


def exposure_order(df: DataFrame, owner: str, keys: dict[str, Column], last: str) -> DataFrame:
    """``df`` with ``place``: the rank of each text of an owner by EXPOSURE, each key's higher values first, nulls last, then ``last``.

    Texts of other places give way before trust does, and trust before style; the newest comes first among equals. An owner may
    have any number of texts: they are numbered range by range.
    """
    unknown = set(keys) - set(EXPOSURE)
    if unknown:
        raise ValueError(f"no such keys: {sorted(unknown)}")
    order = [keys[k].desc_nulls_last() for k in EXPOSURE if k in keys]
    return large_groups.row_numbers(df, [owner], [*order, F.col(last)], "place")


def sentinel(shown: DataFrame, owner: str, top: int = 6, names: int = 3) -> DataFrame:
    """(owner, tier_inversion, other_branches, nameless): owners whose first ``top`` texts look wrong.

    ``shown`` has (owner, place, tier, other_branch, named): a text of lower trust above one of higher trust, two or more
    texts of other branches, or no text that names the owner among ``names`` or more.
    """
    first = shown.where(F.col("place") <= top)
    worst_above = F.min("tier").over(Window.partitionBy(owner).orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    flags = first.withColumn("above", worst_above).groupBy(owner).agg(
        F.bool_or(F.coalesce(F.col("above") < F.col("tier"), F.lit(False))).alias("tier_inversion"), (F.count_if("other_branch") >= 2).alias("other_branches"), ((F.count("*") >= names) & (F.count_if("named") == 0)).alias("nameless")
    )
    return flags.where("tier_inversion OR other_branches OR nameless")
