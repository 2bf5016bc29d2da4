"""Search: query tokens, lexical and vector scores, rank fusion, place lookup, fallbacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import geo, vectors

#: Weights of the fields in the lexical score, grade bonus, fusion constant and similarity floor.
FIELD_WEIGHTS = {"name": 4.0, "identity": 2.5, "signature": 2.0, "note": 2.0, "vibe": 2.0, "uses": 1.5, "beans": 1.5, "area": 1.0}
REVIEW_WEIGHT = 2.0
GRADE_BONUS = {"verified": 25, "reference": 8}
RRF_K = 20
SEMANTIC_FLOOR = 0.75


def tokens(query: Column, stop: tuple[str, ...] = (), particles: tuple[str, ...] = ()) -> Column:
    """Distinct tokens of a query in order: stop words go, one-character particles are cut from tokens of four or more characters."""
    words = F.filter(F.split(F.lower(F.trim(query)), r"[\s,./?!]+"), lambda w: (w != "") & ~w.isin(*stop) if stop else w != "")
    if particles:
        words = F.transform(words, lambda w: F.when((F.char_length(w) >= 4) & F.right(w, F.lit(1)).isin(*particles), F.substring(w, F.lit(1), F.char_length(w) - 1)).otherwise(w))
    return F.array_distinct(words)


def occurrences(text: Column, token: str) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return ((F.char_length(low) - F.char_length(F.replace(low, F.lit(token.lower()), F.lit("")))) / len(token)).cast("int")


def lexical(df: DataFrame, query_tokens: list[str], fields: dict[str, float], review: str) -> DataFrame:
    """Adds exact, review_only: weighted occurrences in the fields and the reviews; matches in reviews alone count half."""
    core = reduce(Column.__add__, [occurrences(F.col(f), t) * w for t in query_tokens for f, w in fields.items()])
    own = reduce(Column.__add__, [occurrences(F.col(review), t) * REVIEW_WEIGHT for t in query_tokens])
    only = (core == 0) & (own > 0)
    return df.withColumn("review_only", only).withColumn("exact", F.when(only, own * 0.5).otherwise(core + own))


def top_similar(df: DataFrame, query: list[float], vector: str, key: str, n: int) -> DataFrame:
    """The n rows of highest cosine similarity to a vector, ties to the smaller key; a partial top-n in each task."""
    sim = vectors.cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    return df.withColumn("sim", F.round(sim, 9)).orderBy(F.desc("sim"), key).limit(n)


def fuse(candidates: DataFrame, key: str, axis: str | None = None, core: Column | None = None) -> DataFrame:
    """Reciprocal-rank fusion of a bounded candidate list (sim, exact, concept, review_only, grade): adds ``score``.

    Unmatched rows take rank 2n in the lexical list; rows that match neither words nor the similarity floor go. Ranks start
    at 0. The ranks are global, so give this the candidates of one query.
    """
    points = F.col("exact") + F.col("concept")
    rank = lambda c: F.row_number().over(Window.orderBy(c.desc(), key)) - 1
    n = F.count("*").over(Window.partitionBy())
    parts = [rank(F.col("sim")), F.when(points > 0, rank(points)).otherwise(2 * n)]
    if axis is not None:
        parts.append(rank(F.col(axis)))
    total = reduce(Column.__add__, [1.0 / (RRF_K + p) for p in parts]) / (len(parts) / RRF_K) * 100
    ok = ((F.col("exact") > 0) & ~F.col("review_only")) | (F.col("concept") > 0)
    bonus = F.when(ok, F.when(F.col("grade") == "verified", GRADE_BONUS["verified"]).when(F.col("grade") == "reference", GRADE_BONUS["reference"]).otherwise(0)).otherwise(0)
    prior = F.when(core, 6).otherwise(0) if core is not None else F.lit(0)
    return candidates.withColumn("score", total + bonus + prior).where(ok | (F.col("sim") >= SEMANTIC_FLOOR))


def first_of(key: str, *lists: DataFrame) -> DataFrame:
    """Union of candidate lists in order; a key keeps its place in the first list that has it."""
    tagged = [df.withColumn("list_no", F.lit(i)) for i, df in enumerate(lists)]
    both = reduce(lambda a, b: a.unionByName(b), tagged)
    return both.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy("list_no"))).where("__rn = 1").drop("__rn")


def place_lookup(df: DataFrame, name: str, kind_order: dict[str, int], limit: int = 8) -> DataFrame:
    """Places by name: exact before prefix before contains, then kind, then length and id."""
    low, q = F.lower("name"), name.lower()
    how = F.when(low == q, 0).when(low.startswith(q), 1).when(low.contains(q), 2)
    kind = F.lit(len(kind_order))
    for k, v in kind_order.items():
        kind = F.when(F.col("kind") == k, v).otherwise(kind)
    return df.withColumn("how", how).where("how IS NOT NULL").withColumn("kind_no", kind).orderBy("how", "kind_no", F.char_length("name"), "id").limit(limit)


def spread_names(df: DataFrame, cells: float = 20.0, clusters: int = 3) -> DataFrame:
    """(name, clusters): names found in at least ``clusters`` cells of 1/cells degree, so a bare name is ambiguous."""
    cell = F.struct(F.floor(F.col("lat") * cells), F.floor(F.col("lng") * cells))
    return df.groupBy(F.lower("name").alias("name")).agg(F.count_distinct(cell).alias("clusters")).where(F.col("clusters") >= clusters)


def region_index(df: DataFrame) -> DataFrame:
    """(dong, area, n, others): the area that a district name belongs to most, and how many others share the name."""
    counts = df.groupBy("dong", "area").agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", F.col("area").alias("a")))
    return counts.groupBy("dong").agg(best.alias("b"), (F.count("*") - 1).alias("others")).select("dong", F.col("b.a").alias("area"), "b.n", "others")


def name_boost(df: DataFrame, query: str) -> Column:
    """Points for a name: 9999 for equality after normalisation, 500 for a prefix, 100 for containment."""
    key = F.lower(F.regexp_replace("name", r"[^\p{L}\p{N}]", ""))
    q = "".join(c for c in query.lower() if c.isalnum())
    return F.when(key == q, 9999).when(key.startswith(q), 500).when(key.contains(q), 100).otherwise(0)


def collapsed(found: DataFrame, name: str, order: list[str], metres: float, at: tuple[str, str] = ("lat", "lng")) -> DataFrame:
    """``found`` without places near one of the same name that comes before them in ``order`` and stays itself.

    A name's matches are gone through in order as one array: this is for the matches of a search, not for a whole table.
    """
    columns = [*order, *[c for c in found.columns if c not in (*order, name)]]
    sorted_ = F.sort_array(F.collect_list(F.struct(*columns))).alias("__rows")
    groups = found.groupBy(name).agg(sorted_)
    row = groups.schema["__rows"].dataType.simpleString()

    def step(kept: Column, x: Column) -> Column:
        near = F.exists(kept, lambda k: geo.planar_m2(k[at[0]], k[at[1]], x[at[0]], x[at[1]]) < metres * metres)
        return F.when(near, kept).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate("__rows", F.array().cast(row), step)
    return groups.select(name, F.explode(kept).alias("r")).select(name, "r.*")


def filled(stages: list[tuple[DataFrame, list[Column]]], key: str, cap: int) -> DataFrame:
    """(key, stage, rank) of at most ``cap`` rows: the first stage's in its order, then what later ones add.

    Each stage gives its first ``cap`` rows at most, so the rest of the work is small however much a stage matches.
    """
    parts = []
    for i, (df, order) in enumerate(stages):
        head = df.orderBy(*order).limit(cap)
        parts.append(head.select(key, F.lit(i).alias("stage"), F.row_number().over(Window.orderBy(*order)).alias("rank")))
    first = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.min(F.struct("stage", "rank")).alias("k"))
    return first.orderBy("k", key).limit(cap).select(key, "k.*")


def with_bonuses(terms: Column, concept: Column, facets: list[Column], concept_points: int = 6, facet_points: int = 14, most: int = 28) -> Column:
    """A lexical score with its bonuses: once for the concept of a search, and for each of its facets, up to ``most``."""
    met = sum((f.cast("int") for f in facets), F.lit(0))
    return terms + F.when(concept, concept_points).otherwise(0) + F.least(F.lit(most), met * facet_points)
