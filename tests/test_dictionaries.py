"""Dictionaries as tables, similar names and places in texts against plain loops."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import dictionary, matching, names, similar_names


@pytest.mark.parametrize("slice_chars", [1 << 20, 40])
def test_hits_equal_searching_each_term(spark, slice_chars):
    rng = np.random.default_rng(2)
    terms = ["".join(rng.choice(list("abé"), rng.integers(1, 5))) for _ in range(60)] + ["", None, "aba", "aba", "naïve x"]
    texts = [(i, "".join(rng.choice(list("abé "), 50))) for i in range(80)] + [(80, None), (81, ""), (82, "a naïve xx"), (83, "aba" * 5_000)]
    t = spark.createDataFrame([(x,) for x in terms], "term string")
    df = spark.createDataFrame(texts, "id long, body string").repartition(3)
    known = {x for x in terms if x}
    want = {(i, x, m.start(), len(x)) for i, s in texts for x in known for m in re.finditer(f"(?={x})", s or "")}
    got = [tuple(r) for r in dictionary.term_hits(df, "id", "body", t, slice_chars, distinct=False).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    first = {}
    for i, x, at, _ in sorted(want):
        first.setdefault((i, x), at)
    assert {(r["id"], r["term"]): r["start"] for r in dictionary.term_hits(df, "id", "body", t, slice_chars).collect()} == first
    assert dictionary.term_hits(df, "id", "body", t.where("term = 'q'")).count() == 0


def test_thousands_of_terms_and_rules(spark):
    terms = [f"term{i:05d}x" for i in range(20_000)]
    rules = spark.createDataFrame([(i, "s", f"r{i}", x, ("reject", "hold", "cap")[i % 3], i % 50) for i, x in enumerate(terms)], "no int, stage string, rule string, term string, action string, points int")
    texts = [(1, f"a {terms[700]} b {terms[30]}", "verified", 60), (2, f"{terms[19_001]}", "verified", 60), (3, f"{terms[5]} {terms[4]}", "verified", 10), (4, "none", "verified", 60), (5, None, "reference", 1)]
    got = dictionary.apply_term_rules(spark.createDataFrame(texts, "id long, body string, verdict string, score int"), "id", "body", rules).drop("body").collect()
    assert {r["id"]: (r["verdict"], r["score"], r["rule"], r["borderline"]) for r in got} == {
        1: ("rejected", 30, "r30", False), 2: ("reference" if 19_001 % 3 == 2 else "rejected", 1, "r19001", 19_001 % 3 == 1), 3: ("rejected", 4, "r4", True), 4: ("verified", 60, None, False), 5: ("reference", 1, None, False),
    }


def test_rivals_of_chains_and_own_names(spark):
    names_ = [(1, "Blue Bolt"), (2, "blue-bolt"), (3, "Ring"), (4, "Tin"), *[(10 + i, "Chain Shop") for i in range(9)]]
    texts = [(100, 1, "We like BLUE bolt, and ring"), (101, 3, "ring ring"), (102, 3, "chain shop and tin"), (103, 9, None)]
    got = matching.rivals_in_text(spark.createDataFrame(texts, "id long, place long, text string"), spark.createDataFrame(names_, "id long, name string"))
    assert sorted(map(tuple, got.collect())) == [(100, 3)]


# ---------------------------------------------------------------- names


@pytest.mark.parametrize("least", [0.3, 0.5, 0.6, 2 / 3, 0.8, 1.0])
def test_similar_sets_equal_all_pairs(spark, least):
    rng = np.random.default_rng(7)
    sets = [(i, sorted({int(x) for x in rng.zipf(1.4, int(rng.integers(0, 9))) % 12})) for i in range(150)]
    got = similar_names.similar_sets(spark.createDataFrame(sets, "id long, items array<long>"), "id", "items", least).collect()
    want = {}
    for (i, x), (j, y) in itertools.combinations(sets, 2):
        shared, either = len(set(x) & set(y)), len(set(x) | set(y))
        if either and shared and shared / either >= least:
            want[i, j] = (shared, shared / either)
    assert {(r["a"], r["b"]): (r["shared"], r["similarity"]) for r in got} == want and len(got) == len(want)


def test_equal_names_are_one_class(spark):
    """A third of all rows share a name: it is matched once."""
    rows = [(i, "The  Harbour Cafe") for i in range(400)] + [(400 + i, f"Harbour {i % 50}") for i in range(800)] + [(2000, "x"), (2001, None), (2002, "ha rb")]
    members, links = similar_names.near_duplicate_names(spark.createDataFrame(rows, "id long, name string"), "id", "name", [], "(cafe|the)")
    plain = {i: re.sub("(cafe|the)", "", re.sub(r"\s+", "", (n or "").lower())) for i, n in rows}
    assert {r["id"]: r["plain"] for r in members.collect()} == plain
    distinct = sorted({p for p in plain.values() if len(p) >= 4})
    assert sorted(map(tuple, links.collect())) == sorted((a, b) for a in distinct for b in distinct if a != b and a in b)


def one(spark, f, row, schema):
    return spark.createDataFrame([row], schema).select(f.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("Harbour", "Harbour Eaststore", True), ("Teagarden", "Gardentea", False), ("Bean 24", "Tea 24", False), ("Lantern", "The lantern(LANTERN)", True), ("ab", "ab cd", True), ("ab", "xab yz", True), ("Mall", "Mall south", True), ("cafe coffee", "cafe coffee best", True), ("", "Harbour", False)],
)
def test_brands_share_words_and_not_parts_of_them(spark, a, b, same):
    words = lambda c: names.distinctive_words(F.col(c), F.array().cast("array<string>"), ("cafe", "coffee", "best"), "(cafe|store)$", "store$")
    assert one(spark, similar_names.brand_overlap(F.col("a"), words("a"), F.col("b"), words("b"), F.lit(False)), (a, b), "a string, b string") is same


def test_tenants_of_one_building_need_the_whole_name(spark):
    f = similar_names.brand_overlap(F.col("a"), F.split("a", " "), F.col("b"), F.split("b", " "), F.lit(True))
    assert one(spark, f, ("tower north", "tower south"), "a string, b string") is False
    assert one(spark, f, ("tower north", "tower north gate"), "a string, b string") is True


@pytest.mark.parametrize(("a", "b", "same"), [("Harbour Eaststore", "harboureaststore", True), ("harbour", "lantern", False), ("Kaffee Nord", "Cafe Nord", True), ("bay", "baynorth", False), ("north", "northbay", True), ("a", "a", False)])
def test_spellings_of_one_name(spark, a, b, same):
    plain = lambda c: similar_names.stripped(F.col(c), [("kaffee", "cafe")], "(cafe|store)")
    assert one(spark, similar_names.near_duplicate(plain("a"), plain("b")), (a, b), "a string, b string") is same


# ---------------------------------------------------------------- places


def test_longest_names_and_their_parents(spark):
    rows = [("p1", "east", 1, None), ("p2", "west", 1, None), ("d1", "mid town", 2, "p1"), ("d2", "mid town", 2, "p2"), ("d3", "town", 2, "p1"), ("v1", "mid town harbour", 3, "d2"), ("v2", "quay", 3, "d3"), ("v3", "quay", 3, "d1")]
    g = spark.createDataFrame(rows, "region string, name string, level int, parent string")
    texts = {1: "east, mid town", 2: "west mid town", 3: "mid town", 4: "town square", 5: "the mid town harbour", 6: "towns", 7: "quay of town", 8: "east quay", 9: None, 10: "west and east", 11: "midtown"}
    got = dictionary.resolve_places(spark.createDataFrame(list(texts.items()), "id long, text string"), "id", "text", g).collect()
    assert {r["id"]: (r["region"], r["level"]) for r in got} == {1: ("d1", 2), 2: ("d2", 2), 4: ("d3", 2), 5: ("v1", 3), 7: ("v2", 3), 8: ("p1", 1), 10: ("p2", 1)}


def test_a_gazetteer_of_thousands(spark):
    rows = [(f"p{i}", f"province {i}", 1, None) for i in range(50)] + [(f"d{i}", f"district {i}", 2, f"p{i % 50}") for i in range(4000)] + [(f"v{i}", f"village {i % 900}", 3, f"d{i}") for i in range(3600)]
    g = spark.createDataFrame(rows, "region string, name string, level int, parent string")
    texts = [(i, f"district {i} village {i % 900}" if i % 2 else f"province {i % 50}, village {i % 900}") for i in range(0, 3600, 7)]
    got = {r["id"]: r["region"] for r in dictionary.resolve_places(spark.createDataFrame(texts, "id long, text string"), "id", "text", g, slice_chars=20_000).collect()}
    assert got == {i: f"v{i}" if i % 2 else f"p{i % 50}" for i, _ in texts}


@pytest.mark.parametrize(
    ("name", "words", "venue_only", "left_out"),
    [
        ("달빛나루COFFEE", ["달빛나루"], False, False),  # scripts are parted, the trade word goes
        ("별내24", ["별내"], False, False),  # a number counts only where nothing else does
        ("24 카페", ["24"], False, False),
        ("모닝빈 가온점", ["모닝빈"], False, False),  # the branch word does not count
        ("가온점", ["가온"], False, False),  # but is all there is
        ("하늘숲", ["하늘숲"], True, False),
        ("리버빈 하늘숲", ["리버빈"], False, True),
        ("한솔 카페, 마중", ["마중"], False, False),  # area and trade words go, marks at the end too
        ("", [], False, False),
        (None, [], False, False),
    ],
)
def test_word_signals_of_names(spark, name, words, venue_only, left_out):
    s = names.word_signals(F.col("n"), F.array(F.lit("한솔")), ("카페", "coffee"), "(점|카페|coffee)$", "점$", "숲$", ("[가-힣]", "[a-z0-9]"))
    got = one(spark, s, (name,), "n string")
    assert (got["words"], got["venue_only"], got["venue_left_out"]) == (words, venue_only, left_out)
