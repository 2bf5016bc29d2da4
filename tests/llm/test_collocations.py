"""Phrase collocations against plain counting."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import collocations, queries

SF = "/root/testdata/sf0.001"
DOCS = "text string, lang string, phrase string, f int, rank string"


def docs(spark, rows):
    return spark.createDataFrame([(t, g, "p", 1, "r") for t, g in rows], DOCS)


def plain(rows, most=4, least=30, top=2000):
    count, total = Counter(), Counter()
    for text, lang in rows:
        text, lang = re.sub("[A-Z]", lambda m: m[0].lower(), text or ""), lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = [w for w in re.split(r"[\x20\x09]", piece) if w]
            total[lang] += len(words)
            for n in range(1, most + 1):
                count.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    cand = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= least}
    longest = Counter()
    for (lang, p), a in cand.items():
        for n in range(2, len(p)):
            for i in range(len(p) - n + 1):
                longest[lang, p[i : i + n]] = max(longest[lang, p[i : i + n]], a)
    out = []
    for (lang, p), a in cand.items():
        if 100 * longest[lang, p] >= 80 * a:
            continue
        score, _, l, r = min((2000000 * a // (count[lang, p[:k]] + count[lang, p[k:]]), k, count[lang, p[:k]], count[lang, p[k:]]) for k in range(1, len(p)))  # noqa: E741
        out.append((lang, -score, -a, " ".join(p).encode(), l, r))
    ranked, place = [], Counter()
    for lang, score, a, p, l, r in sorted(out):  # noqa: E741
        place[lang] += 1
        if place[lang] <= top:
            ranked.append((lang, place[lang], p.decode(), -a, l, r, total[lang], -score))
    return ranked


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_query_equals_plain_counting(spark):
    rows = [(r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found(queries.op13_phrase_collocations(spark, SF)) == plain(rows)


@pytest.mark.parametrize("options", [{}, {"shard_words": 40}, {"filter_bits": 64}])
def test_random_texts_shards_and_filters(spark, options):
    """Small shards merge to the same counts; a filter that is full lets all pass."""
    rng = np.random.default_rng(5)
    vocab = ["a", "B", "c,", "dé", "e.", "f\tg", "h  i", "J"]
    rows = [(" ".join(rng.choice(vocab, int(rng.integers(0, 40)))), [None, "en", "fr"][i % 3]) for i in range(200)]
    got = collocations.collocations(docs(spark, rows).repartition(3), min_count=8, top=50, **options)
    assert found(got) == plain(rows, least=8, top=50)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=9), min_size=1, max_size=5))
def test_intervals_count_every_run(pieces):
    ids = np.array([w for p in pieces for w in p])
    follows = np.array([k < len(p) - 1 for p in pieces for k in range(len(p))])
    room = collocations.room_of(follows, 4)
    order, lcp = collocations.suffix_array(ids, room, 4)
    for n in range(1, 5):
        places, counts = collocations.intervals(order, lcp, room, n)
        got = {tuple(ids[p : p + n].tolist()): c for p, c in zip(places.tolist(), counts.tolist(), strict=True)}
        assert got == dict(Counter(tuple(p[i : i + n]) for p in pieces for i in range(len(p) - n + 1)))


def test_counts_past_64_bits_are_exact(spark, monkeypatch):
    big = 9_000_000_000_000
    counts = [("en", "a b", 2, big), ("en", "a", 1, big + 1), ("en", "b", 1, big + 2), ("en", "", 0, 3 * big)]
    monkeypatch.setattr(collocations, "phrase_counts", lambda *a, **k: spark.createDataFrame(counts, "lang string, phrase string, words int, f long"))
    assert found(collocations.collocations(docs(spark, []))) == [("en", 1, "a b", big, big + 1, big + 2, 3 * big, 2_000_000 * big // (2 * big + 3))]


def test_odd_rows(spark):
    long = "one two " * 200_000  # a single piece, longer than what is split at once
    rows = [(None, "en"), ("", None), (" \t.,", "en"), ("x y" * 40, None), (long, "en"), ("A b. " * 40, "de"), ("A b. " * 40, "de"), ("z, " * 300_000, "fr"), ("a\x1cb c " * 40, "fr")]
    assert found(collocations.collocations(docs(spark, rows))) == plain(rows)
    assert collocations.collocations(docs(spark, [])).count() == 0
    assert collocations.collocations(docs(spark, [(None, None)])).count() == 0
