"""Removal of repeated passages against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import queries, substrings

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, key string, id int, kept boolean"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, True) for i, t in rows], DOCS)


def plain(rows, window=35):
    """(id, n_words, n_removed, kept) by listing every window."""
    split = [(i, (t or "").encode("utf-8", "surrogatepass").split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in split for k in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("id", "n_words", "n_removed", "kept").collect()), key=repr)


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op12_substring_dedup(spark, SF).collect()), key=repr)
    assert got == sorted(((i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in plain(rows)), key=repr)
    assert sum(r[2] for r in got) > 0


@pytest.mark.parametrize(("seed", "tree_rows"), [(1, 10_000), (2, 10_000), (3, 4), (4, 1)])
def test_pasted_passages_of_few_words(spark, seed, tree_rows):
    """Few different words make shared prefixes; passages of every length around the window stand at any place. Small trees
    split the groups."""
    rng = np.random.default_rng(seed)
    passages = [rng.choice(list("abcdefgh"), n).tolist() for n in (11, 12, 13, 20, 40)]
    rows = []
    for i in range(60):
        words = rng.choice(list("abcdefghijklmnop"), int(rng.integers(0, 60))).tolist()
        for p in rng.integers(0, 8, 2):
            if p < 5:
                at = int(rng.integers(0, len(words) + 1))
                words[at:at] = passages[p]
        rows.append((i if i % 9 else None, " \n\t"[i % 3].join(words)))
    got = substrings.remove_repeats(docs(spark, rows).repartition(5), window=12, prefix=3, tree_rows=tree_rows)
    assert found(got) == plain(rows, 12)


def test_hot_passage_in_several_trees(spark):
    """A passage in every text: its groups are dealt to many trees and joined again; its borders differ from text to text."""
    passage = " ".join(f"p{k}" for k in range(50))
    rows = [(i, f"own{i} " * (i % 40) + f"x{i % 7} {passage} y{i % 11} " + " ".join(f"z{i}-{k}" for k in range(40))) for i in range(300)]
    assert found(substrings.remove_repeats(docs(spark, rows), tree_rows=25)) == plain(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(120_000))
    text = " ".join(f"v{k}" for k in range(40))
    rows = [(None, None), (1, ""), (2, " \n"), (3, text), (3, text), (None, text), (4, long), (5, "q " + " ".join(f"w{k}" for k in range(60_000, 60_040)) + " r"), (6, "same " * 34), (6, "same " * 34), (7, "one " * 36), (8, "é" * 400_000)]
    got = found(substrings.remove_repeats(docs(spark, rows)))
    assert got == plain(rows)
    assert [r[2] for r in got if r[1] == 34] == [0, 0] and [r[2] for r in got if r[1] == 36] == [36]
    assert substrings.remove_repeats(docs(spark, [])).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=40), max_size=4))
def test_every_window_has_one_anchor_inside(texts):
    words = np.array([w for t in texts for w in t], dtype=np.uint64)
    pointers = np.cumsum([0] + [len(t) for t in texts])
    owner, place, gram, reach = substrings.anchors(substrings.mix64(words), pointers, 10, 3)
    windows = Counter()
    label = {}
    for i, p, g, r in zip(owner.tolist(), place.tolist(), gram.tolist(), reach.tolist(), strict=True):
        for before in range(r & 255, (r >> 8) + 1):
            start = p - before
            assert start <= p <= start + 10 - 3
            windows[i, start] += 1
            assert label.setdefault(tuple(texts[i][start : start + 10]), (before, g)) == (before, g)
    assert windows == Counter((i, k) for i, t in enumerate(texts) for k in range(len(t) - 9))
