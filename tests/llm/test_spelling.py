"""Spelling variants against all pairs."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import queries, spelling

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, word string, n string, form int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "w", "n", 1) for i, t in rows], DOCS)


def plain_words(rows, min_letters=6, min_count=5, slip=199):
    count = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slip and h % slip == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= min_letters and n >= min_count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(words, times=5):
    form, near = {}, {}
    for w, n in words.items():
        own = [v for v in words if one_edit(w, v)]
        near[w] = len(own)
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, near[w], words[form[w]] if form[w] else None))
    return out


def found(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_equals_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found(queries.op11_spelling_variants(spark, SF)) == plain_variants(plain_words(rows))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abé", min_size=1, max_size=9))
def test_keys_are_equal_where_deletions_are(word):
    own, cut, first = spelling.deletion_keys(word)
    texts = [word[:i] + word[i + 1 :] for i in range(len(word))]
    keys = list(zip(*(c.tolist() for c in cut), strict=True))
    assert len(set(keys)) == len(set(texts)) == int(first.sum())
    for k, t in zip(keys, texts, strict=True):
        assert (tuple(spelling.deletion_keys(t)[0]) if t else (0, 0)) == k
    assert len(own) == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_random_words_of_few_letters(spark, seed):
    rng = np.random.default_rng(seed)
    words = {"".join(rng.choice(list("abÿ"), rng.integers(1, 6))): int(rng.integers(1, 400)) for _ in range(120)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert found(spelling.variants(df, times=2)) == plain_variants(words, times=2)


def test_chains_ties_and_alphabets(spark):
    words = {"colour": 1, "colours": 5, "coloursx": 25, "coloursxy": 125, "coloursxyz": 625}  # each leads to the next
    words |= {"tiea": 10, "tieb": 10, "tie": 2}  # ties: the smaller word
    words |= {f"m{chr(97 + i)}n": 3 + i for i in range(26)}  # one letter differs: a whole alphabet under one key
    words |= {"aab": 9, "aba": 9, "ab": 1}  # a moved letter is two edits
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = found(spelling.variants(df))
    assert got == plain_variants(words)
    by = {r[0]: r for r in got}
    assert by["colour"][2] == "coloursxyz" and by["tie"][1] == "tiea"


def test_odd_rows(spark):
    long = "x" * 60_000
    rows = [(None, None), (None, "Repeat REPEAT repeat rePeat repeat"), (1, ""), (2, "repeat÷ répeat " * 6), (3, f"{long} " * 5), (3, f"{long}y " * 30), (4, "straße STRASSE " * 9)]
    got = found(spelling.spelling_variants(docs(spark, [*rows, rows[3]])))
    assert got == plain_variants(plain_words([*rows, rows[3]]))
    assert spelling.spelling_variants(docs(spark, [])).count() == 0
