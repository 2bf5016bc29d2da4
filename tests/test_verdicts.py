"""Verdicts in answers, decisions, and owners behind shared links."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import audits


def test_answers_in_lists_alone_and_cut_off(spark):
    ok = '{"i":%d,"about":true,"helpful":true}'
    answers = [
        (1, f"Sure: [{ok % 0}, {ok % 1}] done"),
        (2, ok % 0),
        (3, f'[{ok % 0}, {{"i":1,"about":false,"helpful":true,"depth":2.5}}, {{"i":2,"about":true,"hel'),
        (4, "no verdict"),
        (5, None),
        (6, f'[{ok % 0}, {{"i":0,"about":false}}, {{"about":true}}, {{broken}}]'),
        (7, '[{"i":0,"about":true,"helpful":true,"listicle":true,"adStyle":true,"depth":1}, {"i":1,"about":true}]'),
    ]
    items = spark.createDataFrame([(b, i, f"{b}-{i}") for b in range(1, 9) for i in range(3)], "batch long, i int, key string")
    decided = audits.decisions(items, spark.createDataFrame(answers, "batch long, answer string"), "batch", "answer")
    got = {r["key"]: r["decision"] for r in decided.collect()}
    assert len(got) == 24 and {k: v for k, v in got.items() if v is not None} == {"1-0": True, "1-1": True, "2-0": True, "3-0": True, "3-1": False, "6-0": False, "7-0": False, "7-1": False}
    sums = {r["batch"]: tuple(r)[1:] for r in audits.decision_summary(decided, "batch").collect()}
    assert sums[3] == (2, 1, 1, 0, 0, 2.5) and sums[7] == (2, 1, 0, 1, 1, 1.0) and sums[8] == (0, 3, 0, 0, 0, None)


def test_strangers_equal_all_pairs(spark):
    rng = np.random.default_rng(6)
    rows = [(f"l{int(rng.integers(0, 30))}" if i % 3 else "hot", i, sorted({f"w{int(x)}" for x in rng.integers(0, 200 if i % 3 else 4000, 3)})) for i in range(500)]
    rows += [(None, 900, ["w1"]), ("alone", 901, ["w1"]), ("twice", 902, []), ("twice", 903, ["w2"]), ("l1", 1, ["w1"])]
    got = audits.strangers(spark.createDataFrame(rows, "link string, owner long, words array<string>"), "link", "owner", F.col("words"))
    words = {}
    for link, owner, w in rows:
        words.setdefault((link, owner), set()).update(w)
    want = set()
    for link in {r[0] for r in rows if r[0]}:
        own = {o: w for (x, o), w in words.items() if x == link}
        akin = {o for a, b in itertools.permutations(own, 2) if own[a] & own[b] for o in (a, b)}
        want |= {(link, o) for o in own if len(own) > 1 and o not in akin}
    assert {tuple(r) for r in got.collect()} == want and want
