"""Mixing where cells hold less than their targets: a hot source, tiny cells, given shares, copies."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing

KEEP = 0.5


@pytest.fixture(scope="module")
def given(spark):
    """Source hot holds most; cold and tiny want more of their German cells than these hold."""
    kinds = [("hot", "en", 3000), ("hot", "de", 30), ("cold", "en", 300), ("cold", "de", 5), ("tiny", "en", 20), ("tiny", "de", 60)]
    rows = [(f"{s}-{g}-{i}", "word " * 20, g, s) for s, g, n in kinds for i in range(n)]
    return spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")


def goals(shares, held, whole):
    """Plain water-filling of targets into what groups hold."""
    out, left = {}, dict(shares)
    while left:
        rest = whole - sum(out.values())
        factor = rest / sum(left.values())
        over = {k for k, v in left.items() if factor * v > held[k]}
        if not over:
            return out | {k: factor * v for k, v in left.items()}
        out |= {k: held[k] for k in over}
        left = {k: v for k, v in left.items() if k not in over}
    return out


@pytest.mark.parametrize("shares", [None, {"hot": 0.9, "cold": 0.06, "tiny": 0.04}, {"hot": 0.3, "cold": 0.3, "tiny": 0.4}])
def test_bounded_mixture_loses_no_mass(spark, given, shares):
    table = None if shares is None else {"source": spark.createDataFrame(list(shares.items()), "source string, share double")}
    rows = mixing.mix(given, shares=table, keep_share=KEEP).select("mixing.*").collect()
    assert all(0 < r["prob"] <= 1 and r["copies"] == r["sampled"] for r in rows)
    assert sum(r["prob"] for r in rows) == pytest.approx(KEEP * len(rows), rel=1e-6)
    for m in ("source", "lang"):
        n, got = Counter(r[m] for r in rows), Counter()
        for r in rows:
            got[r[m]] += r["prob"]
        target = shares if shares and m == "source" else {k: v**mixing.FLATTEN for k, v in n.items()}
        want = goals(target, n, KEEP * len(rows))
        assert all(got[k] == pytest.approx(want[k], rel=0.01) for k in want), (m, got, want)


def test_rounds_stop_at_the_residual_and_a_given_topic_counts(spark, given):
    table = mixing.cells(given, topic=F.substring("doc_id", -1, 1))
    assert {r["topic"] for r in table.collect()} == set("0123456789")
    fit = mixing.bounded_rake(mixing.staged(table, "test-cells"), KEEP)
    assert mixing.residual(fit) <= mixing.TOLERANCE
    rows = mixing.mix(given, keep_share=KEEP, topic=F.substring("doc_id", -1, 1)).select("mixing.*").collect()
    assert {r["topic"] for r in rows} == set("0123456789") and sum(r["prob"] for r in rows) == pytest.approx(KEEP * len(rows), rel=1e-6)
    assert mixing.bounded_rake(mixing.staged(table, "test-cells"), KEEP, rounds=1).count() == table.count()


def test_copies_meet_the_targets_of_the_plain_fit(spark, given):
    rows = mixing.mix(given, keep_share=KEEP, bounded=False).select("mixing.*").collect()
    assert max(r["copies"] for r in rows) > 1 and all(r["sampled"] == (r["copies"] > 0) and r["prob"] <= 1 for r in rows)
    n, got = Counter(r["source"] for r in rows), Counter()
    for r in rows:
        got[r["source"]] += r["copies"]
    whole = sum(v**mixing.FLATTEN for v in n.values())
    for k, v in n.items():
        assert got[k] == pytest.approx(KEEP * len(rows) * v**mixing.FLATTEN / whole, rel=0.1)


def test_groups_without_target_give_nothing(spark, given):
    only = spark.createDataFrame([("hot", 0.5), ("cold", 0.5)], "source string, share double")
    got = mixing.mix(given, shares={"source": only}, keep_share=KEEP).groupBy("mixing.source").agg(F.sum("mixing.prob").alias("p")).collect()
    by = {r["source"]: r["p"] for r in got}
    assert by["tiny"] == 0 and by["cold"] == pytest.approx(305) and by["hot"] == pytest.approx(KEEP * 3415 - 305, rel=1e-6)
