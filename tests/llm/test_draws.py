"""Training samples stay bounded when one id or one row is very frequent."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_id, quality_classifier, toxicity
from tidemark.llm.common import drawn_texts


def test_equal_rows_count_once_and_texts_of_one_id_are_drawn_each(spark):
    rows = [(7, "the same text")] * 2000 + [(8, f"text number {i}") for i in range(2000)] + [(100 + i, f"other {i}") for i in range(2000)] + [(None, "x"), (9, None)]
    got = drawn_texts(spark.createDataFrame(rows, "id long, text string"), 400, 10**9, 3).collect()
    assert 300 < len(got) < 520 and len(set(got)) == len(got)
    assert sum(r["id"] == 7 for r in got) <= 1 and 140 < sum(r["id"] == 8 for r in got) < 270
    few = drawn_texts(spark.createDataFrame(rows, "id long, text string"), 10**6, 1_000, 3).collect()
    assert sum(len(r["text"] or "") for r in few) < 2_500


@pytest.mark.parametrize("equal", [True, False])
def test_a_hot_labelled_id_leaves_the_driver_bounded(spark, monkeypatch, equal):
    hot = [(5, "bad awful words here" if equal else f"bad awful words here number {i}") for i in range(3000)]
    docs = spark.createDataFrame(hot + [(10 + i, f"plain text with number {i} and more") for i in range(1000)], "doc_id long, text string")
    labels = spark.createDataFrame([(5, 1, 1), *[(10 + i, i % 2, 0) for i in range(300)]], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "POSITIVES", 200)
    monkeypatch.setattr(toxicity, "UNLABELLED", 300)
    seen = []
    monkeypatch.setattr(toxicity, "mean_model", lambda p, u, prior, real=toxicity.mean_model: seen.append((len(p), u.count())) or real(p, u, prior))
    every = lambda i: F.lit(True)
    assert toxicity.score_toxicity(docs, labels, every).count() == 4000
    assert (seen[0][0] == 1 if equal else 120 < seen[0][0] < 300) and seen[0][1] < 420
    rows, known = quality_classifier.training_rows(docs, labels, "quality", every, "doc_id", "text", 200)
    assert len(rows) == len(known) < 300 and (not equal or len(rows) > 120)


def test_the_mean_of_several_models(spark):
    """More unlabelled texts give more models; what half of them have counts with the mean weight."""
    words = [f"word{i}" for i in range(40)]
    texts = [(i, " ".join(words[(i * k) % 40] for k in range(1, 9)) + (" awful" if i % 10 == 0 else "")) for i in range(900)]
    positive = toxicity._rows(toxicity.with_features(spark.createDataFrame([(0, f"awful {words[i % 40]}") for i in range(60)], "deal long, text string")).toArrow().column("features"))
    df = spark.createDataFrame([(i % 3, t) for i, t in texts], "deal long, text string")
    got = toxicity.mean_model(positive, df, 0.1)
    each = [toxicity.fit(positive, toxicity._rows(toxicity.with_features(df.where(F.col("deal") == d)).toArrow().column("features")), 0.1) for d in range(3)]
    weight = {}
    for m in each:
        for k, w in zip(m.keys.tolist(), m.weights.tolist(), strict=True):
            weight.setdefault(k, []).append(w)
    want = {k: sum(w) / 3 for k, w in weight.items() if 2 * len(w) >= 3}
    assert got.keys.tolist() == sorted(want) and got.weights.tolist() == pytest.approx([want[k] for k in sorted(want)])
    assert got.offset == pytest.approx(sum(m.offset for m in each) / 3)
    bad, fine = got.score(["so awful", "word1 word2"])
    assert bad > fine
    assert toxicity.mean_model(positive, df.where("deal > 9"), 0.1).offset == pytest.approx(toxicity.fit(positive, [], 0.1).offset)


def test_language_models_count_and_measure_every_document(spark, monkeypatch):
    """The models are those of all n-grams; every document is measured with its spans, by models that have not seen it."""
    words = {"aa": ("alpha", "beta", "gamma"), "zz": ("kilo", "lima", "mike")}
    rows = [(i, " ".join(words[lang][(i * k) % 3] for k in range(1, 9)) + f" {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{lang}", lang) for i in range(2500) for lang in words]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    monkeypatch.setattr(language_id, "GATHERED", 200)
    seen = []
    monkeypatch.setattr(language_id, "calibrate", lambda models, held, real=language_id.calibrate: seen.append(held) or real(models, held))
    got = language_id.learn_models(docs, lambda i: i % 4 != 2)
    want = language_id.build({lang: language_id.count_ngrams([t for i, t, of in rows if of == lang and i % 4 != 2]) for lang in words})
    for n in range(1, language_id.ORDER + 1):
        assert (got.keys[n] == want.keys[n]).all() and (got.logp[n] == want.logp[n]).all()
    learnt = [(lang, len(s)) for i, t, lang in rows if i % 4 != 2 for s in language_id.spans(t)]
    assert seen[0].count() == len(learnt) and seen[0].where("won").count() > 0.9 * len(learnt)
    assert got.spread.shape == (2, 2) and got.tail[0] < 10


def test_spans_are_measured_as_texts(spark):
    m = language_id.build({"a": language_id.count_ngrams(["abba abc cab", "bab"]), "b": language_id.count_ngrams(["cc dd cd", "dcd"])})
    texts = ["abba", "12", "dcd", "x", "cab dd"]
    for (ce, n), (want, size) in zip(m.cross_entropies(texts), filter(None, map(m.cross_entropy, texts)), strict=True):
        assert n == size and ce.tolist() == pytest.approx(want.tolist(), rel=1e-5)
