"""Quality rules, source mixing and line dedup: SQL, brute force, odd rows."""

import hashlib
import os
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, mixing, quality_rules, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, id string, line_dedup int, mixing string, n_words int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, "x", 1, "y", 2) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        path = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert [names[i] for i in order] == columns
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=repr)


# ---------------------------------------------------------------- quality rules


def plain_metrics(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


ODD = [None, "", " \n\t", "a", "a b c d e a b c d e", "x\n\nx\nx \n", "été #1 | <b>\x0b\x0cé", "w " * 30_000, "a b c d e f a b c d e f a b c d", "same line here\n" * 50, "\U0001f600 a\x1cb c"]


def test_metrics_equal_brute_force(spark):
    rows = [*enumerate(ODD), (3, ODD[3]), (None, "a b")]
    got = quality_rules.judge(docs(spark, [(i, t, "s") for i, t in rows])).collect()
    assert len(got) == len(rows)
    want = sorted(map(repr, ((i, *plain_metrics(t)) for i, t in rows)))
    assert sorted(repr(tuple(r[c] for c in ("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))) for r in got) == want
    assert not any(r["kept"] for r in got if r["base_failed"])
    assert quality_rules.judge(docs(spark, [])).count() == 0


def test_order_follows_rejections_per_cost_and_never_changes_verdicts(spark):
    rules = {k: quality_rules.Rule(k, F.lit(True)) for k in "abc"}
    m = [quality_rules.Measured(rules["a"], 1.0, 0.5), quality_rules.Measured(rules["b"], 0.1, 0.2), quality_rules.Measured(rules["c"], 0.2, 0.0)]
    assert [x.rule.name for x in quality_rules.by_gain(m)] == ["b", "a", "c"]
    near = [quality_rules.Measured(rules["a"], 1.0, 0.1), quality_rules.Measured(rules["b"], 1.0, 0.2), quality_rules.Measured(rules["c"], 1.0, 0.9)]
    assert [x.rule.name for x in quality_rules.by_gain(near)] == ["c", "a", "b"]  # a and b are a tie and stay as given
    df = quality_rules.metrics_of(spark.createDataFrame([(1, "a!! b"), (2, "fine words here")], "doc_id long, text string"))
    own = quality_rules.text_rules()
    for order in (own, own[::-1]):
        got = [r[0] for r in df.orderBy("text").select(quality_rules.cascade(order).isNull()).collect()]
        assert got == [False, True]
    measured = quality_rules.measure(df, own)
    assert {x.rule.name: x.rejected for x in measured}["exclamations"] == 0.5 and all(x.cost > 0 for x in measured)


def test_dear_rules_come_late_and_selective_ones_early_in_every_run(spark):
    """A planted dear rule, a planted selective one and one without rejections: ten measurements give one order."""
    text, n = F.col("text"), F.col("n_words")
    planted = lambda: [
        quality_rules.Rule("dear", (F.regexp_count(text, F.lit("(a|e|i)[a-z]*[xyz]")) + F.regexp_count(text, F.lit("([a-z]+) [A-Z]"))) > n),
        quality_rules.Rule("never", F.regexp_count(text, F.lit("[A-Z]")) < 0),
        quality_rules.Rule("selective", n % 2 == 0),
        quality_rules.Rule("rare", n % 50 == 0),
    ]
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    orders = [[m.rule.name for m in quality_rules.ordered(d, planted)] for _ in range(10)]
    assert all(o.index("selective") == 0 and o.index("rare") == 1 for o in orders), orders
    cost = {m.rule.name: m.cost for m in quality_rules.ordered(d, planted)}
    assert cost["dear"] > 100 * cost["selective"]


def test_the_sample_is_drawn_by_rows(spark, monkeypatch):
    """Equal ids and rows do not come together: a third of the rows is some third of the sample."""
    rows = [(7, "one two three")] * 2000 + [(i, "other words here and there") for i in range(100, 4100)]
    found = []
    monkeypatch.setattr(quality_rules, "measure", lambda sample, rules: found.extend(r["id"] for r in sample.collect()) or [])
    quality_rules.ordered(spark.createDataFrame(rows, "doc_id long, text string"), list, sample_rows=300)
    assert 200 < len(found) < 400 and 50 < found.count(7) < 150


def test_clean_documents_are_kept(spark):
    d, l = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))  # noqa: E741
    got = quality_rules.judge(d).join(l, F.col("id") == F.col("doc_id")).where("quality = 1 AND NOT base_failed")
    n, kept = got.count(), got.where("kept").count()
    assert kept >= 0.98 * n


# ---------------------------------------------------------------- line dedup


def plain_dedup(rows):
    split = {i: (t or "").split("\n") for i, t in rows}
    key = lambda line: re.sub(r"[A-Z]", lambda m: m[0].lower(), line).strip(" \t\n\x0b\x0c\r")
    holders = defaultdict(set)
    for i, lines in split.items():
        for line in lines:
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    return {i: [x for x in lines if gone.get(key(x), i) == i] for i, lines in split.items()}


def test_lines_equal_brute_force(spark):
    shared = "This LINE stands in many documents"
    rows = [(i, f"own line number {i} of its text\n \t{shared if i % 2 else shared.lower()} \nshort\n") for i in range(9)]
    rows += [(20, None), (21, ""), (22, f"{shared}\n{shared}"), (23, "É" * 25), (24, "é" * 25), (25, "É" * 25), (26, "É" * 25), (27, "z" * 200_000), (28, shared + "\x1c")]
    got = line_dedup.dedup_lines(docs(spark, [(i, t, "s") for i, t in rows])).collect()
    want = plain_dedup(rows)
    assert {r["doc_id"]: r["line_dedup"]["text"] for r in got} == {i: "\n".join(x) for i, x in want.items()}
    for r in got:
        n = len((dict(rows)[r["doc_id"]] or "").split("\n"))
        assert (r["line_dedup"]["n_lines"], r["line_dedup"]["n_dropped"]) == (n, n - len(want[r["doc_id"]]))


def test_line_dedup_of_repeated_and_null_ids_and_nothing(spark):
    line = "one and the same long line of text"
    got = line_dedup.dedup_lines(docs(spark, [(1, line, "s"), (1, line, "s"), (2, line, "s")])).collect()
    assert sorted((r["doc_id"], r["line_dedup"]["text"]) for r in got) == [(1, line), (1, line), (2, line)]
    got = line_dedup.dedup_lines(docs(spark, [(1, line, "s"), (1, f"x\n{line}\n{line}", "s"), (1, line, "s"), (2, f"{line}\ny", "s"), (3, line, "s")])).collect()
    assert sorted((r["doc_id"], r["line_dedup"]["text"], r["line_dedup"]["n_dropped"]) for r in got) == [(1, "", 1), (1, "", 1), (1, "x", 2), (2, "y", 1), (3, line, 0)]
    nulls = line_dedup.dedup_lines(docs(spark, [(None, line, "s"), (None, line, "s"), (5, line, "s")])).collect()
    assert sorted((str(r["doc_id"]), r["line_dedup"]["text"]) for r in nulls) == [("5", line), ("None", ""), ("None", "")]
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_long_texts_of_shared_lines_take_linear_time(spark):
    import time

    lines = [f"boilerplate line number {i} of all texts" for i in range(40_000)]
    texts = [(i, "\n".join(x for k, x in enumerate(lines) if k % 5 or i == 9) + f"\nown {i}") for i in (1, 2, 3, 9)]
    began = time.perf_counter()
    got = {r["doc_id"]: r["line_dedup"] for r in line_dedup.dedup_lines(docs(spark, [(i, t, "s") for i, t in texts])).collect()}
    assert {i: r["text"] for i, r in got.items()} == {1: "own 1", 2: "own 2", 3: "own 3", 9: texts[3][1]} and got[1]["n_dropped"] == 32_000
    assert time.perf_counter() - began < 60


def test_kept_text_digest(spark):
    got = queries.op10_line_dedup(spark, SF).collect()
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = plain_dedup(rows)
    assert {r["doc_id"]: r["kept_sha256"] for r in got} == {i: hashlib.sha256("\n".join(x).encode()).hexdigest() for i, x in want.items()}


# ---------------------------------------------------------------- mixing


def test_raked_weights_meet_the_margins(spark):
    table = mixing.cells(spark.read.parquet(f"{SF}/documents.parquet"))
    raked = mixing.rake(table)
    whole = table.agg(F.sum("tokens")).first()[0]
    for m in mixing.MARGINS:
        want = {r[0]: r[1] for r in mixing.targets(table, m).collect()}
        got = {r[0]: r[1] / whole for r in raked.groupBy(m).agg(F.sum("weight")).collect()}
        assert sum(abs(got[k] - want[k]) for k in want) < (1e-9 if m == mixing.MARGINS[-1] else 0.02)


def test_given_shares_and_sampled_tokens(spark):
    rows = [(i, "word " * 20, "a" if i % 4 else "b") for i in range(4000)]
    half = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "source string, share double")
    got = mixing.mix(docs(spark, rows), shares={"source": half}, keep_share=0.4).where("mixing.sampled").groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in got}
    assert abs(n["a"] - 800) < 120 and abs(n["b"] - 800) < 120


def test_mixing_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, None, None, "x", 1, "y", 2), (None, "", "en", "s", "x", 1, "y", 2), (2, "t " * 50_000, "en", "s", "x", 1, "y", 2), (2, "t", "en", "s", "x", 1, "y", 2)], DOCS)
    got = mixing.mix(rows.withColumnRenamed("mixing", "mix_before")).collect()
    assert len(got) == 4 and all(r["mixing"]["prob"] is not None for r in got)
    assert {r["mixing"]["source"] for r in got} == {"unknown", "s"} and {r["mixing"]["topic"] for r in got} >= {"empty", "long"}
    assert mixing.mix(docs(spark, []).drop("mixing")).count() == 0
