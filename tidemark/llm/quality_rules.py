"""Rule-based quality filter as a short-circuit cascade, with DataFrame functions only.

Every rule is a Boolean expression over a text and its metrics. Its rejection rate comes from a bounded sample, its cost from
timing jobs on it that are long enough for the clock; the rules then run in the order of rejections per cost, each one only on
rows that no earlier rule rejected.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLANK_CLASS, bound, discard, staged, words

#: Rows, about, of the sample on which costs and selectivities are measured.
SAMPLE_ROWS = 300
#: Seconds of a timing job, how many count, rows of one at most, the share of an idle job that is noise, and the ratio of gains
#: from which on one rule is better than another.
JOB_SECONDS, RUNS, MOST_ROWS, NOISE, MARGIN = 0.2, 3, 8_000_000, 0.2, 3.0
#: Rows of the jobs that tell what repeating rows takes.
IDLE_ROWS = 2_000_000
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``reject`` is true for rows that the rule rejects; null counts as not rejected."""

    name: str
    reject: Column


@dataclass(frozen=True)
class Measured:
    rule: Rule
    cost: float
    rejected: float

    @property
    def gain(self) -> float:
        """Expected rejections per second of work; half a rejection more than the sample has, as none seen is not none."""
        return (self.rejected + 0.5 / SAMPLE_ROWS) / self.cost


def _seconds(sample: DataFrame, column: Column, repeats: int) -> float:
    """Wall seconds of one job that evaluates a condition on every row of the sample, ``repeats`` times each."""
    rows = sample.withColumn("__again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    began = time.perf_counter()
    rows.agg(F.count_if(column & (F.col("__again") > 0))).collect()
    return time.perf_counter() - began


def idle_cost(sample: DataFrame, rows: int) -> tuple[float, float]:
    """(seconds of a job, seconds a row) of jobs that only repeat rows."""
    some, many = 1, max(2, IDLE_ROWS // rows)
    few = median(_seconds(sample, F.lit(True), some) for _ in range(RUNS))
    lot = median(_seconds(sample, F.lit(True), many) for _ in range(RUNS))
    return few, max(lot - few, 1e-4) / (rows * many)


def cost_of(sample: DataFrame, rows: int, column: Column, idle: tuple[float, float]) -> float:
    """Seconds that a condition takes a row: rows are repeated until a job takes ``JOB_SECONDS``; the median of ``RUNS`` such jobs
    less what they would take without the condition. What is lost in the noise of that counts as a share of it."""
    repeats = 1
    while (seconds := _seconds(sample, column, repeats)) < JOB_SECONDS + idle[0] and rows * repeats < MOST_ROWS:
        repeats = min(max(2 * repeats, int(1.3 * repeats * JOB_SECONDS / max(seconds - idle[0], 1e-3))), 64 * repeats, MOST_ROWS // rows + 1)
    work = median([seconds, *(_seconds(sample, column, repeats) for _ in range(RUNS - 1))])
    empty = idle[0] + idle[1] * rows * repeats
    return max(work - empty, NOISE * empty) / (rows * repeats)


def measure(sample: DataFrame, rules: list[Rule]) -> list[Measured]:
    """Cost (seconds a row) and rejection rate of each rule on the sample. The rates come from one job."""
    if not rules:
        return []
    got = sample.agg(F.count("*"), *[F.count_if(r.reject) for r in rules]).first()
    rows = max(1, got[0])
    idle = idle_cost(sample, rows)
    return [Measured(rule, cost_of(sample, rows, rule.reject, idle), n / rows) for rule, n in zip(rules, got[1:], strict=True)]


def by_gain(measured: list[Measured]) -> list[Measured]:
    """Most rejections per cost first. Rules whose gains are within ``MARGIN`` of the best of them are a tie and keep the order
    in which they were given, so that what a clock cannot tell apart does not change the order."""
    out: list[Measured] = []
    rest = list(measured)
    while rest:
        best = max(m.gain for m in rest)
        tie = [m for m in rest if m.gain * MARGIN >= best]
        out += tie
        rest = [m for m in rest if m not in tie]
    return out


def ordered(docs: DataFrame, rules: Callable[[], list[Rule]], id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Measured]:
    """The rules of ``metrics_of`` rows in the order in which they should run; the order never changes a verdict.

    About ``sample_rows`` rows are drawn, each by itself, so equal ids do not come together; they are written with their
    metrics and the rules are timed on that table, so no text reaches the driver.
    """
    n = docs.count()
    rate = int(min(1.0, sample_rows / max(1, n)) * 1_000_000)
    # the row's number only serves the draw; the table that is written holds what was drawn
    drawn = docs.withColumn("__row", F.monotonically_increasing_id()).where(F.pmod(F.xxhash64(F.lit(17), F.col(id_col), F.length(text_col), F.col("__row")), F.lit(1_000_000)) < rate)
    sample = staged(metrics_of(drawn, id_col, text_col), "rules-sample")
    measured = by_gain(measure(sample, rules()))
    discard(sample)
    return measured


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule, in the given order, that rejects a row; null if none does. Later rules are not evaluated."""
    if not rules:
        return F.lit(None).cast("string")
    out = None
    for rule in rules:
        out = F.when(rule.reject, F.lit(rule.name)) if out is None else out.when(rule.reject, F.lit(rule.name))
    return out


def text_rules() -> list[Rule]:
    """Default rules over ``metrics_of`` rows, with whole-number comparisons: what the metrics hold is not counted again."""
    text, n_words = F.col("text"), F.col("n_words")
    return [
        Rule("symbols", 10 * F.col("n_symbols") > n_words),
        Rule("shouting", 10 * F.regexp_count(text, F.lit("[A-Z]")) > 4 * F.regexp_count(text, F.lit("[A-Za-z]"))),
        Rule("exclamations", 10 * F.regexp_count(text, F.lit("!")) > 2 * n_words),
        Rule("word_length", F.col("word_chars") > 20 * n_words),
        Rule("repeated_lines", 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
    ]


def _repeated_words(w: Column) -> Column:
    """Words covered by windows that occur twice or more: windows are hashed and sorted with their places, equal neighbours marked."""
    window = F.transform(
        F.when(F.size(w) >= WINDOW, F.sequence(F.lit(0), F.size(w) - WINDOW)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]).alias("h"), i.alias("i")),
    )

    def places(s: Column) -> Column:
        same = lambda x, i, k: F.coalesce(F.get(s, i + k)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["i"]))

    covered = F.aggregate(
        bound(F.sort_array(window), places),
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("n")),
        lambda acc: acc["n"].cast("long"),
    )
    return covered


def metrics_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (lines with a word) of every whole
    text; null text counts as empty.

    Time is n log n and memory linear in a text, also where a later filter makes Spark compute a metric twice.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]")))
    counts = bound(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated_words(w).alias("n_repeat_words")))
    shared = bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    cells = F.struct(counts.alias("c"), shared.alias("l"), F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", "text", cells.alias("m")).select("id", "text", "m.c.n_words", "m.c.word_chars", "m.n_symbols", "m.l.n_dup_lines", "m.c.n_repeat_words", "m.l.n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """id, base metrics, base_failed, rejected_by and kept of every document.

    ``rejected_by`` is ``base`` or the first rule of the measured order that fired; which rule is named may depend on the
    order, ``kept`` does not. The base comes first: its counts are part of the result, so it costs nothing more. Null and
    blank texts have no words and fail the base. Repeated rows are judged each.
    """
    rules = [Rule("base", base_failed()), *[m.rule for m in ordered(docs, text_rules, id_col, text_col, sample_rows)]]
    columns = [F.col(c) for c in ("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return metrics_of(docs, id_col, text_col).select(*columns, base_failed().alias("base_failed"), cascade(rules).alias("rejected_by")).withColumn("kept", F.col("rejected_by").isNull())


__all__ = ["BLANK_CLASS", "Measured", "Rule", "base_failed", "cascade", "judge", "measure", "metrics_of", "ordered", "text_rules"]
