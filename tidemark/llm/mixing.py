"""Mixing sources to target weights: iterative proportional fitting on token counts, with DataFrame functions only.

Documents are summed into cells (source, language, topic) with map-side combination; raking works on the cell table
alone, whose size is the number of distinct combinations and not of documents. Each pass scales the cells to the source,
then the language, then the topic marginal with one window each.

A cell cannot give more tokens than it holds. ``rake`` knows no such bound: a draw at ``least(1, .)`` loses the mass over
one. ``bounded_rake`` has the bound in the fit: weight = least(bound, tokens times a factor of each group), and each step
finds the group's factor at which its bounded weights meet the target, so other cells of the group take the excess.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, staged, words

#: Most rounds of raking, and the residual at which it stops: the largest difference of a group from its goal, as a share of
#: the corpus. It is looked at after every CHECK_ROUNDS.
ROUNDS = 40
TOLERANCE = 1e-7
CHECK_ROUNDS = 4
#: Cells up to which the cell table is one partition, whose windows need no shuffle; a larger one is shuffled by group.
ONE_PARTITION = 100_000
MARGINS = ("source", "lang", "topic")
#: Target shares by margin are natural shares raised to this power and normalised: small groups gain.
FLATTEN = 0.7
#: Share of the corpus tokens that the mixture keeps.
KEEP_SHARE = 0.5
SALT = "mix-1"


def topic_of(text: Column) -> Column:
    """A coarse topic by the form of the whole text: table, list of short lines, long prose or short prose."""
    n_lines = F.regexp_count(text, F.lit("\n")) + 1
    return (
        F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "empty")
        .when(F.instr(text, " | ") > 0, "table")
        .when(F.length(text) < 80 * n_lines, "lines")
        .when(F.length(text) >= 3000, "long")
        .otherwise("short")
    )


def cells(docs: DataFrame, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None) -> DataFrame:
    """(source, lang, topic, tokens, docs). Null source or language counts as the group ``unknown``; a text has one token at least."""
    return (
        docs.select(
            F.coalesce(F.col(source_col).cast("string"), F.lit("unknown")).alias("source"),
            F.coalesce(F.col(lang_col).cast("string"), F.lit("unknown")).alias("lang"),
            (topic_of(F.col(text_col)) if topic is None else topic).alias("topic"),
            F.greatest(F.size(words(F.col(text_col))), F.lit(1)).cast("long").alias("tokens"),
        )
        .groupBy(*MARGINS)
        .agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    )


def targets(cell_table: DataFrame, margin: str, power: float = FLATTEN) -> DataFrame:
    """(margin, share): natural token shares to a power, normalised."""
    sums = cell_table.groupBy(margin).agg(F.sum("tokens").alias("t"))
    raised = sums.select(margin, F.pow(F.col("t").cast("double"), F.lit(power)).alias("p"))
    total = raised.agg(F.sum("p").alias("whole"))
    return raised.crossJoin(F.broadcast(total)).select(margin, (F.col("p") / F.col("whole")).alias("share"))


def rake(cell_table: DataFrame, shares: dict[str, DataFrame] | None = None, rounds: int = 12, margins: tuple[str, ...] = MARGINS) -> DataFrame:
    """Cells with ``weight``: fitted token weights that sum to about the corpus and meet the margins in turn.

    ``shares`` maps a margin to a table (margin, share); a margin that it lacks gets ``targets``. Groups without a target
    get weight zero. Lineage is cut every four rounds.
    """
    shares = shares or {}
    total = cell_table.agg(F.sum("tokens").cast("double").alias("corpus"))
    out = cell_table.crossJoin(F.broadcast(total)).withColumn("weight", F.col("tokens").cast("double"))
    for m in margins:
        out = out.join(shares.get(m, targets(cell_table, m)).withColumnRenamed("share", f"share_{m}"), m, "left")
    out = staged(out.fillna(0.0, [f"share_{m}" for m in margins]), "mix-cells")
    for i in range(rounds):
        for m in margins:
            have = F.sum("weight").over(Window.partitionBy(m))
            out = out.withColumn("weight", F.when(have > 0, F.col("weight") * F.col(f"share_{m}") * F.col("corpus") / have).otherwise(0.0))
        if i % 4 == 3 and i + 1 < rounds:
            out = staged(out, "mix-rake")
    return out


def _filled(df: DataFrame, group: str, bound: str, value: str, goal: str) -> DataFrame:
    """``df`` with ``value`` scaled in each ``group`` so that the sum of least(``bound``, ``value``) is ``goal``.

    ``goal`` is a column that is constant in the group and at most the sum of bounds. Rows are met in the order in which
    they reach their bound; rows without bound get zero.
    """
    whole, so_far = Window.partitionBy(group), Window.partitionBy(group).orderBy("__at")
    out = df.withColumn("__at", F.when((F.col(bound) > 0) & (F.col(value) > 0), F.col(bound) / F.col(value)))
    live = F.col("__at").isNotNull()
    out = out.withColumn("__u", F.sum(F.when(live, F.col(bound)).otherwise(0.0)).over(so_far)).withColumn("__v", F.sum(F.when(live, F.col(value)).otherwise(0.0)).over(so_far))
    reached = F.col("__u") + F.col("__at") * (F.sum(F.when(live, F.col(value)).otherwise(0.0)).over(whole) - F.col("__v"))
    out = out.withColumn("__full", live & (reached <= F.col(goal)))
    rest = F.col(goal) - F.coalesce(F.sum(F.when(F.col("__full"), F.col(bound))).over(whole), F.lit(0.0))
    free = F.sum(F.when(live & ~F.col("__full"), F.col(value))).over(whole)
    least = F.max(F.when(F.col("__full"), F.col("__at"))).over(whole)
    out = out.withColumn("__factor", F.greatest(F.when(free > 0, rest / free), least))
    return out.withColumn(value, F.when(live, F.col(value) * F.col("__factor")).otherwise(0.0)).drop("__at", "__u", "__v", "__full", "__factor")


def feasible(raked: DataFrame, margin: str, bound: str = "bound") -> DataFrame:
    """(margin, goal): tokens that each group of a margin is to give. A target over what the group holds is cut to that and
    the rest goes to the other groups in proportion to their targets, so that the sum stays as far as all hold so much."""
    groups = raked.groupBy(margin).agg(F.sum(bound).alias("held"), (F.first(f"share_{margin}") * F.first("corpus")).alias("goal"))
    totals = groups.agg(F.least(F.sum("goal"), F.sum(F.when(F.col("goal") > 0, F.col("held")).otherwise(0.0))).alias("sum"))
    one = groups.crossJoin(F.broadcast(totals)).withColumn("all", F.lit(1))
    return _filled(one, "all", "held", "goal", "sum").select(margin, F.least("held", "goal").alias(f"goal_{margin}"))


def residual(raked: DataFrame, margins: tuple[str, ...] = MARGINS) -> float:
    """The largest difference between what a group gives and its goal, as a share of the corpus."""
    worst = [raked.groupBy(m).agg((F.abs(F.sum(F.least("bound", "free")) - F.first(f"goal_{m}")) / F.first("corpus")).alias("off")).agg(F.max("off").alias("off")) for m in margins]
    rows = worst[0]
    for other in worst[1:]:
        rows = rows.unionByName(other)
    return rows.agg(F.coalesce(F.max("off"), F.lit(0.0)).alias("off")).first()["off"]


def bounded_rake(
    cell_table: DataFrame, keep_share: float, shares: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, margins: tuple[str, ...] = MARGINS, tolerance: float = TOLERANCE
) -> DataFrame:
    """As ``rake``, with no weight over tokens / ``keep_share``: every inclusion probability is one at most and no mass is lost.

    Where a group holds less than its target at this share, all of it is kept and the other groups share the rest
    (``feasible``). Rounds stop once ``residual`` is within ``tolerance``, or after ``rounds`` where the cells cannot meet all
    goals together; the last margin is met exactly in any case.
    """
    shares = shares or {}
    total = cell_table.agg(F.sum("tokens").cast("double").alias("corpus"))
    out = cell_table.crossJoin(F.broadcast(total))  # one row
    for m in margins:
        out = out.join(shares.get(m, targets(cell_table, m)).withColumnRenamed("share", f"share_{m}"), m, "left")
    out = out.fillna(0.0, [f"share_{m}" for m in margins])
    wanted = F.least(*[F.col(f"share_{m}") for m in margins], F.lit(1.0)) > 0
    tokens = F.when(wanted, F.col("tokens").cast("double")).otherwise(0.0)
    out = staged(out.withColumn("bound", tokens / F.lit(keep_share)).withColumn("free", tokens), "mix-cells")
    small = out.count() <= ONE_PARTITION
    near = lambda df: df.coalesce(1) if small else df
    for m in margins:
        out = out.join(staged(feasible(near(out), m), "mix-goals"), m)
    out = staged(out, "mix-bounds")
    for done in range(0, rounds, CHECK_ROUNDS):
        before, now = out, near(out)
        for _ in range(min(CHECK_ROUNDS, rounds - done)):
            for m in margins:
                now = _filled(now, m, "bound", "free", f"goal_{m}")
        out = staged(now, "mix-rake")
        discard(before)
        if residual(near(out), margins) <= tolerance:
            break
    return out.withColumn("weight", F.least("bound", "free"))


def probabilities(raked: DataFrame, keep_share: float = KEEP_SHARE) -> DataFrame:
    """(source, lang, topic, prob, times): inclusion probability of each document of a cell, at most one, and how often the
    fit wants the document, which is over one where a cell holds less than its weight."""
    times = F.lit(keep_share) * F.col("weight") / F.col("tokens")
    return raked.select(*MARGINS, F.least(F.lit(1.0), times).alias("prob"), times.alias("times"))


def draw(doc_id: Column, salt: str = SALT) -> Column:
    """A uniform number in [0, 1) from the id and a salt: the first 48 bits of an MD5, the same on every run and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    shares: dict[str, DataFrame] | None = None,
    keep_share: float = KEEP_SHARE,
    rounds: int | None = None,
    out: str = "mixing",
    bounded: bool = True,
    topic: Column | None = None,
) -> DataFrame:
    """``docs`` with a struct column ``out`` (source, lang, topic, prob, sampled, copies); filter on its ``sampled`` for the sample.

    With ``bounded`` each document is wanted once at most (``bounded_rake``) and ``copies`` is 0 or 1. Without it weights
    follow ``rake``: ``copies`` is the whole part of what the fit wants and a draw for the rest, so repeating each document
    so often meets the targets; ``sampled`` alone, once each, loses what cells want over one.
    ``topic`` is the topic of a document, a column of strings, where there is one; else the form of the text stands for it
    (``topic_of``). Null groups are ``unknown``, empty texts form a topic of their own, rows with the same id are drawn alike, and an
    empty table gives an empty result. Cell probabilities are a written table: the optimizer broadcasts them only where
    their measured size is under the session's threshold. An input column named as ``out`` is replaced.
    """
    docs = docs.drop(out)
    topic = topic_of(F.col(text_col)) if topic is None else F.coalesce(topic.cast("string"), F.lit("unknown"))
    table = staged(cells(docs, text_col, source_col, lang_col, topic), "mix-sums")
    limit = {} if rounds is None else {"rounds": rounds}
    raked = bounded_rake(table, keep_share, shares, **limit) if bounded else rake(table, shares, **limit)
    prob = staged(probabilities(raked, keep_share), "mix-prob").select(*[F.col(m).alias(f"__cell_{m}") for m in MARGINS], F.col("prob").alias("__cell_prob"), F.col("times").alias("__cell_times"))
    group = F.struct(
        F.coalesce(F.col(source_col).cast("string"), F.lit("unknown")).alias("source"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("unknown")).alias("lang"),
        topic.alias("topic"),
    )
    keyed = docs.select(*[F.col(c) for c in docs.columns], group.alias("__cell"))
    joined = keyed.join(prob, [F.col(f"__cell.{m}") == F.col(f"__cell_{m}") for m in MARGINS], "left")
    whole = F.floor("__cell_times")
    copies = whole + (draw(F.col(id_col)) < F.col("__cell_times") - whole).cast("long")
    verdict = F.struct("__cell.*", F.col("__cell_prob").alias("prob"), (draw(F.col(id_col)) < F.col("__cell_prob")).alias("sampled"), copies.alias("copies"))
    return joined.select(*[F.col(c) for c in docs.columns], verdict.alias(out))
