"""Review classification, grading and synthesis. Dictionaries and thresholds are arguments; defaults are small examples."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx

# ---------------------------------------------------------------- classifier


@dataclass(frozen=True)
class Reject:
    """A hard rule: the first one that holds decides. ``borderline`` ones may be revived by a later decision."""

    name: str
    when: Column
    score: int = 0
    borderline: bool = False


def classify(df: DataFrame, rejects: list[Reject], signals: dict[str, Column]) -> DataFrame:
    """Adds verdict, score, reason and borderline.

    ``signals`` gives Boolean columns title_full, title_part, in_body, visit, area, listicle, combo, passing, sponsored,
    many_tags and the counts substance and length. Hard rules come first, in order; then points are added, clamped to
    0..100 and compared; a combination post is capped at reference.
    """
    s = signals
    flag = lambda name, points: F.when(s[name], points).otherwise(0)
    name = F.when(s["title_full"], 42).when(s["title_part"], 30).when(s["in_body"], 14).otherwise(0)
    substance = F.when(s["substance"] >= 3, 24).when(s["substance"] == 2, 16).when(s["substance"] == 1, 8).otherwise(0)
    size = F.when(s["length"] >= 60, 5).when(s["length"] < 25, -10).otherwise(0)
    points = name + flag("visit", 24) + substance + flag("area", 8) + size + flag("listicle", -22) + flag("combo", -20) + flag("passing", -16) + flag("sponsored", -10) + flag("many_tags", -8)
    hard = F.lit(None).cast("struct<reason:string,score:int,borderline:boolean>")
    for i, r in enumerate(rejects):
        out = F.struct(F.lit(r.name).alias("reason"), F.lit(r.score).alias("score"), F.lit(r.borderline).alias("borderline"))
        hard = F.when(r.when, out) if i == 0 else hard.when(r.when, out)
    staged = df.withColumn("hard", hard).withColumn("points", F.greatest(F.lit(0), F.least(F.lit(100), points)))
    in_title = s["title_full"] | s["title_part"]
    verdict = F.when(F.col("hard").isNotNull(), "rejected").when((F.col("points") >= 60) & in_title & (s["visit"] | (s["substance"] >= 1)), "verified").when((F.col("points") >= 38) & (in_title | s["in_body"]), "reference").otherwise("rejected")
    staged = staged.withColumn("verdict", verdict)
    capped = (F.col("verdict") == "verified") & s["combo"]
    return (
        staged.withColumn("score", F.when(F.col("hard").isNotNull(), F.col("hard.score")).when(capped, F.least(F.col("points"), F.lit(59))).otherwise(F.col("points")))
        .withColumn("verdict", F.when(capped, "reference").otherwise(F.col("verdict")))
        .withColumn("reason", F.coalesce("hard.reason", F.when(F.col("verdict") == "rejected", "low quality")))
        .withColumn("borderline", F.coalesce("hard.borderline", F.lit(False)))
        .drop("hard", "points")
    )


def override(verdict: Column, ad: Column, closure: Column, own_source: Column, borderline: Column, decision: Column, allowed: Column) -> Column:
    """The final verdict: ad, closure and self-promotion reject; hard rejects stand; then decisions, then the allow list."""
    return (
        F.when(ad, "rejected")
        .when((verdict != "rejected") & (closure | own_source), "rejected")
        .when((verdict == "rejected") & ~borderline, "rejected")
        .when(decision.isNotNull(), F.when(~decision, "rejected").when(verdict == "verified", "verified").otherwise("reference"))
        .when(allowed, "verified")
        .otherwise(verdict)
    )


# ---------------------------------------------------------------- collection and grades


def collect(df: DataFrame, owner: str, pos: str, link: Column, text: Column) -> DataFrame:
    """Rows without repeats of a link or of a text key, first in ``pos`` kept.

    A row whose link was seen is dropped before its text counts; both steps are windows on the owner and the key.
    """
    keyed = df.withColumn("__lk", tx.link_key(link)).withColumn("__tk", tx.text_key(text))
    by_link = Window.partitionBy(owner, "__lk").orderBy(pos)
    keyed = keyed.withColumn("__n", F.when(F.col("__lk") != "", F.row_number().over(by_link)).otherwise(1)).where("__n = 1")
    return keyed.withColumn("__n", F.row_number().over(Window.partitionBy(owner, "__tk").orderBy(pos))).where("__n = 1").drop("__lk", "__tk", "__n")


def grades(df: DataFrame, owner: str, pos: str, account: str, verified_at: float = 30, reference_at: int = 3, cap: int = 2, old_months: int = 36) -> DataFrame:
    """(owner, raw, verified, reference, rejected, account_cap, old_half, grade_count, grade).

    Accepted rows count towards the grade: two of an account at most, old ones half, references half again. Columns used:
    verdict, months (age, null: unknown).
    """
    accepted = F.col("verdict") != "rejected"
    turn = F.row_number().over(Window.partitionBy(owner, account, accepted).orderBy(pos))
    capped = accepted & F.col(account).isNotNull() & (F.col("__turn") > cap)
    weight = F.when(F.coalesce(F.col("months") > old_months, F.lit(False)), 0.5).otherwise(1.0) * F.when(F.col("verdict") == "verified", 1.0).otherwise(0.5)
    counted = accepted & ~capped
    out = (
        df.withColumn("__turn", turn)
        .groupBy(owner)
        .agg(
            F.count("*").alias("raw"),
            *[F.count_if(F.col("verdict") == v).alias(v) for v in ("verified", "reference", "rejected")],
            F.count_if(capped).alias("account_cap"),
            F.count_if(counted & F.coalesce(F.col("months") > old_months, F.lit(False))).alias("old_half"),
            F.sum(F.when(counted, weight).otherwise(0.0)).alias("grade_count"),
        )
    )
    return out.withColumn("grade", F.when(F.col("grade_count") >= verified_at, "verified").when(F.col("verified") + F.col("reference") >= reference_at, "reference").otherwise("candidate"))


def recency_points(months: Column) -> Column:
    """60 falling by one a month in the first year, then by 1.6; 8 for unknown dates."""
    return F.when(months.isNull(), 8.0).when(months <= 12, 60 - months).otherwise(F.greatest(F.lit(0.0), 48 - (months - 12) * 1.6))


def evidence_rank(score: Column, trust: Column, months: Column, named: Column) -> Column:
    return F.coalesce(score, F.lit(50)) + F.when(trust == "verified", 20).when(trust == "reference", 0).otherwise(-15) + recency_points(months) + F.when(named, 35).otherwise(0)


def taste_coordinate(strong: Column, weak: Column) -> Column:
    """0.5 moved by 0.09 for each weighted mention more on one side, within 0.05 and 0.95; null under two mentions."""
    up, down = F.least(F.lit(0.95), 0.5 + 0.09 * (strong - weak)), F.greatest(F.lit(0.05), 0.5 - 0.09 * (weak - strong))
    return F.when((strong >= 2) & (strong > weak), up).when((weak >= 2) & (weak > strong), down)


def recency_weight(years: Column) -> Column:
    return F.when(years.isNull(), 0.6).when(years <= 1, 1.0).when(years <= 2, 0.7).when(years <= 3, 0.5).otherwise(0.4)


def axis_coordinates(texts: DataFrame, owner: str, key: str, text: str, years: str, axes: dict[str, tuple[tuple[str, ...], tuple[str, ...]]], denial: str) -> DataFrame:
    """(owner, texts, axis, strong, weak, coordinate) of every owner and axis.

    ``axes`` maps an axis to its strong words and to its weak or ambiguous ones. A text speaks for an axis if a strong word
    stands without a denial near it, against it if one stands with a denial or a weak word occurs; it may do both. Texts
    weigh by their age in ``years``. Texts of an owner that are equal but for blanks and case count once, the newest.
    """
    plain = F.regexp_replace(F.lower(F.trim(F.col(text))), r"\s+", "")
    flags = []
    for name, (strong, weak) in axes.items():
        met = tx.said_and_denied(F.col(text), strong, denial)
        low = F.lower(F.col(text))
        against = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w.lower())) for w in weak], F.lit(False))
        flags.append(F.struct(F.lit(name).alias("axis"), met.alias("met"), against.alias("against")))
    # what a text says is found before equal ones meet, so that no text is shuffled
    own = texts.where(F.length(text) > 0).select(F.col(owner).alias("owner"), F.md5(plain.cast("binary")).alias("print"), F.coalesce(F.col(years).cast("double"), F.lit(1e9)).alias("age"), F.col(key).alias("key"), F.xxhash64(text).alias("tie"), F.array(*flags).alias("flags"))
    once = own.groupBy("owner", "print").agg(F.min_by(F.struct("age", "flags"), F.struct("age", "key", "tie")).alias("t"))
    weight = recency_weight(F.when(F.col("t.age") < 1e9, F.col("t.age")))
    rows = once.select("owner", weight.alias("w"), F.explode("t.flags").alias("f")).select("owner", "w", "f.axis", F.col("f.met.said").alias("said"), (F.col("f.met.denied") | F.col("f.against")).alias("against"))
    sums = rows.groupBy("owner", "axis").agg(F.count("*").alias("texts"), F.sum(F.when(F.col("said"), F.col("w")).otherwise(0.0)).alias("strong"), F.sum(F.when(F.col("against"), F.col("w")).otherwise(0.0)).alias("weak"))
    strong, weak = F.round("strong", 6), F.round("weak", 6)
    return sums.select(F.col("owner").alias(owner), "texts", "axis", strong.alias("strong"), weak.alias("weak"), taste_coordinate(strong, weak).alias("coordinate"))


def highlights(texts: DataFrame, owner: str, labels: dict[str, tuple[tuple[str, ...], int | None]], denial: str, least_texts: int = 6, top: int = 6) -> DataFrame:
    """(owner, label, n, weight, rank): labels that enough texts affirm. ``texts`` has (owner, text, w).

    Needs ``least_texts`` texts and, for labels without an own minimum, three and nine in a hundred of them. One pass: every
    text yields one array of flags, and the labels are conditional counts.
    """
    filled = texts.where(F.coalesce("text", F.lit("")) != "")
    flags = filled.select(owner, "w", *[tx.affirmed(F.col("text"), words, denial).alias(f"h{i}") for i, (words, _) in enumerate(labels.values())])
    sums = flags.groupBy(owner).agg(F.count("*").alias("texts"), *[x for i in range(len(labels)) for x in (F.count_if(F.col(f"h{i}")).alias(f"n{i}"), F.sum(F.when(F.col(f"h{i}"), F.col("w")).otherwise(0.0)).alias(f"w{i}"))])
    common = F.greatest(F.lit(3), F.floor(F.col("texts") * 0.09 + 0.5).cast("int"))
    rows = F.array(*[F.struct(F.lit(label).alias("label"), F.col(f"n{i}").alias("n"), F.col(f"w{i}").alias("weight"), (common if own is None else F.lit(own)).alias("need"), F.lit(i).alias("no")) for i, (label, (_, own)) in enumerate(labels.items())])
    found = sums.where(F.col("texts") >= least_texts).select(owner, F.explode(rows).alias("r")).select(owner, "r.*").where(F.col("n") >= F.col("need"))
    order = Window.partitionBy(owner).orderBy(F.desc("weight"), F.desc("n"), "no")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).drop("need", "no")


def axis_profile(df: DataFrame, axes: list[str], least: int = 8) -> DataFrame:
    """(id, axis, mult, share_at_most, side): rates by axis against the population of rows with at least ``least`` texts.

    side is strong (1.3 times the mean and two mentions; best three) or weak (0.6 times at most; lowest two).
    """
    pairs = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(i).alias("no"), F.col("scores")[a].alias("raw")) for i, a in enumerate(axes)])
    long = df.where(F.col("count") >= least).select("id", "count", F.explode(pairs).alias("p")).select("id", "p.*", F.round(F.col("p.raw") / F.col("count"), 9).alias("rate"))
    values = long.groupBy("axis", "rate").agg(F.count("*").alias("n"))  # ratios of small whole numbers: few values however many rows
    upto, whole = F.sum("n").over(Window.partitionBy("axis").orderBy("rate")), Window.partitionBy("axis")
    spread = values.select("axis", "rate", (upto / F.sum("n").over(whole)).alias("share_at_most"), (F.sum(F.col("rate") * F.col("n")).over(whole) / F.sum("n").over(whole)).alias("mean"))
    long = long.join(spread, ["axis", "rate"])
    mult = F.round(F.when(F.col("mean") > 0, F.col("rate") / F.col("mean")).when(F.col("rate") > 0, 99.0).otherwise(0.0), 6)
    long = long.withColumn("mult", mult)
    strong, weak = (F.col("mult") >= 1.3) & (F.col("raw") >= 2), F.col("mult") <= 0.6
    up = F.row_number().over(Window.partitionBy("id", strong).orderBy(F.desc("mult"), "no"))
    down = F.row_number().over(Window.partitionBy("id", weak).orderBy("mult", "no"))
    side = F.when(strong & (up <= 3), "strong").when(weak & ~strong & (down <= 2), "weak")
    return long.withColumn("side", side).where(F.col("side").isNotNull()).select("id", "axis", "mult", "share_at_most", "side")


def campaign_clusters(df: DataFrame, owner: str, least: int = 5, rate: float = 0.25, template: float = 0.25, personal: float = 0.34, burst: float = 0.5) -> DataFrame:
    """(owner, cluster_day, cluster_n, cluster_rate, personal_rate, template_score, suspect): the densest three days of an owner.

    ``df`` has (owner, id, day, text, personal). The mean overlap of word pairs over all pairs of texts, shared pairs over the
    smaller set, is exact without forming any pair of texts: the texts that hold one word pair are sorted by the size of their
    sets, and each text of size s adds 1/s for every one before it.
    """
    personally = F.sum(F.col("personal").cast("int")).alias("p")
    days = df.where(F.col("day").isNotNull()).groupBy(owner, "day").agg(F.count("*").alias("n"), personally, F.count("personal").alias("known"))
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    three, all_days = Window.partitionBy(owner).orderBy(number).rangeBetween(-1, 1), Window.partitionBy(owner)
    best = days.select(owner, "day", *[F.sum(c).over(three).alias(c) for c in ("n", "p", "known")], F.sum("n").over(all_days).alias("dated"))
    best = best.groupBy(owner).agg(F.max_by(F.struct("day", "n", "p", "known", "dated"), F.struct("n", -number)).alias("b")).select(
        owner, F.col("b.day").alias("cluster_day"), F.col("b.n").alias("cluster_n"), (F.col("b.n") / F.col("b.dated")).alias("cluster_rate"), (F.col("b.p") / F.col("b.known")).alias("personal_rate")
    )
    best = best.where((F.col("cluster_n") >= least) & (F.col("cluster_rate") >= rate))
    members = df.select(owner, "day", "text").join(best.select(owner, "cluster_day"), owner).where(F.abs(F.datediff("day", "cluster_day")) <= 1)
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}\s]", " "), r"\s+"), lambda w: w != "")
    # word pairs as 64-bit hashes. Words and pairs are bound in lambdas, and the generator is an outer one, for which no filter
    # on its input is inferred: so no rewrite of the plan computes them a second time.
    once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    pairs = lambda ws: F.array_distinct(F.transform(F.when(F.size(ws) > 1, F.sequence(F.lit(1), F.size(ws) - 1)), lambda i: F.xxhash64(F.get(ws, i - 1), F.get(ws, i))))
    sized = once(once(words, pairs), lambda g: F.transform(g, lambda x: F.struct(F.size(g).alias("size"), x.alias("g"))))
    grams = members.select(owner, F.explode_outer(sized).alias("p")).where("p IS NOT NULL").select(owner, "p.size", "p.g")
    # one spilling sort: counting pairs in the tasks that read the texts would hold all pairs of a task in memory
    larger = F.row_number().over(Window.partitionBy(owner, "g").orderBy(F.desc("size"))) - 1
    shared = grams.select(owner, (larger / F.col("size")).alias("added")).groupBy(owner).agg(F.sum("added").alias("shared"))
    out = best.join(shared, owner, "left")
    score = F.coalesce("shared", F.lit(0.0)) / (F.col("cluster_n") * (F.col("cluster_n") - 1) / 2)
    suspect = (F.col("personal_rate") < personal) & ((F.col("template_score") >= template) | (F.col("cluster_rate") >= burst))
    return out.withColumn("template_score", score).withColumn("suspect", suspect).select(owner, "cluster_day", "cluster_n", "cluster_rate", "personal_rate", "template_score", "suspect")


def ad_template(text: Column, personal: str, endings: str, signals: list[str]) -> Column:
    """An information card instead of a review: long enough, nothing personal, under two sentence ends, two signals or more."""
    hits = F.when(F.regexp_count(text, F.lit("#")) >= 3, 1).otherwise(0)
    for s in signals:
        hits = hits + F.rlike(text, F.lit(s)).cast("int")
    return F.coalesce((F.char_length(text) >= 20) & ~F.rlike(text, F.lit(personal)) & (F.regexp_count(text, F.lit(endings)) < 2) & (hits >= 2), F.lit(False))


def mention_shares(df: DataFrame, owner: str, patterns: dict[str, str], least: int = 8) -> DataFrame:
    """(owner, n, one share for each pattern): share of texts that match; 0 under the minimum sample."""
    shares = [F.avg(F.rlike("text", F.lit(p)).cast("double")).alias(name) for name, p in patterns.items()]
    out = df.where(F.coalesce("text", F.lit("")) != "").groupBy(owner).agg(F.count("*").alias("n"), *shares)
    return out.select(owner, "n", *[F.when(F.col("n") >= least, F.round(name, 6)).otherwise(0.0).alias(name) for name in patterns])


def reputation(df: DataFrame, owner: str, bad: str, good: str, as_of: Column) -> DataFrame:
    """(owner, texts, neg, pos, dated, recent, note): divided opinions, or hardly anything within the last year."""
    recent = F.datediff(as_of, "day") < 365
    out = df.groupBy(owner).agg(
        F.count("*").alias("texts"),
        F.count_if(F.rlike("text", F.lit(bad))).alias("neg"),
        F.count_if(F.rlike("text", F.lit(good))).alias("pos"),
        F.count("day").alias("dated"),
        F.count_if(recent).alias("recent"),
    )
    divided = (F.col("neg") >= 3) & (F.col("neg") >= 0.15 * F.col("texts")) & (F.col("neg") >= 0.5 * F.col("pos"))
    stale = (F.col("dated") >= 5) & (F.col("recent") < 5) & (F.col("recent") < 0.15 * F.col("dated"))
    return out.withColumn("note", F.when(divided, "divided").when(stale, "stale"))


def reviewer_stats(df: DataFrame, account: Column, owner: str) -> DataFrame:
    """(account, owner, accepted, rejected, first_day, last_day) of each reviewer and place."""
    ok = F.col("verdict") != "rejected"
    return df.withColumn("account", account).where(F.col("account") != "").groupBy("account", owner).agg(
        F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"), F.min("day").alias("first_day"), F.max("day").alias("last_day")
    )


def mine_terms(df: DataFrame, pattern: str, known: DataFrame, owner: str = "source", least: int = 3) -> DataFrame:
    """(term, n, owners): terms by pattern found in at least ``least`` texts and not known yet."""
    found = df.select(owner, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0)))).alias("term"))
    counted = found.groupBy("term").agg(F.count("*").alias("n"), F.count_distinct(owner).alias("owners")).where(F.col("n") >= least)
    return counted.join(known.select("term"), "term", "left_anti")


# ---------------------------------------------------------------- lifecycle


def pipeline_state(held: Column, excluded: Column, grade: Column, rejected_rate: Column, count: Column) -> Column:
    """Status of an entity: exclusion first, then holds, then noise, then publication by grade."""
    return F.when(excluded, "excluded").when(held, "held").when((count == 0) & (rejected_rate >= 0.9), "rejected").when(rejected_rate >= 0.8, "noise").when(grade.isin("verified", "reference"), "live").otherwise("pending")


def exact_duplicates(df: DataFrame, cells: float = 2000.0) -> DataFrame:
    """(id, keep): rows of one normalised name in one cell of 1/2000 degree give way to the one with the most reviews, then the smallest id."""
    key = [tx.normal_name(F.col("name")), F.floor(F.col("lat") * cells + 0.5), F.floor(F.col("lng") * cells + 0.5)]
    best = F.max(F.struct(F.col("count").alias("c"), (-F.col("id")).alias("i")))
    groups = df.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(key)]).agg(best.alias("b"), F.count("*").alias("n")).where("n > 1").select("k0", "k1", "k2", (-F.col("b.i")).alias("keep"))
    keyed = df.select("id", *[k.alias(f"k{i}") for i, k in enumerate(key)])
    return keyed.join(groups, ["k0", "k1", "k2"]).where("id <> keep").select("id", "keep")
