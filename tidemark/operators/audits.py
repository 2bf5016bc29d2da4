"""Audits and healers: what to hold, release, clear or look at again, and how far that may go in one run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_within_cap(df: DataFrame, key: str, rules: dict[str, Column], cap: int) -> DataFrame:
    """(key, rule) of rows that each rule would hold; a rule that would hold more than ``cap`` rows holds none.

    A row is held by the first rule, in order, that holds it; the guard counts all rows of a rule. The counts are one row
    for each rule.
    """
    hits = F.filter(F.array(*[F.when(bad, F.struct(F.lit(i).alias("no"), F.lit(name).alias("rule"))) for i, (name, bad) in enumerate(rules.items())]), lambda x: x.isNotNull())
    found = df.select(key, F.explode(hits).alias("h")).select(key, "h.*")
    within = found.groupBy("rule").agg(F.count("*").alias("n")).where(F.col("n") <= cap).select("rule")
    return found.join(within, "rule").groupBy(key).agg(F.min_by("rule", "no").alias("rule"))


def evidence_state(rows: DataFrame, checks: DataFrame, key: str, none_left: str, cap: int) -> DataFrame:
    """(key, change): rows to hold, whose check says that no evidence is left, and held rows to release, whose check is good.

    ``rows`` has (key, held, qualified), ``checks`` (key, grounded, issue). Only qualified rows are released. Above ``cap``
    rows nothing is held.
    """
    j = rows.join(checks, key)
    hold = j.where(~F.col("held") & ~F.col("grounded") & F.rlike("issue", F.lit(none_left))).select(key, F.lit("hold").alias("change"))
    allowed = hold.agg((F.count("*") <= cap).alias("allowed"))
    release = j.where(F.col("held") & F.col("grounded") & F.col("qualified")).select(key, F.lit("release").alias("change"))
    return hold.crossJoin(F.broadcast(allowed)).where("allowed").drop("allowed").unionByName(release)  # one row


def audited(df: DataFrame, key: str, seen: str, bad: Column, most: int, cap: int) -> DataFrame:
    """(key, bad) of the ``most`` rows that were looked at longest ago, up to the one with which ``cap`` bad ones are found."""
    oldest = df.orderBy(F.col(seen).asc_nulls_first(), key).limit(most).select(key, F.col(seen).alias("__seen"), bad.alias("bad"))
    before = F.sum(F.col("bad").cast("int")).over(Window.orderBy(F.col("__seen").asc_nulls_first(), key).rowsBetween(Window.unboundedPreceding, -1))
    return oldest.withColumn("__n", F.coalesce(before, F.lit(0))).where(F.col("__n") < cap).select(key, "bad")


def link_owner(rows: DataFrame, link: str, owner: str, hit: Column, name: str, score: str) -> DataFrame:
    """(link, owner, keeps): of owners that share a link, the one keeps it whose name the text holds, then the longer name,
    the higher score and the smaller owner; links of one owner are left out."""
    each = rows.where(F.col(link).isNotNull()).groupBy(link, owner).agg(F.max(F.struct(hit.alias("hit"), F.char_length(name).alias("n"), F.col(score).alias("score"))).alias("b"))
    best = each.groupBy(link).agg(F.max(F.struct("b.hit", "b.n", "b.score", (-F.col(owner)).alias("o"))).alias("w"), F.count("*").alias("owners")).where("owners > 1")
    return each.join(best, link).select(link, owner, (F.col(owner) == -F.col("w.o")).alias("keeps"))


def strangers(rows: DataFrame, link: str, owner: str, words: Column) -> DataFrame:
    """(link, owner) of owners that share a link with others but no distinctive word of a name with any of them.

    ``words`` is an array for each row. Owners are counted by link and word, so a link of very many owners makes no pairs.
    """
    known = rows.where(F.col(link).isNotNull()).select(link, owner, words.alias("__words")).distinct()
    groups = known.groupBy(link).agg(F.count_distinct(owner).alias("n")).where("n > 1").select(link)
    members = known.join(groups, link)
    flat = members.select(link, owner, F.explode("__words").alias("word")).distinct()
    shared = flat.groupBy(link, "word").agg(F.count("*").alias("n")).where("n > 1").select(link, "word")
    akin = flat.join(shared, [link, "word"]).select(link, owner).distinct()
    return members.select(link, owner).distinct().join(akin, [link, owner], "left_anti")


VERDICT = "struct<i:int,about:boolean,helpful:boolean,listicle:boolean,adStyle:boolean,depth:double>"


def verdicts_in(answer: Column) -> Column:
    """The verdicts that an answer holds, as an array: whole objects in order, whether in a list, alone or in a list that is cut off."""
    each = F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\{[^{}]*\}"), F.lit(0)), lambda t: F.from_json(t, VERDICT))
    return F.filter(each, lambda v: v["i"].isNotNull())


def decisions(items: DataFrame, answers: DataFrame, batch: str, answer: str) -> DataFrame:
    """``items`` (batch, i, ...) with decision, depth, ad and listicle from the answer of their batch.

    An item counts if its text is about the place and helpful and no mere list. Items without a verdict stay undecided (null),
    so that the rules' own verdict holds. Of several verdicts of an item the last counts.
    """
    flat = answers.select(batch, F.posexplode(verdicts_in(F.col(answer))).alias("no", "v")).groupBy(batch, F.col("v.i").alias("i")).agg(F.max_by("v", "no").alias("v"))
    fine = F.coalesce(F.col("v.about"), F.lit(False)) & F.coalesce(F.col("v.helpful"), F.lit(False)) & ~F.coalesce(F.col("v.listicle"), F.lit(False))
    out = items.join(flat, [batch, "i"], "left")
    return out.select(*items.columns, F.when(F.col("v").isNotNull(), fine).alias("decision"), F.col("v.depth").alias("depth"), F.col("v.adStyle").alias("ad"), F.col("v.listicle").alias("listicle"))


def decision_summary(decided: DataFrame, batch: str) -> DataFrame:
    """(batch, answered, unanswered, kept, ads, lists, depth) of decided items."""
    answered = F.col("decision").isNotNull()
    return decided.groupBy(batch).agg(
        F.count_if(answered).alias("answered"), F.count_if(~answered).alias("unanswered"), F.count_if("decision").alias("kept"), F.count_if("ad").alias("ads"), F.count_if("listicle").alias("lists"), F.avg("depth").alias("depth")
    )


def to_recheck(current: DataFrame, history: list[DataFrame], key: str, changed: str, passes: Column) -> DataFrame:
    """(key, decided) of excluded rows, decided before the latest change of any policy, that pass now.

    ``current`` has (key, excluded, decided); ``history`` are tables with a moment ``changed``.
    """
    latest = history[0].select(changed)
    for h in history[1:]:
        latest = latest.unionByName(h.select(changed))
    latest = latest.agg(F.max(changed).alias("latest"))
    return current.crossJoin(F.broadcast(latest)).where(F.col("excluded") & (F.col("decided") < F.col("latest")) & passes).select(key, "decided")  # one row


def parsed_verdicts(df: DataFrame, key: str, answer: str) -> DataFrame:
    """(key, about, related): verdicts from JSON text, tolerant of what stands around it; what cannot be read is undecided (null)."""
    body = F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)(\{.*\})", 1)
    got = F.from_json(body, "about string, related boolean", {"mode": "PERMISSIVE"})
    return df.select(key, F.lower(got["about"]).alias("about"), got["related"].alias("related"))


def gaps(texts: DataFrame, owner: str, word: str, known: tuple[str, ...], least: int) -> DataFrame:
    """(word, owners, texts): words by the pattern ``word``, not yet ``known``, that texts of ``least`` owners or more hold."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(word), F.lit(1)))
    found = texts.select(owner, F.explode(words).alias("word")).where(~F.col("word").isin(*known))
    each = found.groupBy("word", owner).agg(F.count("*").alias("n"))
    return each.groupBy("word").agg(F.count("*").alias("owners"), F.sum("n").alias("texts")).where(F.col("owners") >= least)


def fingerprint(entries: DataFrame, *columns: str) -> DataFrame:
    """(rules, fingerprint) of a table of dictionary entries: one digest that any change of an entry changes, order aside.

    Entries are digested each and summed as numbers, so that no task holds them all.
    """
    number = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).cast("binary")), 1, 12), 16, 10).cast("decimal(20,0)")
    return entries.agg(F.count("*").alias("rules"), F.md5(F.concat_ws("|", F.count("*"), F.sum(number)).cast("binary")).alias("fingerprint"))


def list_changes(before: DataFrame, after: DataFrame, page: str, member: str) -> DataFrame:
    """(page, member, change) of members that pages gained or lost; both states are rows of page and member, repeats do not matter."""
    old, new = (d.select(page, F.col(member).alias("member")).distinct() for d in (before, after))
    gone = old.join(new, [page, "member"], "left_anti").withColumn("change", F.lit("lost"))
    return gone.unionByName(new.join(old, [page, "member"], "left_anti").withColumn("change", F.lit("gained")))


def encoded(scores: Column, axes: tuple[str, ...]) -> Column:
    """A map of scores as an array in the order of ``axes``; missing ones are 0."""
    return F.array(*[F.coalesce(scores[a], F.lit(0)) for a in axes])


def decoded(values: Column, axes: tuple[str, ...]) -> Column:
    """The map of an encoded array, without zeros."""
    return F.map_filter(F.map_from_arrays(F.array(*[F.lit(a) for a in axes]), values), lambda k, v: v != 0)
