"""Review queries: documents stand in for reviews, their sources for places."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import neighbours
from tidemark.operators import reviews as rv
from tidemark.plans.base import AXES, LONG_SCORES, PLACES, SCORES, axis_scores, load, places, query, sql_without_contacts

AS_OF = "2024-07-01"
BASE_DAY = "2020-01-01"


def reviews(spark, sf):
    """(id, source, text, day, months, link, account): day and account from the id, some missing."""
    i = F.col("doc_id")
    day = F.when(i % 13 != 0, F.date_add(F.lit(BASE_DAY).cast("date"), (i * 7 % 1600).cast("int")))
    link = F.when(i % 5 != 0, F.concat(F.when(i % 2 == 0, "https://m.blog.example.org/").otherwise("http://blog.example.org/"), (F.floor(i / 2) % 400).cast("long"), F.when(i % 3 == 0, "?x=1").otherwise("/")))
    return load(spark, sf, "documents").select(
        i.alias("id"), "source", "text", day.alias("day"), (F.datediff(F.lit(AS_OF).cast("date"), day) / 30.0).alias("months"), link.alias("link"), F.when(i % 7 != 0, F.concat(F.lit("u"), i % 60)).alias("account")
    )


REVIEWS = f"""reviews AS (
  SELECT doc_id AS id, source, text, CASE WHEN doc_id % 13 <> 0 THEN DATE '{BASE_DAY}' + (doc_id * 7 % 1600)::INTEGER END AS day,
         (DATE '{AS_OF}' - CASE WHEN doc_id % 13 <> 0 THEN DATE '{BASE_DAY}' + (doc_id * 7 % 1600)::INTEGER END) / 30.0::DOUBLE AS months,
         CASE WHEN doc_id % 5 <> 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'https://m.blog.example.org/' ELSE 'http://blog.example.org/' END || (doc_id // 2 % 400) || CASE WHEN doc_id % 3 = 0 THEN '?x=1' ELSE '/' END END AS link,
         CASE WHEN doc_id % 7 <> 0 THEN 'u' || (doc_id % 60) END AS account
  FROM documents
)"""

#: The example dictionaries of these queries, made of words that the test documents hold.
SPONSORED, CLOSED, TAGS = "(mit license|creative commons)", "(gnu general)", "[#*$%&]"
VISIT, SUBSTANCE = "(and|und|que|les) ", ("tion", "ing", "eau", "heit")

_SIGNAL_SQL = f"""title AS (SELECT *, lower(string_split(text, chr(10))[1]) AS t, lower(text) AS b FROM reviews),
signals AS (SELECT *, contains(t, 'the') AS title_full, contains(t, 'er') AS title_part, contains(b, 'an') AS in_body, regexp_matches(b, '{VISIT}') AS visit, contains(t, 'de') AS area,
  contains(text, ' | ') AS listicle, contains(t, '!!') AS combo, length(text) > 3000 AS passing, regexp_matches(b, '{SPONSORED}') AS sponsored,
  len(regexp_extract_all(text, '{TAGS}')) > 8 AS many_tags, {" + ".join(f"contains(b, '{w}')::INTEGER" for w in SUBSTANCE)} AS substance FROM title),
points AS (SELECT *, greatest(0, least(100, CASE WHEN title_full THEN 42 WHEN title_part THEN 30 WHEN in_body THEN 14 ELSE 0 END + visit::INTEGER * 24 + CASE WHEN substance >= 3 THEN 24 WHEN substance = 2 THEN 16 WHEN substance = 1 THEN 8 ELSE 0 END
  + area::INTEGER * 8 + CASE WHEN length(text) >= 60 THEN 5 WHEN length(text) < 25 THEN -10 ELSE 0 END - listicle::INTEGER * 22 - combo::INTEGER * 20 - passing::INTEGER * 16 - sponsored::INTEGER * 10 - many_tags::INTEGER * 8)) AS p,
  CASE WHEN regexp_matches(b, '{CLOSED}') THEN 1 WHEN length(text) < 80 THEN 2 END AS hard FROM signals),
raw_verdict AS (SELECT *, CASE WHEN hard IS NOT NULL THEN 'rejected' WHEN p >= 60 AND (title_full OR title_part) AND (visit OR substance >= 1) THEN 'verified' WHEN p >= 38 AND (title_full OR title_part OR in_body) THEN 'reference' ELSE 'rejected' END AS v FROM points),
verdicts AS (SELECT *, CASE WHEN v = 'verified' AND combo THEN 'reference' ELSE v END AS verdict, CASE hard WHEN 1 THEN 0 WHEN 2 THEN 22 ELSE CASE WHEN v = 'verified' AND combo THEN least(p, 59) ELSE p END END AS score,
  coalesce(hard = 2, false) AS borderline, CASE WHEN hard = 1 THEN 'closed' WHEN hard = 2 THEN 'short' WHEN v = 'rejected' THEN 'low quality' END AS reason FROM raw_verdict)"""


def classified(spark, sf):
    r = reviews(spark, sf).withColumn("t", F.lower(F.split("text", "\n")[0])).withColumn("b", F.lower("text"))
    t, b = F.col("t"), F.col("b")
    signals = {
        "title_full": t.contains("the"),
        "title_part": t.contains("er"),
        "in_body": b.contains("an"),
        "visit": b.rlike(VISIT),
        "area": t.contains("de"),
        "listicle": F.col("text").contains(" | "),
        "combo": t.contains("!!"),
        "passing": F.char_length("text") > 3000,
        "sponsored": b.rlike(SPONSORED),
        "many_tags": F.regexp_count("text", F.lit(TAGS)) > 8,
        "substance": sum((b.contains(w).cast("int") for w in SUBSTANCE), F.lit(0)),
        "length": F.char_length("text"),
    }
    rejects = [rv.Reject("closed", b.rlike(CLOSED)), rv.Reject("short", F.char_length("text") < 80, 22, True)]
    return rv.classify(r, rejects, signals)


@query("review_classifier", f"WITH {REVIEWS}, {_SIGNAL_SQL} SELECT id, verdict, score::INTEGER AS score, borderline, reason FROM verdicts")
def review_classifier(spark, sf):
    return classified(spark, sf).select("id", "verdict", F.col("score").cast("int").alias("score"), "borderline", "reason")


_OVERRIDE_SQL = f"""CASE WHEN regexp_matches(b, '{SPONSORED}') THEN 'rejected' WHEN verdict <> 'rejected' AND (id % 101 = 0 OR source = 'src19') THEN 'rejected' WHEN verdict = 'rejected' AND NOT borderline THEN 'rejected'
  WHEN id % 9 = 0 THEN CASE WHEN id % 2 = 1 THEN 'rejected' WHEN verdict = 'verified' THEN 'verified' ELSE 'reference' END WHEN id % 17 = 0 THEN 'verified' ELSE verdict END"""


def final_verdicts(spark, sf):
    i = F.col("id")
    out = rv.override(F.col("verdict"), F.col("b").rlike(SPONSORED), i % 101 == 0, F.col("source") == "src19", F.col("borderline"), F.when(i % 9 == 0, i % 2 == 0), i % 17 == 0)
    return classified(spark, sf).withColumn("verdict", out)


@query("verdict_overrides", f"WITH {REVIEWS}, {_SIGNAL_SQL} SELECT id, {_OVERRIDE_SQL} AS verdict FROM verdicts")
def verdict_overrides(spark, sf):
    return final_verdicts(spark, sf).select("id", "verdict")


_LINK = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce(link, ''))), '^https?://', ''), '^m\.', ''), '[#?].*$', ''), '/+$', '')"
_COLLECT_SQL = rf"""final AS (SELECT *, {_OVERRIDE_SQL} AS fv, {_LINK} AS lk, left(regexp_replace(lower(coalesce(text, '')), '[ \t\r\n]+', '', 'g'), 60) AS tk FROM verdicts),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, lk ORDER BY id) AS n FROM final) WHERE n = 1 OR lk = ''),
kept AS (SELECT * FROM (SELECT * EXCLUDE (n), row_number() OVER (PARTITION BY source, tk ORDER BY id) AS n FROM one) WHERE n = 1)"""


@query("collected_reviews", f"WITH {REVIEWS}, {_SIGNAL_SQL}, {_COLLECT_SQL} SELECT id, source, fv AS verdict FROM kept")
def collected_reviews(spark, sf):
    return rv.collect(final_verdicts(spark, sf), "source", "id", F.col("link"), F.col("text")).select("id", "source", "verdict")


@query(
    "place_grades",
    f"""WITH {REVIEWS}, {_SIGNAL_SQL}, {_COLLECT_SQL}, t AS (SELECT *, fv <> 'rejected' AS ok, row_number() OVER (PARTITION BY source, account, fv <> 'rejected' ORDER BY id) AS turn FROM kept),
    c AS (SELECT *, ok AND account IS NOT NULL AND turn > 2 AS capped, coalesce(months > 36, false) AS old FROM t),
    g AS (SELECT source, count(*) AS raw, count(*) FILTER (WHERE fv = 'verified') AS verified, count(*) FILTER (WHERE fv = 'reference') AS reference, count(*) FILTER (WHERE fv = 'rejected') AS rejected, count(*) FILTER (WHERE capped) AS account_cap,
      count(*) FILTER (WHERE ok AND NOT capped AND old) AS old_half, sum(CASE WHEN ok AND NOT capped THEN CASE WHEN old THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN fv = 'verified' THEN 1.0 ELSE 0.5::DOUBLE END ELSE 0.0 END)::DOUBLE AS grade_count FROM c GROUP BY 1)
    SELECT *, CASE WHEN grade_count >= 30 THEN 'verified' WHEN verified + reference >= 3 THEN 'reference' ELSE 'candidate' END AS grade FROM g""",
)
def place_grades(spark, sf):
    return rv.grades(rv.collect(final_verdicts(spark, sf), "source", "id", F.col("link"), F.col("text")), "source", "id", "account")


@query(
    "evidence_ranking",
    f"""WITH {REVIEWS}, {_SIGNAL_SQL}, r AS (SELECT id, source, score + CASE verdict WHEN 'verified' THEN 20 WHEN 'reference' THEN 0 ELSE -15 END
      + CASE WHEN months IS NULL THEN 8 WHEN months <= 12 THEN 60 - months ELSE greatest(0, 48 - (months - 12) * 1.6::DOUBLE) END + CASE WHEN title_full THEN 35 ELSE 0 END AS r, account FROM verdicts),
    d AS (SELECT *, row_number() OVER (PARTITION BY source, account ORDER BY round(r, 6) DESC, id) AS n FROM r)
    SELECT id, round(r, 6) AS rank_value, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(r, 6) DESC, id) AS place FROM d WHERE n <= 2 OR account IS NULL) WHERE place <= 8""",
)
def evidence_ranking(spark, sf):
    """Evidence by rank, two of an account at most, eight of a place."""
    r = F.round(rv.evidence_rank(F.col("score"), F.col("verdict"), F.col("months"), F.col("t").contains("the")), 6)
    ranked = classified(spark, sf).withColumn("rank_value", r)
    order = [F.desc("rank_value"), F.col("id")]
    capped = ranked.withColumn("n", F.row_number().over(Window.partitionBy("source", "account").orderBy(*order))).where("n <= 2 OR account IS NULL")
    return capped.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(*order))).where("place <= 8").select("id", "rank_value", "place")


@query(
    "taste_synthesis",
    f"""WITH {REVIEWS}, w AS (SELECT source, CASE WHEN months IS NULL THEN 0.6::DOUBLE WHEN months <= 12 THEN 1.0 WHEN months <= 24 THEN 0.7 WHEN months <= 36 THEN 0.5 ELSE 0.4 END AS w, contains(lower(text), 'the') AS pos, contains(lower(text), '%') AS neg FROM reviews),
    s AS (SELECT source, round(sum(CASE WHEN pos THEN w ELSE 0 END), 6) AS strong, round(sum(CASE WHEN neg THEN w ELSE 0 END), 6) AS weak FROM w GROUP BY 1)
    SELECT source, strong, weak, round(CASE WHEN strong >= 2 AND strong > weak THEN least(0.95, 0.5 + 0.09 * (strong - weak)) WHEN weak >= 2 AND weak > strong THEN greatest(0.05, 0.5 - 0.09 * (weak - strong)) END, 2)::DOUBLE AS coordinate FROM s""",
)
def taste_synthesis(spark, sf):
    w = rv.recency_weight(F.col("months") / 12)
    low = F.lower("text")
    s = reviews(spark, sf).groupBy("source").agg(F.round(F.sum(F.when(low.contains("the"), w).otherwise(0.0)), 6).alias("strong"), F.round(F.sum(F.when(low.contains("%"), w).otherwise(0.0)), 6).alias("weak"))
    return s.withColumn("coordinate", F.round(rv.taste_coordinate(F.col("strong"), F.col("weak")), 2))


_TASTE = {"roast": (("tion", "heit"), ("###",)), "quiet": (("eau", "que "), ("|", "!!")), "work": (("ing ", "los "), ())}
_DENIAL = "(the|und|des|las)"


def _axis_sql(name: str, strong: tuple[str, ...], weak: tuple[str, ...]) -> str:
    wins = ", ".join(f"list_transform(list_filter(range(1, length(low) - {len(w) - 2}), lambda p: substr(low, p, {len(w)}) = '{w}'), lambda p: substr(low, greatest(p - 14, 1), p - greatest(p - 14, 1) + {len(w) + 14}))" for w in strong)
    against = " OR ".join(["false", *[f"contains(low, '{w}')" for w in weak]])
    return f"SELECT source, w, '{name}' AS axis, len(list_filter(wins, lambda x: NOT regexp_matches(x, '{_DENIAL}'))) > 0 AS said, len(list_filter(wins, lambda x: regexp_matches(x, '{_DENIAL}'))) > 0 OR {against} AS against FROM (SELECT *, flatten([{wins}]) AS wins FROM t)"


@query(
    "axis_coordinates",
    f"""WITH d AS (SELECT source, doc_id, text, CASE WHEN doc_id % 10 <> 0 THEN (doc_id % 5)::DOUBLE END AS years, md5(regexp_replace(lower(trim(text)), '[ \\t\\n\\x0b\\f\\r]+', '', 'g')) AS print FROM documents WHERE length(text) > 0),
    t AS (SELECT source, lower(text) AS low, CASE WHEN years IS NULL THEN 0.6::DOUBLE WHEN years <= 1 THEN 1.0 WHEN years <= 2 THEN 0.7 WHEN years <= 3 THEN 0.5 ELSE 0.4 END AS w FROM (SELECT *, row_number() OVER (PARTITION BY source, print ORDER BY coalesce(years, 1e9), doc_id) AS rn FROM d) WHERE rn = 1),
    f AS ({" UNION ALL ".join(_axis_sql(k, *v) for k, v in _TASTE.items())}), s AS (SELECT source, axis, count(*) AS texts, round(sum(CASE WHEN said THEN w ELSE 0 END), 6) AS strong, round(sum(CASE WHEN against THEN w ELSE 0 END), 6) AS weak FROM f GROUP BY 1, 2)
    SELECT source, texts, axis, strong, weak, round(CASE WHEN strong >= 2 AND strong > weak THEN least(0.95, 0.5 + 0.09 * (strong - weak)) WHEN weak >= 2 AND weak > strong THEN greatest(0.05, 0.5 - 0.09 * (weak - strong)) END, 6)::DOUBLE AS coordinate FROM s""",
)
def axis_coordinates(spark, sf):
    """Tastes of each source over three axes, with denials near a word and equal texts counted once."""
    years = F.when(F.col("doc_id") % 10 != 0, (F.col("doc_id") % 5).cast("double"))
    d = load(spark, sf, "documents").select("source", "doc_id", "text", years.alias("years"))
    return rv.axis_coordinates(d, "source", "doc_id", "text", "years", _TASTE, _DENIAL).withColumn("coordinate", F.round("coordinate", 6))


@query(
    "keyword_axes",
    "SELECT doc_id, ((length(l) - length(replace(l, 'the', ''))) // 3 + (length(l) - length(replace(l, 'tion', ''))) // 4)::INTEGER AS a, ((length(l) - length(replace(l, 'ch', ''))) // 2)::INTEGER AS b FROM (SELECT doc_id, lower(text) AS l FROM documents)",
)
def keyword_axes(spark, sf):
    return load(spark, sf, "documents").select("doc_id", tx.keyword_count(F.col("text"), ("the", "tion")).alias("a"), tx.keyword_count(F.col("text"), ("ch",)).alias("b"))


_LABELS = {"bright": (("thing", "tion"), None), "quiet": (("heit",), 2), "view": (("eau", "oux"), None), "warm": (("ando",), 3)}


def _hit(words: tuple[str, ...]) -> str:
    pattern = "|".join(words)
    starts = f"list_filter(range(1, length(l) + 1), lambda i: regexp_matches(substr(l, i, 24), '^({pattern})'))"
    return f"len(list_filter({starts}, lambda i: NOT regexp_matches(substr(l, greatest(i - 14, 1), i - greatest(i - 14, 1)) || substr(l, i, length(regexp_extract(substr(l, i, 24), '^({pattern})')) + 10), '(un|nicht)'))) > 0"


@query(
    "highlights",
    f"""WITH t AS (SELECT source, lower(text) AS l, CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE 1.0 END AS w FROM documents WHERE coalesce(text, '') <> ''),
    f AS (SELECT source, w, {", ".join(f"{_hit(words)} AS h{i}" for i, (words, _) in enumerate(_LABELS.values()))} FROM t),
    s AS (SELECT source, count(*) AS texts, {", ".join(f"count(*) FILTER (WHERE h{i}) AS n{i}, sum(CASE WHEN h{i} THEN w ELSE 0 END)::DOUBLE AS w{i}" for i in range(len(_LABELS)))} FROM f GROUP BY 1 HAVING count(*) >= 6),
    u AS ({" UNION ALL ".join(f"SELECT source, '{label}' AS label, n{i} AS n, w{i} AS weight, {i} AS no, {'greatest(3, floor(texts * 0.09 + 0.5))' if own is None else own} AS need FROM s" for i, (label, (_, own)) in enumerate(_LABELS.items()))})
    SELECT source, label, n, weight, row_number() OVER (PARTITION BY source ORDER BY weight DESC, n DESC, no)::INTEGER AS rank FROM u WHERE n >= need""",
)
def highlights(spark, sf):
    t = load(spark, sf, "documents").select("source", "text", F.when(F.col("doc_id") % 3 == 0, 0.5).otherwise(1.0).alias("w"))
    return rv.highlights(t, "source", _LABELS, "(un|nicht)")


@query(
    "axis_profile",
    f"""WITH {PLACES}, {SCORES}, {LONG_SCORES}, r AS (SELECT id, axis, axis_no, mentions, round(mentions / "count", 9) AS rate FROM axis_rows WHERE "count" >= 8),
    m AS (SELECT *, avg(rate) OVER (PARTITION BY axis) AS mean, cume_dist() OVER (PARTITION BY axis ORDER BY rate) AS share FROM r),
    x AS (SELECT *, round(CASE WHEN mean > 0 THEN rate / mean WHEN rate > 0 THEN 99 ELSE 0 END, 6) AS mult FROM m), y AS (SELECT *, mult >= 1.3 AND mentions >= 2 AS strong, mult <= 0.6 AS weak FROM x),
    z AS (SELECT *, row_number() OVER (PARTITION BY id, strong ORDER BY mult DESC, axis_no) AS up, row_number() OVER (PARTITION BY id, weak ORDER BY mult, axis_no) AS down FROM y)
    SELECT id, axis, mult, round(share, 6) AS share_at_most, CASE WHEN strong AND up <= 3 THEN 'strong' ELSE 'weak' END AS side FROM z WHERE (strong AND up <= 3) OR (weak AND NOT strong AND down <= 2)""",
)
def axis_profile(spark, sf):
    return rv.axis_profile(axis_scores(spark, sf), list(AXES)).withColumn("share_at_most", F.round("share_at_most", 6))


@query(
    "campaign_clusters",
    r"""WITH r AS (SELECT doc_id AS id, source, lower(text) AS text, DATE '2023-01-01' + (doc_id % 5)::INTEGER AS day, contains(text, 'the ') AND length(text) < 900 AS personal FROM documents),
    d AS (SELECT source, day, count(*) AS n FROM r GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY day RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 DAY FOLLOWING) AS near, sum(n) OVER (PARTITION BY source) AS dated FROM d),
    b AS (SELECT source, arg_max(day, (near, -(day - DATE '1970-01-01'))) AS cluster_day, max(near)::BIGINT AS cluster_n, any_value(dated) AS dated FROM w GROUP BY 1), c AS (SELECT *, cluster_n / dated AS cluster_rate FROM b WHERE cluster_n >= 5 AND cluster_n / dated >= 0.25),
    m AS (SELECT r.* FROM r JOIN c USING (source) WHERE abs(day - cluster_day) <= 1), t AS (SELECT source, id, list_filter(regexp_split_to_array(regexp_replace(text, '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+'), lambda x: x <> '') AS ws FROM m),
    g AS (SELECT source, id, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS g FROM t WHERE len(ws) > 1), e AS (SELECT source, id, len(g) AS size, unnest(g) AS g FROM g),
    s AS (SELECT source, sum((m - rn)::DOUBLE / size) AS shared FROM (SELECT source, size, count(*) OVER (PARTITION BY source, g) AS m, row_number() OVER (PARTITION BY source, g ORDER BY size, id) AS rn FROM e) GROUP BY 1), p AS (SELECT source, avg(personal::INTEGER) AS personal_rate FROM m GROUP BY 1),
    o AS (SELECT source, cluster_day, cluster_n, cluster_rate, personal_rate, coalesce(shared, 0) / (cluster_n * (cluster_n - 1) / 2) AS template_score FROM c JOIN p USING (source) LEFT JOIN s USING (source))
    SELECT source, cluster_day, cluster_n, round(cluster_rate, 6) AS cluster_rate, round(personal_rate, 6) AS personal_rate, round(template_score, 6) AS template_score, personal_rate < 0.34 AND (template_score >= 0.25 OR cluster_rate >= 0.5) AS suspect FROM o""",
)
def campaign_clusters(spark, sf):
    d = load(spark, sf, "documents")
    r = d.select(F.col("doc_id").alias("id"), "source", "text", F.date_add(F.lit("2023-01-01").cast("date"), (F.col("doc_id") % 5).cast("int")).alias("day"), (F.col("text").contains("the ") & (F.char_length("text") < 900)).alias("personal"))
    out = rv.campaign_clusters(r, "source")
    return out.select("source", "cluster_day", "cluster_n", *[F.round(c, 6).alias(c) for c in ("cluster_rate", "personal_rate", "template_score")], "suspect")


_AD = {"personal": "(the |que )", "endings": r"[a-z]\.( |\n|$)", "signals": [r"[*]{3}", r"[%]{3}", " [|] ", "License", "[0-9]{3}-[0-9]{3}"]}


@query(
    "ad_templates",
    rf"""SELECT doc_id, length(text) >= 20 AND NOT regexp_matches(text, '{_AD["personal"]}') AND len(regexp_extract_all(text, '{_AD["endings"]}')) < 2
    AND (CASE WHEN length(text) - length(replace(text, '#', '')) >= 3 THEN 1 ELSE 0 END + {" + ".join(f"regexp_matches(text, '{s}')::INTEGER" for s in _AD["signals"])}) >= 2 AS ad FROM documents""",
)
def ad_templates(spark, sf):
    return load(spark, sf, "documents").select("doc_id", rv.ad_template(F.col("text"), **_AD).alias("ad"))


@query(
    "mention_shares",
    "SELECT source, count(*) AS n, CASE WHEN count(*) >= 8 THEN round(avg(regexp_matches(text, '(tion|eau)')::INTEGER), 6) ELSE 0 END AS trip, CASE WHEN count(*) >= 8 THEN round(avg(regexp_matches(text, '(heit|ung)')::INTEGER), 6) ELSE 0 END AS \"local\" FROM documents WHERE coalesce(text, '') <> '' GROUP BY 1",
)
def mention_shares(spark, sf):
    return rv.mention_shares(load(spark, sf, "documents"), "source", {"trip": "(tion|eau)", "local": "(heit|ung)"})


@query(
    "reputation",
    f"""WITH {REVIEWS}, g AS (SELECT source, count(*) AS texts, count(*) FILTER (WHERE regexp_matches(text, '[%$]')) AS neg, count(*) FILTER (WHERE regexp_matches(text, 'shing')) AS pos, count(day) AS dated, count(*) FILTER (WHERE DATE '{AS_OF}' - day < 365) AS recent FROM reviews GROUP BY 1)
    SELECT *, CASE WHEN neg >= 3 AND neg >= 0.15 * texts AND neg >= 0.5 * pos THEN 'divided' WHEN dated >= 5 AND recent < 5 AND recent < 0.15 * dated THEN 'stale' END AS note FROM g""",
)
def reputation(spark, sf):
    return rv.reputation(reviews(spark, sf), "source", "[%$]", "shing", F.lit(AS_OF).cast("date"))


@query(
    "reviewer_stats",
    f"""WITH {REVIEWS}, {_SIGNAL_SQL} SELECT regexp_extract(link, 'blog\\.example\\.org/([0-9]+)', 1) AS account, source, count(*) FILTER (WHERE verdict <> 'rejected') AS accepted, count(*) FILTER (WHERE verdict = 'rejected') AS rejected, min(day) AS first_day, max(day) AS last_day
    FROM verdicts WHERE link IS NOT NULL GROUP BY 1, 2""",
)
def reviewer_stats(spark, sf):
    return rv.reviewer_stats(classified(spark, sf), F.coalesce(F.regexp_extract("link", r"blog\.example\.org/([0-9]+)", 1), F.lit("")), "source")


@query(
    "term_mining",
    """WITH t AS (SELECT source, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,8}tion'))) AS term FROM documents) SELECT term, count(*) AS n, count(DISTINCT source) AS owners FROM t WHERE term NOT IN ('ention', 'thtion') GROUP BY 1 HAVING count(*) >= 3""",
)
def term_mining(spark, sf):
    known = spark.createDataFrame([("ention",), ("thtion",)], "term string")
    return rv.mine_terms(load(spark, sf, "documents"), "[a-z]{3,8}tion", known)


@query(
    "rejection_census",
    f"""WITH {REVIEWS}, {_SIGNAL_SQL} SELECT regexp_replace(reason, '[ ]+', '_', 'g') AS reason, count(*) AS n, count(DISTINCT source) AS places FROM verdicts WHERE reason IS NOT NULL GROUP BY 1""",
)
def rejection_census(spark, sf):
    return classified(spark, sf).where(F.col("reason").isNotNull()).groupBy(F.regexp_replace("reason", " +", "_").alias("reason")).agg(F.count("*").alias("n"), F.count_distinct("source").alias("places"))


@query(
    "pipeline_states",
    f"""WITH {PLACES} SELECT id, CASE WHEN id % 23 = 0 THEN 'excluded' WHEN id % 19 = 0 THEN 'held' WHEN "count" = 0 AND (id % 10) / 10 >= 0.9 THEN 'rejected' WHEN (id % 10) / 10 >= 0.8 THEN 'noise' WHEN grade IN ('verified', 'reference') THEN 'live' ELSE 'pending' END AS state FROM places""",
)
def pipeline_states(spark, sf):
    i = F.col("id")
    return places(spark, sf).select("id", rv.pipeline_state(i % 19 == 0, i % 23 == 0, F.col("grade"), (i % 10) / 10, F.col("count")).alias("state"))


@query(
    "promotions",
    f"""WITH {PLACES} SELECT id FROM places WHERE grade = 'verified' AND "count" >= 30 AND id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 3000)""",
)
def promotions(spark, sf):
    flags = load(spark, sf, "supplier").where("s_acctbal < 3000").select(F.col("s_suppkey").alias("id"))
    return places(spark, sf).where("grade = 'verified' AND `count` >= 30").join(flags, "id", "left_anti").select("id")


@query(
    "exact_duplicates",
    f"""WITH {PLACES}, p AS (SELECT id, "count" AS c, lower(regexp_replace(name, '[^a-zA-Z0-9]', '', 'g')) AS k, floor((37 + (id % 9) / 100) * 2000 + 0.5) AS y, floor((126 + (id % 5) / 100) * 2000 + 0.5) AS x FROM places),
    g AS (SELECT k, y, x, arg_max(id, (c, -id)) AS keep FROM p GROUP BY 1, 2, 3 HAVING count(*) > 1) SELECT id, keep FROM p JOIN g USING (k, y, x) WHERE id <> keep""",
)
def exact_duplicates(spark, sf):
    p = places(spark, sf).withColumn("lat", 37 + (F.col("id") % 9) / 100).withColumn("lng", 126 + (F.col("id") % 5) / 100)
    return rv.exact_duplicates(p)


# ---------------------------------------------------------------- text cleanup


@query("link_keys", f"SELECT page_id, {_LINK.replace('link', 'url')} AS key FROM pages")
def link_keys(spark, sf):
    return load(spark, sf, "pages").select("page_id", tx.link_key(F.col("url")).alias("key"))


@query(
    "plain_text",
    r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
    b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM a)
    SELECT page_id, md5(trim(regexp_replace(t, '[ \t\r\n]+', ' ', 'g'))) AS digest FROM b""",
)
def plain_text(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.md5(tx.strip_markup(F.col("html")).cast("binary")).alias("digest"))


@query("masked_text", f"SELECT doc_id, md5({sql_without_contacts('text')}) AS digest FROM documents")
def masked_text(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.md5(tx.without_contacts(F.col("text")).cast("binary")).alias("digest"))


@query(
    "shown_checksums",
    """SELECT page_id, md5(concat_ws('|', url, length(html)::VARCHAR)) AS sum FROM pages""",
)
def shown_checksums(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.md5(F.concat_ws("|", "url", F.length("html")).cast("binary")).alias("sum"))


@query(
    "freshness",
    f"""WITH {REVIEWS} SELECT source, count(*) FILTER (WHERE DATE '{AS_OF}' - day <= 365) AS recent, strftime(max(day), '%Y.%m') AS latest, DATE '{AS_OF}' - max(day) > 365 AS stale, count(*) FILTER (WHERE (2024 - year(day)) * 12 + 7 - month(day) >= 18) AS old FROM reviews WHERE day IS NOT NULL GROUP BY 1""",
)
def freshness(spark, sf):
    age = F.datediff(F.lit(AS_OF).cast("date"), "day")
    old = (2024 - F.year("day")) * 12 + 7 - F.month("day") >= 18
    return reviews(spark, sf).where("day IS NOT NULL").groupBy("source").agg(F.count_if(age <= 365).alias("recent"), F.date_format(F.max("day"), "yyyy.MM").alias("latest"), (F.min(age) > 365).alias("stale"), F.count_if(old).alias("old"))


@query(
    "top_traits",
    f"""WITH {PLACES}, {SCORES}, {LONG_SCORES} SELECT id, string_agg(axis, ',' ORDER BY mentions DESC, axis_no) AS traits FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY mentions DESC, axis_no) AS rn FROM axis_rows WHERE mentions > 0) WHERE rn <= 2 GROUP BY 1""",
)
def top_traits(spark, sf):
    rows = F.array(*[F.struct(F.col("scores")[a].alias("m"), F.lit(-i).alias("no"), F.lit(a).alias("a")) for i, a in enumerate(AXES)])
    best = F.slice(F.sort_array(F.filter(rows, lambda r: r["m"] > 0), asc=False), 1, 2)
    return axis_scores(spark, sf).select("id", F.array_join(F.transform(best, lambda r: r["a"]), ",").alias("traits")).where(F.col("traits") != "")


@query(
    "taste_neighbours",
    f"""WITH {PLACES}, {SCORES}, v AS (SELECT id, area, [{", ".join(f's_{a}::DOUBLE / greatest("count", 1)' for a in AXES)}] AS v FROM scored),
    p AS (SELECT a.id, b.id AS other, round(sqrt({" + ".join(f"power(a.v[{i + 1}] - b.v[{i + 1}], 2)" for i in range(len(AXES)))}), 9) AS d FROM v a JOIN v b ON a.area = b.area AND a.id <> b.id WHERE a.id % 100 = 0)
    SELECT id, other, round(d, 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS rn FROM p) WHERE rn <= 3""",
)
def taste_neighbours(spark, sf):
    """The nearest three of the same area for a stated set of places, not for all pairs."""
    vec = [(F.col("scores")[a].cast("double") / F.greatest("count", F.lit(1))).alias(a) for a in AXES]
    near = neighbours.nearest_in_group(axis_scores(spark, sf).select("id", "area", *vec), F.col("id") % 100 == 0, "id", "area", list(AXES), 3)
    return near.select("id", "other", F.round("d", 5).alias("distance"))


@query(
    "price_bands",
    r"""WITH p AS (SELECT l_suppkey AS id, floor(l_extendedprice / 10) AS v FROM lineitem), k AS (SELECT id, v, row_number() OVER (PARTITION BY id ORDER BY v) AS rn, count(*) OVER (PARTITION BY id) AS n FROM p WHERE v BETWEEN 3000 AND 13000)
    SELECT id, floor(v / 1000 + 0.5)::BIGINT AS band FROM k WHERE n >= 3 AND rn = n // 2 + 1""",
)
def price_bands(spark, sf):
    """The upper median from counts by value, of which a supplier has 10,001 at most."""
    v = F.floor(F.col("l_extendedprice") / 10)
    counts = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"), v.alias("v")).where("v BETWEEN 3000 AND 13000").groupBy("id", "v").count()
    so_far, whole = F.sum("count").over(Window.partitionBy("id").orderBy("v")), F.sum("count").over(Window.partitionBy("id"))
    reached = counts.withColumn("upto", so_far).withColumn("n", whole).where("n >= 3 AND upto >= floor(n / 2) + 1")
    return reached.groupBy("id").agg(F.floor(F.min("v") / 1000 + 0.5).alias("band"))
