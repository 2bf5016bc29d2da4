"""Queries of display, audits, reports and searches: documents stand in for texts, parts for places."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import vectors
from tidemark.operators import audits, display, search
from tidemark.plans.base import AXES, LONG_SCORES, PLACES, SCORES, axis_scores, load, places, query

# ---------------------------------------------------------------- display

EXPERIENCE, INFO, MENTION = "(and |und )", "(License|[0-9]{3}-[0-9]{3})", "([a-z]{2,})ation(?:[^a-z]|$)"
_INFO_SQL = f"(trim(text) <> '' AND NOT regexp_matches(text, '{EXPERIENCE}') AND (regexp_matches(text, '{INFO}') OR len(regexp_extract_all(text, '#[^ \\t\\r\\n]+')) >= 3))"
_MINE_SQL = "CASE substr(source, 4)::INTEGER % 3 WHEN 0 THEN ['ther'] WHEN 1 THEN ['onth', 'erth'] ELSE [] END"
_BRANCH_SQL = f"(len(mine) > 0 AND len(list_filter(mine, lambda m: contains(text, m))) = 0 AND len(list_filter(regexp_extract_all(text, '{MENTION}', 1), lambda o: length(o) >= 2 AND len(list_filter(mine, lambda m: contains(m, o) OR contains(o, m))) = 0)) > 0)"


def _texts(spark, sf):
    """Documents with ``mine``, the branch tokens of their place."""
    kind = F.substring("source", 4, 9).cast("int") % 3
    mine = F.when(kind == 0, F.array(F.lit("ther"))).when(kind == 1, F.array(F.lit("onth"), F.lit("erth"))).otherwise(F.array().cast("array<string>"))
    return load(spark, sf, "documents").withColumn("mine", mine)


@query("info_dumps", f"SELECT source, count(*) FILTER (WHERE {_INFO_SQL}) AS dumps, count(*) AS texts FROM documents GROUP BY 1")
def info_dumps(spark, sf):
    return load(spark, sf, "documents").groupBy("source").agg(F.count_if(display.info_dump(F.col("text"), EXPERIENCE, INFO)).alias("dumps"), F.count("*").alias("texts"))


@query("other_branch_quotes", f"WITH t AS (SELECT *, {_MINE_SQL} AS mine FROM documents) SELECT doc_id, {_BRANCH_SQL} AS other FROM t")
def other_branch_quotes(spark, sf):
    return _texts(spark, sf).select("doc_id", display.other_branch(F.col("text"), F.col("mine"), MENTION).alias("other"))


@query(
    "display_quotes",
    r"""WITH a AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \t\r\n]+', ' ', 'g')) AS raw FROM documents),
    b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(raw, '^ *[\[(][^\])]{0,24}[\])] *', ''), '^[^\p{L}\p{N}]+', ''), '#[^ #]+', ' ', 'g') AS bare FROM a),
    c AS (SELECT *, regexp_split_to_array(bare, '(Licensed|Copyright|[0-9]{3}-[0-9]{3})')[1] AS ahead FROM b), d AS (SELECT *, trim(regexp_replace(regexp_replace(CASE WHEN length(ahead) > 12 THEN ahead ELSE bare END, '[ ,:|/-]+$', ''), ' +', ' ', 'g')) AS tidy FROM c),
    e AS (SELECT *, CASE WHEN length(tidy) < 8 THEN raw ELSE tidy END AS shown FROM d)
    SELECT doc_id, md5(CASE WHEN length(shown) < length(raw) - 4 THEN shown || '…' ELSE shown END) AS digest, length(regexp_replace(regexp_replace(replace(replace(lower(shown), 'the', ' '), 'und', ' '), '(tion|license)', ' ', 'g'), '[^\p{L}]', '', 'g')) < 6 AS empty FROM e""",
)
def display_quotes(spark, sf):
    shown = display.display_quote(F.col("text"), F.array(F.lit("the"), F.lit("und")), "(tion|license)", "(Licensed|Copyright|[0-9]{3}-[0-9]{3})")
    return load(spark, sf, "documents").select("doc_id", shown.alias("s")).select("doc_id", F.md5(F.col("s.text").cast("binary")).alias("digest"), "s.empty")


@query(
    "scrubbed_quotes",
    rf"""WITH q AS (SELECT conv_id, list(regexp_replace(array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\r\n]+'), lambda w: w <> '' AND NOT regexp_matches(w, '@.')), ' '), '{display.tx.number_pattern()}', '[tel]', 'g') ORDER BY turn) AS q FROM conversations GROUP BY 1)
    SELECT conv_id, md5(array_to_string(list_filter(q, lambda x: regexp_matches(x, '\p{{L}}')), '|')) AS digest FROM q""",
)
def scrubbed_quotes(spark, sf):
    """Quotes held as an array in one row (a conversation's turns); each element is cleaned where it lies."""
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"])
    held = load(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("q"))
    return held.select("conv_id", F.md5(F.array_join(display.scrubbed(F.col("q")), "|").cast("binary")).alias("digest"))


CAUTIONS = {"noise": ("ering", "ation"), "wait": ("heit",), "price": ("eaux", "ciones"), "seats": ("ndst",)}
FLIP, LISTING = r"^(?:[^.!?\n]{0,8}(?:not|the)|ed)", "[0-9]{3}-[0-9]{3}"


def _mention_sql(words: tuple[str, ...]) -> str:
    one = [f"(SELECT trim(regexp_replace(right(p[i - 1], 40) || '{w}' || left(p[i], 45), '[ \\t\\r\\n]+', ' ', 'g')) FROM (SELECT p, list_filter(range(2, len(p) + 1), lambda k: NOT regexp_matches(left(p[k], 10), '{FLIP}'))[1] AS i FROM (SELECT string_split(low, '{w}') AS p)))" for w in words]
    return f"coalesce({', '.join(one)})"


@query(
    "cautions",
    f"""WITH t AS (SELECT source, doc_id, lower(coalesce(text, '')) AS low FROM documents WHERE coalesce(text, '') <> ''), many AS (SELECT source FROM t GROUP BY 1 HAVING count(*) >= 6),
    s AS ({" UNION ALL ".join(f"SELECT source, doc_id, {i} AS no, '{label}' AS label, {_mention_sql(words)} AS quote FROM t" for i, (label, words) in enumerate(CAUTIONS.items()))}),
    c AS (SELECT source, no, label, count(*) AS "count", arg_min(quote, (regexp_matches(quote, '{LISTING}'), doc_id)) AS quote FROM s JOIN many USING (source) WHERE quote IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 2)
    SELECT source, label, "count", quote FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY "count" DESC, no) AS rn FROM c) WHERE rn <= 4""",
)
def cautions(spark, sf):
    return display.cautions(load(spark, sf, "documents"), "source", "doc_id", CAUTIONS, FLIP, LISTING)


FACILITIES = {"outlets": ("(ing|tion) ", "(ed|er) "), "wifi": ("(eau|heit)", "(aux|ung) "), "parking": ("(que|los) ", "(las|les) ")}


@query(
    "facility_statements",
    "WITH m AS (" + " UNION ALL ".join(f"SELECT source, '{k}' AS label, len(regexp_extract_all(coalesce(text, ''), '{y}')) AS y, len(regexp_extract_all(coalesce(text, ''), '{n}')) AS n FROM documents" for k, (y, n) in FACILITIES.items()) + ") SELECT source, label, count(*) FILTER (WHERE y > n) AS yes, count(*) FILTER (WHERE y <= n) AS no FROM m WHERE y + n > 0 GROUP BY 1, 2",
)
def facility_statements(spark, sf):
    return display.facility_statements(load(spark, sf, "documents"), "source", FACILITIES)


_KEYS_SQL = f"""k AS (SELECT *, contains(text, 'the') AS confident, NOT {_BRANCH_SQL} AS own_branch, NOT contains(text, ' | ') AS same_business, doc_id % 3 AS tier, NOT contains(text, '***') AS not_ad, doc_id % 10 <> 0 AS not_campaign, length(text) >= 40 AS readable,
  NOT {_INFO_SQL} AS not_info, regexp_matches(text, '[.!?]$') AS sentence, coalesce(nullif(doc_id % 4, 3), 1.5)::DOUBLE AS depth, CASE WHEN doc_id % 13 <> 0 THEN doc_id * 7 % 1600 END AS day, doc_id % 101 AS accuracy FROM (SELECT *, {_MINE_SQL} AS mine FROM documents)),
  shown AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {", ".join(f"{k} DESC NULLS LAST" for k in display.EXPOSURE)}, doc_id) AS place FROM k)"""


def _shown(spark, sf):
    t, i = F.col("text"), F.col("doc_id")
    other = display.other_branch(t, F.col("mine"), MENTION)
    keys = {
        "confident": t.contains("the"), "own_branch": ~other, "same_business": ~t.contains(" | "), "tier": i % 3, "not_ad": ~t.contains("***"), "not_campaign": i % 10 != 0, "readable": F.char_length(t) >= 40,
        "not_info": ~display.info_dump(t, EXPERIENCE, INFO), "sentence": t.rlike("[.!?]$"), "depth": F.coalesce(F.nullif(i % 4, F.lit(3)), F.lit(1.5)).cast("double"), "day": F.when(i % 13 != 0, i * 7 % 1600), "accuracy": i % 101,
    }
    named = _texts(spark, sf).select("source", "doc_id", (i % 3).alias("tier"), other.alias("other_branch"), keys["confident"].alias("named"), *[v.alias(f"key_{k}") for k, v in keys.items()])
    return display.exposure_order(named, "source", {k: F.col(f"key_{k}") for k in keys}, "doc_id")


@query("exposure_order", f"WITH {_KEYS_SQL} SELECT doc_id, place::INTEGER AS place FROM shown")
def exposure_order(spark, sf):
    return _shown(spark, sf).select("doc_id", F.col("place").cast("int").alias("place"))


@query(
    "exposure_sentinel",
    f"""WITH {_KEYS_SQL}, f AS (SELECT *, min(tier) OVER (PARTITION BY source ORDER BY seat ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY accuracy DESC, doc_id) AS seat FROM k) WHERE seat <= 6),
    g AS (SELECT source, bool_or(coalesce(above < tier, false)) AS tier_inversion, count(*) FILTER (WHERE NOT own_branch) >= 2 AS other_branches, count(*) >= 3 AND count(*) FILTER (WHERE confident) = 0 AS nameless FROM f GROUP BY 1) SELECT * FROM g WHERE tier_inversion OR other_branches OR nameless""",
)
def exposure_sentinel(spark, sf):
    """Checked on a list that accuracy alone has put in order, as a faulty release might."""
    listed = _shown(spark, sf).drop("place")
    return display.sentinel(display.exposure_order(listed, "source", {"accuracy": F.col("key_accuracy")}, "doc_id"), "source")


# ---------------------------------------------------------------- audits

_HOLDS = {"out_of_box": "lat < 37.02", "category": "dong = 'ECONOMY'", "name": "name LIKE 'small%'", "label": "area = 'Brand#3'"}


@query(
    "held_within_cap",
    f"""WITH {PLACES}, h AS ({" UNION ALL ".join(f"SELECT id, {i} AS no, '{n}' AS rule FROM places WHERE {c}" for i, (n, c) in enumerate(_HOLDS.items()))}), w AS (SELECT rule FROM h GROUP BY 1 HAVING count(*) <= 250)
    SELECT id, arg_min(rule, no) AS rule FROM h JOIN w USING (rule) GROUP BY 1""",
)
def held_within_cap(spark, sf):
    return audits.held_within_cap(places(spark, sf), "id", {n: F.expr(c) for n, c in _HOLDS.items()}, 250)


@query(
    "evidence_state",
    """WITH r AS (SELECT doc_id, doc_id % 4 = 0 AS held, doc_id % 3 <> 0 AS qualified, quality = 1 AS grounded, CASE WHEN doc_id % 2 = 0 THEN 'no text left' ELSE 'all of other shops' END AS issue FROM documents JOIN labels USING (doc_id)),
    h AS (SELECT doc_id FROM r WHERE NOT held AND NOT grounded AND regexp_matches(issue, '(no text|all of other)')) SELECT doc_id, 'hold' AS change FROM h WHERE (SELECT count(*) FROM h) <= 100000 UNION ALL SELECT doc_id, 'release' FROM r WHERE held AND grounded AND qualified""",
)
def evidence_state(spark, sf):
    i = F.col("doc_id")
    rows = load(spark, sf, "documents").select("doc_id", (i % 4 == 0).alias("held"), (i % 3 != 0).alias("qualified"))
    checks = load(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("grounded"), F.when(i % 2 == 0, "no text left").otherwise("all of other shops").alias("issue"))
    return audits.evidence_state(rows, checks, "doc_id", "(no text|all of other)", 100_000)


@query(
    "audited_oldest",
    """WITH o AS (SELECT o_orderkey AS id, o_orderdate, o_totalprice < 20000 AS bad FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 500) SELECT id, bad FROM (SELECT *, coalesce(sum(bad::INTEGER) OVER (ORDER BY o_orderdate, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM o) WHERE n < 10""",
)
def audited_oldest(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate", "o_totalprice")
    return audits.audited(o, "id", "o_orderdate", F.col("o_totalprice") < 20000, 500, 10)


@query(
    "link_owners",
    """WITH r AS (SELECT CASE WHEN doc_id % 5 <> 0 THEN 'post/' || (doc_id // 3 % 500) END AS link, substr(source, 4)::INTEGER AS owner, contains(text, 'the ') AS hit, repeat('n', substr(source, 4)::INTEGER % 4 + 1) AS name, doc_id % 100 AS score FROM documents),
    e AS (SELECT link, owner, max({'hit': hit, 'n': length(name), 'score': score}) AS b FROM r WHERE link IS NOT NULL GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY b.hit DESC, b.n DESC, b.score DESC, owner) AS rn, count(*) OVER (PARTITION BY link) AS owners FROM e)
    SELECT link, owner, rn = 1 AS keeps FROM w WHERE owners > 1""",
)
def link_owners(spark, sf):
    i, number = F.col("doc_id"), F.substring("source", 4, 9).cast("int")
    r = load(spark, sf, "documents").select(F.when(i % 5 != 0, F.concat(F.lit("post/"), (F.floor(i / 3) % 500).cast("long"))).alias("link"), number.alias("owner"), F.col("text").contains("the ").alias("said"), F.repeat(F.lit("n"), number % 4 + 1).alias("name"), (i % 100).alias("score"))
    return audits.link_owner(r, "link", "owner", F.col("said"), "name", "score")


@query(
    "policy_rechecks",
    """WITH latest AS (SELECT max(moment) AS moment FROM (SELECT ts AS moment FROM events WHERE event_type = 'error' UNION ALL SELECT o_orderdate FROM orders)), c AS (SELECT c_custkey AS id, c_custkey % 3 = 0 AS excluded, TIMESTAMP '2023-12-01' + INTERVAL 1 DAY * (c_custkey % 300)::INTEGER AS decided, c_acctbal FROM customer)
    SELECT id, decided FROM c, latest WHERE excluded AND decided < moment AND c_acctbal > 0""",
)
def policy_rechecks(spark, sf):
    k = F.col("c_custkey")
    current = load(spark, sf, "customer").select(k.alias("id"), (k % 3 == 0).alias("excluded"), F.expr("TIMESTAMP '2023-12-01' + make_dt_interval(CAST(c_custkey % 300 AS INT))").alias("decided"), "c_acctbal")
    history = [load(spark, sf, "events").where("event_type = 'error'").select(F.col("ts").alias("at")), load(spark, sf, "orders").select(F.col("o_orderdate").alias("at"))]
    return audits.to_recheck(current, history, "id", "at", F.col("c_acctbal") > 0)


_ANSWERS = ('Sure: {"about":"CAFE","related":true} ok', '{"about":"Food","related":false}', "no verdict", '{"about":"bar"', '{"related":true}', "")


@query(
    "parsed_verdicts",
    f"""WITH a AS (SELECT doc_id, regexp_extract(({list(_ANSWERS)!r})[doc_id % {len(_ANSWERS)} + 1], '(?s)(\\{{.*\\}})', 1) AS body FROM documents) SELECT doc_id, CASE WHEN json_valid(body) THEN lower(body ->> 'about') END AS about, CASE WHEN json_valid(body) THEN (body ->> 'related')::BOOLEAN END AS related FROM a""",
)
def parsed_verdicts(spark, sf):
    answer = F.element_at(F.array(*[F.lit(a) for a in _ANSWERS]), (F.col("doc_id") % len(_ANSWERS) + 1).cast("int"))
    return audits.parsed_verdicts(load(spark, sf, "documents").select("doc_id", answer.alias("answer")), "doc_id", "answer")


_BATCH = 12
_OBJECT = """'{"i":' || doc_id % 12 || ',"about":' || contains(text, 'the ') || ',"helpful":' || (length(text) > 600) || ',"listicle":' || contains(text, ' | ') || ',"adStyle":' || (doc_id % 9 = 0) || ',"depth":' || doc_id % 4 || '}'"""
_DECIDED = f"""t AS (SELECT doc_id, doc_id // {_BATCH} AS batch, coalesce(text, '') AS text FROM documents),
  a AS (SELECT batch, left(CASE WHEN batch % 5 = 0 THEN '' ELSE 'Here: [' END || string_agg({_OBJECT}, ', ' ORDER BY doc_id), CASE WHEN batch % 4 = 0 THEN 330 ELSE 100000 END) AS answer FROM t WHERE doc_id % 17 <> 0 GROUP BY 1),
  o AS (SELECT batch, unnest(regexp_extract_all(answer, '\\{{[^{{}}]*\\}}')) AS o FROM a),
  d AS (SELECT batch, regexp_extract(o, '"i":([0-9]+)', 1)::INTEGER AS i, contains(o, '"about":true') AND contains(o, '"helpful":true') AND NOT contains(o, '"listicle":true') AS decision, contains(o, '"adStyle":true') AS ad, contains(o, '"listicle":true') AS listicle, regexp_extract(o, '"depth":([0-9]+)', 1)::DOUBLE AS depth FROM o),
  decided AS (SELECT doc_id, t.batch, decision, ad, listicle, depth FROM t LEFT JOIN d ON d.batch = t.batch AND d.i = doc_id % {_BATCH})"""


def _decided(spark, sf):
    """Documents in batches of twelve with answers about them, some cut off, some without a list, some items left out."""
    i, text = F.col("doc_id"), F.col("text")
    t = load(spark, sf, "documents").select("doc_id", F.floor(i / _BATCH).cast("long").alias("batch"), (i % _BATCH).cast("int").alias("i"), F.coalesce("text", F.lit("")).alias("text"))
    said = lambda name, v: F.concat(F.lit(f',"{name}":'), v.cast("string"))
    one = F.concat(F.lit('{"i":'), F.col("i"), said("about", text.contains("the ")), said("helpful", F.char_length(text) > 600), said("listicle", text.contains(" | ")), said("adStyle", i % 9 == 0), said("depth", i % 4), F.lit("}"))
    listed = t.where(i % 17 != 0).groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("doc_id", one.alias("o")))).alias("os"))  # a batch has twelve items
    answer = F.concat(F.when(F.col("batch") % 5 == 0, "").otherwise("Here: ["), F.array_join(F.transform("os", lambda x: x["o"]), ", "))
    answers = listed.select("batch", F.when(F.col("batch") % 4 == 0, F.left(answer, F.lit(330))).otherwise(answer).alias("answer"))
    return audits.decisions(t.drop("text"), answers, "batch", "answer")


@query("verdict_decisions", f"WITH {_DECIDED} SELECT doc_id, decision, depth FROM decided")
def verdict_decisions(spark, sf):
    return _decided(spark, sf).select("doc_id", "decision", "depth")


@query("verdict_summary", f"WITH {_DECIDED} SELECT batch, count(decision) AS answered, count(*) - count(decision) AS unanswered, count(*) FILTER (WHERE decision) AS kept, count(*) FILTER (WHERE ad) AS ads, count(*) FILTER (WHERE listicle) AS lists, round(avg(depth), 6) AS depth FROM decided GROUP BY 1")
def verdict_summary(spark, sf):
    return audits.decision_summary(_decided(spark, sf), "batch").withColumn("depth", F.round("depth", 6))


@query(
    "link_strangers",
    r"""WITH r AS (SELECT DISTINCT 'post/' || (doc_id // 3 % 500) AS link, source AS owner, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n]+'), lambda w: w <> '')[1:4] AS ws FROM documents),
    g AS (SELECT link FROM r GROUP BY 1 HAVING count(DISTINCT owner) > 1), m AS (SELECT r.* FROM r JOIN g USING (link)), f AS (SELECT DISTINCT link, owner, unnest(ws) AS word FROM m), s AS (SELECT link, word FROM f GROUP BY 1, 2 HAVING count(*) > 1)
    SELECT DISTINCT link, owner FROM m WHERE (link, owner) NOT IN (SELECT (link, owner) FROM f JOIN s USING (link, word))""",
)
def link_strangers(spark, sf):
    """Sources that share a link but no word of their titles with any other source of it."""
    words = F.slice(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[ \t\n]+"), lambda w: w != ""), 1, 4)
    r = load(spark, sf, "documents").select(F.concat(F.lit("post/"), (F.floor(F.col("doc_id") / 3) % 500).cast("long")).alias("link"), F.col("source").alias("owner"), words.alias("words"))
    return audits.strangers(r, "link", "owner", F.col("words"))


@query(
    "rule_gaps",
    """WITH w AS (SELECT source, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '(?:^|[^a-z])([a-z]{5,9}ing)', 1))) AS word FROM documents) SELECT word, count(DISTINCT source) AS owners, count(*) AS texts FROM w WHERE word NOT IN ('thating', 'ndering') GROUP BY 1 HAVING count(DISTINCT source) >= 3""",
)
def rule_gaps(spark, sf):
    return audits.gaps(load(spark, sf, "documents"), "source", "(?:^|[^a-z])([a-z]{5,9}ing)", ("thating", "ndering"), 3)


@query("rules_fingerprint", "SELECT rules, md5(rules || '|' || s) AS fingerprint FROM (SELECT count(*) AS rules, sum(('0x' || substr(md5(concat_ws('|', p_brand, p_type, p_size::VARCHAR)), 1, 12))::BIGINT) AS s FROM (SELECT DISTINCT p_brand, p_type, p_size FROM part))")
def rules_fingerprint(spark, sf):
    return audits.fingerprint(load(spark, sf, "part").select("p_brand", "p_type", "p_size").distinct(), "p_brand", "p_type", "p_size")


@query(
    "list_changes",
    f"""WITH {PLACES}, a AS (SELECT area, id FROM places WHERE "count" >= 20), b AS (SELECT area, id FROM places WHERE "count" >= 23 OR "count" = 3) SELECT area, id AS member, 'lost' AS change FROM a WHERE (area, id) NOT IN (SELECT (area, id) FROM b) UNION ALL SELECT area, id, 'gained' FROM b WHERE (area, id) NOT IN (SELECT (area, id) FROM a)""",
)
def list_changes(spark, sf):
    p = places(spark, sf).select("area", "id", "count")
    return audits.list_changes(p.where("`count` >= 20"), p.where("`count` >= 23 OR `count` = 3"), "area", "id")


@query(
    "axis_codec",
    f"""WITH {PLACES}, {SCORES} SELECT id, concat_ws(',', {", ".join(f"s_{a}" for a in AXES)}) AS code, ({" + ".join(f"(s_{a} <> 0)::INTEGER" for a in AXES)})::INTEGER AS kept, true AS same FROM scored""",
)
def axis_codec(spark, sf):
    code = axis_scores(spark, sf).withColumn("v", audits.encoded(F.col("scores"), AXES)).withColumn("back", audits.decoded(F.col("v"), AXES))
    same = F.forall(F.map_entries("scores"), lambda e: F.coalesce(F.col("back")[e["key"]], F.lit(0)) == e["value"])
    return code.select("id", F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("code"), F.size("back").alias("kept"), same.alias("same"))


# ---------------------------------------------------------------- reports


@query(
    "area_report",
    f"""WITH {PLACES}, {SCORES}, {LONG_SCORES}, n AS (SELECT area, count(*) AS places, count(*) FILTER (WHERE grade = 'verified') AS verified FROM places GROUP BY 1),
    x AS (SELECT area, axis, count(*) FILTER (WHERE mentions >= 8) / count(*) AS share FROM axis_rows GROUP BY 1, 2), o AS (SELECT area, string_agg(axis, ',' ORDER BY axis) FILTER (WHERE share <= 0.15) AS open_axes, round(max(share), 6) AS best_share FROM x GROUP BY 1),
    t AS (SELECT area, string_agg(id::VARCHAR, ',' ORDER BY "count" DESC, id) AS top FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY "count" DESC, id) AS rn FROM places) WHERE rn <= 5 GROUP BY 1)
    SELECT area, places, verified, coalesce(open_axes, '') AS open_axes, best_share, top FROM n JOIN o USING (area) JOIN t USING (area)""",
)
def area_report(spark, sf):
    """Counts, axes that few places of an area stand for, and its first five places, from one aggregate by area and one ranked cut."""
    s = axis_scores(spark, sf)
    shares = F.array(*[F.struct(F.lit(a).alias("axis"), F.avg((F.col("scores")[a] >= 8).cast("double")).alias("share")) for a in AXES])
    base = s.groupBy("area").agg(F.count("*").alias("places"), F.count_if(F.col("grade") == "verified").alias("verified"), shares.alias("x"))
    opened = F.array_join(F.sort_array(F.transform(F.filter("x", lambda v: v["share"] <= 0.15), lambda v: v["axis"])), ",")
    first = s.withColumn("rn", F.row_number().over(Window.partitionBy("area").orderBy(F.desc("count"), "id"))).where("rn <= 5")
    top = first.groupBy("area").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "id"))), lambda r: r["id"].cast("string")), ",").alias("top"))
    return base.join(top, "area").select("area", "places", "verified", opened.alias("open_axes"), F.round(F.array_max(F.transform("x", lambda v: v["share"])), 6).alias("best_share"), "top")


@query(
    "owner_insight",
    f"""WITH {PLACES}, {SCORES}, p AS (SELECT *, {", ".join(f'100.0::DOUBLE * s_{a} / greatest("count", 1) AS p_{a}' for a in AXES)} FROM scored),
    w AS (SELECT id, rank() OVER (PARTITION BY area ORDER BY "count" DESC)::INTEGER AS place, round(cume_dist() OVER (PARTITION BY area ORDER BY "count"), 6) AS at_most, {", ".join(f"p_{a} - avg(p_{a}) OVER (PARTITION BY area) AS d_{a}" for a in AXES)} FROM p)
    SELECT id, place, at_most, ({" + ".join(f"(round(d_{a}, 6) >= 15)::INTEGER" for a in AXES)})::INTEGER AS ahead, ({" + ".join(f"(round(d_{a}, 6) <= -15)::INTEGER" for a in AXES)})::INTEGER AS behind FROM w""",
)
def owner_insight(spark, sf):
    """A place beside its area: rank and share from counts by value, lead and lag on each axis against the area's means."""
    percent = {a: 100.0 * F.col("scores")[a].cast("double") / F.greatest(F.col("count"), F.lit(1)) for a in AXES}
    s = axis_scores(spark, sf).select("id", "area", "count", *[p.alias(f"p_{a}") for a, p in percent.items()])
    values = s.groupBy("area", "count").agg(F.count("*").alias("n"))
    up, down, whole = Window.partitionBy("area").orderBy("count"), Window.partitionBy("area").orderBy(F.desc("count")), Window.partitionBy("area")
    places_ = values.select("area", "count", (F.sum("n").over(down) - F.col("n") + 1).cast("int").alias("place"), F.round(F.sum("n").over(up) / F.sum("n").over(whole), 6).alias("at_most"))
    means = s.groupBy("area").agg(*[F.avg(f"p_{a}").alias(f"m_{a}") for a in AXES])
    lead = [F.round(F.col(f"p_{a}") - F.col(f"m_{a}"), 6) for a in AXES]
    total = lambda flags: sum((f.cast("int") for f in flags), F.lit(0))
    return s.join(places_, ["area", "count"]).join(means, "area").select("id", "place", "at_most", total([d >= 15 for d in lead]).alias("ahead"), total([d <= -15 for d in lead]).alias("behind"))


@query(
    "series_trend",
    """WITH f AS (SELECT o_orderpriority AS series, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS first, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last FROM orders GROUP BY 1), t AS (SELECT *, round((last - first) / first * 100, 1) AS change FROM f)
    SELECT series, change, series || CASE WHEN change > 0 THEN ' rose' WHEN change < 0 THEN ' fell' ELSE ' held' END AS summary FROM t""",
)
def series_trend(spark, sf):
    at = F.struct("o_orderdate", "o_orderkey")
    ends = load(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("series")).agg(F.min_by("o_totalprice", at).alias("first"), F.max_by("o_totalprice", at).alias("last"))
    change = F.round((F.col("last") - F.col("first")) / F.col("first") * 100, 1)
    said = F.when(F.col("change") > 0, " rose").when(F.col("change") < 0, " fell").otherwise(" held")
    return ends.withColumn("change", change).select("series", "change", F.concat("series", said).alias("summary"))


# ---------------------------------------------------------------- searches


@query(
    "place_lookup_collapsed",
    f"""WITH {PLACES}, m AS (SELECT id, name, lat, lng, CASE WHEN name = 'red widget' THEN 0 WHEN starts_with(name, 'red widget') THEN 1 ELSE 2 END AS kind FROM places WHERE contains(name, 'widget')),
    o AS (SELECT name, list([{{'kind': kind, 'id': id, 'lat': lat, 'lng': lng}}] ORDER BY kind, id) AS r FROM m GROUP BY 1),
    k AS (SELECT name, unnest(list_reduce(r, lambda kept, x: CASE WHEN len(list_filter(kept, lambda a: sqrt(power((a.lat - x[1].lat) * 110570, 2) + power((a.lng - x[1].lng) * 111320 * cos(radians(a.lat)), 2)) < 5000)) > 0 THEN kept ELSE list_concat(kept, x) END)) AS p FROM o)
    SELECT p.id AS id, name, p.kind AS kind FROM k ORDER BY p.kind, p.id LIMIT 20""",
)
def place_lookup_collapsed(spark, sf):
    kind = F.when(F.col("name") == "red widget", 0).when(F.col("name").startswith("red widget"), 1).otherwise(2)
    found = places(spark, sf).where(F.col("name").contains("widget")).select("id", "name", "lat", "lng", kind.alias("kind"))
    return search.collapsed(found, "name", ["kind", "id"], 5000.0).orderBy("kind", "id").limit(20).select("id", "name", "kind")


@query(
    "fallback_fill",
    f"""WITH {PLACES}, c AS (SELECT id, 0 AS stage, row_number() OVER (ORDER BY "count" DESC, id) AS rn FROM places WHERE area = 'Brand#7' AND "count" >= 49 UNION ALL SELECT id, 1, row_number() OVER (ORDER BY id) FROM places WHERE name LIKE 'red w%' UNION ALL SELECT id, 2, row_number() OVER (ORDER BY price DESC, id) FROM places WHERE dong = 'PROMO'),
    f AS (SELECT id, min((stage, rn)) AS k FROM c WHERE rn <= 30 GROUP BY 1) SELECT id, k[1]::INTEGER AS stage FROM f ORDER BY k, id LIMIT 30""",
)
def fallback_fill(spark, sf):
    p = places(spark, sf)
    stages = [(p.where("area = 'Brand#7' AND `count` >= 49"), [F.desc("count"), F.asc("id")]), (p.where("name LIKE 'red w%'"), [F.asc("id")]), (p.where("dong = 'PROMO'"), [F.desc("price"), F.asc("id")])]
    return search.filled(stages, "id", 30).select("id", "stage")


@query(
    "vector_top_in_area",
    """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) AS sim FROM embeddings, q WHERE label = 3) SELECT vec_id, round(sim, 5) AS sim FROM s ORDER BY round(sim, 5) DESC, vec_id LIMIT 80""",
)
def vector_top_in_area(spark, sf):
    """The known region's rows are filtered before any similarity is computed, so the cut to 80 is among them alone."""
    e = load(spark, sf, "embeddings")
    q = e.where("vec_id = 0").orderBy(F.hash("embedding")).limit(1).select(F.col("embedding").alias("q"))  # one row, whatever ids repeat
    near = e.where("label = 3").crossJoin(F.broadcast(q)).select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("q")), 5).alias("sim"))
    return near.orderBy(F.desc("sim"), "vec_id").limit(80)


# ---------------------------------------------------------------- small relational forms


@query("seeded_shuffle", "SELECT c_custkey AS id, (row_number() OVER (ORDER BY md5('7-' || c_custkey), c_custkey))::INTEGER AS place FROM customer ORDER BY place LIMIT 50")
def seeded_shuffle(spark, sf):
    """A shuffle that a seed fixes: the order of digests, of which the wanted head is taken without sorting the rest."""
    head = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.md5(F.concat(F.lit("7-"), F.col("c_custkey")).cast("binary")).alias("d")).orderBy("d", "id").limit(50)
    return head.select("id", F.row_number().over(Window.orderBy("d", "id")).cast("int").alias("place"))


@query("insert_from_arrays", "SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT unnest([100, 101, 7]) AS id, unnest(['x', 'y', 'z']) AS name EXCEPT SELECT 7, 'z'")
def insert_from_arrays(spark, sf):
    """Rows from parallel arrays, inserted where their key is new."""
    given = spark.createDataFrame([([100, 101, 7], ["x", "y", "z"])], "ids array<int>, names array<string>")
    rows = given.select(F.explode(F.arrays_zip("ids", "names")).alias("r")).select(F.col("r.ids").alias("id"), F.col("r.names").alias("name"))
    have = load(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return have.unionByName(rows.join(have, "id", "left_anti"))


@query("best_of_axes", f"WITH {PLACES}, {SCORES} SELECT id, greatest(s_roast, s_quiet, s_mood) AS best FROM scored ORDER BY best DESC, id LIMIT 40")
def best_of_axes(spark, sf):
    best = F.array_max(F.transform(F.array(*[F.lit(a) for a in ("roast", "quiet", "mood")]), lambda a: F.col("scores")[a]))
    return axis_scores(spark, sf).select("id", best.alias("best")).orderBy(F.desc("best"), "id").limit(40)


@query("counts_with_zeros", "SELECT c_custkey AS id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS n FROM customer")
def counts_with_zeros(spark, sf):
    n = load(spark, sf, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("id")).join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "grandfathered_evidence",
    """WITH old AS (SELECT o_custkey AS owner, o_orderkey AS link, o_totalprice AS score FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'), new AS (SELECT o_custkey AS owner, o_orderkey AS link, o_totalprice + 1 AS score FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01')
    SELECT owner, link, score FROM new UNION ALL SELECT owner, link, score FROM old WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.owner = old.owner AND n.link = old.link)""",
)
def grandfathered_evidence(spark, sf):
    """New evidence wins by key, and what was shown before stays: the table never shrinks."""
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("link"), F.col("o_totalprice").alias("score"), "o_orderdate")
    old, new = o.where("o_orderdate < '1999-01-01'").drop("o_orderdate"), o.where("o_orderdate >= '1998-06-01'").drop("o_orderdate").withColumn("score", F.col("score") + 1)
    return new.unionByName(old.join(new, ["owner", "link"], "left_anti"))


@query(
    "dated_series_merge",
    """WITH a AS (SELECT o_orderdate::DATE AS date, max(o_totalprice) AS value, 1 AS run FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), b AS (SELECT o_orderdate::DATE AS date, min(o_totalprice) AS value, 2 AS run FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1)
    SELECT date, arg_max(value, run) AS value FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""",
)
def dated_series_merge(spark, sf):
    """Runs of a collector merged by date: the last run that has a date wins, and repeating a run changes nothing."""
    run = lambda p, f, n: load(spark, sf, "orders").where(F.col("o_orderpriority") == p).groupBy(F.to_date("o_orderdate").alias("date")).agg(f("o_totalprice").alias("value")).withColumn("run", F.lit(n))
    runs = run("1-URGENT", F.max, 1).unionByName(run("5-LOW", F.min, 2)).unionByName(run("5-LOW", F.min, 2))
    return runs.groupBy("date").agg(F.max_by("value", "run").alias("value"))
