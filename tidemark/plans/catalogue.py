"""Catalogue queries: ranking and rotation, search, entity resolution, market batch, data quality, scalar functions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import geo, vectors
from tidemark.functions import text as tx
from tidemark.operators import market, matching, quality, ranking, search
from tidemark.plans.base import AXES, PLACES, SCORES, axis_scores, load, places, query, sql_without_contacts

# ---------------------------------------------------------------- ranking


@query(
    "momentum",
    f"""WITH {PLACES}, o AS (SELECT o_custkey % 2000 AS id, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2000-06-01') AS r90, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2000-10-01') AS r30, count(*) AS total FROM orders GROUP BY 1),
    s AS (SELECT p.id, grade, area, (r30 * 2 + r90 * (0.6::DOUBLE + 0.8::DOUBLE * least(r90 / greatest("count", 1), 1)) + greatest("count" - total, 0) * 3) * CASE WHEN p.id % 3 = 0 THEN 1.25 ELSE 1 END AS score FROM places p JOIN o USING (id) WHERE r90 >= 1)
    SELECT id, round(score, 4) AS score, row_number() OVER (PARTITION BY area ORDER BY CASE grade WHEN 'verified' THEN 2 WHEN 'reference' THEN 1 ELSE 0 END DESC, round(score, 6) DESC, id)::INTEGER AS place FROM s""",
)
def momentum(spark, sf):
    at = lambda d: F.count_if(F.col("o_orderdate") >= F.lit(d).cast("timestamp"))
    o = load(spark, sf, "orders").groupBy((F.col("o_custkey") % 2000).alias("id")).agg(at("2000-06-01").alias("r90"), at("2000-10-01").alias("r30"), F.count("*").alias("total"))
    share = F.least(F.col("r90") / F.greatest("count", F.lit(1)), F.lit(1.0))
    score = (F.col("r30") * 2 + F.col("r90") * (0.6 + 0.8 * share) + F.greatest(F.col("count") - F.col("total"), F.lit(0)) * 3) * F.when(F.col("id") % 3 == 0, 1.25).otherwise(1.0)
    s = places(spark, sf).join(o, "id").where("r90 >= 1").withColumn("score", score)
    grade = F.when(F.col("grade") == "verified", 2).when(F.col("grade") == "reference", 1).otherwise(0)
    w = Window.partitionBy("area").orderBy(grade.desc(), F.round("score", 6).desc(), "id")
    return s.select("id", F.round("score", 4).alias("score"), F.row_number().over(w).alias("place"))


_TOP = "t AS (SELECT *, row_number() OVER (ORDER BY \"count\" DESC, id)::INTEGER AS pos FROM places WHERE grade = 'verified' ORDER BY \"count\" DESC, id LIMIT 60)"


def _top(spark, sf):
    t = places(spark, sf).where("grade = 'verified'").orderBy(F.desc("count"), "id").limit(60)
    return t.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("count"), "id")))


@query("chain_cap", f"WITH {PLACES}, {_TOP}, c AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pos) AS n FROM t) SELECT id, row_number() OVER (ORDER BY n > 2, pos)::INTEGER AS new_position FROM c")
def chain_cap(spark, sf):
    return ranking.cap_per_key(_top(spark, sf), F.col("name"), "pos", 2).select("id", "new_position")


@query("source_cap", f"WITH {PLACES}, {_TOP} SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY dong ORDER BY pos) AS n FROM t) WHERE n <= 2")
def source_cap(spark, sf):
    return ranking.cap_per_key(_top(spark, sf), F.col("dong"), "pos", 2, drop=True).select("id")


@query(
    "province_round_robin",
    f"""WITH {PLACES}, n AS (SELECT *, substr(area, 7)::INTEGER % 5 AS province, row_number() OVER (PARTITION BY substr(area, 7)::INTEGER % 5 ORDER BY "count" DESC, id) AS turn FROM places)
    SELECT id, turn::INTEGER AS turn, ((province - 3 + 5) % 5)::INTEGER AS seat FROM n ORDER BY turn, seat LIMIT 12""",
)
def province_round_robin(spark, sf):
    p = places(spark, sf).withColumn("province", F.substring("area", 7, 3).cast("int") % 5)
    out = ranking.round_robin(p, F.col("province"), [F.desc("count"), F.col("id")], F.col("province"), F.lit(5), 3, 12)
    return out.select("id", "turn", F.col("seat").cast("int").alias("seat"))


@query(
    "one_per_district",
    f"""WITH {PLACES}, o AS (SELECT id, area, row_number() OVER (PARTITION BY area ORDER BY "count" DESC, id) AS n FROM places) SELECT id, area FROM o WHERE n = 1""",
)
def one_per_district(spark, sf):
    best = F.max(F.struct("count", (-F.col("id")).alias("i")))
    return places(spark, sf).groupBy("area").agg(best.alias("b")).select((-F.col("b.i")).alias("id"), "area")


@query(
    "pool_rotation",
    f"""WITH {PLACES}, p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM places WHERE "count" = 50), o AS (SELECT *, ((i - 19783 % n + n) % n)::INTEGER AS place FROM p) SELECT id, place FROM o WHERE place < 10""",
)
def pool_rotation(spark, sf):
    moment = 1_704_067_200_000 + 11 * 3_600_000  # 2024-01-01 11:00 UTC
    offset = ranking.slice_offset(moment)
    return ranking.rotate(places(spark, sf).where("`count` = 50").select("id"), "id", offset, 10).select("id", F.col("place").cast("int").alias("place"))


@query(
    "reserved_recent_slot",
    """WITH s AS (SELECT o_custkey % 50 AS owner, o_orderkey AS id, o_orderdate >= TIMESTAMP '2000-09-01' AND o_orderstatus = 'F' AS e, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS pos FROM orders),
    m AS (SELECT *, bool_or(e AND pos <= 6) OVER (PARTITION BY owner) AS has, min(CASE WHEN e THEN pos END) OVER (PARTITION BY owner) AS pick, max(pos) OVER (PARTITION BY owner) AS last FROM s)
    SELECT owner, id, (CASE WHEN has OR pick IS NULL THEN pos WHEN pos = pick THEN 6 WHEN pos = 6 THEN last WHEN pos > pick THEN pos - 1 ELSE pos END)::INTEGER AS new_position FROM m""",
)
def reserved_recent_slot(spark, sf):
    o = load(spark, sf, "orders").withColumn("owner", F.col("o_custkey") % 50)
    s = o.withColumn("pos", F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("o_totalprice"), "o_orderkey")))
    e = (F.col("o_orderdate") >= F.lit("2000-09-01").cast("timestamp")) & (F.col("o_orderstatus") == "F")
    return ranking.reserve_recent(s, "owner", "pos", e).select("owner", F.col("o_orderkey").alias("id"), "new_position")


@query(
    "risk_queue",
    """SELECT id, risk FROM (SELECT o_orderkey AS id, (CASE WHEN o_orderstatus = 'P' THEN 40 ELSE 0 END + CASE WHEN o_totalprice > 300000 THEN 25 ELSE 0 END + CASE WHEN o_orderpriority LIKE '1%' THEN 10 ELSE 0 END)::INTEGER AS risk, o_orderdate FROM orders)
    ORDER BY risk DESC, o_orderdate NULLS FIRST, id LIMIT 100""",
)
def risk_queue(spark, sf):
    risk = F.when(F.col("o_orderstatus") == "P", 40).otherwise(0) + F.when(F.col("o_totalprice") > 300000, 25).otherwise(0) + F.when(F.col("o_orderpriority").like("1%"), 10).otherwise(0)
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), risk.alias("risk"), "o_orderdate").orderBy(F.desc("risk"), F.asc_nulls_first("o_orderdate"), "id").limit(100).select("id", "risk")


@query(
    "review_ordering",
    """SELECT l_suppkey AS owner, l_orderkey AS id, l_linenumber AS line, row_number() OVER (PARTITION BY l_suppkey ORDER BY (l_quantity > 25) DESC, CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 1 ELSE 0 END DESC, (l_discount < 0.05) DESC, (l_linestatus = 'F') DESC, l_tax DESC, l_shipdate DESC NULLS LAST, l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey)::INTEGER AS place FROM lineitem""",
)
def review_ordering(spark, sf):
    """Lexicographic order by many keys in one window: name confidence, trust tier, advertising, readability, depth, date, accuracy."""
    tier = F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "N", 1).otherwise(0)
    keys = [(F.col("l_quantity") > 25).desc(), tier.desc(), (F.col("l_discount") < 0.05).desc(), (F.col("l_linestatus") == "F").desc(), F.desc("l_tax"), F.desc_nulls_last("l_shipdate"), F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*keys)).alias("place"))


_CENTER = (37.25, 126.75)


@query(
    "nearby_ranking",
    f"""WITH {PLACES}, {SCORES}, k AS (SELECT *, 2 * 6371.0 * asin(least(1.0, sqrt(power(sin(radians(lat - {_CENTER[0]}) / 2), 2) + cos(radians({_CENTER[0]})) * cos(radians(lat)) * power(sin(radians(lng - {_CENTER[1]}) / 2), 2)))) AS km FROM scored),
    t AS (SELECT *, CASE WHEN area = 'Brand#2' AND dong = 'SMALL' THEN 0 WHEN km <= 10 THEN 1 ELSE 2 END AS tier FROM k)
    SELECT id, tier::INTEGER AS tier, round(km, 3) AS km FROM t WHERE tier < 2 OR area = 'Brand#2' ORDER BY tier, CASE grade WHEN 'verified' THEN 0 WHEN 'reference' THEN 1 ELSE 2 END, round(km, 6), "count" DESC, id LIMIT 6""",
)
def nearby_ranking(spark, sf):
    km = geo.haversine_km(F.lit(_CENTER[0]), F.lit(_CENTER[1]), F.col("lat"), F.col("lng"))
    tier = F.when((F.col("area") == "Brand#2") & (F.col("dong") == "SMALL"), 0).when(F.col("km") <= 10, 1).otherwise(2)
    grade = F.when(F.col("grade") == "verified", 0).when(F.col("grade") == "reference", 1).otherwise(2)
    p = places(spark, sf).withColumn("km", km).withColumn("tier", tier).where("tier < 2 OR area = 'Brand#2'")
    return p.orderBy("tier", grade, F.round("km", 6), F.desc("count"), "id").limit(6).select("id", "tier", F.round("km", 3).alias("km"))


# ---------------------------------------------------------------- search


@query(
    "query_tokens",
    r"""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(trim(text)), '[\s,./?!]+'), lambda x: x <> '' AND x NOT IN ('the', 'of', 'and')) AS w FROM benchmark),
    c AS (SELECT item_id, list_transform(w, lambda x: CASE WHEN length(x) >= 4 AND right(x, 1) IN ('e', 'y') THEN left(x, length(x) - 1) ELSE x END) AS w FROM w)
    SELECT item_id, array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: list_position(w, z[1]) = z[2]), lambda z: z[1]), ' ') AS tokens FROM c""",
)
def query_tokens(spark, sf):
    return load(spark, sf, "benchmark").select("item_id", F.array_join(search.tokens(F.col("text"), ("the", "of", "and"), ("e", "y")), " ").alias("tokens"))


_TOKENS = ["the", "eau", "stion"]
_OCC = lambda c, t: f"(length(lower({c})) - length(replace(lower({c}), '{t}', ''))) // {len(t)}"


@query(
    "lexical_scores",
    f"""WITH c AS (SELECT doc_id, {" + ".join(f"{_OCC(f, t)} * {w}::DOUBLE" for t in _TOKENS for f, w in (("source", 4), ("lang", 1)))} AS core, {" + ".join(f"{_OCC('text', t)} * 2.0::DOUBLE" for t in _TOKENS)} AS own FROM documents)
    SELECT doc_id, core = 0 AND own > 0 AS review_only, CASE WHEN core = 0 AND own > 0 THEN own * 0.5 ELSE core + own END AS exact FROM c""",
)
def lexical_scores(spark, sf):
    return search.lexical(load(spark, sf, "documents"), _TOKENS, {"source": 4.0, "lang": 1.0}, "text").select("doc_id", "review_only", "exact")


_QUERY = [round(((i * 37) % 17 - 8) / 10, 1) for i in range(64)]
_SIM = f"""v AS (SELECT vec_id, label, {" + ".join(f"embedding[{i + 1}]::DOUBLE * ({x})::DOUBLE" for i, x in enumerate(_QUERY))} AS dot, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) * {sum(x * x for x in _QUERY)!r}::DOUBLE) AS n FROM embeddings),
top AS (SELECT vec_id, label, round(CASE WHEN n = 0 THEN 0 ELSE dot / n END, 6) AS sim FROM v ORDER BY round(CASE WHEN n = 0 THEN 0 ELSE dot / n END, 6) DESC, vec_id LIMIT 80)"""


def _similar(spark, sf):
    e = load(spark, sf, "embeddings")
    sim = F.round(vectors.cosine(F.col("embedding"), F.array(*[F.lit(x) for x in _QUERY])), 6)
    return e.select("vec_id", "label", sim.alias("sim")).orderBy(F.desc("sim"), "vec_id").limit(80)


@query("vector_top_80", f"WITH {_SIM} SELECT vec_id, sim FROM top")
def vector_top_80(spark, sf):
    return _similar(spark, sf).select("vec_id", "sim")


@query(
    "rank_fusion",
    f"""WITH {_SIM}, c AS (SELECT *, (vec_id % 7)::DOUBLE AS exact, CASE WHEN vec_id % 5 = 0 THEN 6 ELSE 0 END AS concept, vec_id % 11 = 0 AS review_only, CASE label % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'reference' ELSE 'candidate' END AS grade FROM top),
    r AS (SELECT *, row_number() OVER (ORDER BY sim DESC, vec_id) - 1 AS a, CASE WHEN exact + concept > 0 THEN row_number() OVER (ORDER BY exact + concept DESC, vec_id) - 1 ELSE 2 * count(*) OVER () END AS b FROM c),
    q AS (SELECT *, (exact > 0 AND NOT review_only) OR concept > 0 AS ok FROM r)
    SELECT vec_id, round((1.0::DOUBLE / (20 + a) + 1.0::DOUBLE / (20 + b)) / (2 / 20.0::DOUBLE) * 100 + CASE WHEN ok THEN CASE grade WHEN 'verified' THEN 25 WHEN 'reference' THEN 8 ELSE 0 END ELSE 0 END, 4) AS score FROM q WHERE ok OR sim >= 0.75""",
)
def rank_fusion(spark, sf):
    i = F.col("vec_id")
    grade = F.when(F.col("label") % 3 == 0, "verified").when(F.col("label") % 3 == 1, "reference").otherwise("candidate")
    c = _similar(spark, sf).select("vec_id", "sim", (i % 7).cast("double").alias("exact"), F.when(i % 5 == 0, 6).otherwise(0).alias("concept"), (i % 11 == 0).alias("review_only"), grade.alias("grade"))
    return search.fuse(c, "vec_id").select("vec_id", F.round("score", 4).alias("score"))


@query(
    "candidate_lists",
    f"""WITH {PLACES}, {SCORES}, a AS (SELECT id, 0 AS list_no FROM scored ORDER BY "count" DESC, id LIMIT 40), b AS (SELECT id, 1 AS list_no FROM scored ORDER BY s_roast DESC, id LIMIT 40), c AS (SELECT id, 2 AS list_no FROM scored WHERE contains(name, 'ring') ORDER BY id LIMIT 40)
    SELECT id, min(list_no)::INTEGER AS list_no FROM (FROM a UNION ALL FROM b UNION ALL FROM c) GROUP BY 1""",
)
def candidate_lists(spark, sf):
    p = axis_scores(spark, sf)
    a, b, c = p.orderBy(F.desc("count"), "id").limit(40), p.orderBy(F.col("scores")["roast"].desc(), "id").limit(40), p.where(F.col("name").contains("ring")).orderBy("id").limit(40)
    return search.first_of("id", a.select("id"), b.select("id"), c.select("id"))


@query(
    "place_lookup",
    f"""WITH {PLACES}, h AS (SELECT id, name, CASE WHEN lower(name) = 'red' THEN 0 WHEN starts_with(lower(name), 'red') THEN 1 WHEN contains(lower(name), 'red') THEN 2 END AS how, CASE dong WHEN 'SMALL' THEN 0 WHEN 'LARGE' THEN 1 ELSE 2 END AS k FROM places)
    SELECT id, how::INTEGER AS how FROM h WHERE how IS NOT NULL ORDER BY how, k, length(name), id LIMIT 8""",
)
def place_lookup(spark, sf):
    return search.place_lookup(places(spark, sf).withColumn("kind", F.col("dong")), "red", {"SMALL": 0, "LARGE": 1}).select("id", "how")


@query("ambiguous_names", f"WITH {PLACES} SELECT lower(name) AS name, count(DISTINCT (floor(lat * 20), floor(lng * 20))) AS clusters FROM places GROUP BY 1 HAVING count(DISTINCT (floor(lat * 20), floor(lng * 20))) >= 3")
def ambiguous_names(spark, sf):
    return search.spread_names(places(spark, sf))


@query(
    "region_index",
    f"""WITH {PLACES}, c AS (SELECT dong, area, count(*) AS n FROM places GROUP BY 1, 2) SELECT dong, arg_max(area, (n, area)) AS area, max(n) AS n, count(*) - 1 AS others FROM c GROUP BY 1""",
)
def region_index(spark, sf):
    return search.region_index(places(spark, sf))


@query("name_boost", f"""WITH {PLACES}, k AS (SELECT id, lower(regexp_replace(name, '[^a-zA-Z0-9]', '', 'g')) AS k FROM places) SELECT id, (CASE WHEN k = 'redring' THEN 9999 WHEN starts_with(k, 'redring') THEN 500 WHEN contains(k, 'redring') THEN 100 ELSE 0 END)::INTEGER AS boost FROM k""")
def name_boost(spark, sf):
    return places(spark, sf).select("id", search.name_boost(F.col("name"), "Red Ring").alias("boost"))


# ---------------------------------------------------------------- entity resolution

_PERMITS = f"""permits AS (SELECT id AS permit, CASE WHEN id % 4 = 0 THEN name || ' shop' WHEN id % 4 = 1 THEN reverse(name) ELSE name END AS pname, CASE WHEN id % 5 <> 0 THEN area || '|' || id // 3 END AS road, area || '|' || id AS lot, id % 3 <> 0 AS "open", DATE '2023-01-01' + (id % 300)::INTEGER AS closed_on FROM places),
sites AS (SELECT id, name, area || '|' || id // 3 AS road, area || '|' || id AS lot, DATE '2023-03-01' + (id % 400)::INTEGER AS last_review FROM places)"""
_GRAMS = lambda c: f"CASE WHEN length({c}) >= 2 THEN list_distinct(list_transform(range(1, length({c})), lambda i: substr({c}, i, 2))) ELSE [{c}] END"
_SIMILAR = f"""CASE WHEN x = '' OR y = '' THEN 0 WHEN x = y THEN 1 WHEN length(x) >= 3 AND length(y) >= 3 AND (contains(x, y) OR contains(y, x)) THEN 0.9
  ELSE len(list_intersect({_GRAMS("x")}, {_GRAMS("y")})) / len(list_distinct(list_concat({_GRAMS("x")}, {_GRAMS("y")}))) END"""


@query(
    "permit_matching",
    f"""WITH {PLACES}, {_PERMITS}, r AS (SELECT s.id, s.name, last_review, permit, pname, "open", closed_on, 'road' AS way FROM sites s JOIN permits p ON s.road = p.road),
    l AS (SELECT s.id, s.name, last_review, permit, pname, "open", closed_on, 'lot' AS way FROM sites s JOIN permits p ON s.lot = p.lot WHERE s.id NOT IN (SELECT id FROM r)),
    b AS (SELECT *, lower(regexp_replace(name, '[^a-zA-Z0-9]', '', 'g')) AS x, lower(regexp_replace(pname, '[^a-zA-Z0-9]', '', 'g')) AS y, count(*) OVER (PARTITION BY id) AS n FROM (FROM r UNION ALL FROM l)),
    k AS (SELECT *, round({_SIMILAR}, 6) AS similarity FROM b), m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY "open" DESC, similarity DESC, permit) AS rn FROM k WHERE similarity >= CASE WHEN n = 1 THEN 0.45 ELSE 0.62 END)
    SELECT id, permit, way, similarity, NOT "open" AND NOT (last_review - closed_on > 60) AS closed, NOT "open" AND last_review - closed_on > 60 AS live_after FROM m WHERE rn = 1""",
)
def permit_matching(spark, sf):
    p, i = places(spark, sf), F.col("id")
    road, lot = F.concat("area", F.lit("|"), F.floor(i / 3)), F.concat("area", F.lit("|"), i)
    name = F.when(i % 4 == 0, F.concat("name", F.lit(" shop"))).when(i % 4 == 1, F.reverse("name")).otherwise(F.col("name"))
    permits = p.select(i.alias("permit"), name.alias("pname"), F.when(i % 5 != 0, road).alias("road"), lot.alias("lot"), (i % 3 != 0).alias("open"), F.date_add(F.lit("2023-01-01").cast("date"), (i % 300).cast("int")).alias("closed_on"))
    sites = p.select("id", "name", road.alias("road"), lot.alias("lot"), F.date_add(F.lit("2023-03-01").cast("date"), (i % 400).cast("int")).alias("last_review"))
    return matching.match_permits(sites, permits)


@query(
    "ingest_matching",
    f"""WITH {PLACES}, o AS (SELECT id AS o, name || ' ' || area AS name, lat, lng, area || '  ' || id AS address FROM places WHERE id % 2 = 0),
    n AS (SELECT id, CASE id % 3 WHEN 0 THEN name || ' ' || area WHEN 1 THEN name || ' ' || area || 'x' ELSE 'new ' || id END AS name, lat + 0.0001 AS lat, lng - 0.0001 AS lng, CASE WHEN id % 4 < 2 THEN area || ' ' || id ELSE '' END AS address FROM places),
    a AS (SELECT n.id, min(o.o) AS match, 0 AS no FROM n JOIN o USING (name) GROUP BY 1),
    p AS (SELECT n.id, o.o, lower(regexp_replace(n.name, '[^a-zA-Z0-9]', '', 'g')) AS x, lower(regexp_replace(o.name, '[^a-zA-Z0-9]', '', 'g')) AS y FROM n JOIN o ON abs(n.lat - o.lat) < 0.0005 AND abs(n.lng - o.lng) < 0.0005),
    b AS (SELECT id, min(o) AS match, 1 AS no FROM p WHERE {_SIMILAR} >= 0.5 GROUP BY 1), c AS (SELECT n.id, min(o.o) AS match, 2 AS no FROM n JOIN o ON n.address <> '' AND trim(regexp_replace(n.address, '\\s+', ' ', 'g')) = trim(regexp_replace(o.address, '\\s+', ' ', 'g')) GROUP BY 1)
    SELECT id, arg_min(match, no) AS match, ['name', 'place', 'address'][min(no) + 1] AS how FROM (FROM a UNION ALL FROM b UNION ALL FROM c) GROUP BY 1""",
)
def ingest_matching(spark, sf):
    p, i = places(spark, sf), F.col("id")
    full = F.concat("name", F.lit(" "), "area")
    old = p.where("id % 2 = 0").select("id", full.alias("name"), "lat", "lng", F.concat("area", F.lit("  "), i).alias("address"))
    name = F.when(i % 3 == 0, full).when(i % 3 == 1, F.concat(full, F.lit("x"))).otherwise(F.concat(F.lit("new "), i))
    new = p.select("id", name.alias("name"), (F.col("lat") + 0.0001).alias("lat"), (F.col("lng") - 0.0001).alias("lng"), F.when(i % 4 < 2, F.concat("area", F.lit(" "), i)).otherwise("").alias("address"))
    return matching.ingest_matches(old, new)


@query(
    "rival_names",
    f"""WITH {PLACES}, c AS (SELECT lower(regexp_replace(name, '[^a-zA-Z0-9]', '', 'g')) AS core, min(id) AS rival FROM places GROUP BY 1 HAVING count(*) <= 40 AND length(core) >= 4),
    t AS (SELECT id, lower(regexp_replace(name || ' ' || area || ' ' || reverse(name) || ' blue bolt', '[^a-zA-Z0-9]', '', 'g')) AS t FROM places) SELECT id, rival FROM t JOIN c ON contains(t, core) AND rival <> id""",
)
def rival_names(spark, sf):
    p = places(spark, sf)
    texts = p.select("id", F.col("id").alias("place"), F.concat("name", F.lit(" "), "area", F.lit(" "), F.reverse("name"), F.lit(" blue bolt")).alias("text"))
    return matching.rivals_in_text(texts, p.select("id", "name"), 4, 40)


@query(
    "closure_queue",
    f"""WITH {PLACES} SELECT p.id, (12 - month(DATE '2023-01-01' + (p.id % 330)::INTEGER))::INTEGER AS months, s_suppkey IS NOT NULL AS permit_closed FROM places p LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal < 2000) ON s_suppkey = p.id
    WHERE (12 - month(DATE '2023-01-01' + (p.id % 330)::INTEGER)) >= 6 OR s_suppkey IS NOT NULL""",
)
def closure_queue(spark, sf):
    s = load(spark, sf, "supplier").where("s_acctbal < 2000").select(F.col("s_suppkey").alias("id"), F.lit(True).alias("c"))
    months = 12 - F.month(F.date_add(F.lit("2023-01-01").cast("date"), (F.col("id") % 330).cast("int")))
    out = places(spark, sf).join(s, "id", "left").select("id", months.alias("months"), F.coalesce("c", F.lit(False)).alias("permit_closed"))
    return out.where("months >= 6 OR permit_closed")


# ---------------------------------------------------------------- market

_SERIES = "coffee AS (SELECT CAST(o_orderdate AS DATE) AS date, round(avg(o_totalprice) / 100000, 4) AS value FROM orders GROUP BY 1), fx AS (SELECT CAST(l_shipdate AS DATE) AS date, round(1200 + avg(l_quantity) * 4, 2) AS value FROM lineitem GROUP BY 1)"


def _coffee(spark, sf):
    return load(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.round(F.avg("o_totalprice") / 100000, 4).alias("value"))


def _fx(spark, sf):
    return load(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.round(1200 + F.avg("l_quantity") * 4, 2).alias("value"))


@query("series_join", f"WITH {_SERIES} SELECT date, coffee.value AS usd_lb, fx.value AS usd_krw, round(coffee.value * fx.value, 3) AS krw_lb FROM coffee JOIN fx USING (date)")
def series_join(spark, sf):
    return _coffee(spark, sf).withColumnRenamed("value", "usd_lb").join(_fx(spark, sf).withColumnRenamed("value", "usd_krw"), "date").withColumn("krw_lb", F.round(F.col("usd_lb") * F.col("usd_krw"), 3))


_ORIGINS = [("Alta", 1000, 0.0), ("Brava", 500, 0.02), ("Cedra", 0, 0.0), ("Duna", -300, 0.08)]
_GREEN = "((p + points / 10000.0::DOUBLE) * 2.2046::DOUBLE * r * 1.08::DOUBLE * (1 + tariff) + 250) * 1.15::DOUBLE"


@query(
    "landed_cost",
    f"""WITH {_SERIES}, o(origin, points, tariff) AS (VALUES {", ".join(f"('{n}', {p}, {t}::DOUBLE)" for n, p, t in _ORIGINS)}),
    c AS (SELECT list(value ORDER BY date DESC) AS v FROM coffee), f AS (SELECT list(value ORDER BY date DESC) AS v FROM fx),
    g AS (SELECT origin, k, (SELECT v[least(len(v), k + 1)] FROM c) AS p, (SELECT v[least(len(v), k + 1)] FROM f) AS r, points, tariff FROM o, (VALUES (0), (1), (7)) AS ks(k)),
    h AS (SELECT origin, max({_GREEN}) FILTER (WHERE k = 0) AS g0, max(round({_GREEN})) FILTER (WHERE k = 1) AS g1, max(round({_GREEN})) FILTER (WHERE k = 7) AS g7, max(p + points / 10000.0::DOUBLE) FILTER (WHERE k = 0) AS fob FROM g GROUP BY 1)
    SELECT origin, round(fob, 4) AS fob, round(g0) AS green, round(g0 / 0.83::DOUBLE) AS roasted, round((round(g0) - g1) / g1 * 100, 1) AS change_1, round((round(g0) - g7) / g7 * 100, 1) AS change_7 FROM h""",
)
def landed_cost(spark, sf):
    """Cost of each origin now, one and seven rows ago; the series are reduced to one row before they meet the origins."""
    origins = spark.createDataFrame(_ORIGINS, "origin string, points int, tariff double")
    p = market.latest_values(_coffee(spark, sf)).toDF("p0", "p1", "p7")
    r = market.latest_values(_fx(spark, sf)).toDF("r0", "r1", "r7")
    both = origins.crossJoin(F.broadcast(p)).crossJoin(F.broadcast(r))
    cost = {n: market.landed_cost(F.col(f"p{n}"), F.col(f"r{n}"), F.col("points"), F.col("tariff")) for n in (0, 1, 7)}
    change = lambda n: F.round((cost[0]["green"] - cost[n]["green"]) / cost[n]["green"] * 100, 1)
    return both.select("origin", cost[0]["fob"].alias("fob"), cost[0]["green"].alias("green"), cost[0]["roasted"].alias("roasted"), change(1).alias("change_1"), change(7).alias("change_7"))


@query(
    "price_signal",
    f"""WITH {_SERIES}, a AS (SELECT list(value ORDER BY date DESC) AS v, min(value) AS lo, max(value) AS hi, avg(value) AS mean, count(*) AS days FROM coffee), b AS (SELECT *, CASE WHEN hi = lo THEN 0.5 ELSE (v[1] - lo) / (hi - lo) END AS p FROM a)
    SELECT round(v[1], 4) AS current, round(lo, 4) AS low, round(hi, 4) AS high, round(mean, 4) AS mean, round(p * 100, 1) AS place, CASE WHEN p <= 0.33 THEN 'low' WHEN p >= 0.67 THEN 'high' ELSE 'middle' END AS label,
    CASE WHEN days < 6 THEN 'none' WHEN v[1] > v[6] THEN 'up' WHEN v[1] < v[6] THEN 'down' ELSE 'flat' END AS trend, days FROM b""",
)
def price_signal(spark, sf):
    return market.price_signal(_coffee(spark, sf))


@query(
    "catalogue_cleaning",
    """WITH k AS (SELECT p_partkey AS id, coalesce(nullif(p_type, 'PROMO'), 'unknown') AS process, p_size::DOUBLE AS a, p_retailprice AS b FROM part WHERE p_brand IS NOT NULL AND p_size > 0 AND p_retailprice > 0), s AS (SELECT id, process, (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) AS a, (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) AS b FROM k)
    SELECT process, count(*) AS n, round(avg(a), 6) AS acidity, round(avg(b), 6) AS body FROM s GROUP BY 1 HAVING count(*) >= 3""",
)
def catalogue_cleaning(spark, sf):
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.nullif("p_type", F.lit("PROMO")).alias("process"), F.col("p_brand").alias("origin"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    clean = market.clean_catalogue(p, "origin", ["a", "b"], {"process": "unknown"})
    return clean.groupBy("process").agg(F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("acidity"), F.round(F.avg("b"), 6).alias("body")).where("n >= 3")


# ---------------------------------------------------------------- data quality and scalars


_CHECKS = {
    "published_has_reviews": "fail", "order_total_positive": "fail", "line_has_order": "fail", "repeated_names": "warn", "negative_balance": "warn", "place_in_country": "fail", "grade_known": "fail",
    "price_per_size": "warn", "discount_range": "fail", "ship_after_order": "fail", "return_flag_known": "fail", "order_priority_known": "warn", "supplier_nation_known": "fail", "shipped_before_receipt": "warn",
}


@query(
    "quality_suite",
    f"""WITH {PLACES}, bad("check", k) AS (SELECT 'published_has_reviews', id::VARCHAR FROM places WHERE grade <> 'candidate' AND "count" < 3
      UNION ALL SELECT 'place_in_country', id::VARCHAR FROM places WHERE NOT (lat BETWEEN 33 AND 39 AND lng BETWEEN 124 AND 132) UNION ALL SELECT 'grade_known', id::VARCHAR FROM places WHERE grade NOT IN ('verified', 'reference', 'candidate')
      UNION ALL SELECT 'price_per_size', id::VARCHAR FROM places WHERE price > 1500 AND "count" < 5 UNION ALL SELECT 'order_total_positive', o_orderkey::VARCHAR FROM orders WHERE o_totalprice <= 0
      UNION ALL SELECT 'order_priority_known', o_orderkey::VARCHAR FROM orders WHERE o_orderpriority IS NULL OR o_orderpriority NOT LIKE '_-%' UNION ALL SELECT 'line_has_order', l_orderkey::VARCHAR FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey IS NULL
      UNION ALL SELECT 'ship_after_order', l_orderkey::VARCHAR FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate UNION ALL SELECT 'discount_range', l_orderkey::VARCHAR FROM lineitem WHERE NOT l_discount BETWEEN 0 AND 0.1
      UNION ALL SELECT 'return_flag_known', l_orderkey::VARCHAR FROM lineitem WHERE l_returnflag NOT IN ('A', 'N', 'R') UNION ALL SELECT 'shipped_before_receipt', l_orderkey::VARCHAR FROM lineitem WHERE l_quantity > 49 AND l_tax > 0.07
      UNION ALL SELECT 'repeated_names', name FROM (SELECT name FROM places GROUP BY name HAVING count(*) > 110) UNION ALL SELECT 'negative_balance', s_suppkey::VARCHAR FROM supplier WHERE s_acctbal < 500
      UNION ALL SELECT 'supplier_nation_known', s_suppkey::VARCHAR FROM supplier WHERE s_nationkey NOT BETWEEN 0 AND 24),
    names("check", level) AS (VALUES {", ".join(f"('{n}', '{v}')" for n, v in _CHECKS.items())}),
    slices AS (SELECT "check", substr(md5(k), 1, 2) AS slice, count(*) AS n, min(k) AS k FROM bad GROUP BY 1, 2), few AS (SELECT *, row_number() OVER (PARTITION BY "check" ORDER BY k) AS rn FROM slices)
    SELECT n."check", n.level, coalesce(sum(f.n), 0)::BIGINT AS failures, coalesce(string_agg(f.k, ',' ORDER BY f.k) FILTER (WHERE rn <= 6), '') AS samples, count(f.k) = 0 AS passed FROM names n LEFT JOIN few f ON f."check" = n."check" GROUP BY n."check", n.level""",
)
def quality_suite(spark, sf):
    """Fourteen checks, each table read once for all of its row checks (orders twice: alone, and beside their lines)."""
    p, o, s = places(spark, sf), load(spark, sf, "orders"), load(spark, sf, "supplier")
    l = load(spark, sf, "lineitem").join(o.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"), "left")  # noqa: E741
    return quality.run_checks(
        spark,
        _CHECKS,
        quality.failing(p, "id", {
            "published_has_reviews": F.expr("grade <> 'candidate' AND `count` < 3"),
            "place_in_country": F.expr("NOT (lat BETWEEN 33 AND 39 AND lng BETWEEN 124 AND 132)"),
            "grade_known": F.expr("grade NOT IN ('verified', 'reference', 'candidate')"),
            "price_per_size": F.expr("price > 1500 AND `count` < 5"),
        }),
        quality.failing(o, "o_orderkey", {"order_total_positive": F.expr("o_totalprice <= 0"), "order_priority_known": F.expr("o_orderpriority IS NULL OR o_orderpriority NOT LIKE '_-%'")}),
        quality.failing(l, "l_orderkey", {
            "line_has_order": F.expr("o_orderkey IS NULL"),
            "ship_after_order": F.expr("l_shipdate < o_orderdate"),
            "discount_range": F.expr("NOT l_discount BETWEEN 0 AND 0.1"),
            "return_flag_known": F.expr("l_returnflag NOT IN ('A', 'N', 'R')"),
            "shipped_before_receipt": F.expr("l_quantity > 49 AND l_tax > 0.07"),
        }),
        quality.failing(p.groupBy("name").count(), "name", {"repeated_names": F.expr("`count` > 110")}),
        quality.failing(s, "s_suppkey", {"negative_balance": F.expr("s_acctbal < 500"), "supplier_nation_known": F.expr("s_nationkey NOT BETWEEN 0 AND 24")}),
    )


@query(
    "string_functions",
    r"""SELECT page_id, split_part(url, '/', 3) AS host, nullif(regexp_extract(url, 'page=([0-9]+)', 1), '') AS page, position('/' IN url)::INTEGER AS slash, replace(left(url, 8), 'http', 'H') AS head, length(trim(url))::INTEGER AS n, len(string_split(url, '/'))::INTEGER AS parts, md5(url || '|x') AS sum FROM pages""",
)
def string_functions(spark, sf):
    u = F.col("url")
    return load(spark, sf, "pages").select(
        "page_id",
        F.split_part(u, F.lit("/"), F.lit(3)).alias("host"),
        F.nullif(F.regexp_extract(u, r"page=([0-9]+)", 1), F.lit("")).alias("page"),
        F.locate("/", u).alias("slash"),
        F.replace(F.left(u, F.lit(8)), F.lit("http"), F.lit("H")).alias("head"),
        F.length(F.trim(u)).alias("n"),
        F.size(F.split(u, "/")).alias("parts"),
        F.md5(F.concat(u, F.lit("|x")).cast("binary")).alias("sum"),
    )


@query(
    "date_functions",
    """SELECT o_orderkey AS id, date_trunc('month', o_orderdate)::TIMESTAMP AS month, extract(hour FROM o_orderdate + INTERVAL 9 HOUR)::INTEGER AS hour, dayofweek(o_orderdate)::INTEGER AS dow, epoch(o_orderdate)::BIGINT AS epoch, strftime(o_orderdate, '%m-%d') AS label, try_strptime(replace(strftime(o_orderdate, '%Y.%m.%d'), '.', '-'), '%Y-%m-%d')::DATE AS parsed, (o_orderdate + INTERVAL 5 DAY)::TIMESTAMP AS later FROM orders""",
)
def date_functions(spark, sf):
    d = F.col("o_orderdate")
    return load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.date_trunc("month", d).alias("month"),
        F.hour(F.from_utc_timestamp(d, "Asia/Seoul")).alias("hour"),
        (F.dayofweek(d) - 1).alias("dow"),
        F.unix_timestamp(d).alias("epoch"),
        F.date_format(d, "MM-dd").alias("label"),
        F.try_to_date(F.replace(F.date_format(d, "yyyy.MM.dd"), F.lit("."), F.lit("-"))).alias("parsed"),
        (d + F.expr("INTERVAL 5 DAYS")).alias("later"),
    )


@query(
    "array_and_json_functions",
    f"""WITH {PLACES}, {SCORES} SELECT id, nullif(list_position(string_split(name, ' '), 'ring'), 0)::INTEGER AS at, array_to_string(list_distinct([dong, area, dong]), '+') IS NOT NULL AS ok, s_roast + s_work AS two, len(list_filter([{", ".join(f"s_{a}" for a in AXES)}], lambda x: x > 5))::INTEGER AS strong FROM scored""",
)
def array_and_json_functions(spark, sf):
    s = axis_scores(spark, sf)
    return s.select(
        "id",
        F.nullif(F.array_position(F.split("name", " "), "ring"), F.lit(0)).cast("int").alias("at"),
        (F.size(F.array_distinct(F.array("dong", "area", "dong"))) > 0).alias("ok"),
        (F.get_json_object(F.to_json("scores"), "$.roast").cast("int") + F.col("scores")["work"]).alias("two"),
        F.size(F.map_filter("scores", lambda k, v: v > 5)).alias("strong"),
    )


@query("rounding", "SELECT l_orderkey AS id, l_linenumber AS line, round(l_extendedprice / 7, 2) AS half_up, floor(l_extendedprice / 7 + 0.5)::BIGINT AS half_to_plus, l_orderkey // 7 AS whole, l_partkey, l_suppkey FROM lineitem")
def rounding(spark, sf):
    x = F.col("l_extendedprice") / 7
    return load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.round(x, 2).alias("half_up"), F.floor(x + 0.5).alias("half_to_plus"), F.floor(F.col("l_orderkey") / 7).cast("long").alias("whole"), "l_partkey", "l_suppkey")


@query(
    "best_sentences",
    r"""WITH s AS (SELECT item_id, text, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?…])[ \t\r]+', '\1' || chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^[ \t\r]+|[ \t\r]+$', '', 'g')), lambda x: length(x) >= 5) AS s FROM benchmark),
    p AS (SELECT item_id, unnest(s) AS q, unnest(range(len(s))) AS i FROM s),
    b AS (SELECT item_id, arg_max(q, (NOT regexp_matches(q, '(?:\.{3}|…)$'), CASE WHEN contains(lower(q), 'tion') THEN 3 ELSE 0 END + CASE WHEN contains(lower(q), 'the ') THEN 1 ELSE 0 END - CASE WHEN contains(lower(q), 'license') THEN 5 ELSE 0 END, -i)) AS q FROM p GROUP BY 1),
    """
    + f"""m AS (SELECT item_id, {sql_without_contacts('coalesce(q, text)')} AS q FROM s LEFT JOIN b USING (item_id))
    SELECT item_id, CASE WHEN length(q) <= 90 THEN q ELSE left(q, 90) || '…' END AS quote FROM m""",
)
def best_sentences(spark, sf):
    return load(spark, sf, "benchmark").select("item_id", tx.best_sentence(F.col("text"), {"tion": 3, "the ": 1, "license": -5}).alias("quote"))
