"""Queries of names, addresses, rules and searches: parts and documents stand in for places and their texts."""

from pyspark.sql import functions as F

from tidemark.operators import names
from tidemark.plans.base import load, query

# ---------------------------------------------------------------- names

GENERIC, SUFFIX, BRANCH = ("cafe", "coffee", "widget", "best"), "(cafe|store)$", "store$"
TAILS = ("best", "24", "cafe")
_NAMED = """named AS (SELECT p_partkey AS id, [lower(p_brand), 'north'] AS areas, p_name || CASE p_partkey % 5 WHEN 0 THEN ' cafe' WHEN 1 THEN ' ' || lower(p_brand) || 'store' WHEN 2 THEN ' 24' WHEN 3 THEN ' coffee, best' ELSE '' END AS name FROM part)"""
_WORDS = f"""words AS (SELECT *, list_filter(list_transform(list_filter(regexp_split_to_array(lower(coalesce(name, '')), '[ \\t,.;:]+'), lambda w: w <> ''), lambda w: {{'core': regexp_replace(w, '{SUFFIX}', ''), 'branch': regexp_matches(w, '{BRANCH}')}}),
    lambda m: length(m.core) >= 2 AND m.core NOT IN {GENERIC!r} AND len(list_filter(areas, lambda a: a = m.core OR contains(a, m.core) OR (contains(m.core, a) AND length(m.core) - length(a) <= 1))) = 0) AS k0 FROM named),
  own AS (SELECT *, CASE WHEN len(list_filter(k0, lambda m: NOT m.branch)) > 0 THEN list_filter(k0, lambda m: NOT m.branch) ELSE k0 END AS k1 FROM words),
  told AS (SELECT id, name, list_transform(CASE WHEN len(list_filter(k1, lambda m: NOT regexp_matches(m.core, '^[0-9]+$'))) > 0 THEN list_filter(k1, lambda m: NOT regexp_matches(m.core, '^[0-9]+$')) ELSE k1 END, lambda m: m.core) AS words FROM own)"""


def named(spark, sf):
    """(id, name, areas): parts with trade words, branches and numbers in their names."""
    k, brand = F.col("p_partkey"), F.lower("p_brand")
    more = F.when(k % 5 == 0, " cafe").when(k % 5 == 1, F.concat(F.lit(" "), brand, F.lit("store"))).when(k % 5 == 2, " 24").when(k % 5 == 3, " coffee, best").otherwise("")
    return load(spark, sf, "part").select(k.alias("id"), F.concat("p_name", more).alias("name"), F.array(brand, F.lit("north")).alias("areas"))


@query("distinctive_words", f"WITH {_NAMED}, {_WORDS} SELECT id, array_to_string(words, '|') AS words FROM told")
def distinctive_words(spark, sf):
    words = names.distinctive_words(F.col("name"), F.col("areas"), GENERIC, SUFFIX, BRANCH)
    return named(spark, sf).select("id", F.array_join(words, "|").alias("words"))


VENUE, SCRIPTS = "(ring|tower|park)", ("[a-z]", "[0-9]")
_GLUED = """glued AS (SELECT p_partkey AS id, [lower(p_brand), 'north'] AS areas, p_name || CASE p_partkey % 6 WHEN 0 THEN '24cafe' WHEN 1 THEN ' ' || lower(p_brand) || 'store' WHEN 2 THEN ' park, 7' WHEN 3 THEN ' tower' || p_size WHEN 4 THEN ' best;' ELSE 'store ring' END AS name FROM part)"""
_IS_VENUE = f"(regexp_matches(m.raw, '{VENUE}') OR regexp_matches(m.core, '{VENUE}'))"
_RATHER = lambda items, weak: f"CASE WHEN len(list_filter({items}, lambda m: NOT {weak})) > 0 THEN list_filter({items}, lambda m: NOT {weak}) ELSE {items} END"


@query(
    "word_signals",
    f"""WITH {_GLUED}, b AS (SELECT id, areas, list_filter(regexp_split_to_array(lower(name), '[ \\t]+'), lambda w: w <> '') AS ws FROM glued),
    p AS (SELECT id, areas, flatten(list_transform(ws, lambda w: list_transform(string_split(regexp_replace(regexp_replace(w, '([a-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([a-z])', '\\1 \\2', 'g'), ' '), lambda x: {{'raw': x, 'branch': regexp_matches(w, '{BRANCH}')}}))) AS ps FROM b),
    c AS (SELECT *, list_filter(list_transform(ps, lambda m: {{'raw': m.raw, 'core': regexp_replace(regexp_replace(m.raw, '[,.;:]+$', ''), '{SUFFIX}', ''), 'branch': m.branch}}), lambda m: length(m.core) >= 2 AND m.core NOT IN {GENERIC!r} AND len(list_filter(areas, lambda a: a = m.core OR contains(a, m.core) OR (contains(m.core, a) AND length(m.core) - length(a) <= 1))) = 0) AS k FROM p),
    d AS (SELECT *, {_RATHER("k", "m.branch")} AS pool FROM c), e AS (SELECT *, {_RATHER("pool", _IS_VENUE)} AS final FROM d), f AS (SELECT *, {_RATHER("final", "regexp_matches(m.core, '^[0-9]+$')")} AS strong FROM e)
    SELECT id, array_to_string(list_transform(strong, lambda m: m.core), '|') AS words, len(pool) > 0 AND len(list_filter(pool, lambda m: NOT {_IS_VENUE})) = 0 AS venue_only,
      len(list_filter(ps, lambda m: regexp_matches(m.raw, '{VENUE}'))) > 0 AND len(final) > 0 AND len(list_filter(final, lambda m: {_IS_VENUE})) = 0 AS venue_left_out FROM f""",
)
def word_signals(spark, sf):
    """Names with numbers and trade words written together, and words of buildings that many share."""
    k, brand = F.col("p_partkey"), F.lower("p_brand")
    more = F.when(k % 6 == 0, "24cafe").when(k % 6 == 1, F.concat(F.lit(" "), brand, F.lit("store"))).when(k % 6 == 2, " park, 7").when(k % 6 == 3, F.concat(F.lit(" tower"), "p_size")).when(k % 6 == 4, " best;").otherwise("store ring")
    own = load(spark, sf, "part").select(k.alias("id"), F.concat("p_name", more).alias("name"), F.array(brand, F.lit("north")).alias("areas"))
    own = own.repartition("id")  # a small file is one task's, but each row is much work
    got = own.select("id", names.word_signals(F.col("name"), F.col("areas"), GENERIC, SUFFIX, BRANCH, VENUE, SCRIPTS).alias("s"))
    return got.select("id", F.array_join("s.words", "|").alias("words"), "s.venue_only", "s.venue_left_out")


@query("cleaned_names", f"WITH {_NAMED}, w AS (SELECT id, name, regexp_split_to_array(trim(name), '[ \\t]+') AS ws FROM named) SELECT id, array_to_string(ws[1:greatest(list_max(list_transform(range(len(ws)), lambda i: CASE WHEN lower(ws[i + 1]) NOT IN {TAILS!r} OR i = 0 THEN i END)) + 1, 1)], ' ') AS name FROM w")
def cleaned_names(spark, sf):
    return named(spark, sf).select("id", names.cleaned_name(F.col("name"), TAILS).alias("name"))


SHOPS = ("The House", "Und Heit", "Que Les Eau", "Ther", "Cafe", "Tionst Store")
CONTEXT = "(tion|heit|eau)"
_SHOPS = f"""shops AS (SELECT DISTINCT source AS id, ({list(SHOPS)!r})[substr(source, 4)::INTEGER % {len(SHOPS)} + 1] AS name FROM documents), named AS (SELECT *, ['house', 'rest'] AS areas FROM shops)"""
_SQUEEZED = "regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_SPACED = "' ' || regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')"
_BY_WORD = f"len(list_filter(words, lambda w: contains({_SPACED}, ' ' || w))) > 0"


def shops(spark, sf):
    """(id, name, words): the sources of documents as places with names."""
    number = F.substring("source", 4, 9).cast("int") % len(SHOPS) + 1
    own = load(spark, sf, "documents").select(F.col("source").alias("id")).distinct().withColumn("source", F.col("id")).withColumn("name", F.element_at(F.array(*[F.lit(s) for s in SHOPS]), number))
    return own.select("id", "name", names.distinctive_words(F.col("name"), F.array(F.lit("house"), F.lit("rest")), GENERIC, SUFFIX, BRANCH).alias("words"))


@query(
    "name_coherence",
    f"""WITH {_SHOPS}, {_WORDS}, h AS (SELECT told.id, CASE WHEN len(words) = 0 THEN length({_SQUEEZED.format('name')}) >= 4 AND contains({_SQUEEZED.format('text')}, {_SQUEEZED.format('name')}) AND regexp_matches(lower(text), '{CONTEXT}')
      ELSE (length({_SQUEEZED.format('name')}) >= 4 AND contains({_SQUEEZED.format('text')}, {_SQUEEZED.format('name')})) OR {_BY_WORD} END AS hit FROM told JOIN documents d ON d.source = told.id WHERE coalesce(text, '') <> '')
    SELECT told.id, count(hit) AS quotes, round(coalesce(avg(hit::INTEGER), 1), 6) AS coherence FROM told LEFT JOIN h USING (id) GROUP BY 1""",
)
def name_coherence(spark, sf):
    out = names.coherence(shops(spark, sf), load(spark, sf, "documents").select(F.col("source").alias("id"), "text"), "id", CONTEXT)
    return out.withColumn("coherence", F.round("coherence", 6))


@query(
    "quote_confidence",
    f"""WITH {_SHOPS}, {_WORDS}, q AS (SELECT doc_id, text, words, {_SQUEEZED.format('name')} AS plain, {_SQUEEZED.format('text')} AS sq FROM told JOIN documents d ON d.source = told.id),
    f AS (SELECT *, len(words) = 1 AND words[1] = plain AS sole, len(list_filter(words, lambda w: NOT (w IN ('the', 'und') OR regexp_matches(w, '^[0-9]+$') OR length(w) <= 2))) = 0 AS all_weak FROM q)
    SELECT doc_id, (CASE WHEN sole AND (all_weak OR length(plain) <= 4) THEN length(plain) >= 2 AND contains(sq, plain) AND regexp_matches(lower(text), '{CONTEXT}') WHEN NOT coalesce(sole, false) AND length(plain) >= 4 AND contains(sq, plain) THEN true WHEN all_weak OR len(words) = 0 THEN false ELSE {_BY_WORD} END)::INTEGER AS confidence FROM f""",
)
def quote_confidence(spark, sf):
    quotes = load(spark, sf, "documents").select("doc_id", F.col("source").alias("id"), "text").join(shops(spark, sf), "id")
    return quotes.select("doc_id", names.quote_confidence(F.col("text"), F.col("name"), F.col("words"), ("the", "und"), CONTEXT).alias("confidence"))


# ---------------------------------------------------------------- addresses

#: A small example of a gazetteer: provinces with their districts, and what addresses of a province begin with.
GAZETTEER = [("서울", "강남구"), ("서울", "중구"), ("서울", "강동구"), ("부산", "중구"), ("부산", "해운대구"), ("경기", "수원시"), ("경기", "광주시"), ("광주", "북구"), ("전남", "여수시"), ("대구", "북구")]
PREFIXES = [("서울", "서울"), ("부산", "부산"), ("경기", "경기"), ("광주광역시", "광주"), ("전라남도", "전남"), ("전남", "전남"), ("대구", "대구")]
#: Parts of addresses: a customer's key and nation choose one of each, so addresses are as many as customers.
_HEADS = ("서울특별시", "부산광역시", "경기도", "광주광역시", "전라남도", "", "대구광역시", "Seoul", "서울")
_DISTRICTS = ("강남구", "중구", "강동구", "해운대구", "수원시", "광주시", "북구", "여수시", "서구", "")
_DONG_NAMES = ("역삼동", "명동2가", "남포동", "오포읍", "용봉동", "화양면", "", "천호1동")
_PICK = lambda items, n: f"({list(items)!r})[{n} % {len(items)} + 1]"
_ADDRESSES = f"addresses AS (SELECT c_custkey AS id, trim(concat_ws(' ', {_PICK(_HEADS, 'c_nationkey')}, {_PICK(_DISTRICTS, 'c_custkey')}, {_PICK(_DONG_NAMES, '(c_custkey // 10)')}, c_name)) AS address FROM customer)"
_PROVINCE = "CASE " + " ".join(f"WHEN starts_with(trim(address), '{p}') THEN '{v}'" for p, v in PREFIXES) + " END"


def addresses(spark, sf):
    """(id, address): each customer's own address."""
    pick = lambda items, n: F.element_at(F.array(*[F.lit(x) for x in items]), (n % len(items) + 1).cast("int"))
    k = F.col("c_custkey")
    at = F.trim(F.concat_ws(" ", pick(_HEADS, F.col("c_nationkey")), pick(_DISTRICTS, k), pick(_DONG_NAMES, F.floor(k / 10)), "c_name"))
    return load(spark, sf, "customer").select(k.alias("id"), at.alias("address"))


@query("province_case", f"WITH {_ADDRESSES} SELECT {_PROVINCE} AS province, count(*) AS n FROM addresses GROUP BY 1")
def province_case(spark, sf):
    return addresses(spark, sf).groupBy(names.province_of(F.trim("address"), PREFIXES).alias("province")).agg(F.count("*").alias("n"))


@query(
    "address_parts",
    f"""WITH {_ADDRESSES}, g(province, district) AS (VALUES {", ".join(map(repr, GAZETTEER))}), only_ AS (SELECT district, count(DISTINCT province) AS provinces FROM g GROUP BY 1),
    o AS (SELECT id, {_PROVINCE} AS own, regexp_extract_all(address, '([가-힣]+(?:구|시|군))(?:[^가-힣]|$)', 1) AS ws, nullif(regexp_extract(address, '(?:구|시|군) +([가-힣]+[0-9]?(?:동|읍|면|가))(?:[^가-힣]|$)', 1), '') AS dong FROM addresses),
    w AS (SELECT id, own, unnest(ws) AS district, unnest(range(len(ws))) AS no FROM o), f AS (SELECT id, arg_min(province, no) AS province, arg_min(district, no) AS district FROM w JOIN g USING (district) JOIN only_ USING (district) WHERE province = own OR (own IS NULL AND provinces = 1) GROUP BY 1)
    SELECT o.id, coalesce(own, province) AS province, district, dong FROM o LEFT JOIN f USING (id)""",
)
def address_parts(spark, sf):
    gazetteer = spark.createDataFrame(GAZETTEER, "province string, district string")
    return names.address_parts(addresses(spark, sf), "id", "address", gazetteer, PREFIXES)


_KINDS = [("province", {"서울": "서울", "부산": "부산"}), ("district", {"강남구": "강남구", "강남": "강남구", "해운대": "해운대구"}), ("dong", {"역삼": "역삼동", "역삼동": "역삼동", "우동": "우동"})]
_PLACES_SAID = ("강남", "서울", "역삼카페", "해운대맛집", "우동", "quiet", "강남구청역", "", "역삼동", "우동맛집")
_Q_SQL = f"searches AS (SELECT doc_id AS id, string_split(concat_ws(' ', w[1], ({list(_PLACES_SAID)!r})[doc_id % {len(_PLACES_SAID)} + 1], w[2], ({list(_PLACES_SAID)!r})[doc_id // 7 % {len(_PLACES_SAID)} + 1]), ' ') AS ws FROM (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS w FROM documents))"


@query(
    "region_of_search",
    f"""WITH {_Q_SQL}, r(no, kind, name, region) AS (VALUES {", ".join(f"({i}, '{k}', '{n}', '{v}')" for i, (k, m) in enumerate(_KINDS) for n, v in m.items())}), s AS (SELECT DISTINCT ws FROM searches),
    e AS (SELECT ws, arg_min({{'kind': kind, 'region': region}}, (no, name)) AS hit FROM s JOIN r ON list_contains(ws, name) GROUP BY 1),
    p AS (SELECT ws, arg_max({{'kind': kind, 'region': region}}, (length(name), name)) AS hit FROM s JOIN r ON len(list_filter(ws, lambda w: starts_with(w, name) AND regexp_matches(substr(w, length(name) + 1), '^(?:카페|맛집)'))) > 0 GROUP BY 1)
    SELECT id, coalesce(e.hit, p.hit).kind AS kind, coalesce(e.hit, p.hit).region AS region FROM searches LEFT JOIN e USING (ws) LEFT JOIN p USING (ws)""",
)
def region_of_search(spark, sf):
    """Searches made of words of each document with names of places between them."""
    said = lambda n: F.element_at(F.array(*[F.lit(x) for x in _PLACES_SAID]), (n % len(_PLACES_SAID) + 1).cast("int"))
    w, i = F.split(F.coalesce("text", F.lit("")), " "), F.col("doc_id")
    words = F.split(F.concat_ws(" ", F.get(w, F.lit(0)), said(i), F.get(w, F.lit(1)), said(F.floor(i / 7))), " ")
    found = names.region_of_query(words, _KINDS, "카페|맛집")
    return load(spark, sf, "documents").select(i.alias("id"), found.alias("f")).select("id", "f.kind", "f.region")


# ---------------------------------------------------------------- rules

#: A rule table as data, in the order of its stages: final rejections, categories, holds, then caps.
RULES = [
    names.TextRule("a closed", "closed", "body", "gnu general", "reject", 0),
    names.TextRule("b advertising", "paid post", "body", "mit license", "reject", 5, unless="apache"),
    names.TextRule("b advertising", "own account", "title", "^[0-9]{3}-", "reject", 5),
    names.TextRule("c other trade", "tables", "body", " [|] .* [|] ", "reject", 8),
    names.TextRule("d shouting", "marks", "body", "!! .*!! ", "reject", 10),
    names.TextRule("e empty", "no letters", "body", r"^[^\p{L}]*$", "reject", 0),
    names.TextRule("f symbols", "symbols in title", "title", "[*]{3}", "hold", 20),
    names.TextRule("g short", "short", "body", r"^(?s:.{0,80})$", "hold", 22),
    names.TextRule("h repeats", "word again", "title", "(de de de|the the the|und und und)", "hold", 25, unless="tion"),
    names.TextRule("i list", "numbered", "title", "^[0-9]+[.] ", "cap", 55),
    names.TextRule("k borrowed", "licensed", "body", "creative commons", "cap", 59),
    names.TextRule("l mixed", "two languages", "body", " the .* und | und .* the ", "cap", 57, unless=" que "),
]


@query(
    "rule_table",
    f"""WITH d AS (SELECT doc_id, lower(text) AS body, lower(string_split(text, chr(10))[1]) AS title, CASE WHEN doc_id % 3 = 0 THEN 'reference' ELSE 'verified' END AS v, (40 + doc_id % 60)::INTEGER AS s FROM documents),
    r(no, stage, rule, action, score) AS (VALUES {", ".join(f"({i}, '{r.stage}', '{r.name}', '{r.action}', {r.score})" for i, r in enumerate(RULES))}),
    m AS (SELECT *, CASE {" ".join(f"WHEN {r.sql()} THEN {i}" for i, r in enumerate(RULES))} END AS no FROM d)
    SELECT doc_id, CASE WHEN action IN ('reject', 'hold') THEN 'rejected' WHEN action = 'cap' AND v = 'verified' THEN 'reference' ELSE v END AS verdict, CASE WHEN action IN ('reject', 'hold') THEN score WHEN action = 'cap' THEN least(s, score) ELSE s END AS score,
      rule, stage, coalesce(action = 'hold', false) AS borderline FROM m LEFT JOIN r USING (no)""",
)
def rule_table(spark, sf):
    i = F.col("doc_id")
    texts = load(spark, sf, "documents").select("doc_id", F.lower("text").alias("body"), F.lower(F.split("text", "\n")[0]).alias("title"), F.when(i % 3 == 0, "reference").otherwise("verified").alias("verdict"), (40 + i % 60).cast("int").alias("score"))
    return names.apply_rules(texts, RULES).drop("body", "title")
