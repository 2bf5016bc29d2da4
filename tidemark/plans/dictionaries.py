"""Queries of dictionaries that are tables, of similar names and of places in texts."""

from pyspark.sql import functions as F

from tidemark.operators import dictionary, names, similar_names
from tidemark.plans.base import load, query
from tidemark.plans.domain import BRANCH, GENERIC, SUFFIX

# ---------------------------------------------------------------- terms and rules

_TERMS = r"""terms AS (SELECT DISTINCT w AS term FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM benchmark) WHERE length(w) >= 6)"""
_RULES = f"""{_TERMS}, rules AS (SELECT row_number() OVER (ORDER BY length(term) DESC, term) AS no, 's' || (length(term) % 4) AS stage, 'term ' || term AS rule, term, (['reject', 'hold', 'cap'])[length(term) % 3 + 1] AS action, (length(term) * 3 % 60)::INTEGER AS points FROM terms)"""


def terms(spark, sf):
    """(term): the longer words of the benchmark texts, a dictionary as a table."""
    words = load(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("term"))
    return words.where(F.char_length("term") >= 6).distinct()


def term_rules(spark, sf):
    """The dictionary as a table of rules: longer terms decide first; numbers come from counts of longer and smaller terms."""
    own = terms(spark, sf)
    size = F.char_length("term")
    action = F.element_at(F.array(F.lit("reject"), F.lit("hold"), F.lit("cap")), size % 3 + 1)
    return own.select(F.struct((-size).alias("n"), "term").alias("no"), F.concat(F.lit("s"), size % 4).alias("stage"), F.concat(F.lit("term "), "term").alias("rule"), "term", action.alias("action"), (size * 3 % 60).cast("int").alias("points"))


@query("dictionary_hits", f"WITH {_TERMS}, d AS (SELECT doc_id, lower(text) AS text FROM documents WHERE text IS NOT NULL) SELECT doc_id, count(*) AS terms, min(term) AS first_term, min(strpos(text, term) - 1)::INTEGER AS start FROM d JOIN terms ON contains(text, term) GROUP BY 1")
def dictionary_hits(spark, sf):
    hits = dictionary.term_hits(load(spark, sf, "documents").select("doc_id", F.lower("text").alias("text")), "doc_id", "text", terms(spark, sf))
    return hits.groupBy("doc_id").agg(F.count("*").alias("terms"), F.min("term").alias("first_term"), F.min("start").alias("start"))


@query(
    "term_rule_table",
    f"""WITH {_RULES}, d AS (SELECT doc_id, lower(text) AS body, CASE WHEN doc_id % 3 = 0 THEN 'reference' ELSE 'verified' END AS v, (40 + doc_id % 60)::INTEGER AS s FROM documents),
    f AS (SELECT doc_id, min(no) AS no FROM d JOIN rules ON contains(body, term) GROUP BY 1)
    SELECT doc_id, CASE WHEN action IN ('reject', 'hold') THEN 'rejected' WHEN action = 'cap' AND v = 'verified' THEN 'reference' ELSE v END AS verdict, CASE WHEN action IN ('reject', 'hold') THEN points WHEN action = 'cap' THEN least(s, points) ELSE s END AS score,
      rule, stage, coalesce(action = 'hold', false) AS borderline FROM d LEFT JOIN f USING (doc_id) LEFT JOIN rules USING (no)""",
)
def term_rule_table(spark, sf):
    i = F.col("doc_id")
    texts = load(spark, sf, "documents").select("doc_id", F.lower("text").alias("body"), F.when(i % 3 == 0, "reference").otherwise("verified").alias("verdict"), (40 + i % 60).cast("int").alias("score"))
    return dictionary.apply_term_rules(texts, "doc_id", "body", term_rules(spark, sf)).drop("body")


# ---------------------------------------------------------------- names

_NAMES = r"""labels_ AS (SELECT doc_id AS id, array_to_string(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n]+'), lambda w: w <> '')[1:3], ' ') AS name FROM documents)"""
_PLAIN = r"lower(regexp_replace(coalesce(name, ''), '[^\p{L}\p{N}]', '', 'g'))"
_PIECES = "CASE WHEN length(plain) >= 2 THEN list_distinct(list_transform(range(1, length(plain)), lambda i: substr(plain, i, 2))) ELSE [plain] END"
LEAST = 0.6


def titles(spark, sf):
    """(id, name): the first three words of each document."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \t\n]+"), lambda w: w != "")
    return load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.array_join(F.slice(words, 1, 3), " ").alias("name"))


@query(
    "similar_name_pairs",
    f"""WITH {_NAMES}, p AS (SELECT DISTINCT {_PLAIN} AS plain FROM labels_), s AS (SELECT plain, {_PIECES} AS g FROM p WHERE plain <> ''),
    j AS (SELECT x.plain AS a, y.plain AS b, len(list_intersect(x.g, y.g)) AS shared, len(x.g) + len(y.g) AS total FROM s x JOIN s y ON x.plain < y.plain)
    SELECT a, b, shared, round(shared / (total - shared), 9) AS similarity FROM j WHERE shared / (total - shared) >= {LEAST}""",
)
def similar_name_pairs(spark, sf):
    """Every two of the distinct titles with six tenths of their pieces in common."""
    return similar_names.similar_names(titles(spark, sf), "name", LEAST).select("a", "b", F.col("shared").cast("long").alias("shared"), F.round("similarity", 9).alias("similarity"))


SPELLINGS, TRADE = [("ph", "f"), ("ck", "k")], "(the|und|que|des)"
_STRIPPED = f"regexp_replace(replace(replace(regexp_replace(lower(coalesce(name, '')), '\\s+', '', 'g'), 'ph', 'f'), 'ck', 'k'), '{TRADE}', '', 'g')"


@query(
    "near_duplicate_titles",
    f"""WITH {_NAMES}, m AS (SELECT id, {_STRIPPED} AS plain FROM labels_), d AS (SELECT DISTINCT plain FROM m), l AS (SELECT a.plain AS x, b.plain AS y FROM d a JOIN d b ON a.plain <> b.plain AND length(a.plain) >= 4 AND contains(b.plain, a.plain)),
    n AS (SELECT p AS plain, count(*) AS links FROM (SELECT x AS p FROM l UNION ALL SELECT y FROM l) GROUP BY 1)
    SELECT id, plain, count(*) OVER (PARTITION BY plain) AS alike, coalesce(links, 0) AS links FROM m LEFT JOIN n USING (plain)""",
)
def near_duplicate_titles(spark, sf):
    """Each title with the rows that have the same stripped name and the other names that hold it or that it holds."""
    members, links = similar_names.near_duplicate_names(titles(spark, sf), "id", "name", SPELLINGS, TRADE)
    ends = links.select(F.explode(F.array("short", "long")).alias("plain")).groupBy("plain").agg(F.count("*").alias("links"))
    classes = members.groupBy("plain").agg(F.count("*").alias("alike")).join(ends, "plain", "left")
    return members.join(classes, "plain").select("id", "plain", "alike", F.coalesce("links", F.lit(0)).alias("links"))


_CORES = f"""cores AS (SELECT id, name, list_transform(CASE WHEN len(list_filter(k1, lambda m: NOT regexp_matches(m.core, '^[0-9]+$'))) > 0 THEN list_filter(k1, lambda m: NOT regexp_matches(m.core, '^[0-9]+$')) ELSE k1 END, lambda m: m.core) AS words FROM (
    SELECT *, CASE WHEN len(list_filter(k0, lambda m: NOT m.branch)) > 0 THEN list_filter(k0, lambda m: NOT m.branch) ELSE k0 END AS k1 FROM (
    SELECT *, list_filter(list_transform(list_filter(regexp_split_to_array(lower(coalesce(name, '')), '[ \\t,.;:]+'), lambda w: w <> ''), lambda w: {{'core': regexp_replace(w, '{SUFFIX}', ''), 'branch': regexp_matches(w, '{BRANCH}')}}), lambda m: length(m.core) >= 2 AND m.core NOT IN {GENERIC!r}) AS k0 FROM labels_)))"""
_SQ = lambda c: f"regexp_replace(lower({c}), '\\s+', '', 'g')"


@query(
    "brand_overlap",
    f"""WITH {_NAMES}, {_CORES}, p AS (SELECT a.id, a.id % 7 = 0 AS venue, a.words AS x, b.words AS y, {_SQ("a.name")} AS n, {_SQ("b.name")} AS m FROM cores a JOIN cores b ON b.id = a.id // 2),
    h AS (SELECT *, length(n) >= 2 AND (contains(m, n) OR contains(n, m)) AS whole, CASE WHEN len(y) > 0 THEN len(list_intersect(x, y)) > 0 ELSE len(list_filter(x, lambda w: contains(m, w))) > 0 END AS shared, venue OR len(list_filter(x, lambda w: length(w) > 2)) = 0 AS weak FROM p)
    SELECT id, CASE WHEN len(x) > 0 AND shared AND NOT weak THEN true ELSE whole END AS same_brand FROM h""",
)
def brand_overlap(spark, sf):
    """Whether a title and that of the document with half its number share a brand."""
    empty = F.array().cast("array<string>")
    own = titles(spark, sf).select("id", "name", names.distinctive_words(F.col("name"), empty, GENERIC, SUFFIX, BRANCH).alias("words"))
    other = own.select(F.col("id").alias("half"), F.col("name").alias("other"), F.col("words").alias("other_words"))
    pairs = own.withColumn("half", F.floor(F.col("id") / 2)).join(other, "half")
    return pairs.select("id", similar_names.brand_overlap(F.col("name"), F.col("words"), F.col("other"), F.col("other_words"), F.col("id") % 7 == 0).alias("same_brand"))


# ---------------------------------------------------------------- places

_GAZETTEER = """gazetteer AS (
      SELECT 'r' || r_regionkey AS region, lower(r_name) AS name, 1 AS level, NULL AS parent FROM region
      UNION ALL SELECT 'n' || n_nationkey, lower(replace(n_name, '_', ' ')), 2, 'r' || n_regionkey FROM nation
      UNION ALL SELECT 'p' || n_nationkey, 'port ' || (n_nationkey % 5), 3, 'n' || n_nationkey FROM nation
      UNION ALL SELECT 's' || s_suppkey, lower(replace(s_name, '#', ' ')), 3, 'n' || s_nationkey FROM supplier)"""
_PLACED = """texts AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN lower(r_name) || ', nation ' || n_nationkey WHEN 1 THEN 'port ' || (n_nationkey % 5) || ' in nation ' || n_nationkey WHEN 2 THEN 'near port ' || (n_nationkey % 5) || ', ' || lower(r_name)
      ELSE 'supplier ' || lpad((c_custkey % 200)::VARCHAR, 9, '0') || ' of ' || lower(c_name) END AS text FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""


def gazetteer(spark, sf):
    """(region, name, level, parent): regions, nations, and ports and suppliers below them; five port names are shared."""
    r, n, s = (load(spark, sf, t) for t in ("region", "nation", "supplier"))
    kind = lambda letter, c: F.concat(F.lit(letter), F.col(c))
    below = [
        n.select(kind("n", "n_nationkey").alias("region"), F.lower(F.replace("n_name", F.lit("_"), F.lit(" "))).alias("name"), F.lit(2).alias("level"), kind("r", "n_regionkey").alias("parent")),
        n.select(kind("p", "n_nationkey"), F.concat(F.lit("port "), F.col("n_nationkey") % 5), F.lit(3), kind("n", "n_nationkey")),
        s.select(kind("s", "s_suppkey"), F.lower(F.replace("s_name", F.lit("#"), F.lit(" "))), F.lit(3), kind("n", "s_nationkey")),
    ]
    out = r.select(kind("r", "r_regionkey").alias("region"), F.lower("r_name").alias("name"), F.lit(1).alias("level"), F.lit(None).cast("string").alias("parent"))
    for part in below:
        out = out.union(part)
    return out


@query(
    "places_in_texts",
    f"""WITH {_GAZETTEER}, {_PLACED}, h AS (SELECT id, name, level, region, parent, strpos(text, name) AS place FROM texts JOIN gazetteer ON regexp_matches(' ' || text || ' ', '[^a-z0-9]' || name || '[^a-z0-9]')),
    l AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.id = h.id AND length(o.name) > length(h.name) AND contains(o.name, h.name))),
    c AS (SELECT name, count(DISTINCT region) AS regions FROM gazetteer GROUP BY 1),
    m AS (SELECT l.* FROM l JOIN c USING (name) WHERE regions = 1 OR EXISTS (SELECT 1 FROM l u WHERE u.id = l.id AND u.region = l.parent))
    SELECT id, region, level::INTEGER AS level, name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY level DESC, length(name) DESC, place) AS rn FROM m) WHERE rn = 1""",
)
def places_in_texts(spark, sf):
    """Where a text of a customer is: shared port names need their nation beside them."""
    c, n, r = (load(spark, sf, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    port, nation, region = F.concat(F.lit("port "), F.col("n_nationkey") % 5), F.concat(F.lit("nation "), "n_nationkey"), F.lower("r_name")
    k = F.col("c_custkey") % 4
    text = F.when(k == 0, F.concat_ws(", ", region, nation)).when(k == 1, F.concat_ws(" in ", port, nation)).when(k == 2, F.concat(F.lit("near "), port, F.lit(", "), region))
    text = text.otherwise(F.concat(F.lit("supplier "), F.lpad((F.col("c_custkey") % 200).cast("string"), 9, "0"), F.lit(" of "), F.lower("c_name")))
    return dictionary.resolve_places(joined.select(F.col("c_custkey").alias("id"), text.alias("text")), "id", "text", gazetteer(spark, sf))
