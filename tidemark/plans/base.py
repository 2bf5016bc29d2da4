"""Registration of queries with their SQL equivalents, and the stand-ins that map test tables to the domain's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as tx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under a name; ``sql`` gives the same rows in DuckDB."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_without_contacts(text: str) -> str:
    """``without_contacts`` in DuckDB."""
    words = rf"list_filter(regexp_split_to_array(coalesce({text}, ''), '[ \t\r\n]+'), lambda w: w <> '' AND NOT regexp_matches(w, '@.'))"
    return f"regexp_replace(array_to_string({words}, ' '), '{tx.number_pattern()}', '[tel]', 'g')"


SOURCES = ("direct", "direct", "semrush", "direct", "instagram", "direct", "naver", "spam")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The traffic log: events as page visits (anon_id, ts, kind, k, path, src, duration_ms)."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    kind = F.col("event_type")
    path = F.when(kind == "view", F.concat(F.lit("/area/"), k)).when(kind == "click", F.concat(F.lit("/c/"), k)).otherwise(F.concat(F.lit("/"), kind))
    src = F.element_at(F.array(*[F.lit(s) for s in SOURCES]), k % len(SOURCES) + 1)
    return load(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("anon_id"), "ts", kind.alias("kind"), k.alias("k"), path.alias("path"), src.alias("src"), F.floor(F.col("value") * 1000).cast("long").alias("duration_ms")
    )


VISITS = f"""visits AS (
  SELECT event_id, user_id AS anon_id, ts, event_type AS kind, k,
         CASE event_type WHEN 'view' THEN '/area/' || k WHEN 'click' THEN '/c/' || k ELSE '/' || event_type END AS path,
         ({list(SOURCES)!r})[k % {len(SOURCES)} + 1] AS src, floor(value * 1000)::BIGINT AS duration_ms
  FROM (SELECT *, regexp_extract(props, '([0-9]+)', 1)::INTEGER AS k FROM events)
)"""


#: Hosts of the example site and of its previews.
OWN_HOST, PREVIEW_HOST = "example.org", "preview.example.net"


def visitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visitor state (anon_id, user_agent, referrer, agreed, internal, sessions) made from customers; agreed may be null."""
    c = load(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    agents = F.array(*[F.lit(x) for x in AGENTS])
    return c.select(
        key.alias("anon_id"),
        F.element_at(agents, (F.col("c_nationkey") % len(AGENTS) + 1).cast("int")).alias("user_agent"),
        F.when(key % 11 == 0, "https://example.org/?cafe=1").when(key % 13 == 0, f"https://{PREVIEW_HOST}/").otherwise("").alias("referrer"),
        F.when(key % 3 == 0, True).when(key % 3 == 1, False).alias("agreed"),
        (key % 37 == 0).alias("internal"),
        (key % 4).cast("int").alias("sessions"),
    )


AGENTS = ("Mozilla iPhone Mobile", "Mozilla Windows", "Googlebot/2.1", "Mozilla Android Mobile", "HeadlessChrome")
VISITORS = f"""visitors AS (
  SELECT c_custkey AS anon_id, ({list(AGENTS)!r})[c_nationkey % {len(AGENTS)} + 1] AS user_agent,
         CASE WHEN c_custkey % 11 = 0 THEN 'https://example.org/?cafe=1' WHEN c_custkey % 13 = 0 THEN 'https://{PREVIEW_HOST}/' ELSE '' END AS referrer,
         CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS agreed, c_custkey % 37 = 0 AS internal, (c_custkey % 4)::INTEGER AS sessions
  FROM customer
)"""


def day_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole log with a visitor id for each person and day, as devices that forget their id over night give."""
    return visits(spark, sf_dir).withColumn("anon_id", F.col("anon_id") * 100 + F.dayofmonth("ts"))


def day_visitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of the visitors of ``day_visits``."""
    own = day_visits(spark, sf_dir).select(F.col("anon_id").alias("day_id")).distinct()
    return own.join(visitors(spark, sf_dir), F.floor(F.col("day_id") / 100) == F.col("anon_id")).drop("anon_id").withColumnRenamed("day_id", "anon_id")


DAY_VISITS = """day_visits AS (SELECT * REPLACE (anon_id * 100 + day(ts) AS anon_id) FROM visits)"""
DAY_VISITORS = """day_visitors AS (SELECT d.anon_id, u.* EXCLUDE (anon_id) FROM (SELECT DISTINCT anon_id FROM day_visits) d JOIN visitors u ON u.anon_id = d.anon_id // 100)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue: parts as places (id, name, area, dong, count, grade, lat, lng, price)."""
    p, key = load(spark, sf_dir, "part"), F.col("p_partkey")
    return p.select(
        key.alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("area"),
        F.col("p_type").alias("dong"),
        F.col("p_size").alias("count"),
        F.when(F.col("p_size") >= 30, "verified").when(F.col("p_size") >= 3, "reference").otherwise("candidate").alias("grade"),
        (F.lit(37.0) + (key * 37 % 1000) / 2000.0).alias("lat"),
        (F.lit(126.5) + (key * 91 % 1000) / 2000.0).alias("lng"),
        F.col("p_retailprice").alias("price"),
    )


PLACES = """places AS (
  SELECT p_partkey AS id, p_name AS name, p_brand AS area, p_type AS dong, p_size AS count,
         CASE WHEN p_size >= 30 THEN 'verified' WHEN p_size >= 3 THEN 'reference' ELSE 'candidate' END AS grade,
         37.0::DOUBLE + (p_partkey * 37 % 1000) / 2000.0::DOUBLE AS lat, 126.5::DOUBLE + (p_partkey * 91 % 1000) / 2000.0::DOUBLE AS lng, p_retailprice AS price
  FROM part
)"""

AXES = ("roast", "work", "quiet", "dessert", "mood", "space")


def axis_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places with ``scores``: mentions by taste axis as a map, from the key's digits."""
    entries = [x for i, a in enumerate(AXES) for x in (F.lit(a), ((F.col("id") * (7 + 2 * i) + i) % (11 + 4 * i)).cast("int"))]
    return places(spark, sf_dir).withColumn("scores", F.create_map(*entries))


SCORES = "scored AS (SELECT *, " + ", ".join(f"((id * {7 + 2 * i} + {i}) % {11 + 4 * i})::INTEGER AS s_{a}" for i, a in enumerate(AXES)) + " FROM places)"
LONG_SCORES = "axis_rows AS (" + " UNION ALL ".join(f"SELECT id, area, count, '{a}' AS axis, {i} AS axis_no, s_{a} AS mentions FROM scored" for i, a in enumerate(AXES)) + ")"
