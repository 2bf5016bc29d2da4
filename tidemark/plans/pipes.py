"""Queries that write and read files, and streams over the event log run to their end."""

from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.operators.traffic import SEARCH_ENGINES
from tidemark.plans.base import VISITORS, VISITS, load, query, visitors, visits
from tidemark.sources import files
from tidemark.sources.snapshots import SnapshotTable
from tidemark.streaming import stateful
from tidemark.streaming import traffic as stream

# ---------------------------------------------------------------- files

SUPPLIERS = "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"


@query("csv_round_trip", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_round_trip(spark, sf):
    path = files.scratch(spark, "suppliers-csv")
    files.write_csv(load(spark, sf, "supplier"), path)
    return files.read_csv(spark, path, SUPPLIERS)


@query("tsv_round_trip", "SELECT o_orderdate::DATE AS date, max(o_totalprice) AS value, o_orderpriority AS source FROM orders GROUP BY 1, 3")
def tsv_round_trip(spark, sf):
    path = files.scratch(spark, "series-tsv")
    series = load(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("source")).agg(F.max("o_totalprice").alias("value"))
    files.write_csv(series.select("date", "value", "source"), path, "\t")
    return files.read_tsv(spark, path, files.SERIES)


@query("ndjson_round_trip", "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def ndjson_round_trip(spark, sf):
    path = files.scratch(spark, "turns-json")
    files.write_json(load(spark, sf, "conversations"), path)
    turns = files.read_ndjson(spark, path, "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("part_round_trip", "SELECT (o_orderkey % 4)::INTEGER AS part, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderkey % 4 IN (1, 3) GROUP BY 1")
def part_round_trip(spark, sf):
    """Orders in folders by a remainder of their key; a filter on it reads only the folders that it names."""
    path = files.scratch(spark, "orders-parts")
    files.write_parts(load(spark, sf, "orders"), path, F.col("o_orderkey"))
    return files.read_table(spark, path).where("part IN (1, 3)").groupBy("part").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("sorted_series_file", "SELECT strftime(o_orderdate, '%Y-%m-01')::DATE AS date, round(avg(o_totalprice), 2) AS value, 'orders' AS source FROM orders GROUP BY 1")
def sorted_series_file(spark, sf):
    path = files.scratch(spark, "monthly-csv")
    monthly = load(spark, sf, "orders").groupBy(F.trunc("o_orderdate", "month").alias("date")).agg(F.round(F.avg("o_totalprice"), 2).alias("value")).withColumn("source", F.lit("orders"))
    files.write_sorted_csv(monthly, path, "date")
    return files.read_csv(spark, path, files.SERIES)


_BOXES = {"west": (37.0, 126.5, 37.25, 126.75), "east": (37.1, 126.8, 37.4, 127.0)}


@query(
    "geojson_districts",
    """WITH p AS (SELECT p_partkey AS id, 37.0::DOUBLE + (p_partkey * 37 % 1000) / 2000.0::DOUBLE AS lat, 126.5::DOUBLE + (p_partkey * 91 % 1000) / 2000.0::DOUBLE AS lng FROM part)
    SELECT id, CASE WHEN lng < 126.78 THEN 'west' ELSE 'east' END AS polygon FROM p WHERE (lat >= 37.0 AND lat < 37.25 AND lng >= 126.5 AND lng < 126.75) OR (lat >= 37.1 AND lat < 37.4 AND lng >= 126.8 AND lng < 127.0)""",
)
def geojson_districts(spark, sf):
    """A GeoJSON file of a polygon and a multipolygon, read and joined with places."""
    ring = lambda a, b, c, d: f"[[{b},{a}],[{d},{a}],[{d},{c}],[{b},{c}],[{b},{a}]]"
    west, east = (ring(*_BOXES[k]) for k in ("west", "east"))
    feature = lambda name, kind, rings: f'{{"properties":{{"name":"{name}"}},"geometry":{{"type":"{kind}","coordinates":{rings}}}}}'
    text = f'{{"features":[{feature("west", "Polygon", f"[{west}]")},{feature("east", "MultiPolygon", f"[[{east}]]")}]}}'
    path = files.scratch(spark, "districts-json")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    k = F.col("p_partkey")
    points = load(spark, sf, "part").select(k.alias("id"), (F.lit(37.0) + (k * 37 % 1000) / 2000.0).alias("lat"), (F.lit(126.5) + (k * 91 % 1000) / 2000.0).alias("lng"))
    return geo.inside(points, files.polygon_edges(spark, path, "name"), cell=0.1)


# ---------------------------------------------------------------- streams


FILES, STATE_PARTITIONS = 4, 8


def _arriving(spark, sf, label, columns=("event_id", "anon_id", "ts", "src", "path")):
    """The event log as a stream of ``FILES`` batches in order of time, and one late event that closes all windows."""
    source = files.scratch(spark, f"{label}-in")
    log = visits(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).join(visitors(spark, sf).select("anon_id", "user_agent"), "anon_id", "left").select(*columns)
    log = files.staged(log, f"{label}-log")
    span = log.agg(F.min("ts").alias("first"), F.max("ts").alias("last")).first()
    width = (span["last"] - span["first"]) / FILES
    for k in range(FILES):
        low, high = span["first"] + k * width, span["first"] + (k + 1) * width
        log.where((F.col("ts") >= F.lit(low)) & ((F.col("ts") < F.lit(high)) | F.lit(k == FILES - 1))).coalesce(1).write.parquet(f"{source}/{k}")
    ends = {"event_id": F.lit(-1).cast("long"), "anon_id": F.lit(-1).cast("long"), "ts": F.lit(span["last"]) + F.expr("INTERVAL 60 DAYS"), "path": F.lit("/c/end")}
    spark.range(1).select(*[ends.get(c, F.lit("")).alias(c) for c in columns]).write.parquet(f"{source}/{FILES}")
    return spark.readStream.schema(log.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(source)


def _run(live, label, mode="append", sink=None):
    """Run a stream to its end: into a parquet folder, which is returned, or into ``sink``, a function for each batch."""
    spark = live.sparkSession
    target = files.scratch(spark, f"{label}-out")
    # state is in RocksDB; the log of a query is small, so a few state partitions are enough
    own = {"spark.sql.streaming.stateStore.providerClass": stateful.STORE, "spark.sql.shuffle.partitions": str(STATE_PARTITIONS)}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        writer = live.writeStream.outputMode(mode).option("checkpointLocation", files.scratch(spark, f"{label}-state")).trigger(availableNow=True)
        q = writer.foreachBatch(sink).start() if sink else writer.format("parquet").option("path", target).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return None if sink else spark.read.schema(live.schema).parquet(target)


def _stream(spark, sf, make, label):
    return _run(make(_arriving(spark, sf, label)), label)


@query("stream_sessions", f"""WITH {VISITS}, g AS (SELECT *, coalesce(ts > lag(ts) OVER w + INTERVAL 30 MINUTE, true)::INTEGER AS fresh FROM visits WINDOW w AS (PARTITION BY anon_id ORDER BY ts)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY anon_id ORDER BY ts) AS run FROM g)
    SELECT anon_id, min(ts) AS start, max(ts) AS "end", count(*) AS events FROM r GROUP BY anon_id, run""")
def stream_sessions(spark, sf):
    runs = _stream(spark, sf, stream.sessions, "sessions").where("anon_id >= 0")
    return runs.select("anon_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "events")


@query("stream_daily_counts", f"WITH {VISITS} SELECT (ts + INTERVAL 9 HOUR)::DATE AS day, count(*) AS pageviews FROM visits GROUP BY 1")
def stream_daily_counts(spark, sf):
    return _stream(spark, sf, stream.daily_counts, "daily")


@query("stream_distinct", f"WITH {VISITS} SELECT DISTINCT event_id FROM visits")
def stream_distinct(spark, sf):
    """Each event once, although the log is sent twice."""
    return _stream(spark, sf, lambda v: stream.distinct_events(v.unionByName(v), ["event_id"]), "distinct").where("event_id >= 0").select("event_id")


@query("stream_first_touch", f"WITH {VISITS} SELECT anon_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS visits FROM visits GROUP BY 1")
def stream_first_touch(spark, sf):
    """Visitors by state with an age limit; every batch is merged by key into a stored table."""
    table = SnapshotTable.create(spark, files.scratch(spark, "touches"), stateful.TOUCHES, ["anon_id", "since"], 16)
    _run(stateful.visitor_touches(_arriving(spark, sf, "touch"), "10 days"), "touch", "update", stateful.into_table(table, "touch"))
    out = stateful.first_touch_of(table.read()).where("anon_id >= 0")
    return out.select("anon_id", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"), F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "visits")


@query("stream_burst_visitors", f"WITH {VISITS}, c AS (SELECT anon_id, date_trunc('minute', ts) AS slot FROM visits WHERE path LIKE '/c/%'), hot AS (SELECT slot FROM c GROUP BY 1 HAVING count(DISTINCT anon_id) >= 2) SELECT DISTINCT anon_id FROM c JOIN hot USING (slot)")
def stream_burst_visitors(spark, sf):
    """Visitors of minutes with two visitors or more; the log is thin, so two stand for the usual eight."""
    return _run(stateful.burst_visitors(_arriving(spark, sf, "burst"), ids=2), "burst").where("anon_id >= 0").select("anon_id").distinct()


@query(
    "stream_day_verdicts",
    f"""WITH {VISITS}, {VISITORS}, d AS (SELECT anon_id, (ts + INTERVAL 9 HOUR)::DATE AS day, count(*) AS events, bool_or(coalesce(src IN {tuple(SEARCH_ENGINES)!r}, false)) AS s, bool_or(regexp_matches(coalesce(user_agent, ''), '(?i)Mobile|iPhone|Android')) AS m, min(path) AS low, max(path) AS high
      FROM visits LEFT JOIN visitors USING (anon_id) GROUP BY 1, 2)
    SELECT anon_id, day, events, NOT (bool_or(s) OVER w OR bool_or(m) OVER w OR min(low) OVER w < max(high) OVER w OR row_number() OVER w > 1) AS bot FROM d WINDOW w AS (PARTITION BY anon_id ORDER BY day)""",
)
def stream_day_verdicts(spark, sf):
    """Verdicts of each visitor and day, half an hour after the day."""
    live = _arriving(spark, sf, "verdict", ("event_id", "anon_id", "ts", "src", "path", "user_agent"))
    return _run(stateful.day_verdicts(live, keep_days=60), "verdict").where("anon_id >= 0")
