"""Traffic queries over the event log."""

from pyspark.sql import functions as F

from tidemark.operators import traffic as t
from tidemark.plans.base import DAY_VISITORS, DAY_VISITS, OWN_HOST, PREVIEW_HOST, VISITORS, VISITS, day_visitors, day_visits, load, query, visitors, visits

FIRST, LAST = "2024-01-01", "2024-01-31"
DAY = "CAST(ts + INTERVAL 9 HOUR AS DATE)"
ENUMERATORS = "SELECT anon_id FROM visits WHERE path LIKE '/area/%' GROUP BY anon_id HAVING count(DISTINCT path) >= 18"
BURSTS = """SELECT DISTINCT anon_id FROM visits WHERE path LIKE '/c/%' AND date_trunc('hour', ts) IN
  (SELECT date_trunc('hour', ts) FROM visits WHERE path LIKE '/c/%' GROUP BY 1 HAVING count(DISTINCT anon_id) >= 7)"""


def _people(spark, sf):
    v = visits(spark, sf)
    return t.excluding(v, t.any_of(t.enumerators(v, most=18), t.bursts(v, ids=7, unit="hour")))


@query(
    "daily_traffic",
    f"""WITH {VISITS}, bots AS ({ENUMERATORS} UNION {BURSTS}),
    days AS (SELECT unnest(generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 DAY))::DATE AS day),
    n AS (SELECT {DAY} AS day, count(*) AS pageviews, count(DISTINCT anon_id) AS visitors FROM visits WHERE anon_id NOT IN (SELECT anon_id FROM bots) GROUP BY 1)
    SELECT day, coalesce(pageviews, 0)::BIGINT AS pageviews, coalesce(visitors, 0)::BIGINT AS visitors FROM days LEFT JOIN n USING (day)""",
)
def daily_traffic(spark, sf):
    return t.daily_series(_people(spark, sf), t.day_spine(spark, FIRST, LAST))


@query("bots_by_enumeration", f"WITH {VISITS} {ENUMERATORS}")
def bots_by_enumeration(spark, sf):
    return t.enumerators(visits(spark, sf), most=18)


@query("bots_by_burst", f"WITH {VISITS} {BURSTS}")
def bots_by_burst(spark, sf):
    return t.bursts(visits(spark, sf), ids=7, unit="hour")


@query(
    "bots_by_agent_repeat",
    f"""WITH {VISITS}, {VISITORS}, lone AS (SELECT anon_id FROM visits GROUP BY 1 HAVING count(DISTINCT path) <= 40),
    own AS (SELECT v.anon_id, path, user_agent FROM visits v LEFT JOIN visitors u USING (anon_id) WHERE path LIKE '/c/%' AND v.anon_id IN (SELECT anon_id FROM lone))
    SELECT DISTINCT anon_id FROM own WHERE (user_agent, path) IN (SELECT (user_agent, path) FROM own GROUP BY user_agent, path HAVING count(DISTINCT anon_id) >= 5)""",
)
def bots_by_agent_repeat(spark, sf):
    return t.agent_repeats(visits(spark, sf), visitors(spark, sf), ids=5, pages=40)


@query(
    "bots_declared",
    f"""WITH {VISITS}, {VISITORS} SELECT DISTINCT v.anon_id FROM visits v LEFT JOIN visitors u USING (anon_id)
    WHERE regexp_matches(coalesce(user_agent, ''), '(?i){t.BOT_AGENTS}') OR regexp_matches(coalesce(src, ''), '(?i){t.BOT_SOURCES}') OR coalesce(src, '') = 'spam'
       OR coalesce(internal, false) OR contains(lower(coalesce(referrer, '')), '{PREVIEW_HOST}')""",
)
def bots_declared(spark, sf):
    return t.declared(visits(spark, sf), visitors(spark, sf), PREVIEW_HOST)


@query(
    "bots_without_evidence",
    f"""WITH {VISITS}, {VISITORS}, {DAY_VISITS}, {DAY_VISITORS}
    SELECT e.anon_id FROM day_visits e LEFT JOIN day_visitors u USING (anon_id) GROUP BY e.anon_id
    HAVING NOT coalesce(bool_or(src IN ('naver', 'google', 'bing', 'daum')), false) AND count(DISTINCT path) < 2 AND count(DISTINCT {DAY}) < 2
       AND NOT bool_or(regexp_matches(coalesce(user_agent, ''), '(?i)Mobile|iPhone|Android'))""",
)
def bots_without_evidence(spark, sf):
    return t.without_evidence(day_visits(spark, sf), day_visitors(spark, sf), pages=2, days=2)


@query(
    "bots_zero_dwell",
    f"""WITH {VISITS}, {VISITORS}, {DAY_VISITS}, {DAY_VISITORS}
    SELECT anon_id FROM (SELECT e.anon_id, count(DISTINCT path) p, max(coalesce(duration_ms, 0)) d, bool_or(coalesce(src IN ('naver', 'google', 'bing', 'daum'), false)) s,
      max(coalesce(sessions, 0)) n, bool_or(coalesce(agreed, false)) a, bool_or(coalesce(internal, false)) i FROM day_visits e LEFT JOIN day_visitors u USING (anon_id) GROUP BY 1)
    WHERE d <= 100000 AND p <= 2 AND n <= 1 AND NOT s AND NOT a AND NOT i""",
)
def bots_zero_dwell(spark, sf):
    return t.zero_dwell(day_visits(spark, sf), day_visitors(spark, sf), pages=2, dwell_ms=100_000)


@query(
    "bots_self_links",
    f"""WITH {VISITS}, {VISITORS}, {DAY_VISITS}, {DAY_VISITORS}
    SELECT anon_id FROM (SELECT u.anon_id, count(DISTINCT path) p, max(coalesce(duration_ms, 0)) d, bool_or(coalesce(src IN ('naver', 'google', 'bing', 'daum'), false)) s
      FROM day_visitors u LEFT JOIN day_visits e USING (anon_id) WHERE referrer ILIKE '%{OWN_HOST}/?cafe=%' AND NOT coalesce(agreed, false) AND NOT coalesce(internal, false) AND coalesce(sessions, 1) <= 2 GROUP BY 1)
    WHERE d <= 100000 AND p <= 2 AND NOT s""",
)
def bots_self_links(spark, sf):
    return t.self_links(day_visits(spark, sf), day_visitors(spark, sf), f"%{OWN_HOST}/?cafe=%", pages=2, dwell_ms=100_000)


GAPS = "SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL {m} MINUTE THEN 0 ELSE 1 END AS new FROM visits WINDOW w AS ({part}ORDER BY ts)"


@query(
    "global_sessions",
    f"""WITH {VISITS}, g AS ({GAPS.format(m=5, part="")}), r AS (SELECT ts, sum(new) OVER (ORDER BY ts) AS no FROM g)
    SELECT min(ts) AS "start", max(ts) AS "end", count(*) AS events FROM r GROUP BY no""",
)
def global_sessions(spark, sf):
    return t.sessions(visits(spark, sf), 5)


@query(
    "visitor_sessions",
    f"""WITH {VISITS}, g AS ({GAPS.format(m=30, part="PARTITION BY anon_id ")}), r AS (SELECT anon_id, ts, sum(new) OVER (PARTITION BY anon_id ORDER BY ts) AS no FROM g)
    SELECT anon_id, min(ts) AS "start", max(ts) AS "end", count(*) AS events FROM r GROUP BY anon_id, no""",
)
def visitor_sessions(spark, sf):
    return t.sessions(visits(spark, sf), 30, ["anon_id"])


#: Example of sources that count as assistants, from those of the test log.
ASSISTANTS = "^(insta|helper)"


@query(
    "page_and_source_buckets",
    f"""WITH {VISITS} SELECT CASE WHEN path LIKE '/area/%' THEN 'area' WHEN path LIKE '/c/%' THEN 'place' WHEN path IN ('/signup', '/purchase') THEN 'action' ELSE 'other' END AS bucket,
    regexp_matches(src, '{ASSISTANTS}') AS ai, count(*) AS views FROM visits GROUP BY 1, 2""",
)
def page_and_source_buckets(spark, sf):
    return visits(spark, sf).groupBy(t.page_bucket(F.col("path")).alias("bucket"), F.col("src").rlike(ASSISTANTS).alias("ai")).agg(F.count("*").alias("views"))


@query(
    "device_buckets",
    f"""WITH {VISITORS} SELECT CASE WHEN regexp_matches(user_agent, '(?i)iphone|ipad') THEN 'ios' WHEN regexp_matches(user_agent, '(?i)android') THEN 'android'
    WHEN regexp_matches(user_agent, '(?i){t.BOT_AGENTS}') THEN 'bot' ELSE 'desktop' END AS device, count(*) AS visitors, count(*) FILTER (WHERE agreed) AS agreed, count(*) FILTER (WHERE agreed IS NULL) AS not_asked
    FROM visitors GROUP BY 1""",
)
def device_buckets(spark, sf):
    v = visitors(spark, sf)
    return v.groupBy(t.device_bucket(F.col("user_agent")).alias("device")).agg(F.count("*").alias("visitors"), F.count_if("agreed").alias("agreed"), F.count_if(F.col("agreed").isNull()).alias("not_asked"))


_REFERRER_SQL = " ".join(f"WHEN {' OR '.join(f'contains(lower(url), {p!r})' for p in parts)} THEN '{name}'" for parts, name in t.REFERRERS)


@query(
    "source_bucket",
    f"""SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'news' WHEN url = '' THEN 'direct' {_REFERRER_SQL} WHEN contains(lower(url), 'example.org') THEN 'direct'
    WHEN regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) <> '' THEN left(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '^www\\.', ''), 40) ELSE 'other' END AS src FROM pages""",
)
def source_bucket(spark, sf):
    return load(spark, sf, "pages").select("page_id", t.source_bucket(F.col("url"), F.when(F.col("page_id") % 7 == 0, " News "), OWN_HOST, PREVIEW_HOST).alias("src"))


@query(
    "first_touch",
    f"""WITH {VISITS}, r AS (SELECT *, row_number() OVER (PARTITION BY anon_id ORDER BY ts, event_id) AS n FROM visits)
    SELECT anon_id, max(src) FILTER (WHERE n = 1) AS first_src, max(path) FILTER (WHERE n = 1) AS first_path, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS visits FROM r GROUP BY anon_id""",
)
def first_touch(spark, sf):
    return t.first_touch(visits(spark, sf))


@query("visit_frequency", f"WITH {VISITS}, d AS (SELECT anon_id, count(DISTINCT {DAY}) AS active_days FROM visits GROUP BY 1) SELECT active_days, count(*) AS visitors FROM d GROUP BY 1")
def visit_frequency(spark, sf):
    return t.frequency_histogram(visits(spark, sf))


@query(
    "weekly_return",
    f"""WITH {VISITS}, w AS (SELECT DISTINCT anon_id, date_trunc('week', ts) AS week FROM visits)
    SELECT a.week::TIMESTAMP AS week, count(*) AS visitors, count(b.anon_id) AS returned FROM w a LEFT JOIN w b ON a.anon_id = b.anon_id AND b.week = a.week + INTERVAL 7 DAY GROUP BY 1""",
)
def weekly_return(spark, sf):
    return t.returning(visits(spark, sf))


STEPS = ["view", "click", "signup", "purchase"]


@query(
    "funnel",
    f"""WITH {VISITS}, {DAY_VISITS}, c AS (SELECT {", ".join(f"count(DISTINCT anon_id) FILTER (WHERE kind = '{s}') AS {s}" for s in STEPS)} FROM day_visits)
    {" UNION ALL ".join(f"SELECT {i}::INTEGER AS no, '{s}' AS step, {s} AS visitors, least(1.0, {s}::DOUBLE / nullif({STEPS[max(0, i - 1)]}, 0)) AS capped_rate FROM c" for i, s in enumerate(STEPS))}""",
)
def funnel(spark, sf):
    return t.funnel(day_visits(spark, sf), STEPS)


@query(
    "anomaly_movers",
    f"""WITH {VISITS}, d AS (SELECT path, {DAY} AS day, count(*) AS n FROM visits GROUP BY ALL),
    b AS (SELECT path, coalesce(sum(n) FILTER (WHERE day = DATE '2024-01-20'), 0)::BIGINT AS today, avg(n) FILTER (WHERE day <> DATE '2024-01-20') AS mean, count(*) FILTER (WHERE day <> DATE '2024-01-20') AS days FROM d GROUP BY 1)
    SELECT path, today, round(mean, 6) AS mean, days, round((today - mean) / mean, 6) AS change FROM b WHERE days >= 3 AND mean >= 1 AND abs((today - mean) / mean) >= 0.5""",
)
def anomaly_movers(spark, sf):
    daily = visits(spark, sf).groupBy("path", t.local_day(F.col("ts")).alias("day")).agg(F.count("*").alias("n"))
    out = t.movers(daily, "path", "2024-01-20")
    return out.select("path", "today", F.round("mean", 6).alias("mean"), "days", F.round("change", 6).alias("change"))


@query(
    "day_type_means",
    f"""WITH {VISITS}, d AS (SELECT {DAY} AS day, count(*) AS n FROM visits GROUP BY 1)
    SELECT CASE WHEN day IN (DATE '2024-01-01', DATE '2024-01-15') THEN 'holiday' WHEN dayofweek(day) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS kind, round(avg(n), 6) AS mean, count(*) AS days FROM d GROUP BY 1""",
)
def day_type_means(spark, sf):
    daily = visits(spark, sf).groupBy(t.local_day(F.col("ts")).alias("day")).agg(F.count("*").alias("n"))
    holidays = spark.createDataFrame([("2024-01-01",), ("2024-01-15",)], "day string").select(F.to_date("day").alias("day"))
    return t.day_type_means(daily, holidays).select("kind", F.round("mean", 6).alias("mean"), "days")


@query(
    "serious_visitors",
    f"""WITH {VISITS}, e AS (SELECT * FROM visits), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY anon_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM e)
    SELECT anon_id, count(DISTINCT path) FILTER (WHERE path LIKE '/c/%') AS pages, sum(duration_ms)::BIGINT AS dwell_ms, sum(new)::BIGINT AS sessions,
      (count(DISTINCT path) FILTER (WHERE path LIKE '/c/%') >= 2 OR sum(duration_ms) >= 60000 OR sum(new) >= 2) AS serious FROM g GROUP BY 1""",
)
def serious_visitors(spark, sf):
    return t.serious(visits(spark, sf))


@query(
    "region_traffic",
    f"""WITH {VISITS}, o AS (SELECT *, k % 9 AS region FROM visits), b AS (SELECT region, count(DISTINCT anon_id) AS people, count(*) AS views, count(DISTINCT {DAY}) AS active_days FROM o GROUP BY 1),
    s AS (SELECT region, src, row_number() OVER (PARTITION BY region ORDER BY count(*) DESC, src) AS r FROM o GROUP BY region, src),
    t AS (SELECT region, string_agg(src, ',' ORDER BY r) AS top_sources FROM s WHERE r <= 3 GROUP BY 1),
    a AS (SELECT region, count(*) AS n FROM (SELECT region, anon_id FROM o GROUP BY 1, 2 HAVING count(DISTINCT {DAY}) > 1) GROUP BY 1)
    SELECT region, people, views, active_days, top_sources, coalesce(n, 0)::BIGINT AS "returning" FROM b LEFT JOIN t USING (region) LEFT JOIN a USING (region)""",
)
def region_traffic(spark, sf):
    return t.region_report(visits(spark, sf), F.col("k") % 9)


@query(
    "two_window_visitors",
    f"""WITH {VISITS}, a AS (SELECT path, anon_id, (epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts))) / 86400 AS age FROM visits)
    SELECT path, count(DISTINCT anon_id) FILTER (WHERE age >= 0 AND age < 10) AS now_visitors, count(DISTINCT anon_id) FILTER (WHERE age >= 10 AND age < 20) AS before_visitors FROM a GROUP BY 1""",
)
def two_window_visitors(spark, sf):
    return t.two_window_sets(visits(spark, sf), "2024-01-31 00:00:00", 10)


@query(
    "demand_gaps",
    f"""WITH {VISITS} SELECT k AS term, count(*) AS searches, round(avg(duration_ms % 7), 6) AS mean_results FROM visits WHERE kind = 'view' GROUP BY k HAVING count(*) >= 3 AND avg(duration_ms % 7) < 3""",
)
def demand_gaps(spark, sf):
    own = visits(spark, sf).where("kind = 'view'").groupBy(F.col("k").alias("term"))
    return own.agg(F.count("*").alias("searches"), F.avg(F.col("duration_ms") % 7).alias("m")).where("searches >= 3 AND m < 3").select("term", "searches", F.round("m", 6).alias("mean_results"))


@query(
    "popular_pins",
    f"""WITH {VISITS} SELECT k AS place, count(DISTINCT anon_id) AS devices FROM visits WHERE kind = 'click' AND anon_id <> 7 GROUP BY k HAVING count(DISTINCT anon_id) >= 2""",
)
def popular_pins(spark, sf):
    own = visits(spark, sf).where((F.col("kind") == "click") & (F.col("anon_id") != 7))
    return own.groupBy(F.col("k").alias("place")).agg(F.count_distinct("anon_id").alias("devices")).where("devices >= 2")
