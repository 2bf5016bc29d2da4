"""Queries of nested rows, of pages made from members, and of results kept by version."""

from pyspark.sql import functions as F

from tidemark.functions import nested
from tidemark.operators import fanout
from tidemark.plans.base import PLACES, load, places, query
from tidemark.sources import files
from tidemark.sources.results import Results

# ---------------------------------------------------------------- nested rows


def orders_with_lines(spark, sf):
    """(id, status, items array<struct<line, part, qty, price, ship>>): orders with their lines."""
    items = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.to_date("l_shipdate").alias("ship"), F.col("l_returnflag").alias("flag")))).alias("items")
    )
    orders = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return orders.join(items, "id", "left")


def order_book(spark, sf):
    """``orders_with_lines`` as a stored nested table."""
    return files.staged(orders_with_lines(spark, sf), "order-book")


_LINES = "l AS (SELECT o_orderkey AS id, o_orderstatus AS status, l_linenumber AS line, l_partkey AS part, l_quantity AS qty, l_extendedprice AS price, l_shipdate::DATE AS ship, l_returnflag AS flag FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey)"


@query(
    "chained_laterals",
    f"""WITH {_LINES}, r AS (SELECT id, count(*) FILTER (WHERE ship >= DATE '1998-01-01') AS recent, count(*) FILTER (WHERE ship >= DATE '1996-01-01') AS later, coalesce(sum(qty) FILTER (WHERE flag = 'R'), 0) AS back, coalesce(sum(qty) FILTER (WHERE flag <> 'R'), 0) AS kept FROM l WHERE line IS NOT NULL GROUP BY 1)
    SELECT id, recent, later, back <= kept AS bonus FROM r WHERE later >= 2 AND NOT (back > 20 AND kept < 5 AND back >= kept * 8)""",
)
def chained_laterals(spark, sf):
    """Counts over each row's own array, then values made from them, then a filter on both: no row is exploded or shuffled."""
    book = order_book(spark, sf).where("items IS NOT NULL")
    since = lambda day: F.size(F.filter("items.ship", lambda d: d >= F.lit(day).cast("date"))).cast("long")
    total = lambda keep: F.aggregate(F.filter(F.arrays_zip("items.flag", "items.qty"), keep), F.lit(0.0), lambda acc, x: acc + x["qty"])
    r = book.select("id", since("1998-01-01").alias("recent"), since("1996-01-01").alias("later"), total(lambda x: x["flag"] == "R").alias("back"), total(lambda x: x["flag"] != "R").alias("kept"))
    x = r.select("*", (F.col("back") <= F.col("kept")).alias("bonus"), ((F.col("back") > 20) & (F.col("kept") < 5) & (F.col("back") >= F.col("kept") * 8)).alias("dominant"))
    return x.where("later >= 2 AND NOT dominant").select("id", "recent", "later", "bonus")


@query("lateral_best_line", f"WITH {_LINES} SELECT id, arg_max(part, (price, -line)) AS part, round(max(price), 2) AS price, count(line) AS lines FROM l GROUP BY 1")
def lateral_best_line(spark, sf):
    """The dearest line of each order by a lateral join over its array; orders without lines stay. The lateral part has no
    filter of its own, so it is one row beside each order and needs no join by the arrays."""
    book = order_book(spark, sf)
    return spark.sql(
        """SELECT b.id, m.x.part AS part, round(m.x.price, 2) AS price, CASE WHEN m.x IS NULL THEN 0 ELSE m.n END AS lines FROM {book} b,
        LATERAL (SELECT array_max(transform(b.items, i -> struct(i.price AS price, -i.line AS line, i.part AS part))) AS x, cast(size(b.items) AS bigint) AS n) m""",
        book=book,
    )


@query(
    "objects_in_arrays",
    f"""WITH {_LINES} SELECT id, coalesce(bool_or(flag = 'R' AND line = 1), false) AS first_returned, coalesce(bool_or(part = 7 OR flag = 'N'), false) AS any_of, count(line)::INTEGER AS lines,
      CASE WHEN count(line) > 0 THEN string_agg(flag, '' ORDER BY line, part, qty, price, ship, flag) END AS flags, CASE WHEN count(line) > 0 THEN 'array' ELSE 'null' END AS kind, 'string' AS status_kind FROM l GROUP BY 1""",
)
def objects_in_arrays(spark, sf):
    """Containment, lengths, kinds and paths in JSON documents with an array of objects. A document is read once: its array as
    objects, its status as a variant. What can be read as objects is an array; only documents without such are read again."""
    document = F.to_json(F.struct("id", "status", "items"), {"ignoreNullFields": "false"})
    docs = orders_with_lines(spark, sf).select("id", document.alias("json"))
    read = docs.select("id", "json", F.from_json("json", f"items {nested.OBJECTS}, status variant").alias("read"))
    objects = F.col("read.items")
    return read.select(
        "id",
        nested.has_object(objects, {"flag": "R", "line": 1}).alias("first_returned"),
        (nested.has_object(objects, {"part": 7}) | nested.has_object(objects, {"flag": "N"})).alias("any_of"),
        F.coalesce(F.array_size(objects), F.lit(0)).alias("lines"),
        F.array_join(nested.object_values(objects, "flag"), "").alias("flags"),
        F.when(objects.isNotNull(), "array").otherwise(nested.json_kind(F.col("json"), "$.items")).alias("kind"),
        nested.variant_kind(F.col("read.status")).alias("status_kind"),
    )


# ---------------------------------------------------------------- pages

_CHANGED = """before_ AS (SELECT id, area, dong, grade, "count" AS score FROM places),
  delta AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'Brand#1' ELSE area END AS area, dong, CASE WHEN id % 14 = 0 THEN 'verified' ELSE grade END AS grade, score + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS score FROM before_ WHERE id % 7 = 0
    UNION ALL SELECT -1 - id, 'Brand#99', dong, grade, score FROM before_ WHERE id % 501 = 0),
  after_ AS (SELECT * FROM before_ WHERE id NOT IN (SELECT id FROM delta) UNION ALL SELECT * FROM delta)"""
_PAGES = "[grade, '/area/' || area, '/area/' || area || '/' || dong, CASE WHEN score >= 30 THEN '/top/' || area END]"


def _members(spark, sf):
    return places(spark, sf).select("id", "area", "dong", "grade", F.col("count").alias("score"))


def _delta(spark, sf):
    """Every seventh place changed, some of them only in score or not at all, and a few new ones."""
    m, i = _members(spark, sf), F.col("id")
    own = m.where(i % 7 == 0).select("id", F.when(i % 3 == 0, "Brand#1").otherwise(F.col("area")).alias("area"), "dong", F.when(i % 14 == 0, "verified").otherwise(F.col("grade")).alias("grade"), (F.col("score") + F.when(i % 2 == 0, 1).otherwise(0)).alias("score"))
    return own.unionByName(m.where(i % 501 == 0).select((-1 - i).alias("id"), F.lit("Brand#99").alias("area"), "dong", "grade", "score"))


def _pages():
    area = F.concat(F.lit("/area/"), "area")
    return F.array(F.col("grade"), area, F.concat(area, F.lit("/"), "dong"), F.when(F.col("score") >= 30, F.concat(F.lit("/top/"), "area")))


@query(
    "pages_to_refresh",
    f"""WITH {PLACES}, {_CHANGED}, c AS (SELECT d.id, CASE WHEN b.id IS NULL OR b.grade IS DISTINCT FROM d.grade THEN 1 ELSE 2 END AS tier FROM delta d LEFT JOIN before_ b USING (id) WHERE b.id IS NULL OR (b.area, b.dong, b.grade, b.score) <> (d.area, d.dong, d.grade, d.score)),
    p AS (SELECT id, unnest({_PAGES}) AS page FROM before_ UNION ALL SELECT id, unnest({_PAGES}) FROM delta) SELECT page, min(tier)::INTEGER AS tier FROM p JOIN c USING (id) WHERE page IS NOT NULL GROUP BY 1""",
)
def pages_to_refresh(spark, sf):
    return fanout.pages_to_refresh(_members(spark, sf), _delta(spark, sf), "id", _pages(), ["grade"])


@query("page_figures_after", f"WITH {PLACES}, {_CHANGED} SELECT page, count(*) AS members, sum(score)::BIGINT AS total, max(score) AS best FROM (SELECT score, unnest({_PAGES}) AS page FROM after_) WHERE page IS NOT NULL GROUP BY 1")
def page_figures_after(spark, sf):
    """Figures of all pages after a change, of which only the touched ones are made anew."""
    old = _members(spark, sf)
    before = files.staged(fanout.page_figures(old, "id", _pages(), "score"), "page-figures")
    return fanout.refreshed(before, old, _delta(spark, sf), "id", _pages(), "score").select("page", "members", "total", "best")


# ---------------------------------------------------------------- results by version


@query("result_by_version", f"WITH {PLACES} SELECT area, count(*) AS places, round(avg(price), 4) AS price FROM places GROUP BY 1")
def result_by_version(spark, sf):
    """A result that is made once and read from its folder the second time, as the table has not changed."""
    p = places(spark, sf)
    kept = Results(spark, files.scratch(spark, "results"))
    make = lambda: p.groupBy("area").agg(F.count("*").alias("places"), F.round(F.avg("price"), 4).alias("price"))
    kept.of("areas", [(p, "id")], make)
    return kept.of("areas", [(p, "id")], lambda: p.limit(0).select("area", F.lit(0).alias("places"), "price"))
