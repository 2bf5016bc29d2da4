"""Queries on tables with many rows at one point or of one name: work grows with the rows, and results stay those of the SQL."""

from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.operators import neighbours, similar_names
from tidemark.plans import registry
from tidemark.streaming import stateful

SF, COPIES = "/root/testdata/sf0.001", 100


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Parts repeated with shifted keys, so that places share points and names; DuckDB on the same tables."""
    root = str(tmp_path_factory.mktemp("many"))
    part = spark.read.parquet(f"{SF}/part.parquet")
    more = part.crossJoin(spark.range(COPIES).select(F.col("id").alias("k"))).withColumn("p_partkey", F.col("p_partkey") + F.col("k") * 1000).drop("k")
    far = more.where("p_partkey BETWEEN 6000 AND 6100").withColumn("p_partkey", F.col("p_partkey") + 1_000_000)
    more.unionByName(far).write.parquet(f"{root}/part.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW part AS SELECT * FROM '{root}/part.parquet/*.parquet'")
    return root, duck


def same(spark, many, name):
    root, duck = many
    df = registry.QUERIES[name](spark, root)
    columns = sorted(df.columns)
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*columns).collect())
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert got == sorted(repr([plain(v) for v in r]) for r in want) and got
    return df


def joined(df):
    """The numbers of rows that the joins of a plan make."""
    df.collect()
    walk, found = [df._jdf.queryExecution().executedPlan()], []
    while walk:
        node = walk.pop()
        if node.nodeName() in ("AdaptiveSparkPlan",):
            walk.append(node.executedPlan())
        elif hasattr(node, "plan") and "QueryStage" in node.nodeName():
            walk.append(node.plan())
        else:
            if "Join" in node.nodeName():
                found.append(node.metrics().apply("numOutputRows").value())
            walk.extend(node.children().apply(i) for i in range(node.children().size()))
    return found


@pytest.mark.parametrize(("name", "share"), [("near_station_join", 0.1), ("nearest_station", 1.1), ("stations_around", 1.1), ("ingest_matching", 1.5)])
def test_places_at_one_point_meet_once(spark, many, name, share):
    df = same(spark, many, name)
    rows = spark.read.parquet(f"{many[0]}/part.parquet").count()
    assert max(joined(df)) <= share * rows


def test_keys_of_new_members_are_never_those_of_old_ones(spark, many):
    same(spark, many, "page_figures_after")
    same(spark, many, "pages_to_refresh")


def test_neighbours_are_those_of_all_pairs(spark, many):
    same(spark, many, "taste_neighbours")


def test_neighbours_read_few_blocks(spark):
    i = F.col("id")
    p = spark.range(6000).select("id", (i % 2).alias("g"), *[((i * m + 7) % n / 10.0).alias(c) for c, m, n in (("x", 37, 101), ("y", 53, 211), ("z", 71, 17))])
    rows = [tuple(r) for r in p.collect()]
    got = neighbours.nearest_in_group(p, i % 100 == 0, "id", "g", ["x", "y", "z"], 3, 50)
    want = {(a[0], o) for a in rows if a[0] % 100 == 0 for _, o in sorted((round(sum((u - v) ** 2 for u, v in zip(a[2:], b[2:])) ** 0.5, 9), b[0]) for b in rows if b[1] == a[1] and b[0] != a[0])[:3]}
    assert {(r["id"], r["other"]) for r in got.collect()} == want
    assert max(joined(got)) < 60 * 3000 / 3


def test_similar_sets_meet_rarely(spark):
    items = lambda seed: F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(60)))
    sets = spark.range(3000).select("id", F.array_distinct(items(1)).alias("items"))
    near = sets.select((F.col("id") + 10_000).alias("id"), F.slice("items", 1, F.size("items") - 1).alias("items")).where("id % 10 = 0")
    got = similar_names.similar_sets(sets.unionByName(near), "id", "items", 0.6)
    assert got.where("b = a + 10000").count() == 300
    assert max(joined(got)) < 200_000


def test_a_batch_of_days_is_one_read_and_one_write_of_state():
    calls, held = [], [None]
    value = SimpleNamespace(
        get=lambda: calls.append("get") or held[0], update=lambda v: calls.append("update") or held.__setitem__(0, v), clear=lambda: calls.append("clear") or held.__setitem__(0, None), exists=lambda: held[0] is not None,
        getValue=lambda k: calls.append("get"), containsKey=lambda k: calls.append("has"), updateValue=lambda k, v: calls.append("update"), removeKey=lambda k: calls.append("remove"),
    )
    p = stateful._Settled(9 * 3_600_000, 30 * stateful.MINUTE_MS, 30)
    p.init(SimpleNamespace(getValueState=lambda *a: value, getMapState=lambda *a: value, registerTimer=lambda at: calls.append("timer")))
    row = Row("anon_id", "ts", "day", "searched", "mobile", "path")
    assert list(p.handleInputRows((1,), iter([row(1, None, d, False, False, "/a") for d in (3, 1, 2, 2)]), None)) == [] and len(calls) == 3
    calls.clear()
    at = SimpleNamespace(getExpiryTimeInMs=lambda: p._settles(1), getCurrentWatermarkInMs=lambda: p._settles(9))
    out = list(p.handleExpiredTimer((1,), at, at))
    assert [(r["day"], r["events"], r["bot"]) for r in out] == [(1, 1, True), (2, 2, False), (3, 1, False)] and len(calls) == 3


def copies(spark, name, part):
    """How often a plan computes a part of an expression."""
    return registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count(part)


@pytest.mark.parametrize("name", ["word_signals", "distinctive_words"])
def test_the_words_of_a_name_are_found_once(spark, name):
    assert copies(spark, name, "split(") == (2 if name == "word_signals" else 1)  # blanks, and scripts


def test_a_quote_is_tidied_once(spark):
    assert copies(spark, "display_quotes", "#[^ #]+") == 1


def test_texts_are_read_once_and_not_shuffled(spark):
    plan = registry.QUERIES["axis_coordinates"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 12  # two groups of six words, each once
    aggregate = next(line for line in plan.splitlines() if "Aggregate [owner" in line and "print" in line)
    assert "min_by(" in aggregate and "text" not in aggregate


def test_windows_of_words_that_overlap_themselves(spark):
    from tidemark.functions import text as tx

    rows = ["ananas", "no ana far from the next anana", "no anana", "no" + "." * 13 + "ana", "x" * 20 + "ana" + "." * 13 + "no", "no" + "." * 11 + "anana", ""]
    got = spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("i", tx.said_and_denied(F.col("t"), ("ana",), "no").alias("s"), tx.said_and_denied(F.col("t"), ("ana", "zu"), "no").alias("z")).orderBy("i").collect()
    want = []
    for t in rows:
        near = ["no" in t[max(0, p - 14) : p + 17] for p in range(len(t)) if t.startswith("ana", p)]
        want.append((not all(near), any(near)))
    assert [tuple(r["s"]) for r in got] == want == [tuple(r["z"]) for r in got]


def test_word_pairs_are_not_counted_where_texts_are_read(spark):
    """No aggregate has the pairs as keys: its map would hold all pairs of a task."""
    plan = registry.QUERIES["campaign_clusters"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number()" in plan and not [line for line in plan.splitlines() if "Aggregate [" in line and " g#" in line]


def test_a_lateral_row_needs_no_join(spark):
    plan = registry.QUERIES["lateral_best_line"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_a_document_is_read_once(spark, tmp_path):
    """One reading for all columns, a second one only where the array is missing; results stay those of the SQL."""
    plan = registry.QUERIES["objects_in_arrays"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == plan.count("parseJson(") == 1 and "get_json_object(" not in plan
    duck, root = duckdb.connect(), tmp_path
    flags = ["N", "R", "A", '"q"', "[{", "é\\"]
    rows = [(o, line, o * line % 9, float(line), 1e10 / o, flags[(o + line) % 6]) for o in range(1, 200) if o % 5 for line in range(1, o % 4 + 2)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_returnflag string")
    lines.withColumn("l_shipdate", F.lit("1997-03-04 00:00:00").cast("timestamp")).write.parquet(f"{root}/lineitem.parquet")
    spark.range(1, 205).select(F.col("id").alias("o_orderkey"), F.lit("[O]").alias("o_orderstatus")).write.parquet(f"{root}/orders.parquet")
    for t in ("orders", "lineitem"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet/*.parquet'")
    got = same(spark, (str(root), duck), "objects_in_arrays").groupBy("kind").count().collect()
    assert {tuple(r) for r in got} == {("array", 160), ("null", 44)}
