"""Behaviour of operators on small fixtures: merges, guards, grades, rotation, text rules, geometry."""

import datetime as dt
import json
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.functions import text as tx
from tidemark.operators import market, matching, merge, ranking, reviews, search, traffic
from tidemark.sources import files


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


SLOW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SLOW
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 6), st.integers(0, 5)), max_size=12), st.lists(st.tuples(st.integers(0, 3), st.integers(0, 6), st.integers(0, 5)), max_size=12))
def test_merge_is_idempotent_and_never_shrinks(spark, old, new):
    schema = "owner int, k int, d int"
    once = {(o, k): (o, k, d) for o, k, d in old}
    fresh = {(o, k): (o, k, d) for o, k, d in new}
    a, b = spark.createDataFrame(list(once.values()), schema), spark.createDataFrame(list(fresh.values()), schema)
    merged = merge.keyed_merge(a, b, F.col("k"), F.col("d"), "owner")
    got = rows(merged, "owner", "k", "d")
    assert got == sorted((once | fresh).values())
    assert rows(merge.keyed_merge(merged, b, F.col("k"), F.col("d"), "owner"), "owner", "k", "d") == got


def test_merge_keeps_newest_and_drops_undated_first(spark):
    old = spark.createDataFrame([(1, "a", "2024-01-01"), (1, "b", None), (1, "c", "2023-01-01")], "owner int, k string, d string")
    new = spark.createDataFrame([(1, "d", "2024-05-01")], "owner int, k string, d string")
    assert rows(merge.keyed_merge(old, new, F.col("k"), F.col("d"), "owner", 3), "k") == [("a",), ("c",), ("d",)]


def test_evidence_key(spark):
    df = spark.createDataFrame([("http://x/1", "blog", "t", "b"), (None, "blog", "t", "b"), ("", "blog", None, None)], "link string, source string, title string, text string")
    keys = [r[0] for r in df.select(merge.evidence_key(F.col("link"), F.col("source"), F.col("title"), F.col("text"))).collect()]
    assert keys == ["L:http://x/1", "T:blog|t|b", "T:blog||"]


def test_shrink_guard_blocks_171_to_36(spark):
    old = spark.createDataFrame([(1, True, 171), (2, True, 9), (3, False, 171), (4, True, 100)], "id int, published boolean, n int")
    new = spark.createDataFrame([(1, 36), (2, 1), (3, 36), (4, 80)], "id int, n int")
    assert rows(merge.blocked_shrinks(old, new, "id"), "id") == [(1,)]


def test_update_of_a_column_that_is_not_derived_fails(spark):
    old = spark.createDataFrame([(1, 2, 3)], "id int, a int, b int")
    with pytest.raises(ValueError, match="b"):
        merge.update_columns(old, spark.createDataFrame([(1, 5)], "id int, b int"), ["id"], frozenset({"a"}))
    assert rows(merge.update_columns(old, spark.createDataFrame([(1, None)], "id int, a int"), ["id"], frozenset({"a"})), "id", "a", "b") == [(1, None, 3)]


@pytest.mark.parametrize(("accounts", "months", "n", "grade", "capped"), [(35, 1, 35, "verified", 0), (1, 1, 35, "reference", 33), (35, 40, 35, "reference", 0), (70, 40, 70, "verified", 0)])
def test_grades_cap_accounts_and_halve_old_reviews(spark, accounts, months, n, grade, capped):
    df = spark.createDataFrame([("p", i, f"u{i % accounts}", "verified", float(months)) for i in range(n)], "place string, pos int, account string, verdict string, months double")
    got = reviews.grades(df, "place", "pos", "account").first()
    assert (got["raw"], got["grade"], got["account_cap"]) == (n, grade, capped)
    assert got["raw"] == got["verified"] + got["reference"] + got["rejected"]


def test_classifier_takes_the_first_hard_rule_and_caps_combinations(spark):
    df = spark.createDataFrame([("closed and short",), ("a combo text of the place, visited and long enough to count for points",)], "text string")
    t = F.col("text")
    no = F.lit(False)
    signals = {"title_full": t.contains("place"), "title_part": no, "in_body": no, "visit": t.contains("visited"), "area": no, "listicle": no, "combo": t.contains("combo"), "passing": no, "sponsored": no, "many_tags": no, "substance": F.lit(3), "length": F.char_length(t)}
    got = reviews.classify(df, [reviews.Reject("closed", t.contains("closed")), reviews.Reject("short", F.char_length(t) < 20, 22, True)], signals).orderBy("text").collect()
    assert (got[0]["verdict"], got[0]["score"]) == ("reference", 59)
    assert (got[1]["verdict"], got[1]["reason"], got[1]["borderline"]) == ("rejected", "closed", False)


def test_affirmation_needs_one_mention_without_denial(spark):
    texts = [("wide parking here", True), ("no parking at all", False), ("no parking today but there is more than enough good parking", True), ("", False), (None, False), ("parking", True), ("PARKING is not", False)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(tx.affirmed(F.col("t"), ("parking",), "(no |not)")).collect()]
    assert got == [w for _, w in texts]


def test_masking_and_links_and_particles(spark):
    df = spark.createDataFrame([("call 010-1234-5678 or me@x.org  now", "HTTPS://m.Blog.org/a/?q=1", "물", "차")], "t string, u string, a string, b string")
    r = df.select(tx.without_contacts(F.col("t")), tx.link_key(F.col("u")), tx.particle(F.col("a"), "을", "를"), tx.particle(F.col("b"), "을", "를")).first()
    assert tuple(r) == ("call [tel] or now", "blog.org/a", "을", "를")


def test_numbers_of_each_kind_and_none_of_other_digits(spark):
    kept = ["2024-12-31", "12345678901", "opened 1999 and 2001", "a@ b", "3.5 of 5", "no. 0101234567890", None, ""]
    gone = ["010 1234 5678", "01012345678", "0507-123-4567", "02-123-4567", "031.1234.5678", "1588 123 4567"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*kept, *gone])], "i int, t string").orderBy("i")
    got = [r[0] for r in df.select(tx.without_contacts(F.col("t"))).collect()]
    assert got == [t or "" for t in kept] + ["[tel]"] * len(gone)


def test_best_sentence_by_weights(spark):
    texts = ["Plain opening. Rich coffee here! Later coffee too.", "Cut coffee title...\nA whole one.", "tiny", None, "x" * 200, "mail me@a.b about coffee now. Other."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = [r[0] for r in df.select(tx.best_sentence(F.col("t"), {"coffee": 2, "later": -1})).collect()]
    assert got == ["Rich coffee here!", "A whole one.", "tiny", "", "x" * 90 + "…", "mail about coffee now."]


def test_near_join_equals_all_pairs(spark):
    points = [(i, 37 + (i * 37 % 101) / 2000, 127 + (i * 53 % 97) / 2000) for i in range(120)]
    a = spark.createDataFrame(points[:20], "a int, alat double, alng double")
    b = spark.createDataFrame(points, "b int, blat double, blng double")
    want = sorted((i, j) for i, y, x in points[:20] for j, v, u in points if math.hypot((v - y) * geo.LAT_M, (u - x) * geo.LNG_M * math.cos(math.radians(y))) <= 800)
    assert rows(geo.near_join(a, b, 800.0, ("alat", "alng"), ("blat", "blng")), "a", "b") == want


def test_name_similarity(spark):
    pairs = [("Blue Bottle", "blue-bottle", 1.0), ("Blue Bottle Seoul", "Blue Bottle", 0.9), ("", "x", 0.0), ("ab", "bc", 0.0), ("abcd", "abxd", 0.2), (None, None, 0.0)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    got = [r[0] for r in df.orderBy("i").select(F.round(matching.name_similarity(F.col("a"), F.col("b")), 3)).collect()]
    assert got == [s for *_, s in pairs]


def test_road_key(spark):
    df = spark.createDataFrame([("Seoul Mapo Wausan-ro, 1",), ("서울 마포구 와우산로29길 34, 1층",), (None,)], "a string")
    got = [r[0] for r in df.select(matching.road_key(F.col("a"))).collect()]
    assert got[1] == "서울|마포구|와우산로29길|34" and got[2] is None


def test_sessions_cover_every_event_once(spark):
    t0 = dt.datetime(2024, 1, 1)
    v = spark.createDataFrame([(1, t0 + dt.timedelta(minutes=m)) for m in (0, 5, 36, 66, 97)], "anon_id int, ts timestamp")
    got = traffic.sessions(v, 30, ["anon_id"]).collect()
    assert sorted(r["events"] for r in got) == [1, 2, 2] and sum(r["events"] for r in got) == 5


def test_source_buckets(spark):
    cases = [("https://m.search.naver.com/x", "", "naver"), ("", "", "direct"), ("https://www.some.org/a", "", "some.org"), ("x", " News ", "news"), (None, None, "direct"), ("nonsense", None, "other")]
    df = spark.createDataFrame([(i, r, u) for i, (r, u, _) in enumerate(cases)], "i int, r string, u string")
    assert [r[0] for r in df.orderBy("i").select(traffic.source_bucket(F.col("r"), F.col("u"), "own.org", "preview.own.net")).collect()] == [w for *_, w in cases]


def test_rotation_walks_through_the_pool(spark):
    pool = spark.createDataFrame([(i,) for i in range(5)], "id int")
    got = [[r["id"] for r in ranking.rotate(pool, "id", k, 2).orderBy("place").collect()] for k in range(5)]
    assert got == [[0, 1], [1, 2], [2, 3], [3, 4], [4, 0]]
    assert ranking.rotate(pool.limit(0), "id", 1, 2).count() == 0
    assert ranking.slot_of(0) == 0 and ranking.slot_of(15 * 3_600_000) == 2


def test_streaks_of_a_hot_key(spark):
    """A third of all rows under one key: the run since its last break is counted without a window."""
    v = [("hot", i, "x" if i > 900 or i % 7 else "y") for i in range(2000)] + [(f"k{i % 200}", i, "xy"[i // 200 % 2]) for i in range(4000)] + [(None, 1, "x")]
    df = spark.createDataFrame(v, "job string, t int, f string").repartition(5)
    got = {r["job"]: (r["value"], r["repeats"]) for r in ranking.streak(df, "job", ["t"], F.col("f"), 1).collect()}
    assert got == {"hot": ("x", 2000 - 897), **{f"k{i}": ("y", 1) for i in range(200)}}
    plan = ranking.streak(df, "job", ["t"], F.col("f"), 1)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_not_in_is_certain_or_nothing(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    values = lambda *v: spark.createDataFrame([(x,) for x in v], "x int")
    got = [sorted((r["k"] for r in merge.not_in(df, "k", values(*v), "x").collect()), key=str) for v in ((), (1,), (1, None), (7,))]
    assert got == [[1, 2, None], [2], [], [1, 2]]
    plan = merge.not_in(df, "k", values(1), "x")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "isnull" not in plan.lower().replace("isnotnull", "")


def test_streaks_break_on_null(spark):
    v = [("a", 1, "x"), ("a", 2, None), ("a", 3, "x"), ("a", 4, "x"), ("b", 1, "x"), ("b", 2, None)]
    df = spark.createDataFrame(v, "job string, t int, f string")
    assert rows(ranking.streak(df, "job", ["t"], F.col("f"), 1), "job", "value", "repeats") == [("a", "x", 2)]


def test_fusion_prefers_rows_high_in_both_lists(spark):
    c = spark.createDataFrame([(1, 0.9, 5.0, 0, False, "verified"), (2, 0.8, 0.0, 0, False, "verified"), (3, 0.2, 0.0, 0, False, "verified"), (4, 0.5, 9.0, 0, True, "reference")], "id int, sim double, exact double, concept int, review_only boolean, grade string")
    got = {r["id"]: r["score"] for r in search.fuse(c, "id").collect()}
    assert set(got) == {1, 2} and got[1] > got[2]


def test_price_signal_needs_two_days_and_scaling_is_half_when_constant(spark):
    s = spark.createDataFrame([(dt.date(2024, 1, d), float(d)) for d in range(1, 8)], "date date, value double")
    r = market.price_signal(s).first()
    assert (r["label"], r["trend"], r["place"]) == ("high", "up", 100.0)
    assert market.price_signal(s.limit(1)).count() == 0
    flat = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id int, x double")
    assert rows(market.min_max(flat, ["x"]), "x") == [(0.5,), (0.5,)]
    assert tuple(market.latest_values(s).first()) == (7.0, 6.0, 1.0)


def test_files_round_trip(spark, tmp_path):
    s = spark.createDataFrame([(dt.date(2024, 1, 2), 2.5, "a"), (dt.date(2024, 1, 1), 1.5, "b")], files.SERIES)
    files.write_sorted_csv(s, f"{tmp_path}/csv", "date")
    assert [r["value"] for r in files.read_csv(spark, f"{tmp_path}/csv", files.SERIES).collect()] == [1.5, 2.5]
    files.write_json(s, f"{tmp_path}/json")
    assert files.read_ndjson(spark, f"{tmp_path}/json", files.SERIES).count() == 2
    (tmp_path / "t.tsv").write_text("date\tvalue\tsource\n2024-01-03\tx\tc\n")
    assert files.read_tsv(spark, f"{tmp_path}/t.tsv", files.SERIES).first()["value"] is None
    files.write_parts(spark.range(8), f"{tmp_path}/parts", F.col("id"))
    assert files.read_table(spark, f"{tmp_path}/parts/part=1", ["id"]).count() == 2
    assert files.version_of(s, "date") == (2, dt.date(2024, 1, 2))


def test_points_in_polygons_of_a_file(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"features": [{"properties": {"name": "sq"}, "geometry": {"type": "Polygon", "coordinates": [[[0.2, 0.2], [2.5, 0.2], [2.5, 2.5], [0.2, 2.5], [0.2, 0.2]]]}}]}')
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 1.0), (3, 2.4, 2.4)], "id int, lat double, lng double")
    assert rows(geo.inside(points, files.polygon_edges(spark, f"{tmp_path}/p.json", "name")), "id", "polygon") == [(1, "sq"), (3, "sq")]


def test_multipolygons_holes_and_other_shapes(spark, tmp_path):
    ring = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
    shape = lambda name, kind, c: {"properties": {"name": name, "gu": "g"}, "geometry": None if kind is None else {"type": kind, "coordinates": c}}
    features = [shape("two", "MultiPolygon", [[ring(0, 1)], [ring(5, 6)]]), shape("holed", "Polygon", [ring(2, 4), ring(2.5, 3.5)]), shape("none", None, None)]
    (tmp_path / "m.json").write_text(json.dumps({"features": features}))
    edges = files.polygon_edges(spark, f"{tmp_path}/m.json", "name", "gu")
    points = spark.createDataFrame([(1, 0.5, 0.5, "g"), (2, 5.5, 5.5, "g"), (3, 3.0, 3.0, "g"), (4, 2.2, 2.2, "g"), (5, 9.0, 9.0, "g"), (6, 9.0, 9.0, "h")], "id int, lat double, lng double, gu string")
    assert rows(geo.inside(points, edges, cell=0.3), "id", "polygon") == [(1, "two"), (2, "two"), (4, "holed")]
    assert rows(geo.inside_or_nearest(points, edges, "gu"), "id", "polygon", "found") == [(1, "two", "inside"), (2, "two", "inside"), (3, "holed", "nearest"), (4, "holed", "inside"), (5, "two", "nearest")]
    (tmp_path / "l.json").write_text(json.dumps({"features": [shape("line", "LineString", [[0, 0], [1, 1]])]}))
    with pytest.raises(Exception, match="not a polygon: LineString"):
        files.polygon_edges(spark, f"{tmp_path}/l.json", "name").count()


def test_sessions_run_on_over_buckets(spark):
    moment = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
    at = [0, 25, 55, 58, 61, 90, 121, 300, 329, 359, 389, 419, 1000, 1000, 1030, 1061]
    log = spark.createDataFrame([(k, moment(m)) for k in ("a", "b") for m in at if k == "a" or m != 58], "who string, ts timestamp")
    def plain(minutes):
        out = []
        for m in sorted(minutes):
            if out and m - out[-1][1] <= 30:
                out[-1][1:] = [m, out[-1][2] + 1]
            else:
                out.append([m, m, 1])
        return [(moment(a), moment(b), n) for a, b, n in out]

    assert rows(traffic.sessions(log.where("who = 'a'")), "start", "end", "events") == plain(at)
    got = rows(traffic.sessions(log, by=["who"], bucket_minutes=7), "who", "start", "end", "events")
    assert got == [("a", *x) for x in plain(at)] + [("b", *x) for x in plain([m for m in at if m != 58])]


def test_rotation_wraps_round_the_pool(spark):
    keys = [5, 9, 10, 11, 40, 41, 999, 1000, 5000, 100_000]
    pool = spark.createDataFrame([(k,) for k in keys], "id long")
    for offset in (0, 3, 9, 10, 27):
        got = [r["id"] for r in ranking.rotate(pool, "id", offset, 4, slices=8).orderBy("place").collect()]
        assert got == [(keys * 2)[(offset % 10) + i] for i in range(4)]
    assert ranking.rotate(pool.limit(0), "id", 3, 4).count() == 0
