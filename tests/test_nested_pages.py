"""Nested values, pages made from members, results by version."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import nested
from tidemark.operators import fanout
from tidemark.sources.results import Results


def test_objects_kinds_and_paths(spark):
    docs = [
        {"a": [{"k": "x", "n": 1, "deep": {"z": 1}}, {"k": "y", "n": None}], "t": "s", "b": True, "o": {"p": [1, 2, 3]}, "f": 1.5, "z": None},
        {"a": [], "t": 3},
        {"a": "no array"},
    ]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(3, None), (4, "not json")], "id long, j string")
    objects = F.from_json(F.get_json_object("j", "$.a"), nested.OBJECTS)
    wanted = [{"k": "x"}, {"k": "x", "n": 1}, {"k": "x", "n": 2}, {"n": None}, {"k": "y", "n": None}, {"missing": None}, {}]
    got = df.select("id", *[nested.has_object(objects, w).alias(str(i)) for i, w in enumerate(wanted)]).orderBy("id").collect()
    assert [tuple(r)[1:] for r in got] == [(True, True, False, True, True, False, True), *[(False,) * 7] * 4]
    kinds = df.select(*[nested.json_kind(F.col("j"), p) for p in ("$", "$.a", "$.t", "$.b", "$.o", "$.f", "$.z", "$.q", "$.o.p[1]")]).collect()
    assert tuple(kinds[0]) == ("object", "array", "string", "boolean", "object", "number", "null", None, "number")
    assert tuple(kinds[3]) == tuple(kinds[4]) == (None,) * 9
    assert [r[0] for r in df.select(nested.json_length(F.col("j"), "$.a")).collect()] == [2, 0, None, None, None]
    assert [r[0] for r in df.select(nested.json_values(F.col("j"), "$.a", "n")).collect()][:2] == [["1", None], []]


def pages():
    return F.array(F.col("grade"), F.concat(F.lit("/"), "area"), F.when(F.col("score") > 5, F.concat(F.lit("/top/"), "area")))


MEMBERS = "id long, area string, grade string, score long"


@pytest.fixture
def members(spark):
    """A third of all members is on one page."""
    return spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"a{i % 9}", ["x", "y", None][i % 3], i % 11) for i in range(600)], MEMBERS)


@pytest.mark.parametrize(
    "delta",
    [
        [(1, "hot", "y", 9), (2, "a2", "x", 3), (5000, "new", "x", 1)],
        [(3, "hot", "x", 3)],  # as it was
        [],
        [(i, f"moved{i % 2}", "y", 0) for i in range(0, 600, 3)],  # a page loses all its members
    ],
)
def test_refreshed_pages_equal_all_pages(spark, members, delta):
    d = spark.createDataFrame(delta, MEMBERS)
    before = fanout.page_figures(members, "id", pages(), "score")
    got = sorted(map(tuple, fanout.refreshed(before, members, d, "id", pages(), "score").collect()))
    after = members.join(d, "id", "left_anti").unionByName(d)
    assert got == sorted(map(tuple, fanout.page_figures(after, "id", pages(), "score").collect()))


def test_only_touched_pages_and_their_urgency(spark, members):
    d = spark.createDataFrame([(4, "a4", "y", 10), (7, "a7", "q", 7), (3, "hot", "x", 3)], MEMBERS)
    got = {r["page"]: r["tier"] for r in fanout.pages_to_refresh(members, d, "id", pages(), ["grade"]).collect()}
    assert got == {"y": 1, "/a4": 2, "/top/a4": 2, "q": 1, "/a7": 1, "/top/a7": 1}


def test_a_result_is_made_once_for_each_version(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "k long, updated string")
    kept, made = Results(spark, f"file://{tmp_path}/r"), []

    def get(df, *more):
        return sorted(map(tuple, kept.of("sums", [(df, "updated")], lambda: made.append(1) or df.groupBy().agg(F.sum("k").alias("s")), *more).collect()))

    def jobs(f):
        spark.sparkContext.setJobGroup("one-call", "")
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("one-call"))
        out = f()
        n = len(spark.sparkContext.statusTracker().getJobIdsForGroup("one-call")) - before
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return out, n

    first, cold = jobs(lambda: get(rows))
    again, warm = jobs(lambda: get(rows))
    assert first == again == [(3,)] and len(made) == 1 and warm < cold
    more = rows.unionByName(spark.createDataFrame([(5, "2024-01-03")], rows.schema))
    assert get(more) == [(8,)] and len(made) == 2
    assert get(rows) == [(3,)] and len(made) == 2
    assert get(rows, "other parameter") == [(3,)] and len(made) == 3
