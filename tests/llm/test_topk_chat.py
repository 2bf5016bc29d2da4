"""Exact top-k and chat repair against brute force; odd rows."""

import itertools
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import chat_format as cf
from tidemark.llm import queries, topk

SF = "/root/testdata/sf0.001"


def plain_top(vectors, queries_, k):
    out = {}
    for i in queries_:
        scores = sorted(((-int(vectors[i] @ v), j) for j, v in vectors.items() if j != i and len(v) == len(vectors[i])))[:k]
        out |= {(i, r + 1): (j, -s) for r, (s, j) in enumerate(scores)}
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(1, 4), st.integers(1, 6), st.integers(0, 10_000))
def test_tree_search_equals_brute_force(n, dim, k, seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(-3, 4, (n, dim))  # many ties and copies
    ids = rng.permutation(1000)[:n]
    tree = topk.Tree.build(points, ids, ids + 5000, leaf=3)
    vectors = dict(zip(ids.tolist(), points.astype(np.int64), strict=True))
    got = tree.search(points, ids + 5000, np.full(n, -np.inf), k)
    want = plain_top(vectors, vectors, k)
    for i, best in zip(ids.tolist(), got, strict=True):
        assert [(-v, s) for s, v in best] == [want[i, r + 1] for r in range(len(best))] and len(best) == min(k, n - 1)


def test_boxes_are_tight_and_halves_even():
    rng = np.random.default_rng(5)
    t = topk.Tree.build(rng.integers(-99, 99, (1000, 5)), np.arange(1000), np.arange(1000), leaf=16)
    for i in range(len(t.start)):
        own = t.points[t.start[i] : t.end[i]]
        assert (own.min(axis=0) == t.low[i]).all() and (own.max(axis=0) == t.high[i]).all()
        if t.left[i]:
            a, b = (t.end[c] - t.start[c] for c in (t.left[i], t.left[i] + 1))
            assert abs(int(a) - int(b)) <= 1


def test_a_floor_leaves_out_only_worse_rows():
    rng = np.random.default_rng(6)
    points, ids = rng.integers(-50, 50, (500, 8)), np.arange(500)
    t = topk.Tree.build(points, ids, ids, leaf=16)
    free = t.search(points[:20], ids[:20], np.full(20, -np.inf), 5)
    floor = np.array([b[2][0] for b in free], dtype=float)
    for a, b in zip(free, t.search(points[:20], ids[:20], floor, 5), strict=True):
        assert a == b or b[: len(a)] == a[: len(b)] and a[2] in b


SCHEMA = "vec_id long, embedding array<float>, rank int, score long, shard string, dim string"


def test_several_shards_and_blocks_and_odd_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.integers(-9, 9, 6) / 4]) for i in range(300)]
    rows += [(1000 + i, [0.25] * 6) for i in range(80)]  # one common vector
    bad = [(2000, None), (2001, []), (2002, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2003, [float("nan")] * 6), (2004, [float("inf")] * 6), (None, [1.0] * 6), (2050, [1.0, 2.0]), (2051, [2.0, 2.0]), (2100, [5.0])]
    df = spark.createDataFrame([(*r, 1, 2, "s", "d") for r in [*rows, *bad]], SCHEMA)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5, shard_rows=64, block_rows=4).collect()}
    vectors = {i: np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(np.int64) for i, v in [*rows, bad[6], bad[7], bad[8]]}
    assert got == plain_top(vectors, [i for i in vectors if i % 50 == 0], 5)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_rows_with_one_id_all_count_as_in_sql(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in rng.integers(-9, 9, 4) / 4]) for i in rng.integers(0, 60, 200)]
    rows += rows[:30] + [(0, [1.0] * 4)] * 3 + [(None, [9.0] * 4), (50, None), (1, [2.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, 2, "s", "d") for r in rows], SCHEMA)
    df.write.parquet(f"{tmp_path}/e")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    want = sorted(c.execute(queries.OP7_SQL).fetchall())
    assert sum(w[0] == 0 for w in want) > 15
    for shard in (16, 8192):
        got = topk.top_k(df, F.col("vec_id") % 50 == 0, 5, shard_rows=shard, block_rows=3)
        assert sorted(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("scale", [1.0, 1e3, 1e9])
def test_wide_numbers_travel_whole(spark, scale):
    rng = np.random.default_rng(12)
    rows = [(i, [float(np.float32(x * scale)) for x in rng.normal(size=3)]) for i in range(200)]
    df = spark.createDataFrame([(*r, 1, 2, "s", "d") for r in rows], SCHEMA)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 3, shard_rows=32, block_rows=2).collect()}
    if scale < 1e9:  # products of larger ones pass 64 bits
        vectors = {i: np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(np.int64) for i, v in rows}
        assert got == plain_top(vectors, [0, 50, 100, 150], 3)
    assert [topk._narrow(np.array([x])).itemsize for x in (0, 1 << 15, 1 << 40, -(1 << 15))] == [2, 4, 8, 2]


def test_regions_are_skipped_by_their_boxes(spark):
    rng = np.random.default_rng(9)
    rows = [(g * 400 + i, [float(x) for x in (np.eye(8)[g] * 40 + rng.normal(size=8)) / 8]) for g in range(8) for i in range(400)]
    df = spark.createDataFrame([(*r, 1, 2, "s", "d") for r in rows], SCHEMA)
    clean = topk._usable(df, F.col("vec_id") % 50 == 0, "vec_id", "embedding")
    trees = topk.build_index(clean, shard_rows=100)
    boxes = topk.region_boxes(trees)
    assert len(boxes[8].names) >= 16 and boxes[8].trees.sum() == trees.count()
    asked = clean.where("asks").select("row", "id", "v", "dim", F.lit(0).cast("long").alias("block"), F.lit(1_000_000.0).alias("floor"), F.lit(-1).cast("long").alias("home_region"), F.lit(0).cast("long").alias("home_tree"))
    sent = topk.visits(asked, boxes, False).select((F.length("rows") / 8).alias("n"), F.length("v").alias("bytes"), "width").collect()
    pairs, whole = sum(r["n"] for r in sent), asked.count() * trees.count()
    assert {r["width"] for r in sent} == {2} and sum(r["bytes"] for r in sent) == pairs * 8 * 2  # two bytes for each number
    assert asked.count() <= pairs < 0.75 * whole  # boxes far from a query are not visited
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5, shard_rows=100).collect()}
    vectors = {i: np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(np.int64) for i, v in rows}
    assert got == plain_top(vectors, [i for i in vectors if i % 50 == 0], 5)


# ---------------------------------------------------------------- chat repair


def plain_cost(roles):
    """Least cost by trying every sequence of states with every insertion."""
    best = None
    for states in itertools.product(range(1, 4), repeat=len(roles)):
        cost, s = 0, 0
        for r, t in zip(roles, states, strict=True):
            cost += cf.STEP[r][s][t][0]
            s = t
        cost += cf.FINISH[s]
        best = cost if best is None else min(best, cost)
    return best or 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=6))
def test_repair_is_legal_and_cheapest(roles):
    fixed = cf.repair(roles)
    s, cost = 0, 0
    for r, (t, action, inserted) in zip(roles, fixed, strict=True):
        cost += cf.STEP[r][s][t][0]
        if action == "merge":
            assert t == s
        else:
            for x in (*inserted, t):
                assert x in cf.LEGAL[s]
                s = x
        s = t
    cost += cf.FINISH[s]
    assert cost == plain_cost(roles)


def test_products_of_chunks_equal_the_whole():
    rng = np.random.default_rng(3)
    roles = rng.integers(0, 4, 60).tolist()
    parts = [cf.transfer(roles[i : i + 7]) for i in range(0, 60, 7)]
    whole = parts[0]
    for p in parts[1:]:
        whole = cf.product(whole, p)
    assert (whole == cf.transfer(roles)).all()


def rendered(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["conv"]].append(((r["part"], r["chunk"], r["pos"]), r))
    return {c: "".join(r["segment"] for _, r in sorted(rows, key=lambda x: x[0])) for c, rows in out.items()}


def plain_render(roles, texts):
    out, s = [], 0
    for (t, action, inserted), text in zip(cf.repair(roles), texts, strict=True):
        if action == "merge":
            out.append("\n" + text)
        else:
            out.append((cf.CLOSE if s else "") + "".join(cf.header(x) + cf.CLOSE for x in inserted) + cf.header(t) + text)
        s = t
    return "".join(out) + cf.CLOSE + "".join(cf.header(x) + cf.CLOSE for x in cf.PATHS[s][cf.ASSISTANT])


def cost_of_text(roles, df_rows):
    s, cost = 0, 0
    for r, row in zip(roles, df_rows, strict=True):
        t = cf.NAMES.index(row["repaired_role"])
        cost += cf.STEP[r][s][t][0]
        s = t
    return cost + cf.FINISH[s]


def test_well_formed_chats_stay(spark):
    df = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a")], "conv_id long, turn long, role string, text string")
    assert rendered(cf.format_chats(df)) == {1: "<|system|>\ns<|end|>\n<|user|>\nu<|end|>\n<|assistant|>\na<|end|>\n"}


@pytest.mark.parametrize("chunk", [3, 256])
def test_one_very_long_conversation_and_many_short_ones(spark, monkeypatch, chunk):
    monkeypatch.setattr(cf, "CHUNK_TURNS", chunk)
    rng = np.random.default_rng(chunk)
    names = [None, "system", "user", "assistant"]
    rows = [(7, i, names[rng.integers(4)], f"t{i}") for i in range(1500)] + [(100 + i // 3, i % 3, names[rng.integers(4)], f"u{i}") for i in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    got = defaultdict(list)
    for r in cf.format_chats(df).collect():
        got[r["conv"]].append(r)
    want = defaultdict(list)
    for c, _, role, _ in rows:
        want[c].append(cf.role_of(role))
    assert set(got) == set(want)
    for c, own in got.items():
        own.sort(key=lambda r: (r["part"], r["chunk"], r["pos"]))
        assert [r["turn"] for r in own] == list(range(len(own)))
        best = sum(cf.STEP[r][s][t][0] for r, (s, t) in zip(want[c], _walk(want[c]), strict=True))
        end = _walk(want[c])[-1][1]
        assert cost_of_text(want[c], own) == best + cf.FINISH[end]
        assert "".join(r["segment"] for r in own).endswith(cf.CLOSE)


def _walk(roles):
    states = [t for t, *_ in cf.repair(roles)]
    return list(zip([0, *states[:-1]], states, strict=True))


def test_chats_of_odd_rows(spark):
    rows = [(None, None, None, None, 1), (None, 1, "USER ", "x", 1), (2, 5, "tool", "y" * 2_000_000, 1), (2, 5, "tool", "z", 1), (3, 1, "user", "a", 1), (3, 1, "user", "a", 1), (4, 0, "assistant", "", 1)]
    schema = "conv_id long, turn long, role string, text string, chunk int"
    got = cf.format_chats(spark.createDataFrame(rows, schema))
    assert got.count() == len(rows)
    out = rendered(got)
    assert out[3] == "<|user|>\na\na<|end|>\n<|assistant|>\n<|end|>\n"
    assert out[None].startswith("<|user|>\n\nx") or out[None].startswith("<|system|>\n")
    assert cf.format_chats(spark.createDataFrame([], schema)).count() == 0


def test_large_whole_numbers_beside_nulls(spark):
    big = 1 << 53
    rows = [(big, big + 1, "user", "a"), (big, big + 2, "assistant", "b"), (big + 1, big + 1, "user", "c"), (big + 1, None, "user", "d"), (None, big + 3, "user", "e"), (-big - 1, 0, "assistant", "f")]
    got = cf.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1))
    assert sorted(((r["conv"], r["turn"]) for r in got.collect()), key=repr) == sorted(((c, t) for c, t, *_ in rows), key=repr)
    own = defaultdict(list)
    for c, t, role, text in rows:
        own[c].append((t is not None, t, role, text))
    want = {c: plain_render([cf.role_of(x[2]) for x in sorted(v)], [x[3] for x in sorted(v)]) for c, v in own.items()}
    assert rendered(got) == want


def test_query_renders_every_conversation(spark):
    rows = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        rows[r["conv_id"]].append((r["turn"], r["role"], r["text"]))
    got = rendered(queries.op2_chat_format(spark, SF).withColumnRenamed("conv_id", "conv"))
    assert got == {c: plain_render([cf.role_of(x[1]) for x in sorted(v)], [x[2] for x in sorted(v)]) for c, v in rows.items()}
