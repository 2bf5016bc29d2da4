"""SimHash near-duplicates against brute force."""

from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from tidemark.llm import queries, simhash
from tidemark.llm.components import connected_components

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("component_id", T.StringType())])


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """ids -> smallest id reachable, by comparing all pairs."""
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in fps}


def test_golay_code_is_perfect():
    code = simhash.golay()
    assert sorted(np.unique(code.count)) == [1, 6]
    words = np.arange(0, 1 << 23, 4099, dtype=np.uint32)
    index, n = code.nearby(words)
    for w, own, k in zip(words.tolist(), index, n, strict=True):
        base = [(int(i) << 11) | int(code.parity[int(i)]) for i in own[:k]]
        distances = sorted((w ^ c).bit_count() for c in base)
        assert len(set(base)) == k and distances[0] <= 3 and distances[-1] <= 4


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 4])
def test_fingerprints_within_four_bits_share_a_key(bits):
    rng = np.random.default_rng(bits)
    x = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    flip = np.array([sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in x], dtype=np.uint64)
    own = [set() for _ in x]
    for k, r in zip(*map(np.ndarray.tolist, simhash.keys(x)), strict=True):
        own[r].add(k)
    met = np.zeros(len(x), dtype=bool)
    for k, r in zip(*map(np.ndarray.tolist, simhash.keys(x ^ flip)), strict=True):
        met[r] |= k in own[r]
    assert met.all()


def test_forest_connects_what_pairs_connect():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 64, 3, dtype=np.uint64)
    fps = np.unique(np.array([b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 7), replace=False))) for b in base for _ in range(60)], dtype=np.uint64))
    want = plain_components(dict(enumerate(fps.tolist())))
    root = {i: i for i in want}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in simhash.forest(fps):
        assert (int(fps[a]) ^ int(fps[b])).bit_count() <= 4
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {i: find(i) for i in want} == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, k) for k in range(1001, 1400)] + [(5000, 5000)] + [(7, 3), (3, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {k: 1000 for k in range(1000, 1400)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    texts = [None, "", " \n\t", "One", "one", "a b c", "A b c d e", long, long + " tail", "Éa b c d", "éa b c d", None, "a b c"]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(5, "a b c", "x", "y"), (None, "a b c", "x", "y")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    fps = {i: plain_fingerprint(t) for i, t, *_ in rows if i is not None}
    want = plain_components(fps)
    assert len(got) == len(rows)
    for r in got:
        if r["id"] is None:
            assert r["component_id"] == want[5]
        else:
            assert (r["fp"] & (1 << 64) - 1, r["component_id"]) == (fps[r["id"]], want[r["id"]])
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs}
    want = plain_components(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op3_simhash(spark, SF).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_large_keys_are_split_and_lose_no_link():
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = [int(base[rng.integers(6)]) for _ in range(900)]
    for i, x in enumerate(fps):
        for bit in rng.choice(40, rng.integers(0, 9), replace=False):
            x ^= 1 << int(bit)
        fps[i] = x
    fps = np.unique(np.array(fps, dtype=np.uint64))

    def groups(pairs):
        root = list(range(len(fps)))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return [find(i) for i in range(len(fps))]

    whole, split = simhash.forest(fps, block=10_000), simhash.forest(fps, block=16)
    assert all(int(fps[a] ^ fps[b]).bit_count() <= simhash.MAX_BITS for a, b in split)
    assert groups(split) == groups(whole) and len(set(groups(whole))) > 6


def test_a_run_over_many_batches_is_one_run():
    import pyarrow as pa

    k = np.array([1, 1, 2, 2, 2, 2, 2, 2, 3, 3], dtype=np.int64)
    f = np.arange(10, dtype=np.int64)
    want = None
    for size in (10, 1, 3):
        parts = [pa.RecordBatch.from_arrays([pa.array(k[i : i + size]), pa.array(f[i : i + size])], names=["key", "fp"]) for i in range(0, 10, size)]
        got = sorted((a, b) for batch in simhash._links(iter(parts)) for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        want = want or got
        assert got == want and len(got) == 7
