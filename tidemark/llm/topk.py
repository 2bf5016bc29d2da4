"""Exact top-k search by integer inner product with a KD-tree on each shard.

Median splits learnt from a bounded sample cut the space into regions; each region's rows are dealt to shards of bounded
size, and each shard's tree (median splits, tight boxes) is one written row. A query first searches one tree of its most
promising region. Its kth score is handed on as the bound with which it then visits the trees of the other regions, only
those whose box may hold a row as good; within a tree boxes are opened best first.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import mix64, staged

SCALE = 256
LEAF = 128
SHARD_ROWS = 8192
#: Queries that meet a tree in one group; a tree travels once for each so many queries.
BLOCK_ROWS = 16_384
#: Regions, about, at most, over all vector lengths, and rows of the sample from which their splits are learnt. Every row is
#: routed and indexed; the sample decides only where regions end.
REGIONS = 1024
SAMPLE_ROWS = 20_000
#: Integers up to which float64 products are exact.
EXACT = 1 << 53


def quantised(embedding: Column) -> Column:
    """floor(256 x) of each component as a whole number; null where the vector is null or empty or has a null, infinite or NaN component."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(embedding.isNotNull() & (F.size(embedding) > 0) & ~F.coalesce(bad, F.lit(True)), F.transform(x, lambda v: F.floor(v * SCALE)))


# ---------------------------------------------------------------- one tree


@dataclass
class Tree:
    """Points in leaf order; node i holds points start[i]:end[i], its children are left[i] and left[i] + 1 (0: a leaf)."""

    points: np.ndarray
    ids: np.ndarray
    rows: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray

    @staticmethod
    def build(points: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> Tree:
        order = np.lexsort((rows, ids))
        points, ids, rows = points[order], ids[order], rows[order]
        at = np.arange(len(ids))
        start, end, left, low, high, first = [0], [len(ids)], [0], [], [], []
        node = 0
        while node < len(start):
            a, b = start[node], end[node]
            own = points[at[a:b]]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            first.append(int(ids[at[a:b]].min()))
            spread = high[-1].astype(np.float64) - low[-1]
            if b - a > leaf and spread.max() > 0:
                split = np.argpartition(own[:, int(np.argmax(spread))], (b - a) // 2)
                at[a:b] = at[a:b][split]
                middle = a + (b - a) // 2
                left[node] = len(start)
                start += [a, middle]
                end += [middle, b]
                left += [0, 0]
            node += 1
        return Tree(points[at], ids[at], rows[at], np.array(start), np.array(end), np.array(left), np.array(low), np.array(high), np.array(first))

    def search(self, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """Per query at most k (score, -id), best first, of points that are not the query's ``own`` row and score at least ``floor``."""
        big = float(np.abs(queries).max(initial=0)) * float(max(np.abs(self.low).max(), np.abs(self.high).max())) * queries.shape[1]
        kind = np.float64 if big < EXACT else np.int64
        q, points = queries.astype(kind), self.points.astype(kind)
        bounds = np.maximum(q, 0) @ self.high.astype(kind).T + np.minimum(q, 0) @ self.low.astype(kind).T
        out = []
        for i in range(len(q)):
            best: list[tuple[int, int]] = []  # a heap, worst first
            heap = [(-bounds[i, 0], 0)]
            while heap:
                bound, node = heapq.heappop(heap)
                bound = -bound
                worst = best[0][0] if len(best) == k else floor[i]
                if bound < worst:
                    break
                if len(best) == k and bound == worst and self.first[node] >= -best[0][1]:
                    continue
                if child := int(self.left[node]):
                    for c in (child, child + 1):
                        if bounds[i, c] >= worst:
                            heapq.heappush(heap, (-bounds[i, c], c))
                    continue
                a, b = self.start[node], self.end[node]
                scores = points[a:b] @ q[i]
                good = np.flatnonzero(scores >= worst)
                if len(good) > 4 * k:
                    kth = np.partition(scores[good], len(good) - k - 1)[len(good) - k - 1]
                    good = good[scores[good] >= kth]
                for s, v in sorted(((int(scores[j]), -int(self.ids[a + j])) for j in good if self.rows[a + j] != own[i]), reverse=True)[:k]:
                    if len(best) < k:
                        heapq.heappush(best, (s, v))
                    elif (s, v) > best[0]:
                        heapq.heapreplace(best, (s, v))
                    else:
                        break
            out.append(sorted(best, reverse=True))
        return out


_TREE = ("points", "ids", "rows", "start", "end", "left", "low", "high", "first")


def _pack(tree: Tree) -> dict:
    small = np.int16 if max(np.abs(tree.low).max(), np.abs(tree.high).max()) < 1 << 15 else np.int64
    kinds = {"points": small, "low": small, "high": small}
    return {name: getattr(tree, name).astype(kinds.get(name, np.int64)).tobytes() for name in _TREE} | {"wide": small is np.int64}


def _unpack(row: pd.Series, dim: int) -> Tree:
    small = np.int64 if row["wide"] else np.int16
    got = {name: np.frombuffer(row[name], small if name in ("points", "low", "high") else np.int64) for name in _TREE}
    return Tree(**got | {name: got[name].reshape(-1, dim) for name in ("points", "low", "high")})


# ---------------------------------------------------------------- regions


@dataclass
class Cuts:
    """A tree of median splits: node i sends points with ``axis`` at most ``value`` to ``left``, others to left + 1; leaves have a region."""

    axis: np.ndarray
    value: np.ndarray
    left: np.ndarray
    region: np.ndarray

    @staticmethod
    def learn(points: np.ndarray, regions: int) -> Cuts:
        axis, value, left, region = [0], [0], [0], [-1]
        todo, found = [(0, points, regions)], 0
        while todo:
            node, own, n = todo.pop()
            spread = own.max(axis=0).astype(np.float64) - own.min(axis=0) if len(own) else np.zeros(1)
            if n < 2 or len(own) < 2 or spread.max() == 0:
                region[node], found = found, found + 1
                continue
            at = int(np.argmax(spread))
            column = np.sort(own[:, at])
            cut = column[(len(column) - 1) // 2]
            if cut == column[-1]:
                cut = column[np.searchsorted(column, cut) - 1]
            axis[node], value[node], left[node] = at, int(cut), len(axis)
            low = own[:, at] <= cut
            for part, share in ((own[low], n // 2), (own[~low], n - n // 2)):
                todo.append((len(axis), part, share))
                for column_, x in ((axis, 0), (value, 0), (left, 0), (region, -1)):
                    column_.append(x)
        return Cuts(np.array(axis), np.array(value), np.array(left), np.array(region))

    def route(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        while (open_ := self.left[node] > 0).any():
            right = points[np.arange(len(points)), self.axis[node]] > self.value[node]
            node = np.where(open_, self.left[node] + right, node)
        return self.region[node]


@dataclass
class Regions:
    """Regions of one vector length: names, how many trees each has, and tight boxes."""

    names: np.ndarray
    trees: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No row of a region has a higher inner product with a query; rounding is added, not lost."""
        q, low, high = queries.astype(np.float64), self.low.astype(np.float64), self.high.astype(np.float64)
        size = np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T
        return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T + size * 1e-12


# ---------------------------------------------------------------- jobs


def _usable(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str) -> DataFrame:
    """(row, id, v, dim, asks) of every usable row; ``row`` tells rows with the same id and vector apart."""
    rows = vectors.select(F.col(id_col).alias("id"), quantised(F.col(vector_col)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull())
    return staged(rows.select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("id"), "v", F.size("v").alias("dim"), "asks"), "topk-vectors")


def _points(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.int64)


def build_index(clean: DataFrame, shard_rows: int = SHARD_ROWS, leaf: int = LEAF, regions: int = REGIONS) -> DataFrame:
    """One row for each tree: (dim, region, tree, its arrays). Every row of ``clean`` is indexed once; vectors of different
    lengths get regions of their own. A region with more rows than ``shard_rows``, such as one common vector's, has several
    trees, over which its rows are dealt by a hash of the row.
    """
    sizes = {r["dim"]: r["n"] for r in clean.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    rate = int(min(1.0, SAMPLE_ROWS / max(1, total)) * 1_000_000)
    drawn: dict[int, list] = {}
    for r in clean.where(F.pmod(F.xxhash64("row", F.lit(2)), F.lit(1_000_000)) < rate).select("dim", "v").toLocalIterator():
        drawn.setdefault(r["dim"], []).append(r["v"])
    cuts = {d: Cuts.learn(np.array(sorted(drawn[d]), dtype=np.int64), min(-(-n // shard_rows), -(-regions * n // total))) for d, n in sizes.items() if d in drawn}
    shared = clean.sparkSession.sparkContext.broadcast(cuts)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, own in batch.groupby("dim"):
                region = shared.value[dim].route(_points(own["v"])) if dim in shared.value else np.zeros(len(own), np.int64)
                yield pd.DataFrame({"row": own["row"], "id": own["id"], "v": own["v"], "dim": own["dim"], "region": region})

    routed = staged(clean.select("row", "id", "v", "dim").mapInPandas(route, "row long, id long, v array<long>, dim int, region long"), "topk-routed")
    counts = routed.groupBy(F.col("dim").alias("d"), F.col("region").alias("g")).agg(F.ceil(F.count("*") / shard_rows).cast("long").alias("trees"))
    counts = staged(counts, "topk-sizes")
    dealt = routed.join(counts, (F.col("dim") == F.col("d")) & (F.col("region") == F.col("g"))).withColumn("tree", F.pmod(F.xxhash64("row"), F.col("trees")))
    schema = "dim int, region long, tree long, box_low array<long>, box_high array<long>, " + ", ".join(f"{n} binary" for n in _TREE) + ", wide boolean"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree = Tree.build(_points(rows["v"]), rows["id"].to_numpy(np.int64), rows["row"].to_numpy(np.int64), leaf)
        box = {"box_low": tree.low[0].tolist(), "box_high": tree.high[0].tolist()}
        return pd.DataFrame([{"dim": key[0], "region": key[1], "tree": key[2]} | box | _pack(tree)])

    return staged(dealt.groupBy("dim", "region", "tree").applyInPandas(run, schema), "topk-trees")


def region_boxes(trees: DataFrame) -> dict[int, Regions]:
    """The boxes of all regions, at most about REGIONS of them, on the driver."""
    corner = F.posexplode(F.arrays_zip("box_low", "box_high")).alias("at", "x")
    corners = trees.select("dim", "region", corner).groupBy("dim", "region", "at").agg(F.min("x.box_low").alias("low"), F.max("x.box_high").alias("high"))
    boxes = corners.groupBy("dim", "region").agg(F.sort_array(F.collect_list(F.struct("at", "low", "high"))).alias("box"))
    counts = trees.groupBy("dim", "region").agg(F.count("*").alias("trees"))
    out: dict[int, list] = {}
    for r in boxes.join(counts, ["dim", "region"]).collect():
        out.setdefault(r["dim"], []).append((r["region"], r["trees"], [c["low"] for c in r["box"]], [c["high"] for c in r["box"]]))
    return {d: Regions(*(np.array(x) for x in zip(*sorted(rows), strict=True))) for d, rows in out.items()}


_PACKED = "dim int, block long, region long, tree long, width int, rows binary, ids binary, v binary, floors binary, homes binary"


def _narrow(v: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as they need."""
    for kind in (np.int16, np.int32):
        if not v.size or (v.min() >= np.iinfo(kind).min and v.max() <= np.iinfo(kind).max):
            return v.astype(kind)
    return v


def _search(asked: DataFrame, trees: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(row, query_id, vec_id, score) of packed queries (``visits``) in their trees; a group is one tree and one block of queries."""
    keys = ["dim", "region", "tree", "block"]
    schema = "row long, query_id long, vec_id long, score long"
    spread = trees.drop("box_low", "box_high").join(blocks.withColumnRenamed("dim", "of"), F.col("dim") == F.col("of")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("of", "blocks")

    def run(queries: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(queries) and len(own):
            tree = _unpack(own.iloc[0], int(queries["dim"].iloc[0]))
            for p in queries.itertuples():
                row, ids, homes, floor = (np.frombuffer(x, t) for x, t in ((p.rows, np.int64), (p.ids, np.int64), (p.homes, np.int64), (p.floors, np.float64)))
                q = np.frombuffer(p.v, f"i{p.width}").reshape(len(row), -1).astype(np.int64)
                new = homes != p.tree  # a query has been in its first tree
                if new.any():
                    got = tree.search(q[new], row[new], floor[new], k)
                    rows += [(int(r), int(i), -v, s) for r, i, best in zip(row[new], ids[new], got, strict=True) for s, v in best]
        return pd.DataFrame(rows, columns=["row", "query_id", "vec_id", "score"]).astype("int64")

    return asked.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(run, schema)


def visits(queries: DataFrame, regions: dict[int, Regions], nearest: bool) -> DataFrame:
    """Queries packed by the tree that they visit, one row for each tree and step: of the region with the highest bound one
    tree, by a hash of the row, or all trees of the regions whose bound reaches the query's floor.

    A vector travels in as few bytes as its numbers need. ``homes`` is a query's first tree where that is in the region of the
    row, else -1: it is not searched again.
    """
    shared = queries.sparkSession.sparkContext.broadcast(regions)
    step = 1024

    def packed(own: pd.DataFrame, v: np.ndarray, at: np.ndarray, region: int, tree: int, homes: np.ndarray) -> dict:
        part = own.iloc[at]
        small = _narrow(v[at])
        columns = {"rows": part["row"].to_numpy(np.int64), "ids": part["id"].to_numpy(np.int64), "v": small, "floors": part["floor"].to_numpy(np.float64), "homes": homes}
        return {"dim": v.shape[1], "block": part["block"].iloc[0], "region": region, "tree": tree, "width": small.dtype.itemsize} | {c: np.ascontiguousarray(x).tobytes() for c, x in columns.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (dim, _), whole in batch.groupby(["dim", "block"]):
                known, out = shared.value[dim], []
                for a in range(0, len(whole), step):
                    own = whole.iloc[a : a + step]
                    v = _points(own["v"])
                    bounds = known.bounds(v)
                    if nearest:
                        best = bounds.argmax(axis=1)
                        tree = (mix64(own["row"].to_numpy(np.int64).view(np.uint64)) % known.trees[best].astype(np.uint64)).astype(np.int64)
                        for r, t in sorted(set(zip(best.tolist(), tree.tolist(), strict=True))):
                            at = np.flatnonzero((best == r) & (tree == t))
                            out.append(packed(own, v, at, int(known.names[r]), t, np.full(len(at), -1)))
                        continue
                    reached = bounds >= own["floor"].to_numpy(np.float64)[:, None]
                    home_region, home_tree = own["home_region"].to_numpy(np.int64), own["home_tree"].to_numpy(np.int64)
                    for r in np.flatnonzero(reached.any(axis=0)).tolist():
                        at = np.flatnonzero(reached[:, r])
                        homes = np.where(home_region[at] == known.names[r], home_tree[at], -1)
                        for t in range(int(known.trees[r])):
                            if (homes != t).any():
                                out.append(packed(own, v, at[homes != t], int(known.names[r]), t, homes[homes != t]))
                if out:
                    yield pd.DataFrame(out)

    return queries.mapInPandas(run, _PACKED)


def _homes(packed: DataFrame) -> DataFrame:
    """(of, home_region, home_tree) of packed queries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p in batch.itertuples():
                yield pd.DataFrame({"of": np.frombuffer(p.rows, np.int64), "home_region": p.region, "home_tree": p.tree})

    return packed.select("rows", "region", "tree").mapInPandas(run, "of long, home_region long, home_tree long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, regions: int = REGIONS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest integer inner product with each query row, ties to the smaller id.

    Candidates are all other rows with a vector of the same length, rows with the same id or the same vector among them: only
    the query's own row is left out. Rows with a null id or an unusable vector take no part, queries without any candidate
    have no row, and each of several query rows with one id has its own ranks.
    """
    clean = _usable(vectors, is_query, id_col, vector_col)
    trees = build_index(clean, shard_rows, regions=regions)
    boxes = region_boxes(trees)
    asks = clean.where("asks")
    blocks = staged(asks.groupBy("dim").agg(F.ceil(F.count("*") / block_rows).cast("long").alias("blocks")), "topk-blocks")
    none = float("-inf")
    queries = asks.select("row", "id", "v", "dim").join(blocks.withColumnRenamed("dim", "of"), F.col("dim") == F.col("of"))
    queries = staged(queries.select("row", "id", "v", "dim", F.pmod(F.xxhash64("row", F.lit(1)), F.col("blocks")).alias("block"), F.lit(none).alias("floor")), "topk-queries")
    home = staged(visits(queries, boxes, True), "topk-homes")
    near = staged(_search(home, trees, blocks, k), "topk-near")
    kth = near.groupBy(F.col("row").alias("found")).agg(F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(none).alias("kth"))
    kth = staged(_homes(home).join(kth, F.col("of") == F.col("found"), "left").drop("found"), "topk-bounds")
    bounded = queries.drop("floor").join(kth, F.col("row") == F.col("of")).select("row", "id", "v", "dim", "block", F.coalesce("kth", F.lit(none)).alias("floor"), "home_region", "home_tree")
    far = _search(visits(bounded, boxes, False), trees, blocks, k)
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    best = near.unionByName(far).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
