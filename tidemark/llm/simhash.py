"""Near-duplicates by SimHash and Golay-code fuzzy hashing.

A fingerprint is cut into three segments of 22, 21 and 21 bits. The perfect [23, 12, 7] Golay code turns a segment into
the indices of its nearby codewords: one, or six for words at distance three. Two segments at distance two or less always
share an index. Four differing bits over three segments leave two cases:

* one segment is equal and another differs in at most two bits: key = the equal segment and an index of the other;
* every segment differs, two of them in one bit each and the third in at most two: key = an equal half of each of the
  two and an index of the third.

Either key has some 33 bits, so chance collisions stay rare far beyond billions of fingerprints. Keys are brought
together by a shuffle and verified; each key's rows give a spanning forest of the true links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import staged, with_scores
from tidemark.llm.components import connected_components

SHINGLE = 4
SEED = 42
MAX_BITS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
_BLOCK = 1 << 14
#: Fingerprints of one key that are compared with each other directly; more are split further.
FOREST_ROWS = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of a whole text: bit b is set if over half of the shingle hashes set it. Texts without words give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII blanks split
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = len(words) - shingle + 1
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):
        a, b = starts[at : min(n, at + _BLOCK)].tolist(), ends[at + shingle - 1 : min(n, at + _BLOCK) + shingle - 1].tolist()
        hashes = np.array([digest(joined[x:y], seed) for x, y in zip(a, b, strict=True)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * counts > n).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``simhash`` (fp long, the fingerprint's 64 bits)."""

    def scorer():
        return lambda texts: [np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)]

    return with_scores(docs, text_col, [T.StructField("fp", T.LongType())], scorer, "simhash")


# ---------------------------------------------------------------- Golay code

#: Generator polynomial of the perfect binary Golay code (a fixed value of the code).
GENERATOR = 0b110001110101


class Golay:
    """Nearby codewords of 23-bit words by their syndrome."""

    def __init__(self) -> None:
        parity = np.zeros(1 << 12, np.uint32)
        for hi in range(1 << 12):
            rest = hi << 11
            for bit in range(22, 10, -1):
                if rest >> bit & 1:
                    rest ^= GENERATOR << (bit - 11)
            parity[hi] = rest
        self.parity = parity
        by: dict[int, list[int]] = {}
        for weight in range(5):
            for places in combinations(range(23), weight):
                error = sum(1 << p for p in places)
                own = by.setdefault(int(self.syndrome(np.array([error], np.uint32))[0]), [])
                # distance four counts only where no codeword is nearer than three
                if weight < 4 or (len(own) and own[0].bit_count() == 3):
                    own.append(error)
        self.errors = np.zeros((1 << 11, 6), np.uint32)
        self.count = np.zeros(1 << 11, np.int64)
        for s, own in by.items():
            self.errors[s, : len(own)] = own
            self.count[s] = len(own)

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        return self.parity[x >> 11] ^ (x & 0x7FF)

    def nearby(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, 6) codeword indices of each word, and how many of the six count."""
        s = self.syndrome(x)
        return (x[:, None] ^ self.errors[s]) >> 11, self.count[s]


_code: list[Golay] = []


def golay() -> Golay:
    if not _code:
        _code.append(Golay())
    return _code[0]


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row): the fuzzy keys of each fingerprint. Fingerprints at most four bits apart share one at least."""
    segment = [((fps >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.uint32) for at, size in SEGMENTS]
    halves = [((s >> 11).astype(np.uint64), (s & 0x7FF).astype(np.uint64)) for s in segment]
    near = [golay().nearby(s) for s in segment]
    exact: list[tuple[np.ndarray, int]] = []
    for j in range(3):
        i, k = (j + 1) % 3, (j + 2) % 3
        exact += [(segment[i].astype(np.uint64), j), (segment[k].astype(np.uint64), j)]
        exact += [(a << np.uint64(11) | b, j) for a in halves[i] for b in halves[k]]
    out, rows = [], []
    slot = np.arange(6)
    for case, (bits, j) in enumerate(exact):
        index, n = near[j]
        base = np.uint64(case) << np.uint64(40) | bits << np.uint64(12)
        row, at = np.nonzero(slot[None, :] < n[:, None])
        out.append(base[row] | index[row, at].astype(np.uint64))
        rows.append(row)
    return np.concatenate(out).view(np.int64), np.concatenate(rows)


def forest(fps: np.ndarray, most: int = MAX_BITS, block: int = FOREST_ROWS) -> list[tuple[int, int]]:
    """Index pairs of true links among distinct fingerprints that connect all that links connect.

    Up to ``block`` fingerprints this is a spanning forest, by breadth-first search over those not yet reached. More of them
    are split by the pigeonhole principle: the bits in which they vary are dealt to one part more than bits may differ, so
    linked fingerprints agree in a part; each part's groups of equal values are searched on their own, again split if large.
    """
    if len(fps) > block:
        varying = np.flatnonzero([bool(np.bitwise_or.reduce(fps ^ fps[0]) >> np.uint64(i) & np.uint64(1)) for i in range(64)])
        if len(varying) <= most:
            return [(0, i) for i in range(1, len(fps))]  # all of them are linked
        found = set()
        for part in np.array_split(varying, most + 1):
            mask = np.uint64(sum(1 << int(i) for i in part))
            order = np.argsort(fps & mask, kind="stable")
            value = (fps & mask)[order]
            edges = np.flatnonzero(np.r_[True, value[1:] != value[:-1], True])
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if y - x > 1:
                    own = order[x:y]
                    found.update((int(own[p]), int(own[q])) for p, q in forest(fps[own], most, block))
        return sorted(found)
    left, out = np.arange(len(fps)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            p = queue.pop()
            hit = np.bitwise_count(fps[left] ^ fps[p]) <= most
            if hit.any():
                new = left[hit].tolist()
                out += [(p, q) for q in new]
                queue += new
                left = left[~hit]
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of each run of equal keys in sorted (key, fp) batches; the last run of a batch waits for the next."""
    waiting: list[tuple[np.ndarray, np.ndarray]] = []  # the pieces of a run that may go on, joined once it has ended

    def found(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch | None:
        if len(k) < 2:
            return None
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        sizes = np.diff(np.r_[starts, len(k)])
        u = f.view(np.uint64)
        two = starts[sizes == 2]
        two = two[np.bitwise_count(u[two] ^ u[two + 1]) <= MAX_BITS]
        a, b = [f[two]], [f[two + 1]]
        for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            if pairs := forest(u[at : at + n]):
                p = np.array(pairs) + at
                a.append(f[p[:, 0]])
                b.append(f[p[:, 1]])
        a, b = np.concatenate(a), np.concatenate(b)
        both = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    def ended(*more: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch | None:
        pieces = [*waiting, *more]
        waiting.clear()
        return found(np.concatenate([k for k, _ in pieces]), np.concatenate([f for _, f in pieces])) if pieces else None

    for batch in batches:
        k, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(k):
            continue
        cut = int(np.searchsorted(k, k[-1]))
        if cut or (waiting and waiting[-1][0][-1] != k[0]):
            if (got := ended((k[:cut], f[:cut]))) is not None:
                yield got
        waiting.append((k[cut:], f[cut:]))
    if (got := ended()) is not None:
        yield got


def links(prints: DataFrame, column: str = "fp") -> DataFrame:
    """(a, b): verified links between distinct fingerprints, a spanning forest within each key; together they connect all
    that four bits or fewer connect."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), _BLOCK // 4):
                part = fps[at : at + _BLOCK // 4]
                key, row = keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], names=["key", "fp"])

    keyed = prints.select(F.col(column).alias("fp")).mapInArrow(emit, "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) of every row: fingerprint and the smallest id reachable by links of four bits or fewer.

    Equal fingerprints are one class from the start, so copies, however many, are a single row of the link search. Null,
    empty and blank texts share fingerprint zero and are one class. Null ids take part and get their class's smallest id;
    repeated rows are returned each.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = staged(with_fingerprints(own).select("id", F.col("simhash.fp").alias("fp")), "simhash-fp")
    classes = staged(marked.groupBy("fp").agg(F.min("id").alias("first")), "simhash-classes")
    found = staged(links(classes), "simhash-links")
    nodes = staged(connected_components(found), "simhash-nodes")
    rooted = classes.join(nodes.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    rooted = staged(rooted, "simhash-rooted")
    lowest = staged(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-lowest")
    answer = staged(rooted.join(lowest, "root").select("fp", "component_id"), "simhash-answer")
    return marked.join(answer, "fp").select("id", "fp", "component_id")
