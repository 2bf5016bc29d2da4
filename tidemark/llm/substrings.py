"""Removal of passages that repeat, by suffix trees over groups of suffixes that share a prefix.

Suffixes start at anchors: of the prefixes of ``PREFIX`` words inside a window, the one with the smallest hash is the window's
anchor, so equal windows have it at the same place and about one word in fourteen is one. Suffixes are grouped by that
prefix. A prefix that occurs once ends there; the others are cut out with the words around them and dealt to tasks in groups
of bounded size, each of which becomes a tree (sorted suffixes and the words that neighbours share) to the right of the
anchor and one to the left. A window repeats if two suffixes lie under the same node of its depth on either side.

A group too large for one task is dealt to several trees; what is single in its own tree is brought together again under the
longest prefix, the whole window, after each tree has given every window once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SLICE_BYTES, _power_table, mix64, staged

WINDOW, PREFIX = 35, 8
#: Suffixes of one tree, about: its words are matrices of some 600 bytes a suffix.
TREE_ROWS = 30_000
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


# ---------------------------------------------------------------- words and anchors


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each word ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text."""
    part = np.zeros(len(raw) + 2, bool)
    np.logical_not(_BLANK[np.frombuffer(raw, np.uint8)], out=part[1:-1])
    edge = np.flatnonzero(part[1:] != part[:-1])
    return edge[::2], edge[1::2]


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, in blocks of about SLICE_BYTES."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        last = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE_BYTES, "right")))
        a, b = int(starts[at]), int(ends[last - 1])
        data = np.frombuffer(raw, np.uint8, count=b - a, offset=a).astype(np.uint64) + np.uint64(1)
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data * _power_table(len(data) + 1, "up")[: len(data)], out=prefix[1:])
        s, e = starts[at:last] - a, ends[at:last] - a
        out[at:last] = mix64((prefix[e] - prefix[s]) * _power_table(len(data) + 1, "down")[s])
        at = last
    return out


def run_hashes(hashed: np.ndarray, n: int, factor: np.uint64 = _FACTORS[0]) -> np.ndarray:
    """Hash of each run of n words."""
    if len(hashed) < n:
        return np.zeros(0, np.uint64)
    out = hashed[: len(hashed) - n + 1] * factor
    for k in range(1, n):
        out = mix64(out) * factor + hashed[k : len(hashed) - n + 1 + k]
    return mix64(out)


def anchors(hashed: np.ndarray, pointers: np.ndarray, window: int = WINDOW, prefix: int = PREFIX) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, prefix hash, reach) of the anchors of texts whose words are ``hashed[pointers[i]:pointers[i + 1]]``.

    ``reach`` is 256 * most + least words that windows of the anchor have before it.
    """
    span = window - prefix + 1
    empty = np.zeros(0, np.int64)
    if len(hashed) < window:
        return empty, empty, np.zeros(0, np.uint64), empty
    grams = run_hashes(hashed, prefix)
    least = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64) % np.uint64(1 << 24)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    start = np.arange(len(least))
    owner = np.searchsorted(pointers, start, "right") - 1
    inside = start + window <= pointers[np.minimum(owner + 1, len(pointers) - 1)]
    start, owner, low = start[inside], owner[inside], (least[inside] & np.uint64((1 << 24) - 1)).astype(np.int64)
    place = start + (low - start) % (1 << 24)
    if not len(place):
        return empty, empty, np.zeros(0, np.uint64), empty
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])
    final = np.r_[first[1:] - 1, len(place) - 1]
    at = place[first]
    return owner[first], at - pointers[owner[first]], grams[at], 256 * (at - start[first]) + (at - start[final])


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE_BYTES together; a longer one is alone."""
    at, size = 0, 0
    for i, raw in enumerate(texts):
        if i > at and size + len(raw) > SLICE_BYTES:
            yield at, i
            at, size = i, 0
        size += len(raw)
    if at < len(texts):
        yield at, len(texts)


def _index(keep_text: bool, window: int, prefix: int):
    """(id, key, text) rows to (id, key, n_words, kept, grams, places): words in all, what stays if nothing repeats, anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
            for a, b in _groups(raws):
                joined = b"\n".join(raws[a:b])
                begins = np.cumsum([0] + [len(r) + 1 for r in raws[a:b]])
                starts, ends = word_spans(joined)
                pointers = np.searchsorted(starts, begins)
                owner, place, gram, reach = anchors(word_hashes(joined, starts, ends), pointers, window, prefix)
                offsets = pa.array(np.searchsorted(owner, np.arange(b - a + 1)), pa.int32())
                whole = [b" ".join(r.split()) for r in raws[a:b]]
                kept = pa.array([w.decode("utf-8", "surrogatepass") for w in whole] if keep_text else [hashlib.sha256(w).hexdigest() for w in whole], pa.string())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (gram.view(np.int64), place << 16 | reach)]
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(np.diff(pointers)), kept, *lists], names=["id", "key", "n_words", "kept", "grams", "places"])

    return run


# ---------------------------------------------------------------- trees


def _cut(window: int):
    """(key, text, anchors) rows to suffixes with the words around them: (gram, tree, trees, key, place, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "tree", "trees", "key", "place", "words"]
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(1)[i].as_py().encode("utf-8", "surrogatepass")
                own = batch.column(2)[i].values
                gram, place, trees = (own.field(n).to_numpy(zero_copy_only=False) for n in ("gram", "place", "trees"))
                words = raw.split()
                at, most, least = place >> 16, place >> 8 & 255, place & 255
                parts = [b" ".join(words[x:y]) for x, y in zip((at - most).tolist(), (at - least + window).tolist(), strict=True)]
                salt = mix64(place.astype(np.uint64) + np.uint64(int.from_bytes(batch.column(0)[i].as_py()[:8], "little")))
                tree = (salt % trees.astype(np.uint64)).astype(np.int32)
                key = pa.array([batch.column(0)[i].as_py()] * len(place), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(tree), pa.array(trees), key, pa.array(place), pa.array(parts, pa.binary())], names=names)

    return run


def _sorted(matrix: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, shared): rows sorted by group and then word by word, and the words each shares with the one before; -1 between groups."""
    width = matrix.shape[1]
    order = np.lexsort((*[matrix[:, k] for k in range(width - 1, -1, -1)], group))
    m, size, g = matrix[order], sizes[order], group[order]
    differ = np.ones((len(m) - 1, width + 1), bool)
    np.not_equal(m[1:], m[:-1], out=differ[:, :width])
    shared = np.minimum(differ.argmax(axis=1), np.minimum(size[1:], size[:-1]))
    shared[g[1:] != g[:-1]] = -1
    return order, np.r_[-1, shared]


def repeats(group: np.ndarray, hashed: np.ndarray, offsets: np.ndarray, most: np.ndarray, least: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, before, class) of every window of the suffixes and a number that equal windows of a group have in common.

    Suffix i has the word hashes ``hashed[offsets[i]:offsets[i + 1]]`` with its anchor after ``most[i]`` words; its windows have
    ``least[i]`` to ``most[i]`` words before the anchor.
    """
    n = len(group)
    after, before = window - least, most
    anchor = offsets[:-1] + most
    right = np.zeros((n, int(after.max())), np.uint64)
    for k in range(right.shape[1]):
        has = after > k
        right[has, k] = hashed[anchor[has] + k]
    left = np.zeros((n, int(before.max())), np.uint64)
    for k in range(left.shape[1]):
        has = before > k
        left[has, k] = hashed[anchor[has] - 1 - k]
    (by_right, shared_right), (by_left, shared_left) = _sorted(right, after, group), _sorted(left, before, group)
    rows, places, classes, base = [], [], [], 0
    nodes = np.empty((2, n), np.int64)
    for o in range(int(least.min()), int(most.max()) + 1):
        own = np.flatnonzero((least <= o) & (o <= most))
        if not len(own):
            continue
        nodes[0, by_right] = np.cumsum(shared_right < window - o)  # suffixes under one node of that depth
        nodes[1, by_left] = np.cumsum(shared_left < o)
        _, number = np.unique(nodes[0, own] * np.int64(n + 1) + nodes[1, own], return_inverse=True)
        rows.append(own)
        places.append(np.full(len(own), o))
        classes.append(number.reshape(-1) + base)
        base += int(number.max()) + 1
    return np.concatenate(rows), np.concatenate(places), np.concatenate(classes)


_FOUND = "key binary, place long, mask long, w1 long, w2 long"


def _trees(window: int):
    """Sorted suffixes to marks (key, place of the anchor, mask: bit o for the window that starts o words before), and for groups
    that are dealt to several trees each window once: (key, place of its start, mask 1 if single here, w1, w2)."""

    def solved(columns: list[np.ndarray]) -> pa.RecordBatch | None:
        gram, tree, trees, key, place, words = columns
        group = np.cumsum(np.r_[True, (gram[1:] != gram[:-1]) | (tree[1:] != tree[:-1])])
        joined = b"\n".join(words)
        starts, ends = word_spans(joined)
        hashed = word_hashes(joined, starts, ends)
        offsets = np.searchsorted(starts, np.cumsum([0] + [len(w) + 1 for w in words]))
        at, most, least = place >> 16, place >> 8 & 255, place & 255
        row, before, number = repeats(group, hashed, offsets, most, least, window)
        size = np.bincount(number)
        mask = np.zeros(len(place), np.int64)
        twice = size[number] > 1
        np.bitwise_or.at(mask, row[twice], np.int64(1) << before[twice])
        hit = np.flatnonzero(mask)
        out = [[key[hit], at[hit], mask[hit], np.zeros(len(hit), np.int64), np.zeros(len(hit), np.int64)]]
        split = trees[row] > 1
        if split.any():
            row, before, number = row[split], before[split], number[split]
            _, one = np.unique(number, return_index=True)
            row, before, single = row[one], before[one], size[number[one]] == 1
            first = offsets[row] + most[row] - before
            label = [run_hashes(hashed, window, f)[first].view(np.int64) for f in _FACTORS]
            out.append([key[row], at[row] - before, single.astype(np.int64), *label])
        parts = [np.concatenate(x) for x in zip(*out, strict=True)]
        merged = np.r_[np.zeros(len(hit), bool), np.ones(len(parts[0]) - len(hit), bool)]
        arrays = [pa.array(parts[0].tolist(), pa.binary()), *[pa.array(p) for p in parts[1:3]], *[pa.array(p, mask=~merged) for p in parts[3:]]]
        return pa.RecordBatch.from_arrays(arrays, names=["key", "place", "mask", "w1", "w2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        rows = 0

        def columns(batch: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
            return [batch.column(i).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(i).to_numpy() for i in range(6)]

        for batch in batches:
            for a in range(0, batch.num_rows, TREE_ROWS):
                part = batch.slice(a, TREE_ROWS)
                waiting.append(part)
                rows += part.num_rows
                if rows < TREE_ROWS:
                    continue
                table = pa.Table.from_batches(waiting)
                gram, tree = table.column(0).to_numpy(), table.column(1).to_numpy()
                ends = np.flatnonzero((gram[1:] != gram[:-1]) | (tree[1:] != tree[:-1]))
                if not len(ends):
                    continue  # one group goes on: it is no larger than a tree may be
                cut = int(ends[-1]) + 1
                yield solved(columns(table.slice(0, cut)))
                rest = table.slice(cut)
                waiting, rows = rest.to_batches(), rest.num_rows
        if rows:
            yield solved(columns(pa.Table.from_batches(waiting)))

    return run


def repeated_places(texts: DataFrame, index: DataFrame, window: int = WINDOW, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(key, marks array of (place, mask)) of the texts that hold a window whose words also start elsewhere in other texts or
    again in the same one. ``texts`` has (key, text), one row or more for each key; ``index`` has (key, grams, places)."""
    zipped = index.select("key", F.explode(F.arrays_zip("grams", "places")).alias("x"))
    suffixes = zipped.select("key", F.col("x.grams").alias("gram"), F.col("x.places").alias("place"))
    often = suffixes.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    # written first: a hot prefix is then the skewed side of a plain join, which adaptive execution splits
    often = staged(often.select("gram", F.ceil(F.col("n") / tree_rows).cast("int").alias("trees")), "substring-prefixes")
    found = suffixes.join(often, "gram")
    wanted = found.groupBy("key").agg(F.collect_set(F.struct("gram", "place", "trees")).alias("anchors"))
    one = texts.groupBy("key").agg(F.first("text").alias("text"))
    cut = one.join(wanted, "key").mapInArrow(_cut(window), "gram long, tree int, trees int, key binary, place long, words binary")
    marks = staged(cut.repartition("gram", "tree").sortWithinPartitions("gram", "tree").mapInArrow(_trees(window), _FOUND), "substring-marks")
    # windows of groups that were dealt to several trees, one row for each tree
    labelled = marks.where("w1 IS NOT NULL")
    shared = labelled.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    again = labelled.where("mask = 1").join(shared, ["w1", "w2"]).select("key", "place", "mask")
    return marks.where("w1 IS NULL").select("key", "place", "mask").unionByName(again).groupBy("key").agg(F.collect_set(F.struct("place", "mask")).alias("marks"))


# ---------------------------------------------------------------- texts


def _removed(keep_text: bool, window: int):
    """(key, text, marks) to (key, n_removed, rest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, rest = [], []
            for i in range(batch.num_rows):
                words = batch.column(1)[i].as_py().encode("utf-8", "surrogatepass").split()
                own = batch.column(2)[i].values
                place, mask = (own.field(n).to_numpy(zero_copy_only=False) for n in ("place", "mask"))
                change = np.zeros(len(words) + 1, np.int64)
                for o in range(window):
                    start = place[mask >> o & 1 == 1] - o
                    np.add.at(change, start, 1)
                    np.add.at(change, start + window, -1)
                stays = np.cumsum(change[:-1]) == 0
                left = b" ".join([words[k] for k in np.flatnonzero(stays).tolist()])
                gone.append(len(words) - int(stays.sum()))
                rest.append(left.decode("utf-8", "surrogatepass") if keep_text else hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.int64()), pa.array(rest, pa.string())], names=["key", "n_removed", "rest"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, prefix: int = PREFIX, tree_rows: int = TREE_ROWS, keep_text: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept) of every row: its words without those covered by a window that occurs more than once.

    ``kept`` is the remaining words joined by single spaces, or with ``keep_text=False`` the SHA-256 of that in hex. A window lies
    within one row; it repeats if its words also start anywhere else, in the same row or in another. Rows with equal texts are
    one text that occurs often: all its words go if it has a window. Null and blank texts have no words; ids may be null or
    repeated; no rows give none.
    """
    key = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    keyed = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    index = staged(keyed.mapInArrow(_index(keep_text, window, prefix), f"id {id_type}, key binary, n_words long, kept string, grams array<long>, places array<long>"), "substring-index")
    copies = staged(index.groupBy("key").agg(F.count("*").alias("n"), F.min("n_words").alias("n_words")).where((F.col("n") > 1) & (F.col("n_words") >= window)).select("key"), "substring-copies")
    texts = keyed.select("key", "text")
    marks = staged(repeated_places(texts, index, window, tree_rows), "substring-places")
    part = texts.groupBy("key").agg(F.first("text").alias("text")).join(marks.join(copies, "key", "left_anti"), "key")
    part = part.mapInArrow(_removed(keep_text, window), "key binary, n_removed long, rest string")
    nothing = F.lit("" if keep_text else hashlib.sha256(b"").hexdigest())
    whole = copies.select("key", F.lit(None).cast("long").alias("n_removed"), nothing.alias("rest"))
    gone = staged(part.unionByName(whole).withColumn("hit", F.lit(True)), "substring-gone")
    out = index.select("id", "key", "n_words", "kept").join(gone, "key", "left")
    n_removed = F.when(F.col("hit").isNull(), F.lit(0).cast("long")).otherwise(F.coalesce("n_removed", "n_words"))
    return out.select("id", "n_words", n_removed.alias("n_removed"), F.coalesce("rest", "kept").alias("kept"))

