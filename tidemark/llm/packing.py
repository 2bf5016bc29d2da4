"""Best-fit packing of tokenised documents into fixed-length sequences, with certified bin counts.

Texts are tokenised where they lie; only (id, piece, length) moves. Pieces are numbered as they are written and dealt by a
hash of that number to partitions of bounded size, whatever their ids, packed there by best-fit decreasing, and each partition's bin count is certified by dual feasible functions.
Partitions that miss their bound put their loose bins into a common pool, which is dealt anew and packed again.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import _slices, staged

CAPACITY = 4096
END_ID = 1
#: Bins of one partition, about; a partition also holds at most PART_PIECES pieces on average.
PART_BINS = 1000
PART_PIECES = 50_000
ROUNDS = 2
#: A bin of a partition that misses its bound is exchanged if it is filled less than this.
LOOSE = 0.995
#: Blank-separated chunks and words whose ids a worker remembers (twice as many at most), and the longest such chunk.
CHUNKS, WORDS, CHUNK_CHARS = 200_000, 350_000, 48
SEGMENT = 1 << 20

#: A Latin word with ASCII punctuation behind it: the vocabulary's splitter parts the two, and the word is stable under NFC.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

_encoders: dict[int, Callable[[str], bytes]] = {}


# ---------------------------------------------------------------- tokens


class Recent(dict):
    """Remembers what ``make`` gave for recent keys, in two generations of at most ``limit`` keys; frequent keys stay."""

    def __init__(self, make: Callable[[str], bytes], limit: int, longest: int) -> None:
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def _word_model(spec: str, tokenizer) -> Callable[[str], bytes] | None:  # noqa: ANN001
    """Ids of a lower-cased Latin word from the vocabulary's merges alone, or None where the vocabulary is laid out otherwise.

    It fits if texts are normalised by NFC, white space and lower case, split at white space and between letters, digits and
    other characters, and merged byte-wise within a word. Then a word's ids do not depend on what stands around it. Probes
    of every letter and mark that the short cut takes are compared with the tokenizer.
    """
    layout = json.loads(spec)
    kinds = lambda part, name: [x.get("type") for x in (layout.get(part) or {}).get(name) or []]
    split = ((layout.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    fits = (
        kinds("normalizer", "normalizers") == ["NFC", "Replace", "Lowercase"]
        and kinds("pre_tokenizer", "pretokenizers") == ["Split", "ByteLevel"]
        and (split.get("behavior"), split.get("invert")) == ("Removed", True)
        and layout.get("post_processor") is None
        and layout["model"].get("type") == "BPE"
        and not layout["model"].get("dropout")
    )
    if not fits:
        return None
    from tokenizers.pre_tokenizers import ByteLevel

    letters = [chr(c) for c in range(0x41, 0x100) if re.fullmatch("[A-Za-zÀ-ÖØ-öø-ÿ]", chr(c))]
    marks = [chr(c) for c in range(0x21, 0x7F) if _SIMPLE.fullmatch("a" + chr(c)) and not chr(c).isalpha()]
    level = ByteLevel(add_prefix_space=False, use_regex=False)
    written = {ord(c): "".join(x for x, _ in level.pre_tokenize_str(c)) for c in letters}
    merge = tokenizer.model.tokenize

    def ids(word: str) -> bytes:
        return array("I", [t.id for t in merge(word.translate(written))]).tobytes()

    whole = lambda text: array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
    probes = ["".join(letters[i::k]) for k in (1, 7, 11) for i in range(k)]
    if any(ids(w.lower()) != whole(w) for w in [*probes, *letters]):
        return None
    if any(ids("ab") + whole(m) + ids("cd") != whole(f"ab{m} cd") for m in [*marks, *(a + b for a in marks for b in ".,!)")]):
        return None
    return ids


def encoder(spec: str) -> Callable[[str], bytes]:
    """Text to little-endian unsigned 32-bit ids, equal to the tokenizer's own ids without special tokens added.

    Where the vocabulary splits at white space and never joins across it (``_word_model`` checks that), the ids of a text are
    those of its blank-separated chunks in turn; recent chunks, and the lower-cased words in them, are looked up, and texts
    are cut at blanks to bound memory. Any other vocabulary encodes whole texts.
    """
    known = zlib.crc32(spec.encode())
    if known in _encoders:
        return _encoders[known]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    raw = lambda text: array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
    model = _word_model(spec, tokenizer)
    if model is None:
        return _encoders.setdefault(known, raw)
    words = Recent(model, WORDS, CHUNK_CHARS)

    def chunk(text: str) -> bytes:
        simple = _SIMPLE.fullmatch(text)
        if not simple:
            return raw(text) if text else b""
        word, rest = simple.groups()
        return words[word.lower()] + words[rest] if rest else words[word.lower()]

    chunks = Recent(chunk, CHUNKS, CHUNK_CHARS)

    def segment(text: str) -> bytes:
        return b"".join(map(chunks.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))

    def encode(text: str) -> bytes:
        if len(text) <= SEGMENT:
            return segment(text)
        out, at = [], 0
        while at < len(text):
            end = min(len(text), at + SEGMENT)
            if end < len(text):
                cuts = [p for p in (text.find(" ", end), text.find("\n", end)) if p >= 0]
                end = min(cuts, default=len(text))
            out.append(segment(text[at:end]))
            at = end
        return b"".join(out)

    return _encoders.setdefault(known, encode)


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every document: its ids and ``end_id``, cut only where longer than ``capacity``.

    A null text counts as empty and gives one piece with the end id alone. Rows with equal ids are documents of their own.
    The vocabulary file is read once on the driver and broadcast (its size does not depend on the data).
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    last = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(spec.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            for part in _slices(batch, 1):
                owner, piece, start, length, crc, kept = [], [], [], [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    ids = encode(text or "") + last
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        owner.append(row)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        if keep_ids:
                            kept.append(own)
                columns = [part.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array(kept, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


# ---------------------------------------------------------------- bins


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each length, and the number of bins. Longest first, each into the fullest bin that still takes it."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = used = 0  # bit r of mask: some bin has r places left
    for i in order.tolist():
        need = int(lengths[i])
        fits = mask >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, used
            used += 1
        bins[i], offsets[i] = b, capacity - room
        if left := room - need:
            free[left].append(b)
            mask |= 1 << left
    return bins, offsets, used


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing can beat, by two families of dual feasible functions.

    ``f_t``: 1 over capacity - t, 0 under t, else the share of the capacity. ``u_k``: floor((k + 1) x) / k, or x where
    (k + 1) x is whole.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    tokens = np.r_[0, np.cumsum(count * size)]  # tokens[i]: of lengths under i
    above = len(lengths) - np.r_[0, np.cumsum(count)]  # above[i]: pieces of length i or more
    t = np.arange(capacity // 2 + 1)
    big = above[capacity - t + 1]
    middle = tokens[capacity - t + 1] - tokens[t]
    best = int((big + -(-middle // capacity)).max())
    for k in range(1, 33):
        scaled = (k + 1) * size
        whole = scaled % capacity == 0
        value = np.where(whole, k * size, scaled // capacity * capacity)  # times k * capacity
        best = max(best, -(-int((value * count).sum()) // (k * capacity)))
    return best


_COLUMNS = ["row", "id", "piece", "start", "length", "ids_crc32"]
_PACKED = ["bin", "offset", "fill", "bins", "bound", "part"]


def _pack_parts(pieces_: DataFrame, capacity: int, parts: int, salt: int) -> DataFrame:
    """Best-fit decreasing within each of ``parts`` groups; Arrow throughout, so ids of any type and size pass unchanged."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces_.select(*_COLUMNS).schema) + "".join(f", {c} long" for c in _PACKED)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.select(_COLUMNS).sort_by([("length", "descending"), ("row", "ascending")])
        lengths = group["length"].to_numpy().astype(np.int64)
        bins, offsets, used = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, weights=lengths, minlength=used).astype(np.int64)
        n, bound = len(lengths), lower_bound(lengths, capacity)
        for name, values in zip(_PACKED, (bins, offsets, fill[bins], np.full(n, used), np.full(n, bound), np.full(n, key[0].as_py())), strict=True):
            group = group.append_column(name, pa.array(values, pa.int64()))
        return group

    dealt = pieces_.select(*_COLUMNS, F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(parts)).alias("deal"))
    return dealt.groupBy("deal").applyInArrow(run, schema)


def _parts(pool: DataFrame, capacity: int, part_bins: int) -> int:
    got = pool.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"), F.count("*").alias("n")).first()
    return max(1, -(-got["tokens"] // (capacity * part_bins)), -(-got["n"] // PART_PIECES))


def pack(pieces_: DataFrame, capacity: int = CAPACITY, part_bins: int = PART_BINS, rounds: int = ROUNDS) -> DataFrame:
    """``pieces_`` (id, piece, start, length, ids_crc32) with sequence_id, offset, and the certificate of its partition (bins, bound).

    Every piece is placed once; sequences are filled from 0 without gaps and never over ``capacity``. Loose bins of
    partitions over their bound are pooled and packed again; a round counts only where it saves bins. Partitions hold a
    bounded number of pieces on average however many ids or lengths are equal or null: pieces are dealt by a number of their
    own, which is written with them, so a task that runs again deals them alike.
    """
    numbered = staged(pieces_.withColumn("row", F.monotonically_increasing_id()), "pieces")
    parts = _parts(numbered, capacity, part_bins)
    now = staged(_pack_parts(numbered, capacity, parts, 0).withColumn("round", F.lit(0)), "pack-0")
    for k in range(1, rounds + 1):
        loose = (F.col("bins") > F.col("bound")) & (F.col("fill") < F.lit(int(LOOSE * capacity)))
        pool = now.where(loose)
        before = pool.where(F.col("offset") == 0).count()
        parts = _parts(pool, capacity, part_bins)
        if before < 2:
            break
        again = staged(_pack_parts(pool, capacity, parts, k).withColumn("round", F.lit(k)), f"pack-{k}")
        if again.where(F.col("offset") == 0).count() >= before:
            break
        now = now.where(~loose).unionByName(again)
    number = F.col("round").cast("long") * F.lit(1 << 60) + F.col("part") * F.lit(1 << 24) + F.col("bin")
    return now.select("id", "piece", "start", "length", "ids_crc32", number.alias("sequence_id"), "offset", "bins", "bound")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Tokenise and pack whole documents; ``pack`` writes the pieces first, so texts are tokenised once."""
    return pack(pieces(docs, tokenizer_path, id_col, text_col, capacity), capacity)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids): the token ids of each packed sequence as an array. Ids of documents must be unique."""
    own = pieces(docs, tokenizer_path, id_col, text_col, capacity, keep_ids=True).select("id", "piece", "ids")
    placed = packed.select("id", "piece", "sequence_id", "offset").join(own, ["id", "piece"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"sequence_id": batch["sequence_id"], "ids": [np.concatenate([np.frombuffer(p["ids"], "<u4") for p in row]).astype(np.int64) for row in batch["parts"]]})

    grouped = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return grouped.mapInPandas(run, "sequence_id long, ids array<long>")
