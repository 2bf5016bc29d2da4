"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The ASCII white space that separates words in every contract of this package.
BLANKS = " \t\n\x0b\f\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"
#: Bytes of text that the vectorised text code holds as numpy arrays at once.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where neither the setting nor a checkpoint directory exists and everything runs in one JVM (a test session), a
    temporary folder is set. Elsewhere that is an error: executors of other machines would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders written by ``staged`` that nothing has removed yet.
_written: list[str] = []
_at_exit: list = []


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors, gives exact sizes to the optimizer.

    The folder stays until ``discard`` of the result, ``clear_staged`` or the end of the driver.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _at_exit:  # registered here, so that it comes before the end of the JVM
        _at_exit.append(atexit.register(_clear_at_exit))
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the folder of a staged table that no later action reads; other tables are left alone."""
    path = getattr(df, "_staged_at", None)
    if path in _written:
        _written.remove(path)
        _delete(df.sparkSession, path)


def clear_staged(spark: SparkSession) -> None:
    """Remove all staged folders of this driver. Results that still read them must have been written before."""
    while _written:
        _delete(spark, _written.pop())


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _clear_at_exit() -> None:
    spark = SparkSession._instantiatedSession
    if spark is not None and spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            clear_staged(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK_CLASS + "+"), "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once. A plain column could be inlined into a lambda and computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_remainder(doc_id: Column, modulus: int) -> Column:
    """``crc32`` of the id as text, modulo ``modulus``: the fold of a document. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


def drawn_texts(texts: DataFrame, most_rows: int, most_chars: int, seed: int, labels: DataFrame | None = None) -> DataFrame:
    """About ``most_rows`` distinct rows of ``texts`` (id, text, ...) with about ``most_chars`` characters of text in all; with
    ``labels`` (id, ...), ids unique, of those rows that have one, joined to it.

    Each text of an id is drawn by itself, by a hash of both, and rows that are equal in them count once. So neither an id
    that very many rows have nor a row that is repeated very often comes whole. Drawn texts are whole; only they are shuffled,
    the sizes come from hashes and lengths.
    """
    own = texts.withColumns({"__text": F.xxhash64("text"), "__size": F.length("text")})
    met = lambda df: df if labels is None else df.join(labels, "id")
    size = met(own.select("id", "__text", "__size")).agg(F.count_distinct("id", "__text").alias("n"), F.count("*").alias("rows"), F.coalesce(F.sum("__size"), F.lit(0)).alias("chars")).first()
    # rows with a null id are left out of a distinct count; the mean length stands for that of distinct texts
    chars = size["n"] * size["chars"] / max(1, size["rows"])
    rate = int(min(1.0, most_rows / max(1, size["n"]), most_chars / max(1, chars)) * 1_000_000)
    drawn = own.where(F.pmod(F.xxhash64("id", "__text", F.lit(seed)), F.lit(1_000_000)) < rate)
    return met(drawn).dropDuplicates(["id", "__text"]).drop("__text", "__size")


def with_scores(
    docs: DataFrame, text_col: str, fields: list[T.StructField], scorer: Callable[[], Callable[[list], list[np.ndarray]]], name: str
) -> DataFrame:
    """``docs`` with a struct column ``name`` computed from whole texts in Arrow batches.

    ``scorer()`` is called once in each task and returns a function from a list of texts (None: null) to one array per field.
    All other columns pass through unchanged; one named ``name`` is replaced.
    """
    docs = docs.drop(name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StructType(fields))])
    at = docs.columns.index(text_col)
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    arrow = [pa.field(f.name, kinds[f.dataType.simpleString()]) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for batch in batches:
            if not batch.num_rows:
                continue
            for part in _slices(batch, at):
                values = score(part.column(at).to_pylist())
                arrays = [pa.array(v, type=f.type) for v, f in zip(values, arrow, strict=True)]
                struct = pa.StructArray.from_arrays(arrays, fields=arrow)
                yield pa.RecordBatch.from_arrays([*part.columns, struct], names=[*part.schema.names, name])

    return docs.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, at: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of a batch with at most about ``limit`` bytes of text each (one row at least)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0), dtype=np.int64)
    group = (np.cumsum(sizes) - sizes) // limit
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], len(sizes)], strict=True):
        yield batch.slice(int(a), int(b - a))


# ---------------------------------------------------------------- vectorised token hashes

_R = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int, which: str) -> np.ndarray:
    got = _powers.get(which)
    if got is None or len(got) < n:
        size = max(n, SLICE_BYTES + 4096)
        got = np.full(size, _R if which == "up" else _R_INVERSE, dtype=np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        _powers[which] = got
    return got


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: multiply and shift."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _byte_classes() -> np.ndarray:
    kinds = np.full(256, 2, dtype=np.uint8)  # punctuation
    kinds[[ord(c) for c in BLANKS] + [0x1C, 0x1D, 0x1E, 0x1F]] = 0
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        kinds[a:b] = 1  # letters, digits and every byte of non-ASCII characters
    return kinds


_KINDS = _byte_classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _hash_slice(raw: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each token: a run of word characters or a run of punctuation."""
    data = np.frombuffer(raw, dtype=np.uint8)
    kind = _KINDS[data]
    edge = np.empty(len(data), dtype=bool)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    starts = np.flatnonzero(edge)
    ends = np.r_[starts[1:], len(data)]
    real = kind[starts] != 0
    starts, ends = starts[real], ends[real]
    if lower:
        data = _LOWER[data]
    up = _power_table(len(data) + 1, "up")
    prefix = np.empty(len(data) + 1, dtype=np.uint64)
    prefix[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    hashed = (prefix[ends] - prefix[starts]) * _power_table(len(data) + 1, "down")[starts]
    return mix64(hashed), starts


def token_hashes(texts: list, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """64-bit token hashes of whole texts, in groups of about SLICE_BYTES.

    Yields (first, last, hashes, pointers): tokens of text ``first + i`` are ``hashes[pointers[i]:pointers[i + 1]]``.
    A text longer than a slice is hashed in pieces cut at blanks, so memory for one text is 8 bytes per token.
    """
    first, size, pieces = 0, 0, []
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if pieces and size + len(raw) > SLICE_BYTES:
            yield (first, i, *_joined(pieces, lower))
            first, size, pieces = i, 0, []
        size += len(raw)
        pieces.append(raw)
    if pieces:
        yield (first, first + len(pieces), *_joined(pieces, lower))


def _cut(raw: bytes) -> Iterator[bytes]:
    """Pieces of about SLICE_BYTES, cut after blanks only: a token is never split, however long it is."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + SLICE_BYTES)
        if end < len(raw):
            back = max(raw.rfind(b" ", at, end), raw.rfind(b"\n", at, end))
            if back > at:
                end = back + 1
            else:
                ahead = [i for i in (raw.find(b" ", end), raw.find(b"\n", end)) if i >= 0]
                end = min(ahead) + 1 if ahead else len(raw)
        yield raw[at:end]
        at = end


def _joined(pieces: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    if len(pieces) == 1 and len(pieces[0]) > SLICE_BYTES:
        hashes = np.concatenate([_hash_slice(part, lower)[0] for part in _cut(pieces[0])])
        return hashes, np.array([0, len(hashes)])
    hashes, starts = _hash_slice(b"\n".join(pieces), lower)
    begins = np.cumsum([0] + [len(p) + 1 for p in pieces])
    return hashes, np.searchsorted(starts, begins)


def word_stems(texts: list, lengths: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]]:
    """(text, word hash, stems) in slices of about SLICE_BYTES, each word of a text once in a slice; words are lower-cased.

    ``stems`` maps each of ``lengths`` to (places, hashes): the words that are longer than so many bytes and the hash of
    their first so many bytes. A text longer than a slice spans several, in which its words may come again.
    """
    raws = [(text or "").encode("utf-8", "surrogatepass") for text in texts]
    at = 0
    while at < len(raws):
        if len(raws[at]) > SLICE_BYTES:
            for part in _cut(raws[at]):
                yield _stem_slice(part, np.array([0, len(part) + 1]), at, lengths)
            at += 1
            continue
        last, size = at, 0
        while last < len(raws) and (last == at or size + len(raws[last]) <= SLICE_BYTES):
            size += len(raws[last])
            last += 1
        begins = np.cumsum([0] + [len(r) + 1 for r in raws[at:last]])
        yield _stem_slice(b"\n".join(raws[at:last]), begins, at, lengths)
        at = last


def _stem_slice(raw: bytes, begins: np.ndarray, first: int, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, dict]:
    data = _LOWER[np.frombuffer(raw, dtype=np.uint8)]
    kind = _KINDS[data]
    starts = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]]) if len(data) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(data)].astype(np.int64)[: len(starts)]
    starts, ends = starts[kind[starts] == 1], ends[kind[starts] == 1]
    up, down = _power_table(len(data) + 1, "up"), _power_table(len(data) + 1, "down")
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    word = mix64((prefix[ends] - prefix[starts]) * down[starts])
    owner = np.searchsorted(begins, starts, "right") - 1 + first
    _, once = np.unique(mix64(word ^ mix64(owner.astype(np.uint64) + np.uint64(1))), return_index=True)
    word, owner, starts, ends = word[once], owner[once], starts[once], ends[once]
    stems = {}
    for n in lengths:
        place = np.flatnonzero(ends - starts > n)
        s = starts[place]
        stems[n] = place, mix64((prefix[s + n] - prefix[s]) * down[s] + np.uint64(n << 48))
    return owner, word, stems


def gram_hashes(hashes: np.ndarray, pointers: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n tokens that lies within one text, and the index of that text."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(pointers) - 1), np.diff(pointers))
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out = mix64(out * _R + hashes[k : len(hashes) - n + 1 + k])
    inside = owner[: len(out)] == owner[n - 1 :]
    return out[inside], owner[: len(out)][inside]
