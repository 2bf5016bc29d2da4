"""Line deduplication across documents, with DataFrame functions only.

Lines are exploded with their positions, normalised and hashed; distinct documents are counted for each hash with map-side
combination, and the lines under a hash over the threshold are dropped. Only hashes and positions are shuffled for that. A
very frequent line is one row per task and document after the partial aggregates; the join on hashes is a plain equi-join,
whose hot side adaptive execution splits. Texts move once, to meet the positions that they lose, and are put together again
by position from the stretches between these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLANKS, bound, staged

MIN_CHARS = 20
MIN_DOCS = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """Blanks stripped at both ends, A-Z lower-cased, other letters left as they are."""
    ascii_only = F.octet_length(line) == F.char_length(line)
    lowered = F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))
    return F.btrim(lowered, F.lit(BLANKS))


def key_hash(key: Column) -> Column:
    """128 bits of two independent hashes, so that keys are told apart at any realistic corpus size."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key, F.length(key)).alias("b"))


def _text_key(id_col: str, text_col: str) -> Column:
    """Rows that agree in id and text lose the same lines: one key for them, with 128 bits for the text."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("a"), F.xxhash64(F.lit(7), F.col(text_col), F.length(text_col)).alias("b"))


def _keyed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(row, at, key) of every line that is long enough to count; ``at`` is its position in the text, from 0."""
    rows = docs.select(_text_key(id_col, text_col).alias("row"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n").alias("lines"))
    lines = rows.select("row", F.posexplode("lines").alias("at", "line"))  # the key of a text is computed below the generator, once
    keyed = lines.where(F.char_length("line") >= min_chars).select("row", "at", line_key(F.col("line")).alias("key"))
    return keyed.where(F.char_length("key") >= min_chars).select("row", "at", key_hash(F.col("key")).alias("key"))


def repeated_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(key, n_docs, keeper): keys found in at least ``min_docs`` documents and the largest id that holds each.

    A document is all rows of one id; every row with a null id is a document of its own.
    """
    nameless = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()).alias("nameless")
    texts = docs.select(F.col(id_col).alias("id"), nameless, F.split(F.coalesce(F.col(text_col), F.lit("")), "\n").alias("lines"))
    lines = texts.select("id", "nameless", F.explode("lines").alias("line")).where(F.char_length("line") >= min_chars).select("id", "nameless", line_key(F.col("line")).alias("key"))
    own = lines.where(F.char_length("key") >= min_chars).select(key_hash(F.col("key")).alias("key"), "id", "nameless").distinct()
    return own.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("id").alias("keeper")).where(F.col("n_docs") >= min_docs)


def stretches(lines: Column, gone: Column) -> Column:
    """``lines`` without those at the sorted positions ``gone``: the stretches between them, one after the other, in linear time."""
    edges = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))

    def cut(both: Column) -> Column:
        return F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.size(both["edges"]) - 2),
                lambda i: F.slice(both["lines"], F.get(both["edges"], i) + 2, F.get(both["edges"], i + 1) - F.get(both["edges"], i) - 1),
            )
        )

    return bound(F.struct(lines.alias("lines"), edges.alias("edges")), cut)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, out: str = "line_dedup") -> DataFrame:
    """``docs`` with a struct column ``out`` (text, n_lines, n_dropped): lines under a repeated key go, except in the largest id.

    Null or empty text is one empty line. Keys shorter than ``min_chars`` code points always stay. Rows that share an id
    count as one document for the threshold, and all of them keep a line whose largest id is theirs. Rows with a null id are
    documents each, but never the keeper: they lose a repeated line in any case. A document that loses all lines keeps an
    empty text. Other columns pass through; one named as ``out`` is replaced.
    """
    docs = docs.drop(out)
    repeated = staged(repeated_keys(docs, id_col, text_col, min_chars, min_docs).select("key", "keeper"), "line-keys")
    held = _keyed_lines(docs, id_col, text_col, min_chars).join(repeated, "key").where(~F.col("row.id").eqNullSafe(F.col("keeper")) | F.col("row.id").isNull())
    drops = staged(held.groupBy("row").agg(F.sort_array(F.collect_set("at")).alias("gone")), "line-drops")  # positions of one text: no more than its lines
    drops = drops.select(F.struct("row").alias("__line_of"), F.struct("gone").alias("__line_drop"))
    mine = _text_key(id_col, text_col)
    joined = docs.join(drops, mine.eqNullSafe(F.col("__line_of.row")), "left")
    text, gone = F.coalesce(F.col(text_col), F.lit("")), F.col("__line_drop.gone")
    n_lines = (F.regexp_count(text, F.lit("\n")) + 1).cast("long")
    result = F.when(gone.isNull(), F.struct(text.alias("text"), n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))).otherwise(
        F.struct(F.array_join(stretches(F.split(text, "\n"), gone), "\n").alias("text"), n_lines.alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"))
    )
    return joined.select(*[F.col(c) for c in docs.columns], result.alias(out))
