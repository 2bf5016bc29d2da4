"""Spelling variants by a symmetric-delete join.

Every word emits itself and its single deletions as keys. A word whose own key equals a deletion of a longer one is one
letter short of it; words that give the same key by deleting at the same place differ in that letter alone. Keys hold the
place, so shared keys are exact and no pairs are listed: the words of one key and place are at most as many as the letters
of the alphabet, and a word has no more deletions than letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, staged

#: Runs of letters that are counted, as a Java pattern: ASCII and Latin-1 from U+00C0 on.
LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LETTERS, MIN_COUNT, TIMES, SLIP = 6, 5, 5, 199
MAX_ROUNDS = 40
#: Keys that a task holds before it passes them on; one word's keys stay together.
KEYS_AT_ONCE = 1 << 17
#: Odd factors of the two polynomial hashes of a key; together they are its 128 bits.
_FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, slip: int | None = SLIP) -> DataFrame:
    """(word, n): runs of letters of whole texts with A-Z lower-cased, of at least so many code points and occurrences.

    With ``slip``, a run whose ``crc32("<id>:<run>")`` it divides loses one code point, at the place the same number gives.
    Null texts have no words, a null id counts as empty text. Runs are counted in the tasks before they are shuffled.
    """
    run = F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"{LETTERS}{{{min_letters},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), run.alias("run"))
    word = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    runs = runs.select("id", word.alias("word"))
    if slip:
        h = F.crc32(F.concat_ws(":", "id", "word").cast("binary"))
        runs = runs.select("word", h.alias("h"))
        at = (F.col("h") % F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("word")).alias("word"))
    return runs.groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") >= min_count) & (F.length("word") >= min_letters))


def _powers(n: int, factor: int) -> np.ndarray:
    out = np.full(n, factor, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def deletion_keys(word: str) -> tuple[list[int], list[np.ndarray], np.ndarray]:
    """Key of a word, keys of its deletions by place, and which places come first among those that give the same deletion.

    Prefix sums give all deletions in time linear in the word, however long it is.
    """
    codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    own, cut = [], []
    for factor in _FACTORS:
        up = np.r_[np.uint64(0), np.cumsum(codes * _powers(len(codes), factor))]
        own.append(int(up[-1:].view(np.int64)[0]))
        cut.append((up[:-1] + (up[-1] - up[1:]) * np.uint64(pow(factor, -1, 1 << 64))).view(np.int64))
    return own, cut, np.r_[True, codes[1:] != codes[:-1]]


_KEYS = ["k1", "k2", "place", "first", "wid", "n"]


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, place, first, wid, n) of (wid, word, n): the word itself at place -1, then its deletions."""
    held: list[tuple] = []
    size = 0

    def joined() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(part)) for part in zip(*held, strict=True)], names=_KEYS)

    for batch in batches:
        for wid, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            own, cut, first = deletion_keys(word)
            rows = len(first) + 1
            held.append((np.r_[own[0], cut[0]], np.r_[own[1], cut[1]], np.arange(-1, rows - 1, dtype=np.int32), np.r_[True, first], np.full(rows, wid), np.full(rows, n)))
            size += rows
            if size >= KEYS_AT_ONCE:
                yield joined()
                held.clear()
                size = 0
    if held:
        yield joined()


def _best(n: str, wid: str) -> Column:
    """The larger the better: most occurrences, then the smaller word."""
    return F.struct(F.col(n).alias("n"), (-F.col(wid)).alias("minus"))


def near_words(words: DataFrame) -> DataFrame:
    """(wid, n_near, best (n, minus)) of every word of ``words`` (wid, word, n) that has a near one: words one inserted, deleted
    or replaced code point away, and the best of them. ``wid`` must rise with the word."""
    keys = staged(words.select("wid", "word", "n").mapInArrow(_emit, "k1 long, k2 long, place int, first boolean, wid long, n long"), "spelling-keys")
    # replaced: one group holds words that differ in the letter at one place, at most one for each letter
    own = _best("n", "wid")
    groups = keys.where("place >= 0").groupBy("k1", "k2", "place").agg(F.sort_array(F.collect_list(own), asc=False).alias("g")).where("size(g) > 1")
    replaced = groups.select(F.posexplode("g").alias("i", "w"), "g").select(
        (-F.col("w.minus")).alias("wid"), (F.size("g") - 1).cast("long").alias("c"), F.when(F.col("i") == 0, F.get("g", F.lit(1))).otherwise(F.get("g", F.lit(0))).alias("best")
    )
    # deleted and inserted: a word joins the longer words of which it is a deletion
    short = keys.where("place < 0").select("k1", "k2", F.col("wid").alias("short"), F.col("n").alias("short_n"))
    pairs = keys.where("place >= 0 AND first").join(short, ["k1", "k2"])
    one = F.lit(1).cast("long")
    both = F.array(F.struct(F.col("wid").alias("wid"), one.alias("c"), _best("short_n", "short").alias("best")), F.struct(F.col("short").alias("wid"), one.alias("c"), own.alias("best")))
    linked = pairs.select(F.explode(both).alias("x")).select("x.*")
    return replaced.unionByName(linked).groupBy("wid").agg(F.sum("c").alias("n_near"), F.max("best").alias("best"))


def roots(forms: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(wid, root) of ``forms`` (wid, form_wid): the last word that forms lead to. Each round doubles the distance."""
    now = staged(forms.select("wid", F.col("form_wid").alias("root")), "spelling-roots")
    for _ in range(max_rounds):
        step = now.select(F.col("wid").alias("root"), F.col("root").alias("further"))
        after = staged(now.join(step, "root", "left").select("wid", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        discard(now)
        now = after
        if now.where("moved").isEmpty():
            return now.select("wid", "root")
    raise RuntimeError(f"forms did not end in {max_rounds} rounds")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct ``words`` (word, n).

    ``form`` is the near word of largest n, ties to the smallest in code-point order, if it has ``times`` as many occurrences at
    least; ``root`` follows forms to the last and is the word itself where there is none. Forms grow by that factor at each
    step, so they end. Empty input gives no rows.
    """
    # ranges of words are numbered in order, so a smaller number is a smaller word
    known = staged(words.orderBy("word").select(F.monotonically_increasing_id().alias("wid"), "word", "n"), "spelling-words")
    near = staged(near_words(known), "spelling-near")
    formed = known.join(near, "wid", "left").select("wid", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("best.n") >= times * F.col("n"), F.col("best")).alias("best"))
    formed = staged(formed.select("wid", "word", "n", "n_near", (-F.col("best.minus")).alias("form_wid"), F.col("best.n").alias("form_n")), "spelling-forms")
    ends = roots(formed.where("form_wid IS NOT NULL"))
    names = known.select(F.col("wid").alias("form_wid"), F.col("word").alias("form"))
    last = known.select(F.col("wid").alias("root_wid"), F.col("word").alias("root"))
    led = formed.where("form_wid IS NOT NULL").join(names, "form_wid").join(ends.withColumnRenamed("root", "root_wid"), "wid").join(last, "root_wid")
    exact = F.assert_true(F.levenshtein("word", "form", 1) == 1, "a form is not one edit away")
    led = led.select("word", F.when(exact.isNull(), F.col("form")).alias("form"), "root", "n", "n_near", "form_n")
    alone = formed.where("form_wid IS NULL").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    return led.unionByName(alone)


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, slip: int | None = SLIP, times: int = TIMES) -> DataFrame:
    """``variants`` of the words of whole texts. Repeated rows count each; null and empty texts give none; other columns are ignored."""
    return variants(counted_words(docs, id_col, text_col, min_letters, min_count, slip), times)
