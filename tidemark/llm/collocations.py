"""Phrase collocations: n-gram counts from word-id suffix arrays of shards, merged by key, and association scores of their cuts.

Texts are read once for each length of phrase and once more. First each shard counts words from its suffix array, as hashes,
then pairs of words that are frequent, then longer runs whose shorter ones are; what a whole language holds often enough
marks bits of filters of fixed size. The last time a shard counts the phrases that pass all filters by their text. A phrase
is no more frequent than its parts, and equal hashes can only add, so the filters lose nothing and the last counts are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import _power_table, mix64, staged

MAX_WORDS, MIN_COUNT, TOP = 4, 30, 2000
#: Words of a shard, about: its suffix array and ranks take some 150 bytes each. Bytes of text that are split at once.
SHARD_WORDS, SLICE = 1 << 19, 1 << 20
#: Rows of counts that a task adds up before it passes them on.
MERGED_ROWS = 3 << 19
#: Bits of each filter (a power of two): 8 MB for every reader, whatever the corpus holds. Fuller filters let more pass.
FILTER_BITS = 1 << 26
#: A longer phrase with so many hundredths of its part's count stands for it.
COVERED = 80
SCALE = 2_000_000
NO_LANG = "und"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a hash by which runs are counted for the filters: equal ones only add, so fewer bits cost time at most.
_KEY = np.uint64((1 << 40) - 1)
#: Slices of a language's phrases that are cut to the first ones before they meet.
SLICES = 64


def _kinds() -> np.ndarray:
    kinds = np.full(256, 2, dtype=np.uint8)
    kinds[[0x20, 0x09]] = 0
    kinds[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = 1
    return kinds


#: Kind of each byte: blank, end of a piece, part of a word.
KINDS = _kinds()


def split_slice(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, follows, hash) of each word of lower-cased UTF-8 text; ``follows``: the next word is in the same piece."""
    data = np.frombuffer(raw, dtype=np.uint8)
    kind = KINDS[data]
    part = np.concatenate(([False], kind == 2, [False]))
    edge = np.flatnonzero(part[1:] != part[:-1])
    starts, ends = edge[::2], edge[1::2]
    piece = np.cumsum(kind == 1, dtype=np.int32)[starts]
    follows = np.append(piece[1:] == piece[:-1], False)[: len(starts)]
    up, down = _power_table(len(data) + 1, "up"), _power_table(len(data) + 1, "down")
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    return starts.astype(np.int32), ends.astype(np.int32), follows, mix64((prefix[ends] - prefix[starts]) * down[starts])


def _cuts(raw: bytes, size: int = SLICE) -> Iterator[bytes]:
    """Parts of a text of about ``size`` bytes that end where a piece ends, so that no phrase is cut."""
    at = 0
    while len(raw) - at > size:
        tail = KINDS[np.frombuffer(raw, np.uint8, count=min(size, len(raw) - at), offset=at)]
        stops = np.flatnonzero(tail == 1)
        if len(stops):
            end = at + int(stops[-1]) + 1
        else:
            ahead = (raw.find(c, at + size) for c in b".,;:!?\n\v\f\r")
            end = min((x + 1 for x in ahead if x >= 0), default=len(raw))
        yield raw[at:end]
        at = end
    yield raw[at:]


class Shard:
    """Words of some texts in order: language, hash (of language and word), room to the end of the piece, and where they are written."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.langs: dict[str, int] = {}
        self.words = 0

    def add(self, raw: bytes, lang: str) -> None:
        code = self.langs.setdefault(lang, len(self.langs))
        salt = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
        starts, ends, follows, hashed = split_slice(raw)
        if len(starts):
            self.parts.append((raw, starts, ends, follows, mix64(hashed ^ salt), code))
            self.words += len(starts)

    def joined(self) -> None:
        shift = np.cumsum([0] + [len(p[0]) for p in self.parts])
        self.raw = b"".join(p[0] for p in self.parts)
        self.start = np.concatenate([p[1] + s for p, s in zip(self.parts, shift, strict=False)])
        self.end = np.concatenate([p[2] + s for p, s in zip(self.parts, shift, strict=False)])
        self.follows = np.concatenate([p[3] for p in self.parts])
        self.hash = np.concatenate([p[4] for p in self.parts])
        self.lang = np.repeat(np.array([p[5] for p in self.parts], np.int32), [len(p[1]) for p in self.parts])
        self.parts = []


def room_of(follows: np.ndarray, most: int) -> np.ndarray:
    """Words from each place to the end of its piece, itself included, up to ``most``."""
    room, run = np.ones(len(follows), np.int8), follows
    for _ in range(most - 1):
        room = room + run
        run = np.r_[run[1:], False] & follows
    return room


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank from 1): places sorted by key, and the rank of each place's key among the distinct ones."""
    order = np.argsort(keys)
    fresh = np.empty(len(keys), np.int64)
    fresh[:1] = 1
    np.not_equal(keys[order[1:]], keys[order[:-1]], out=fresh[1:])
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(fresh)
    return order, rank


def suffix_array(ids: np.ndarray, room: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): suffixes sorted by their first ``depth`` words (a power of two), by prefix doubling, and how many words
    each shares with the one before it. A suffix ends with its piece."""
    order = np.argsort(ids) if depth == 1 else None
    ranks, width = {1: ids.astype(np.int64) + 1}, 1
    while width < depth:
        now = ranks[width]
        behind = np.zeros(len(now), np.int64)
        behind[:-width] = np.where(room[:-width] > width, now[width:], 0)
        order, ranks[2 * width] = ranked(now * (int(now.max(initial=0)) + 1) + behind)
        width *= 2
    a, b = order[:-1], order[1:]
    lcp = np.zeros(len(a), np.int8)
    least = np.minimum(room[a], room[b])
    last = len(ids) - 1
    while width:
        rank = ranks[width]
        lcp += np.int8(width) * ((least >= lcp + width) & (rank[np.minimum(a + lcp, last)] == rank[np.minimum(b + lcp, last)]) & (lcp + width <= depth))
        width //= 2
    return order, np.r_[np.int8(0), lcp] if len(order) else lcp


def intervals(order: np.ndarray, lcp: np.ndarray, room: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, count) of each distinct run of so many words: the LCP intervals of that depth."""
    starts = np.flatnonzero(lcp < words)
    counts = np.diff(np.r_[starts, len(order)])
    places = order[starts]
    whole = room[places] >= words
    return places[whole], counts[whole]


def _grams(hashed: np.ndarray, places: np.ndarray, words: int) -> np.ndarray:
    """Hash of the run of so many words at each place."""
    out = hashed[places]
    for k in range(1, words):
        out = mix64(out * _FACTOR + hashed[places + k])
    return out


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Shard]:
    """Shards of about ``most`` words of (text, lang) rows; long texts are cut between pieces."""
    shard = Shard()
    for batch in batches:
        held, size, lang = [], 0, None
        for text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass").lower()  # bytes: A-Z alone
            if held and (own != lang or size + len(raw) > SLICE):
                shard.add(b"\n".join(held), lang)
                held, size = [], 0
            if shard.words >= most:
                shard.joined()
                yield shard
                shard = Shard()
            lang = own
            if len(raw) > SLICE:
                for part in _cuts(raw):
                    shard.add(part, lang)
                    if shard.words >= most:
                        shard.joined()
                        yield shard
                        shard = Shard()
            else:
                held.append(raw)
                size += len(raw) + 1
        if held:
            shard.add(b"\n".join(held), lang)
    if shard.words:
        shard.joined()
        yield shard


def _kept(shard: Shard, filters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, room, place) of the words that pass the first filter; pieces end where a word or a pair does not pass."""
    hashed, follows, kept = shard.hash, shard.follows.copy(), np.arange(len(shard.hash))
    if filters:
        kept = np.flatnonzero(_passes(filters[0], hashed))
        hashed, follows = hashed[kept], follows[kept] & np.append(kept[1:] == kept[:-1] + 1, False)[: len(kept)]
    if len(filters) > 1:
        both = np.flatnonzero(follows)
        follows[both] = _passes(filters[1], _grams(hashed, both, 2))
    return hashed, follows, kept


def _wanted(hashed: np.ndarray, places: np.ndarray, words: int, filters: list[np.ndarray]) -> np.ndarray:
    """Which places may begin a frequent run of so many words: both runs that are one word shorter pass, and where it is there,
    the run itself."""
    out = np.ones(len(places), bool)
    for n in (words - 1, words):
        if 3 <= n <= len(filters):
            for shift in range(words - n + 1):
                out &= _passes(filters[n - 1], _grams(hashed, places + shift, n))
    return out


def _counts(shards: Iterator[Shard], words: int, filters: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, count) of the runs of ``words`` words of each shard whose shorter runs pass ``filters``."""
    for shard in shards:
        hashed, follows, _ = _kept(shard, filters)
        if not len(hashed):
            continue
        depth = 1 << (words - 1).bit_length()
        room = room_of(follows, depth)
        order, lcp = suffix_array(ranked(hashed)[1], room, depth)
        places, counts = intervals(order, lcp, room, words)
        wanted = _wanted(hashed, places, words, filters)
        yield (_grams(hashed, places[wanted], words) & _KEY).view(np.int64), counts[wanted]


def _merged(counts: Iterator[tuple[np.ndarray, np.ndarray]], most: int) -> Iterator[pa.RecordBatch]:
    """Counts of several shards added up, about ``most`` rows at once."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0

    def added() -> pa.RecordBatch:
        keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return pa.RecordBatch.from_arrays([pa.array(keys[first]), pa.array(np.add.reduceat(n, first))], names=["h", "n"])

    for part in counts:
        held.append(part)
        rows += len(part[0])
        if rows >= most:
            yield added()
            held, rows = [], 0
    if rows:
        yield added()


def _marked(texts: DataFrame, words: int, filters: list[Broadcast], min_count: int, shard_words: int, filter_bits: int) -> np.ndarray:
    """Bits of all runs of ``words`` words whose hashes a language holds ``min_count`` times, of a fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _merged(_counts(_shards(batches, shard_words), words, [f.value for f in filters]), MERGED_ROWS)

    often = texts.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    bit = F.col("h").bitwiseAND(F.lit(filter_bits - 1))
    cells = often.select(F.shiftright(bit, 6).alias("cell"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits"))
    found = cells.toArrow()
    out = np.zeros(filter_bits // 64, np.uint64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)
    return out


def _passes(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    at = hashed & np.uint64(64 * len(bits) - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, shard_words: int = SHARD_WORDS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, phrase, words, f): every phrase of 1 to ``max_words`` words with ``min_count`` occurrences within pieces, overlaps
    included, and one row with words 0 for each language: all its words.

    A-Z are lower-cased; null languages are ``und``, null texts empty. Counts are exact, of whole texts.
    """
    spark = docs.sparkSession
    texts = docs.where(F.length(text_col) > 0).select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit(NO_LANG)).alias("lang"))
    filters: list[Broadcast] = []
    for n in range(1, max_words + 1):
        filters.append(spark.sparkContext.broadcast(_marked(texts, n, filters, min_count, shard_words, filter_bits)))
    depth = 1 << (max_words - 1).bit_length()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, shard_words):
            names = np.array(list(shard.langs), dtype=object)
            totals = np.bincount(shard.lang, minlength=len(names))
            bits = [f.value for f in filters]
            hashed, follows, kept = _kept(shard, bits)
            lang, phrases, words, counts = [names], [[""] * len(names)], [np.zeros(len(names), np.int32)], [totals]
            if len(kept):
                start, end, owner = shard.start[kept], shard.end[kept], shard.lang[kept]
                room = room_of(follows, depth)
                order, lcp = suffix_array(ranked(hashed)[1], room, depth)
                close = np.r_[(start[1:] == end[:-1] + 1), False]
                data = np.frombuffer(shard.raw, np.uint8)
                close &= data[np.minimum(end, len(data) - 1)] == 0x20  # one space stands behind the word
                for n in range(1, max_words + 1):
                    places, c = intervals(order, lcp, room, n)
                    wanted = _wanted(hashed, places, n, bits)
                    places, c = places[wanted], c[wanted]
                    plain = np.ones(len(places), bool)
                    for k in range(n - 1):
                        plain &= close[places + k]
                    raw = shard.raw
                    texts_ = [raw[a:b] for a, b in zip(start[places].tolist(), end[places + n - 1].tolist(), strict=True)]
                    for i in np.flatnonzero(~plain).tolist():
                        texts_[i] = b" ".join(raw[start[p] : end[p]] for p in range(places[i], places[i] + n))
                    lang.append(names[owner[places]])
                    phrases.append(texts_)
                    words.append(np.full(len(places), n, np.int32))
                    counts.append(c)
            text = pa.concat_arrays([pa.array(phrases[0], pa.string()), *[pa.array(p, pa.binary()).cast(pa.string()) for p in phrases[1:]]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lang), pa.string()), text, pa.array(np.concatenate(words)), pa.array(np.concatenate(counts).astype(np.int64))], names=["lang", "phrase", "words", "f"])

    found = texts.mapInArrow(count, "lang string, phrase string, words int, f long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where((F.col("f") >= min_count) | (F.col("words") == 0))


def _wide(c: Column | str) -> Column:
    """Whole numbers of 38 digits: products of counts may pass 64 bits."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int = TOP, covered: int = COVERED, **options: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``max_words`` words by score.

    A cut after k words has score floor(2000000 a / (l + r)); the lowest counts, ties to the smallest k. A phrase goes if a
    longer candidate that holds its words in a row has ``covered`` hundredths of its count. Ties of score fall to the larger
    count, then the smaller phrase in byte order. Repeated rows count each; no rows give none.
    """
    counts = staged(phrase_counts(docs, text_col, lang_col, max_words, min_count, **options), "phrase-counts")
    parts = F.split("phrase", " ")
    run = lambda at, n: F.array_join(F.slice(parts, at, n), " ")
    long = counts.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"))
    inner = [F.struct(F.lit(at).alias("at"), F.lit(n).alias("n")) for n in range(2, max_words) for at in range(1, max_words - n + 2)]
    held = long.where("words >= 3").select("lang", "phrase", "words", "a", F.explode(F.array(*inner)).alias("x")).where("x.n < words AND x.at + x.n - 1 <= words") if inner else None
    if held is not None:
        held = held.select("lang", run(F.col("x.at"), F.col("x.n")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        long = long.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * _wide("longer") < covered * _wide("a"))).drop("longer")
    known = counts.where("words >= 1").select("lang", "phrase", "f")
    cut = long.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", run(F.lit(1), F.col("k")).alias("left"), run(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    cut = cut.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    exact = F.expr(f"cast({SCALE} as decimal(38,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = cut.select("lang", "phrase", "a", F.struct(exact.alias("score"), "k", "l", "r").alias("c")).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min("c").alias("c"))
    order = [F.desc("c.score"), F.desc("a"), F.col("phrase")]
    sliced = best.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    sliced = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("rank") <= top)
    ranked = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "c.l", "c.r", "n", F.col("c.score").alias("score"))

