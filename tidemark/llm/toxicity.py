"""Toxicity scores by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word stems is trained in numpy from confirmed toxic examples and unlabelled
texts. Under the logistic loss the class-prior-corrected risk is

    prior * mean over positives of log(1 + exp(-z))  +  max(0, mean over unlabelled of log(1 + exp(z)) - prior * mean over positives of log(1 + exp(z)))

whose second part, the estimate for the unseen negatives, must not fall below zero: where it does, descent steps back along
it. Training starts at zero. A first descent has an L1 penalty of the size of the sampling noise of each feature's gradient,
which leaves out words that positives hold by chance; a second one refits the features that remain without it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import drawn_texts, staged, with_scores, word_stems

#: Bounds of the samples of one model, by rows and by characters of all drawn texts: confirmed examples, and unlabelled texts.
#: Both bound the rate at which rows are drawn; a drawn text counts whole, however long it is.
POSITIVES, UNLABELLED = 2000, 4000
SAMPLE_CHARS = 12_000_000
#: One unlabelled text in so many is drawn, and UNLABELLED at least; each UNLABELLED of them are one model's, whose mean counts.
UNLABELLED_SHARE = 64
#: Lengths in bytes of the word beginnings that are features, and the numbers of different words from which on they count.
STEMS = (4, 5, 6, 7, 8)
LEVELS = (1, 2, 3, 5)
#: A feature of fewer texts of the sample cannot be learnt.
MIN_TEXTS = 4
#: Penalty in standard deviations of a feature's gradient at the start.
NOISE = 3.0
STEPS, REFIT_STEPS, RATE, DECAY = 150, 400, 0.05, 1e-4
THRESHOLD = 0.7
_LOW = np.uint64(7)  # the last three bits of a feature's hash hold its level; words have level 0


@dataclass
class Model:
    """Sorted 64-bit features, their weights, and the offset; scores are logistic."""

    keys: np.ndarray
    weights: np.ndarray
    offset: float

    def __post_init__(self) -> None:
        self.bases = np.unique(self.keys & ~_LOW)

    def margin(self, texts: list) -> np.ndarray:
        owner, key = features(texts, self.bases)
        at, hit = _places(self.keys, key)
        return np.bincount(owner[hit], weights=self.weights[at[hit]], minlength=len(texts)) + self.offset if len(texts) else np.zeros(0)

    def score(self, texts: list) -> np.ndarray:
        return _sigmoid(self.margin(texts))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in sorted keys, whether it is there) of each wanted key."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def features(texts: list, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature), each feature of a text once: its words, and for each word beginning the LEVELS that the number of
    different words with it reaches. Repeating a word adds nothing. ``only`` limits the output to these hashes, sorted."""
    owners, bases, words, is_stem = [], [], [], []
    for owner, word, stems in word_stems(texts, STEMS):
        for place, h, stem in [(slice(None), word, False), *((p, h, True) for p, h in stems.values())]:
            base, own, of = h & ~_LOW, owner[place], word[place]
            if only is not None:
                hit = _places(only, base)[1]
                base, own, of = base[hit], own[hit], of[hit]
            owners.append(own)
            bases.append(base)
            words.append(of)
            is_stem.append(np.full(len(base), stem))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner, base, word, stem = (np.concatenate(x) for x in (owners, bases, words, is_stem))
    order = np.lexsort((word, stem, base, owner))
    owner, base, word, stem = owner[order], base[order], word[order], stem[order]
    same = (owner[1:] == owner[:-1]) & (base[1:] == base[:-1]) & (stem[1:] == stem[:-1])
    new = np.r_[True, ~(same & (word[1:] == word[:-1]))][: len(owner)]  # a long text's slices may bring a word again
    owner, base, stem = owner[new], base[new], stem[new]
    first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (base[1:] != base[:-1]) | (stem[1:] != stem[:-1])][: len(owner)])
    n = np.diff(np.r_[first, len(owner)])
    owner, base, stem = owner[first], base[first], stem[first]
    out_owner, out_key = [owner[~stem]], [base[~stem]]
    for level, least in enumerate(LEVELS, 1):
        on = stem & (n >= least)
        out_owner.append(owner[on])
        out_key.append(base[on] | np.uint64(level))
    return np.concatenate(out_owner), np.concatenate(out_key)


def non_negative_risk(margin_p: np.ndarray, margin_u: np.ndarray, prior: float) -> tuple[float, float]:
    """(risk on positives, corrected risk on negatives before clipping) under the logistic loss."""
    return prior * np.logaddexp(0, -margin_p).mean(), np.logaddexp(0, margin_u).mean() - prior * np.logaddexp(0, margin_p).mean()


@dataclass
class Incidence:
    """Which rows hold which of ``width`` features, as pairs."""

    at: np.ndarray
    row: np.ndarray
    rows: int
    width: int

    def margin(self, w: np.ndarray, offset: float) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.at], minlength=self.rows) + offset

    def mean(self, slope: np.ndarray) -> np.ndarray:
        """Mean over rows of slope times each feature; the offset's comes last."""
        return np.r_[np.bincount(self.at, weights=slope[self.row], minlength=self.width), slope.sum()] / self.rows

    def keep(self, columns: np.ndarray) -> Incidence:
        new = np.full(self.width, -1)
        new[columns] = np.arange(len(columns))
        on = new[self.at] >= 0
        return Incidence(new[self.at][on], self.row[on], self.rows, len(columns))


def descend(pos: Incidence, unl: Incidence, prior: float, steps: int, noise: float = 0.0, decay: float = 0.0, rate: float = RATE) -> tuple[np.ndarray, float]:
    """(weights, offset) after so many proximal gradient steps on the non-negative risk from zero, with moment estimates per coordinate."""
    share = prior * pos.mean(np.ones(pos.rows))[:-1] + (1 - prior) * unl.mean(np.ones(unl.rows))[:-1]
    share = np.r_[np.clip(share, 2 / unl.rows, 0.9), 1.0]
    penalty = noise * prior * np.sqrt(share / pos.rows)
    penalty[-1] = 0.0
    w, m, v = (np.zeros(pos.width + 1) for _ in range(3))
    for t in range(1, steps + 1):
        z_p, z_u = pos.margin(w[:-1], w[-1]), unl.margin(w[:-1], w[-1])
        negative = unl.mean(_sigmoid(z_u)) - prior * pos.mean(_sigmoid(z_p))
        if non_negative_risk(z_p, z_u, prior)[1] >= 0:
            g = negative - prior * pos.mean(_sigmoid(-z_p))
        else:  # the estimate for negatives over-fits the positives: back along it alone
            g = -negative
        g += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate / (np.sqrt(v / (1 - 0.99**t)) + 0.05 * prior * np.sqrt(share))
        w = w - step * m / (1 - 0.9**t)
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
    return w[:-1], float(w[-1])


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = STEPS, refit_steps: int = REFIT_STEPS, noise: float = NOISE) -> Model:
    """A model from the features of confirmed examples and of unlabelled texts. Without either, every score is the prior's."""
    prior = float(np.clip(prior, 1e-3, 0.9))
    if not positive or not unlabelled:
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))
    keys, n = np.unique(np.concatenate([*positive, *unlabelled]), return_counts=True)
    keys = keys[n >= MIN_TEXTS]

    def incidence(rows: list[np.ndarray]) -> Incidence:
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        at, hit = _places(keys, np.concatenate(rows))
        return Incidence(at[hit], row[hit], len(rows), len(keys))

    pos, unl = incidence(positive), incidence(unlabelled)
    first, offset = descend(pos, unl, prior, steps, noise=noise)
    chosen = np.flatnonzero(first)
    if len(chosen):
        weights, offset = descend(pos.keep(chosen), unl.keep(chosen), prior, refit_steps, decay=DECAY)
        return Model(keys[chosen], weights, offset)
    return Model(np.zeros(0, np.uint64), np.zeros(0), offset)


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(deal, text) to (deal, features): the sorted features of each text as bytes."""
    for batch in batches:
        owner, key = features(batch.column(1).to_pylist())
        order = np.argsort(owner, kind="stable")
        parts = np.split(key[order], np.searchsorted(owner[order], np.arange(1, batch.num_rows)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.sort(p).tobytes() for p in parts], type=pa.binary())], names=["deal", "features"])


def with_features(texts: DataFrame) -> DataFrame:
    """(deal, features) of (deal, text), computed in the tasks: 8 bytes for each feature instead of the text."""
    return texts.select("deal", "text").mapInArrow(_features_of, "deal long, features binary")


def _rows(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Feature arrays in an order that the rows themselves fix."""
    return [np.frombuffer(x, np.uint64) for x in sorted(column.to_pylist())]


def mean_model(positive: list[np.ndarray], unlabelled: DataFrame, prior: float) -> Model:
    """The mean of one model for each deal of unlabelled texts (deal, text), all from the same confirmed examples.

    Each is trained in a task of its own, so the unlabelled texts may be any number. Features that fewer than half of the
    models have are left out: the driver gets no more than twice what one model holds.
    """
    shared = unlabelled.sparkSession.sparkContext.broadcast(positive)

    def train(table: pa.Table) -> pa.Table:
        model = fit(shared.value, _rows(table.column("features")), prior)
        keys = pa.array([None, *model.keys.view(np.int64).tolist()], pa.int64())  # the row without a feature is the offset
        return pa.table({"feature": keys, "weight": pa.array(np.r_[model.offset, model.weights])})

    found = staged(with_features(unlabelled).groupBy("deal").applyInArrow(train, "feature long, weight double"), "toxicity-models")
    n = found.where("feature IS NULL").count()
    if not n:
        return fit(positive, [], prior)
    sums = found.groupBy("feature").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).where(2 * F.col("n") >= n).orderBy("feature").toArrow()
    feature, weight = sums.column("feature").to_pylist(), sums.column("w").to_numpy() / n
    keys = np.array([f for f in feature if f is not None], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return Model(keys[order], np.array([w for f, w in zip(feature, weight, strict=True) if f is not None])[order], float(weight[feature.index(None)]))


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Callable, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", prior: float | None = None) -> DataFrame:
    """``docs`` with a struct column ``toxicity`` (score, predicted).

    Confirmed examples are texts of labelled rows of which ``learn(id)`` holds; unlabelled texts are drawn from all rows of
    which it holds, labels unseen, positives among them as the risk assumes. ``prior`` is the share of toxic texts, by
    default the share among the learnable labels. Both samples are drawn by a hash of id and text, equal rows counting once,
    and bounded by POSITIVES, UNLABELLED and SAMPLE_CHARS for each model whatever ids repeat; there is one model for each
    UNLABELLED of the unlabelled texts drawn, one text in UNLABELLED_SHARE. The driver gets hashes, not texts. Null and empty texts hold no feature and get the
    offset's score. Null labels are ignored; several labels of one id count as their maximum. Repeated rows are scored each;
    an input column named ``toxicity`` is replaced.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & learn(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    known = staged(known, "toxicity-labels")
    seen = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).first()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(learn(F.col("id")))
    positive = _rows(with_features(drawn_texts(texts, POSITIVES, SAMPLE_CHARS, 5, known.where("label = 1").select("id")).withColumn("deal", F.lit(0).cast("long"))).toArrow().column("features"))
    models = max(1, -(-texts.count() // (UNLABELLED * UNLABELLED_SHARE)))
    unlabelled = drawn_texts(texts, UNLABELLED * models, SAMPLE_CHARS * models, 6).withColumn("deal", F.pmod(F.xxhash64("id", "text", F.lit(8)), F.lit(models)))
    share = prior if prior is not None else seen["toxic"] / max(1, seen["n"])
    model = docs.sparkSession.sparkContext.broadcast(mean_model(positive, unlabelled, share))

    def scorer() -> Callable[[list], list[np.ndarray]]:
        def score(batch: list) -> list[np.ndarray]:
            p = model.value.score(batch)
            return [p, (p >= THRESHOLD).astype(np.int32)]

        return score

    return with_scores(docs, text_col, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], scorer, "toxicity")
