"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates.

A text is the unit vector of its counts of words, word pairs and triples, hashed to 2**BITS places, with a bias for texts
of its length. Training uses a bounded sample of labelled rows, in which both classes weigh the same; scoring is a sparse
dot product over every token of every whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import drawn_texts, gram_hashes, staged, token_hashes, with_scores

BITS = 20
GRAMS = (1, 2, 3)
#: The first places are biases, one for each length class; n-grams fall on the others.
LENGTHS = 16
#: Bounds of the training sample, by labelled rows and by characters of all drawn texts. Both bound the rate at which rows
#: are drawn; a drawn text counts whole, however long it is.
TRAIN_ROWS = 4000
TRAIN_CHARS = 10_000_000
EPOCHS = 3
THRESHOLD = 0.7


@dataclass
class Ftrl:
    """Per-coordinate FTRL-proximal logistic regression over hashed features."""

    bits: int = BITS
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 1e-3

    def __post_init__(self) -> None:
        self.z = np.zeros(1 << self.bits)
        self.n = np.zeros(1 << self.bits)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, x: np.ndarray, y: float, importance: float = 1.0) -> float:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = importance * (p - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        return float(p)


def length_class(tokens: np.ndarray) -> np.ndarray:
    """The bias of texts with so many tokens: one for each factor of four."""
    return np.minimum(np.log2(1 + np.asarray(tokens, dtype=np.float64)).astype(np.int64) // 2, LENGTHS - 1)


def counted(texts: list, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, count) of the hashed n-grams, each place of a text once, in order; and the tokens of each text.

    Words and runs of punctuation are tokens of their own and keep their case. Memory is 8 bytes a token of a text.
    """
    room, owners, places, counts = (1 << bits) - LENGTHS, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    tokens = np.zeros(len(texts), np.int64)
    for first, last, hashes, pointers in token_hashes(texts, lower=False):
        tokens[first:last] = np.diff(pointers)
        keys = []
        for n in GRAMS:
            grams, owner = gram_hashes(hashes, pointers, n)
            keys.append((owner << bits) + LENGTHS + ((grams >> np.uint64(n)) % np.uint64(room)).astype(np.int64))
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        owners.append((key >> bits) + first)
        places.append(key & ((1 << bits) - 1))
        counts.append(n)
    return np.concatenate(owners), np.concatenate(places), np.concatenate(counts), tokens


def dot(weights: np.ndarray, texts: list, bits: int = BITS) -> np.ndarray:
    """Sparse dot product of each text's unit vector with the weights, and the bias of its length."""
    owner, place, count, tokens = counted(texts, bits)
    total = np.bincount(owner, weights=weights[place] * count, minlength=len(texts))
    norm = np.sqrt(np.bincount(owner, weights=count.astype(np.float64) ** 2, minlength=len(texts)))
    return total / np.maximum(norm, 1) + weights[length_class(tokens)]


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], labels: list[int], bits: int = BITS, epochs: int = EPOCHS, seed: int = 1) -> np.ndarray:
    """Weights from (places, counts, tokens) of labelled texts. The rarer class weighs as much as the other one in sum."""
    model, rng = Ftrl(bits), np.random.default_rng(seed)
    ones = sum(labels)
    heavy = {0: max(1.0, ones / max(1, len(labels) - ones)), 1: max(1.0, (len(labels) - ones) / max(1, ones))}
    units = []
    for places, counts, tokens in rows:
        x = counts / max(1.0, float(np.sqrt((counts.astype(np.float64) ** 2).sum())))
        units.append((np.r_[length_class(np.array(tokens)), places], np.r_[1.0, x]))
    for _ in range(epochs):
        for i in rng.permutation(len(units)):
            model.update(*units[i], float(labels[i]), heavy[labels[i]])
    return model.weights()


def training_rows(docs: DataFrame, labels: DataFrame, label: str, learn: Callable, id_col: str, text_col: str, rows: int, bits: int = BITS) -> tuple[list, list]:
    """Vectors and labels of about ``rows`` labelled whole texts, drawn by a hash of id and text, equal ones once, in an order that the rows fix.

    N-grams are hashed and counted in the tasks; the driver gets places and counts, not texts.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & learn(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label).cast("int") > 0).cast("int")).alias("label"))
    known = staged(known, "quality-labels")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    drawn = drawn_texts(texts, rows, TRAIN_CHARS, 11, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                _, place, count, tokens = counted([text], bits)
                out.append((place.astype(np.int32).tobytes(), count.astype(np.int32).tobytes(), int(tokens[0])))
            columns = [pa.array([r[k] for r in out], type=t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], names=["places", "counts", "tokens", "label"])

    got = drawn.select("text", "label").mapInArrow(run, "places binary, counts binary, tokens long, label int").toArrow().to_pylist()
    got.sort(key=lambda r: (r["places"], r["counts"], r["label"]))
    return [(np.frombuffer(r["places"], np.int32), np.frombuffer(r["counts"], np.int32), r["tokens"]) for r in got], [r["label"] for r in got]


def score_quality(docs: DataFrame, labels: DataFrame, learn: Callable, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, bits: int = BITS) -> DataFrame:
    """``docs`` with a struct column ``quality_score`` (score, predicted).

    ``learn(id column)`` tells which ids may be learnt from. Null and empty texts get the bias of their length alone. Labels
    that are null are ignored, several labels of one id count as their maximum, and without any label every score is 0.5.
    Repeated rows are scored each; an input column named ``quality_score`` is replaced.
    """
    texts, known = training_rows(docs, labels, label, learn, id_col, text_col, train_rows, bits)
    weights = docs.sparkSession.sparkContext.broadcast(fit(texts, known, bits).astype(np.float32))

    def scorer() -> Callable[[list], list[np.ndarray]]:
        w = weights.value.astype(np.float64)

        def score(batch: list) -> list[np.ndarray]:
            p = 1 / (1 + np.exp(-np.clip(dot(w, batch, bits), -35, 35)))
            return [p, (p >= THRESHOLD).astype(np.int32)]

        return score

    return with_scores(docs, text_col, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], scorer, "quality_score")
