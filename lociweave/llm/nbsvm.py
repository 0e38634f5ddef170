"""Quality classifier: support vectors on n-gram indicators scaled by naive Bayes log-count ratios.

An n-gram is a word or a pair of words in lower case, hashed into WORD_BUCKETS;
1 to ORDERS characters of a text with letters and digits folded to their class
(so that it tells form from words); or a word that follows itself twice, hashed
into FORM_BUCKETS.  From labelled rows come each n-gram's
log-count ratio between the classes; indicators scaled by it are the features
of a linear hinge-loss model, fitted by dual coordinate descent.  A margin of 0
is given the score CUT; the slope of the logistic curve around it is fitted to
the training rows.

The model is fitted on the driver on a bounded sample of labelled rows
(``labelled_sample``); every row is scored in one pass.  Null and empty texts
have no n-grams and get the score of the bias; repeated rows get equal scores.
With labels of one class all rows get that class, without labels 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Texts, blocks, column_texts
from .sampling import labelled_sample, remainder

ORDERS = 4
FORM_BUCKETS, WORD_BITS = 1 << 13, 15
WORD_BUCKETS = 1 << WORD_BITS
BUCKETS = FORM_BUCKETS + WORD_BUCKETS
ROWS_AT_ONCE = 512
FOLDS, HELD_OUT = 4, 2
TRAIN_ROWS = 6_000
CUT = 0.7
C, EPOCHS = 0.05, 15

# Letters and digits by class, all else as it is.
_FORM = np.arange(256, dtype=np.uint32)
_FORM[ord("a") : ord("z") + 1] = ord("a")
_FORM[128:] = ord("a")
_FORM[ord("A") : ord("Z") + 1] = ord("A")
_FORM[ord("0") : ord("9") + 1] = ord("0")


def indicators(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each n-gram that occurs in a text, once, in order."""
    found = np.zeros((len(texts), BUCKETS), bool)
    form = _FORM[texts.data]
    owner = np.repeat(np.arange(len(texts)), texts.ends - texts.starts)
    code = np.zeros(len(form), np.uint32)
    for n in range(1, ORDERS + 1):
        m = len(form) - n + 1
        if m <= 0:
            break
        code = (code[:m] << np.uint32(8)) | form[n - 1 : n - 1 + m]
        bucket = ((code ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(19)
        one = owner[:m] == owner[n - 1 : n - 1 + m]
        found[owner[:m][one], bucket[one]] = True
    w = texts.words()
    if len(w) > 2:
        h = w.hashes
        thrice = np.flatnonzero((h[1:-1] == h[:-2]) & (h[1:-1] == h[2:]) & (w.owner[:-2] == w.owner[2:]))
        found[w.owner[thrice], 0] = True
    w = texts.words(lower=True)
    for n in (1, 2):
        h, first = w.ngrams(n)
        found[w.owner[first], FORM_BUCKETS + (h >> np.uint64(64 - WORD_BITS)).astype(np.int64)] = True
    return np.nonzero(found)


class Model:
    """Weights of the buckets, a bias and the slope of the score."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, constant: float | None = None):
        self.weights, self.bias, self.slope, self.constant = weights, bias, slope, constant

    def scores(self, texts: Texts) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        row, bucket = indicators(texts)
        margin = np.bincount(row, weights=self.weights[bucket], minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + np.log(CUT / (1 - CUT)), -30, 30)))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = np.ones((2, BUCKETS))
    for x, label in zip(rows, y, strict=True):
        counts[label, x] += 1
    p = counts / counts.sum(axis=1, keepdims=True)
    return np.log(p[1] / p[0])


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, c: float, epochs: int, seed: int = 0) -> tuple[np.ndarray, float]:
    """Linear hinge-loss weights on ratio-scaled indicators; c is shared out so that both classes weigh the same."""
    sign = np.where(y == 1, 1.0, -1.0)
    upper = c * len(y) / 2 / np.where(y == 1, (y == 1).sum(), (y == 0).sum())
    scale = ratio**2
    norm = np.array([scale[x].sum() + 1 for x in rows])
    alpha, w, bias = np.zeros(len(y)), np.zeros(BUCKETS), 0.0  # w is over indicators: ratio * ratio * sum of alpha y
    order = np.arange(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order.tolist():
            x = rows[i]
            gradient = sign[i] * (w[x].sum() + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), upper[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[x] += step * scale[x]
                bias += step
                alpha[i] = new
    return w, bias


def slope_of(margin: np.ndarray, y: np.ndarray) -> float:
    """The slope that fits the labels best, by ternary search (the loss is convex in it)."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    loss = lambda a: (weight * np.logaddexp(0, -np.where(y == 1, 1, -1) * a * margin)).sum()
    low, high = 0.1, 10.0
    for _ in range(40):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float((low + high) / 2)


def fit(sample: DataFrame) -> Model:
    """A model from (key, text, label) rows, few enough for the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in blocks(column_texts(batch.column(1)), max_rows=ROWS_AT_ONCE):
                row, bucket = indicators(texts)
                parts = np.split(bucket.astype("<u2"), np.searchsorted(row, np.arange(1, j - i)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array([x.tobytes() for x in parts], pa.binary())], ["key", "label", "buckets"])

    rows = sample.mapInArrow(run, f"key {sample.schema['key'].dataType.simpleString()}, label int, buckets binary").orderBy("key", "buckets").toPandas()
    y = rows["label"].to_numpy(int) if len(rows) else np.zeros(0, int)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS), 0.0, 1.0, float(y[0]) if len(y) else 0.5)
    x = [np.frombuffer(b, "<u2").astype(np.int64) for b in rows["buckets"]]
    w, bias = dual_coordinate_descent(x, y, log_count_ratios(x, y), C, EPOCHS)
    return Model(w, bias, slope_of(np.array([w[i].sum() for i in x]) + bias, y))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row."""
    key_type = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in blocks(column_texts(batch.column(1)), max_rows=ROWS_AT_ONCE):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(shared.value.scores(texts))], ["key", "score"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {key_type}, score double").withColumnRenamed("key", key)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = TRAIN_ROWS) -> DataFrame:
    """(key, held_out, score, predicted) of every row, learned from labels outside the held-out fold."""
    model = fit(labelled_sample(docs, labels, label, FOLDS, HELD_OUT, most, key, text))
    held = F.coalesce(remainder(F.col(key), FOLDS) == HELD_OUT, F.lit(False))
    return score(docs, model, key, text).select(key, held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
