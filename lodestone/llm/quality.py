"""Quality classifier: a linear SVM on n-gram indicators scaled by naive Bayes log-count ratios.

Features are hashed unigrams and bigrams of the words and of their shapes
(letters by case, digits, other bytes as they are). Each present n-gram has the
value of its class log-count ratio; a row is scaled by the root of its length.
A hinge-loss linear model is fitted by dual coordinate descent, interpolated
with its mean weight. Its margins become probabilities by a sigmoid, fitted on
cross-fitted margins at every size: the rows of each class, in their order, are cut
into ``FOLDS`` parts, and a row's margin comes from a model of the other parts (zero where
these hold one class alone).

The fit takes a bounded sample: at most ``sample_rows`` labelled documents of each
class, those with the smallest hash of their id, and of these, in that order, as
many as have ``SAMPLE_FEATURES`` n-grams together (the first one always). Only
this sample comes to the driver; its ids are broadcast. Of repeated ids the text
with the smallest hash stands for all. Scoring covers all rows and uses their
text alone.

Defined results: a null text counts as empty, and an empty text is scored by
the bias alone. Labels other than 0 and 1, or without a document, take no part;
of repeated labels of a document the larger holds. With one class alone every
score is the share of label 1; with no labels it is 0.5. Repeated rows and null
ids are scored like any other; a score of exactly the threshold is predicted 1.
Very long texts are handled one at a time; a text has at most 2**BITS n-grams.
An empty table gives an empty table; extra columns are ignored by ``classify``
and pass through ``keep_good``.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import Window

from .common import map_text, materialize, release, utf8

BITS = 18
SAMPLE_ROWS = 3000
SAMPLE_FEATURES = 4_000_000
FOLDS = 3
THRESHOLD = 0.7
SHAPE = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))


def features(text: bytes) -> np.ndarray:
    """Distinct hashed n-grams of a text, as sorted numbers below 2**BITS."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int32)
    own = np.array([crc32(w) for w in words], np.uint64)
    shape = np.array([crc32(w) for w in text.translate(SHAPE).split()], np.uint64)
    k = np.uint64(0x9E3779B97F4A7C15)
    pairs = own[:-1] * np.uint64(3) + own[1:] * np.uint64(0x100000001)
    shape_pairs = shape[:-1] * np.uint64(5) + shape[1:] * np.uint64(0x200000003)
    mixed = np.concatenate([own, shape ^ np.uint64(1 << 40), pairs, shape_pairs ^ np.uint64(1 << 50)]) * k
    return np.unique((mixed >> np.uint64(64 - BITS)).astype(np.int32))


@dataclass(frozen=True)
class Model:
    """Weights with the ratios multiplied in, bias, and the sigmoid ``1 / (1 + exp(-(a m + b)))``."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        if not len(found):
            return self.bias
        return float(self.weights[found].sum(dtype=np.float64)) / len(found) ** 0.5 + self.bias

    def score(self, found: np.ndarray) -> float:
        z = np.clip(self.slope * self.margin(found) + self.shift, -40, 40)
        return float(1 / (1 + np.exp(-z)))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    counts = np.full((2, 1 << BITS), smoothing)
    for found, label in zip(rows, labels, strict=True):
        counts[label][found] += 1
    rates = counts / counts.sum(axis=1, keepdims=True)
    return np.log(rates[1] / rates[0])


def descend(
    rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float = 1.0, rounds: int = 20, seed: int = 7, tolerance: float = 1e-3
) -> tuple[np.ndarray, float, np.ndarray]:
    """Dual coordinate descent for the L1-loss SVM; classes weigh alike. Returns weights, bias and dual variables."""
    random = np.random.default_rng(seed)
    signs = np.where(labels == 1, 1.0, -1.0)
    share = np.bincount(labels, minlength=2) / len(labels)
    limits = cost / (2 * share[labels])
    values = [ratios[f] / max(len(f), 1) ** 0.5 for f in rows]
    norms = np.array([v @ v + 1 for v in values])
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    for _ in range(rounds):
        moved = 0.0
        for i in random.permutation(len(rows)):
            f, v, y = rows[i], values[i], signs[i]
            slope = y * (w[f] @ v + bias) - 1
            new = min(max(alpha[i] - slope / norms[i], 0.0), limits[i])
            if step := new - alpha[i]:
                w[f] += step * y * v
                bias += step * y
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < tolerance:
            break
    return w, bias, alpha


def sigmoid_fit(margins: np.ndarray, labels: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Platt's fit by Newton steps, with his smoothed targets."""
    up, down = int((labels == 1).sum()), int((labels == 0).sum())
    target = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        g = np.array([((p - target) * margins).sum() + 1e-3 * a, (p - target).sum()])
        d = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(d * margins**2).sum() + 1e-3, (d * margins).sum()], [(d * margins).sum(), d.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        size = np.abs(step).max()
        a, b = a - step[0] * min(1, 5 / size), b - step[1] * min(1, 5 / size)
        if size < 1e-6:
            break
    return float(a), float(b)


def linear(rows: list[np.ndarray], labels: np.ndarray, interpolation: float) -> Model:
    """Weights and bias of the rows; nothing where a class is missing."""
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 1.0, 0.0)
    ratios = log_count_ratios(rows, labels)
    w, bias, _ = descend(rows, labels, ratios)
    w = interpolation * w + (1 - interpolation) * np.abs(w).mean()
    return Model((w * ratios).astype(np.float32), bias, 1.0, 0.0)


def fit(rows: list[np.ndarray], labels: np.ndarray, interpolation: float = 0.9) -> Model:
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    fold = np.zeros(len(rows), int)
    for label in (0, 1):
        own = np.flatnonzero(labels == label)
        fold[own] = np.arange(len(own)) * FOLDS // max(len(own), 1)
    margins = np.zeros(len(rows))
    for k in range(FOLDS):
        other = linear([r for r, f in zip(rows, fold, strict=True) if f != k], labels[fold != k], interpolation)
        for i in np.flatnonzero(fold == k):
            margins[i] = other.margin(rows[i])
    model = linear(rows, labels, interpolation)
    return Model(model.weights, model.bias, *sigmoid_fit(margins, labels))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    spark = docs.sparkSession
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
    )
    chosen = []
    for label in (0, 1):
        own = known.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
        chosen += [(r["doc_id"], r["quality"]) for r in own.collect()]
    if not chosen:
        return fit([], np.zeros(0, int))
    ids = spark.createDataFrame(chosen, "doc_id long, quality int")
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = sample.join(F.broadcast(ids), "doc_id")  # sample_rows of each class at most
    sample = sample.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(t) for t in utf8(batch.column("text"))]
        columns = [pa.array([len(f) for f in found], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())]
        return pa.record_batch([batch.column("doc_id"), batch.column("quality"), *columns], ["doc_id", "quality", "n", "found"])

    rows = materialize(map_text(sample, step, "doc_id long, quality int, n long, found binary"), "sample")
    # sample_rows rows a class at most
    order = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id")
    held = rows.select("doc_id", F.sum("n").over(order).alias("so_far"), F.row_number().over(order).alias("place"))
    kept = held.where((F.col("so_far") <= SAMPLE_FEATURES) | (F.col("place") == 1)).select("doc_id")
    got = rows.join(kept, "doc_id").select("doc_id", "quality", "found").toArrow()  # batches, not a row object each: the driver holds the sample once
    release(rows)
    ids, own = got["doc_id"].to_pylist(), got["quality"].to_numpy()
    found = [np.frombuffer(v.as_buffer(), np.int32) for v in got["found"]]
    order = sorted(range(len(ids)), key=lambda i: (crc32(str(ids[i]).encode()), ids[i]))
    return fit([found[i] for i in order], own[order].astype(int))


SCORE = "_lodestone_score"  # so named that it meets no column of the input


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The documents' columns with their score."""
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = sent.value
        scores = [own.score(features(t)) for t in utf8(batch.column("text"))]
        return pa.record_batch([*(batch.column(n) for n in names), pa.array(scores, pa.float64())], [*names, SCORE])

    return map_text(docs, step, docs.withColumn(SCORE, F.lit(0.0)).schema)


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = train(docs, labels, sample_rows)
    return score(plain, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, in the columns of the input."""
    model = train(docs, labels, sample_rows)
    return score(docs, model).where(F.col(SCORE) >= threshold).select(*docs.columns)
