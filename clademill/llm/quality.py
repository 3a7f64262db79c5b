"""Quality classifier: a linear hinge-loss model on n-gram indicators scaled by naive Bayes log-count ratios.

A text's features are the byte n-grams that it has, hashed to SLOTS slots. Each slot's ratio is the logarithm of its
share among the good rows over its share among the bad ones. The indicators times the ratios, at unit length, go to
dual coordinate descent. A logistic curve, fitted to the margins of rows that a model of the other rows predicts, turns
margins into scores.

The labelled sample has at most SAMPLE rows, those with the lowest hash of their id; scores cover all documents. Null
and empty texts have no features and get the curve's value at margin 0. Without labels of both kinds every text scores
the share of good labels (1 where there are none). Repeated rows get equal scores. An empty table gives an empty result.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SIZES, BITS, SAMPLE, SMOOTH, C, EPOCHS, FOLDS, SEED = (2, 3, 4), 18, 4000, 1.0, 1.0, 20, 4, 11
SLOTS, CUT = 1 << BITS, 0.3
#: A row of the sample comes to the driver as slots or, if it has many, as a bitmap: 32 KB at most, however long its text.
BITMAP = SLOTS // 8


def indicators(text: str | None, seen: np.ndarray) -> np.ndarray:
    """The slots of a text's n-grams, ascending. seen: SLOTS times False, and so again afterwards."""
    raw = np.frombuffer((text or "").encode(), np.uint8).astype(np.uint64)
    for n in SIZES:
        if len(raw) >= n:
            key = np.full(len(raw) - n + 1, n, np.uint64)
            for k in range(n):
                key = key << np.uint64(8) | raw[k : k + len(key)]
            seen[key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)] = True
    out = np.flatnonzero(seen).astype(np.int32)
    seen[out] = False
    return out


def ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    p, q = np.full(SLOTS, SMOOTH), np.full(SLOTS, SMOOTH)
    for own, label in zip(rows, good):
        (p if label else q)[own] += 1
    return np.log(p / p.sum() / (q / q.sum()))


def descend(rows: list[np.ndarray], good: np.ndarray, ratio: np.ndarray, c: float = C, epochs: int = EPOCHS, seed: int = SEED) -> np.ndarray:
    """Weights of the hinge loss by dual coordinate descent. Each label has the same weight in all."""
    y = np.where(good, 1.0, -1.0)
    values = [r / (np.linalg.norm(r) or 1.0) if (r := ratio[own]).size else r for own in rows]
    square = [float(x @ x) for x in values]
    cost = costs(good, c)
    w, alpha, rng = np.zeros(SLOTS), np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(rows)).tolist():
            own, x = rows[i], values[i]
            if not square[i]:
                continue
            slope = y[i] * float(w[own] @ x) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            if new != alpha[i]:
                largest = max(largest, abs(new - alpha[i]))
                w[own] += (new - alpha[i]) * y[i] * x
                alpha[i] = new
        if largest < 1e-3:
            break
    return w


def costs(good: np.ndarray, c: float = C) -> np.ndarray:
    """What one unit of each row's hinge loss costs."""
    return c * np.where(good, len(good) / 2 / max(good.sum(), 1), len(good) / 2 / max((~good).sum(), 1))


def packed(own: np.ndarray) -> bytes:
    """Ascending slots, or a bitmap of them if that is shorter."""
    if own.nbytes < BITMAP:
        return own.tobytes()
    bits = np.zeros(SLOTS, np.uint8)
    bits[own] = 1
    return np.packbits(bits).tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    if len(blob) < BITMAP:
        return np.frombuffer(blob, np.int32)
    return np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8))).astype(np.int32)


def curve(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of largest likelihood, with softened labels."""
    n, m = good.sum(), (~good).sum()
    target = np.where(good, (n + 1) / (n + 2), 1 / (m + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([g @ margins, g.sum()])
        hess = np.array([[h @ margins**2 + 1e-6, h @ margins], [h @ margins, h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


@dataclass
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    slope: float
    offset: float

    @classmethod
    def fit(cls, rows: list[np.ndarray], good: np.ndarray) -> Model:
        zero = np.zeros(SLOTS)
        if not good.size or good.all() or not good.any():
            share = float(good.mean()) if good.size else 1.0
            return cls(zero, zero, 0.0, math.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        fold, margins = np.arange(len(rows)) % FOLDS, np.zeros(len(rows))
        for k in range(FOLDS):
            rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            if good[rest].all() or not good[rest].any():
                continue
            ratio = ratios([rows[i] for i in rest], good[rest])
            weight = descend([rows[i] for i in rest], good[rest], ratio)
            margins[own] = [cls(ratio, weight, 1, 0).margin(rows[i]) for i in own]
        ratio = ratios(rows, good)
        return cls(ratio, descend(rows, good, ratio), *curve(margins, good))

    def margin(self, own: np.ndarray) -> float:
        r = self.ratio[own]
        return float(self.weight[own] @ r / (np.linalg.norm(r) or 1.0)) if own.size else 0.0

    def score(self, own: np.ndarray) -> float:
        return 1 / (1 + math.exp(-min(max(self.slope * self.margin(own) + self.offset, -30), 30)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> Model:
    """A model of at most `sample` rows of labels (doc_id, quality) for which `learn` holds."""
    chosen = labels.where(learn & F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample).cache()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SLOTS, bool)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([packed(indicators(t, seen)) for t in batch.column(2).to_pylist()], pa.binary())], names=["doc_id", "quality", "slots"])

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text")
    # one row for each id and label, whatever rows repeat: `sample` at most
    found = common.python(known, run, "doc_id long, quality int, slots binary").groupBy("doc_id", "quality").agg(F.min("slots").alias("slots")).collect()
    chosen.unpersist()
    found.sort(key=lambda r: (bytes(r.slots), r.quality))
    np.random.default_rng(SEED).shuffle(found)
    return Model.fit([unpacked(bytes(r.slots)) for r in found], np.array([r.quality == 1 for r in found], bool))


def scored(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """doc_id, score and predicted of every text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SLOTS, bool)
        for batch in batches:
            score = np.array([held.value.score(indicators(t, seen)) for t in batch.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= cut).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return common.python(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double, predicted int")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = common.remainder("doc_id", 5) == 0
    model = fit(docs, common.read(spark, sf_dir, "labels"), ~held_out)
    return scored(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")
