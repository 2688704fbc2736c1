"""Shared parts of the classifiers that are trained here in numpy: the labelled sample, Adam, small functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Params = dict[str, np.ndarray]


def fold(doc_id: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int) -> tuple[list[bytes], np.ndarray]:
    """Whole texts and labels of at most `per_class` labelled rows a class, the first by a hash of doc_id.

    `usable` is a condition on doc_id that keeps held-out rows away. A doc_id labelled twice counts once, with the larger
    label; null labels, null ids and ids without a document are left out.
    """
    ids = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    ids = ids.filter(usable).groupBy("doc_id").agg(F.max("label").alias("label"))
    order = F.xxhash64("doc_id")
    kept = ids.filter("label = 0").orderBy(order, "doc_id").limit(per_class).unionByName(ids.filter("label = 1").orderBy(order, "doc_id").limit(per_class))
    # At most 2 * per_class narrow rows: a bounded broadcast.
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(kept), "doc_id")
    rows = sorted(found.groupBy("doc_id").agg(F.first("label"), F.min("text")).collect())
    return [r[2].encode("utf-8") for r in rows], np.array([r[1] for r in rows], dtype=np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Adam:
    def __init__(self, params: Params, rate: float, decay: float = 0.0):
        self.params, self.rate, self.decay, self.step = params, rate, decay, 0
        self.first = {k: np.zeros_like(v) for k, v in params.items()}
        self.second = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: Params) -> None:
        self.step += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for k, g in grads.items():
            m, v = self.first[k], self.second[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            if self.decay:
                self.params[k] *= 1 - self.rate * self.decay
            self.params[k] -= (scale * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


def ranking_quality(scores: np.ndarray, labels: np.ndarray) -> float:
    """Area under the ROC curve."""
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    _, group, size = np.unique(scores, return_inverse=True, return_counts=True)
    ranks = (np.bincount(group, ranks) / size)[group]
    ones = labels == 1
    return float((ranks[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum()))
