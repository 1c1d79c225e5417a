"""What the two classifiers share: folds, bounded labelled samples, logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int, max_bytes: int) -> DataFrame:
    """At most ``rows`` labelled training documents (doc_id, text, y), drawn by a hash of the id.

    Texts of more than ``max_bytes`` are not drawn: rows and bytes of the sample
    are bounded whatever the corpus.  Half the rows at most come from each
    label, so that a rare label is represented.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    known = known.where(fold(F.col("doc_id"), folds) != held_out)
    parts = []
    for y in (0, 1):
        # More ids than needed are drawn, as some have no text here or one too long.
        ids = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        some = docs.where(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes)).select("doc_id", "text").join(F.broadcast(ids), "doc_id")
        parts.append(some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2))
    return parts[0].unionByName(parts[1])


class Logistic:
    """L2-regularised logistic regression by Newton steps on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, l2: float = 1.0, prior: float | None = None) -> None:
        """``prior``: share of label 1 to which the sample's classes are weighted."""
        self.mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        self.scale = x.std(axis=0) + 1e-9 if len(x) else np.ones(x.shape[1])
        self.w = np.zeros(x.shape[1] + 1)
        share = y.mean() if len(y) else 0.5
        if not 0 < share < 1:  # one class or none: its share, smoothed, is all there is to say
            self.w[-1] = np.log((share * len(y) + 0.5) / ((1 - share) * len(y) + 0.5))
            return
        p1 = share if prior is None else prior
        weight = np.where(y == 1, p1 / share, (1 - p1) / (1 - share))
        a = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        ridge = np.diag([l2] * x.shape[1] + [1e-6])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ self.w, -30, 30)))
            grad = a.T @ (weight * (p - y)) + ridge @ self.w
            step = np.linalg.solve(a.T @ (a * (weight * p * (1 - p))[:, None]) + ridge, grad)
            self.w -= np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale @ self.w[:-1] + self.w[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
