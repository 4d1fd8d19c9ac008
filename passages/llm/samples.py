"""Bounded samples of labelled rows and a small logistic model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.session import checkpoint_dir


def _draw(key: str):
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) / F.lit(1 << 30)


def bounded(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` rows, chosen by a hash of ``key``; all rows if there are fewer.

    The choice depends on keys and counts alone, so it is the same on any cluster."""
    return rows.filter(_draw(key) <= min(1.0, bound / max(1, rows.count())))


def bounded_by(rows: DataFrame, key: str, by: str, bound: int) -> DataFrame:
    """About ``bound`` rows of every value of ``by``, which has few values: their counts go to every task."""
    counts = rows.groupBy(by).agg(F.least(F.lit(1.0), F.lit(float(bound)) / F.count("*")).alias("_share"))
    few = counts.limit(10_001).count() <= 10_000
    return rows.join(F.broadcast(counts) if few else counts, by).filter(_draw(key) <= F.col("_share")).drop("_share")


def labelled(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """(doc_id, text, label) of about ``bound`` labelled documents. The labels are drawn first, so that only they travel to
    the texts: the broadcast has as many rows as the bound says."""
    drawn = bounded(labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").select("doc_id", "label"), "doc_id", bound)
    texts = docs.filter("text IS NOT NULL").select("doc_id", "text")
    checkpoint_dir(docs.sparkSession)
    return texts.join(F.broadcast(drawn), "doc_id").checkpoint()


class Logistic:
    """Logistic regression on standardised features, fitted by Newton's method with a small ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.c_[np.ones(len(x)), (x - self.mean) / self.scale]
        self.weights = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[0] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
            slope = z.T @ (y - p) - penalty * self.weights
            curve = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(curve, slope)
            self.weights += step
            if np.abs(step).max() < 1e-8:
                break

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.weights[0] + ((x - self.mean) / self.scale) @ self.weights[1:]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -40, 40)))
