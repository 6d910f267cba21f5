"""Bounded samples of labelled rows, and small fits on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(modulus: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo; null ids count as 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))


def labelled(docs: DataFrame, labels: DataFrame, label: str, use, rows: int, by_label: bool) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled ids, drawn by hash.

    Ids are drawn from the label table alone (``use`` is a condition on doc_id),
    ``rows`` for each label or in all. What is joined with the documents is thus of
    a size that does not grow and is broadcast; the documents do not move. Of rows that
    repeat an id the one with the least text is taken, so ``rows`` holds for rows, too.
    """
    ids = labels.where(use).where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    ids = ids.groupBy("doc_id").agg(F.max("label").alias("label"))
    order = [F.xxhash64(F.col("doc_id").cast("long"), F.lit(17)), "doc_id"]
    if by_label:
        parts = [ids.where(F.col("label") == v).orderBy(*order).limit(rows) for v in (0, 1)]
        drawn = parts[0].union(parts[1])
    else:
        drawn = ids.orderBy(*order).limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights of a logistic regression with intercept first, by damped Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    keep = ridge * len(y) * np.eye(a.shape[1])
    keep[0, 0] = 1e-9

    def loss(t):
        z = a @ t
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * t @ keep @ t

    theta = np.zeros(a.shape[1])
    for _ in range(steps):
        p = sigmoid(a @ theta)
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + keep, a.T @ (y - p) - keep @ theta)
        size, now = 1.0, loss(theta)
        while size > 1e-6 and not loss(theta + size * step) <= now:
            size /= 2
        theta = theta + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return theta


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))
