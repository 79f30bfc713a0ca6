"""Bounded labelled samples for the classifiers, and a logistic fit on a few features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import column, stored


def fold(doc_id: str | F.Column, of: int) -> F.Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit(""))), F.lit(of))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, of: int, held: int, bound: int,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text and label of at most ``bound`` labelled documents outside the held-out fold.

    The rows are those with the smallest hashes of their ids, so reruns agree. The bound makes
    the labels small enough to broadcast: texts are not shuffled to meet them. Texts that repeat
    count once, or groups of copies would decide what is learnt.
    """
    picked = (
        labels.select(column(labels, id_col).cast("long").alias("doc_id"), column(labels, label_col).cast("int").alias("label"))
        .filter((fold("doc_id", of) != held) & F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(bound)
    )
    source = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"))
    found = source.join(F.broadcast(picked), "doc_id").select("text", "label")
    return stored(found.withColumn("same", F.xxhash64("text")).dropDuplicates(["same", "label"]).drop("same"))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights, the intercept first, by damped Newton steps; the intercept is not penalised."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    if len(y):
        rate = (y.sum() + 0.5) / (len(y) + 1)
        w[0] = np.log(rate / (1 - rate))
    if len(set(y.tolist())) < 2:
        return w
    penalty = np.full(x.shape[1], ridge * len(y))
    penalty[0] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - penalty * w
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        w += step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w
