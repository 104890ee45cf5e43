"""Bounded samples of labelled rows, and a small logistic fit, for the classifiers of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import cut, folds


def labelled_sample(df: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, label)`` of at most ``most`` labelled rows outside the held-out fold, the first by a hash of the id.

    The bound is a parameter of the fit alone. Null labels, ids and texts are left out; of repeated labels the largest counts.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    own = own.where(folds(F.col("id")) != 0).groupBy("id").agg(F.max("label").alias("label"))
    few = F.broadcast(own.orderBy(F.xxhash64(F.lit(23), "id"), "id").limit(most))  # at most ``most`` rows of two numbers
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return cut(texts.join(few, F.col("doc_id") == F.col("id")).select("doc_id", "text", "label"))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights by Newton steps, held near ``prior`` with ``strength`` (inverse variance) for each weight."""
    w = prior.astype(float).copy()
    for _ in range(rounds):
        p = sigmoid(x @ w)
        g = x.T @ (p - y) + strength * (w - prior)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(strength + 1e-9)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w
