"""Labelled training rows for the classifiers: a bounded, repeatable sample, never the held-out fifth."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a classifier is fitted on, at most. A parameter of each fit.
TRAIN_ROWS = 6_000


def held_out(id_col: str):
    """crc32 of the id as text, modulo 5, is 0; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training(docs: DataFrame, labels: DataFrame, label_col: str, *, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, text, y) of at most rows labelled documents outside the held-out fifth, those of the smallest hashes.

    Rows with a null id or label don't count; of several labels of an id the
    largest holds. The sample is small (its ids are broadcast: rows x 12 bytes).
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Coefficients (the last is the constant) of a ridge logistic regression by Newton's method."""
    z = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = sigmoid(z @ b)
        grad = z.T @ (p - y) + ridge * b
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.eye(len(b)), grad)
        b -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))
