"""What the trained operators share: a bounded labelled sample, and calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import bounded_sample


LONGEST = 128 << 10


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, rows: int, learn: Column | None = None, longest: int = LONGEST) -> tuple[pa.Array, np.ndarray]:
    """Whole texts and labels of at most ``rows`` labelled documents of at most ``longest`` bytes, the same ones for the same tables.

    Both bounds are for learning alone, so that what comes to the driver is bounded; every text is scored, whole.

    The sample of labels is bounded, so it is broadcast; the documents are scanned once, and only
    sampled texts come to the driver. ``learn`` says which labels may be used at all.
    """
    marked = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    if learn is not None:
        marked = marked.where(learn)
    sample = bounded_sample(marked, rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= longest)
    got = texts.join(F.broadcast(sample), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows).toArrow().combine_chunks()
    text = got.column("text").combine_chunks() if got.num_rows else pa.array([], pa.string())
    return text, np.array(got.column("y").to_pylist(), np.float64)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept that turn scores into probabilities (Platt's smoothed targets, Newton steps)."""
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos or not neg:
        return 1.0, 0.0
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([z, np.ones(len(z))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (p - t) + 1e-6 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), grad)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)
