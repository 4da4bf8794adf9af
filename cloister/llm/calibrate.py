"""Temperature calibration of class scores, and the split that keeps held-out rows out of training."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True for rows that are never learned from: crc32 of the id as text leaves 2 modulo 4; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(True))


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss of ``softmax(logits / t)`` on rows that the model did not learn from."""
    if not len(labels):
        return 1.0
    rows = np.arange(len(labels))
    grid = np.exp(np.linspace(np.log(0.1), np.log(10), 80))
    loss = [-np.log(np.maximum(softmax(logits / t)[rows, labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])
