"""Boosted ensembles scored at several lengths: the trees of a short ensemble are the first trees of a long one.

MLlib draws the rows of each boosting round from the seed and the round, so that rounds do not depend on how many follow.
One fit of the longest ensemble and one pass over the rows, in which each tree is walked once, thus give the errors
of every shorter one.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tallymark.operators.errors import SUMS, ErrorSums, metric_rows

# Worker functions travel with their tasks: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS_TOGETHER = 2048  # rows whose leaves a task holds at a time


def leaf_values(model) -> np.ndarray:
    """Weighted value of every leaf, ``(trees, leaves)``, in the order in which MLlib numbers the leaves of a tree."""
    trees = re.split(r"Tree \d+ \(weight ([^)]+)\):", model.toDebugString)[1:]
    values = [[float(weight) * float(v) for v in re.findall(r"Predict: (\S+)", tree)] for weight, tree in zip(trees[::2], trees[1::2])]
    out = np.zeros((len(values), max(map(len, values), default=1)))
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def prefix_scores(rows: DataFrame, model, lengths: list[int], fold: int, side: str, centre: float, deviance: bool = True) -> list[tuple]:
    """Metrics of the first ``lengths`` trees over ``features, y``: ``(side, fold, index of the length, n, mse, mae, r2, deviance)``."""
    sent = rows.sparkSession.sparkContext.broadcast(leaf_values(model))  # one number per leaf of the ensemble
    leaves = model.copy().setLeafCol("leaves").transform(rows).select(
        F.col("y").cast("double").alias("y"), vector_to_array("leaves", "float32").alias("leaves"))
    try:
        found = leaves.mapInArrow(
            lambda batches: _errors(batches, sent.value, lengths, fold, side, ErrorSums(centre, deviance)), SUMS)
        return metric_rows(found, deviance)
    finally:
        sent.destroy()


def prefix_predictions(leaves: np.ndarray, values: np.ndarray, lengths: list[int]) -> np.ndarray:
    """Predictions ``(rows, lengths)`` from leaf numbers ``(rows, trees)``."""
    out, total, start = np.zeros((len(leaves), len(lengths))), np.zeros(len(leaves)), 0
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
        stop = min(lengths[i], len(values))
        if stop > start:
            total = total + values[np.arange(start, stop), leaves[:, start:stop]].sum(axis=1)
            start = stop
        out[:, i] = total
    return out


def _errors(batches: Iterator[pa.RecordBatch], values, lengths, fold, side, sums: ErrorSums) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_TOGETHER):
            part = batch.slice(at, ROWS_TOGETHER)
            leaves = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1).astype(np.int64)
            sums.add(side, fold, part.column(0).to_numpy(zero_copy_only=False), prefix_predictions(leaves, values, lengths))
    yield from sums.batches()
