"""Errors of many models at once: sums that tasks keep for a matrix of predictions, and the metrics they give."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from tallymark.functions.columns import MEAN_FLOOR

# Worker functions travel with their tasks: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SUMS = ("side string, fold int, setting int, n long, sse double, sae double, deviance double, sum_y double, "
        "squares_y double, low double, high double")


class ErrorSums:
    """Sums of errors by side, fold and model; label spreads are taken about ``centre``, so that they do not cancel."""

    def __init__(self, centre: float, deviance: bool):
        self.centre, self.deviance, self.held = centre, deviance, {}

    def add(self, side: str, fold: int, actual: np.ndarray, guess: np.ndarray) -> None:
        """``guess`` has a column per model."""
        error, off = actual[:, None] - guess, actual - self.centre
        found = np.array([
            (error * error).sum(axis=0), np.abs(error).sum(axis=0),
            deviances(actual, guess).sum(axis=0) if self.deviance else np.zeros(guess.shape[1])])
        sums, low, high = np.array([len(off), off.sum(), (off * off).sum()]), actual.min(), actual.max()
        if (side, fold) in self.held:
            before, label, least, most = self.held[side, fold]
            found, sums, low, high = before + found, label + sums, min(low, least), max(high, most)
        self.held[side, fold] = found, sums, low, high

    def batches(self) -> Iterator[pa.RecordBatch]:
        for (side, fold), ((sse, sae, deviance), (n, total, squares), low, high) in self.held.items():
            settings = len(sse)
            yield pa.RecordBatch.from_arrays([
                pa.array([side] * settings), pa.array([fold] * settings, pa.int32()), pa.array(range(settings), pa.int32()),
                pa.array([int(n)] * settings), pa.array(sse), pa.array(sae), pa.array(deviance),
                *[pa.array([float(v)] * settings) for v in (total, squares, low, high)],
            ], names=[c.split()[0] for c in SUMS.split(", ")])


def deviances(y: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """Poisson deviance of each row and model."""
    mean = np.maximum(guess, MEAN_FLOOR)
    own = np.where(y > 0, y * np.log(np.where(y > 0, y, 1.0)), 0.0)
    return 2 * (own[:, None] - np.where(y > 0, y, 0.0)[:, None] * np.log(mean) - y[:, None] + mean)


def metric_rows(found: DataFrame, deviance: bool) -> list[tuple]:
    """``(side, fold, setting, n, mse, mae, r2, poisson_deviance)`` of summed errors: a row per model, fold and side."""
    out = []
    names = ("n", "sse", "sae", "deviance", "sum_y", "squares_y")
    total = found.groupBy("side", "fold", "setting").agg(
        *[F.sum(c).alias(c) for c in names], F.min("low").alias("low"), F.max("high").alias("high"))
    for r in total.orderBy("side", "fold", "setting").collect():
        n, mse = r["n"], r["sse"] / r["n"]
        spread = r["squares_y"] / n - (r["sum_y"] / n) ** 2
        r2 = (1.0 if mse == 0 else 0.0) if r["low"] == r["high"] else 1 - mse / spread
        out.append((r["side"], r["fold"], r["setting"], n, mse, r["sae"] / n, r2, r["deviance"] / n if deviance else None))
    return out
