"""Squared-error models from cross-products summed by fold: one pass over the rows serves every fold and penalty.

All rows are encoded once, and ``A'A`` of ``A = [1, features, label]`` is summed by fold in the tasks. Training sides are
sums without one fold; their means and scales come from the same matrix, so that each side is standardised on its own
without another look at the rows. Ridge solves the small system, the elastic net descends by coordinate for all
penalties and folds side by side. A second pass scores all of them, or predicts each row by the model
fitted without its fold. The driver holds a matrix per fold, ``GRAM_COLUMNS`` wide at most.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallymark.operators.encode import Encoder, monomials
from tallymark.operators.errors import SUMS, ErrorSums, metric_rows

# Worker functions travel with their tasks: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRAM_COLUMNS = 1024          # encoded columns up to which models are solved from cross-products
HELD_BYTES = 256_000_000     # matrices a task holds before it hands them on
SLOTS = 32                   # partial matrices are added up in so many parts first
LINEAR = ("ols", "ridge", "elastic_net", "polynomial")
MODELS_SCORED = 4096         # models whose errors a task sums up in one pass


def encoded(df: DataFrame, encoder: Encoder, label: str, *columns: str) -> DataFrame:
    """``columns, y, features`` with the features as arrays of doubles."""
    rows = encoder.transform(df.withColumn("__label", F.col(f"`{label}`").cast("double")))
    return rows.select(*columns, F.col("__label").alias("y"), vector_to_array("features").alias("features"))


@dataclass
class Gram:
    """Cross-products of ``[1, features, label]`` by fold; the label is centred and scaled as the encoder says."""

    encoder: Encoder
    folds: list[int]
    parts: np.ndarray  # (folds, width + 2, width + 2)

    def side(self, left_out: int | None) -> "Side":
        """The rows of all folds but one, or of all."""
        total = self.parts.sum(axis=0)
        if left_out is not None:
            total = total - self.parts[self.folds.index(left_out)]
        return Side.of(total, self.encoder)

    def only(self, encoder: Encoder) -> "Gram":
        """The same rows by an encoder whose features are some of this one's, such as polynomial terms of a lower degree."""
        kept = np.array([0, *[1 + at for at in places(encoder, self.encoder)], self.encoder.width + 1])
        return Gram(encoder, self.folds, self.parts[:, kept[:, None], kept])

    def stand_in(self, spark: SparkSession) -> DataFrame:
        """A few rows ``features, __y`` with the means and covariances of all rows, and so with their least-squares models.

        One pair of rows either side of the mean for each axis of the covariance matrix: two for every column.
        """
        total = self.parts.sum(axis=0)
        mean = total[0, 1:] / max(total[0, 0], 1.0)
        values, axes = np.linalg.eigh(total[1:, 1:] / max(total[0, 0], 1.0) - np.outer(mean, mean))
        values = np.where(values > 1e-14 * values.max(initial=0.0), values, 0.0)  # below that it is rounding
        off = (axes * np.sqrt(values * len(values))).T
        rows = np.concatenate([mean + off, mean - off])
        y = (self.encoder.label_mean or 0.0) + (self.encoder.label_std or 1.0) * rows[:, -1]
        return spark.createDataFrame(
            [(Vectors.dense(x), float(v)) for x, v in zip(rows[:, :-1], y)],
            StructType([StructField("features", VectorUDT()), StructField("__y", DoubleType())]))


def places(encoder: Encoder, among: Encoder) -> list[int]:
    """Slot of each feature of ``encoder`` in the vectors of ``among``, which has terms of at least its degree of the same columns."""
    numeric = len(encoder.recipe.numeric)
    own, others = (monomials(numeric, e.recipe.degree) for e in (encoder, among))
    slots = {tuple(sorted(p.items())): i for i, p in enumerate(others)}
    return [slots[tuple(sorted(p.items()))] for p in own] + [i + len(others) for i in range(encoder.width - len(own))]


def cross_products(rows: DataFrame, encoder: Encoder, fold: str | None = "fold") -> Gram:
    """Sum the cross-products of ``encoded`` rows by ``fold`` (one fold without it), on the tasks and then in two levels."""
    width, shift, scale = encoder.width, encoder.label_mean or 0.0, encoder.label_std or 1.0
    narrow = rows.select((F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"), "y", "features")
    schema = "fold int, slot int, place int, sums array<double>"
    parts = narrow.mapInArrow(lambda batches: _products(batches, width, shift, scale), schema)
    parts = parts.groupBy("fold", "place", "slot").applyInArrow(_added, schema)
    parts = parts.groupBy("fold", "place").applyInArrow(_added, schema)
    found: dict[int, np.ndarray] = {}
    for r in parts.select("fold", "place", "sums").toLocalIterator():  # a matrix per fold
        found.setdefault(r["fold"], np.zeros((width + 2, width + 2)))[r["place"], r["place"]:] = r["sums"]
    folds = sorted(found)
    full = [found[f] + np.triu(found[f], 1).T for f in folds]
    return Gram(encoder, folds, np.array(full).reshape(len(folds), width + 2, width + 2))


def _products(batches: Iterator[pa.RecordBatch], width: int, shift: float, scale: float) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    slot = TaskContext.get().partitionId() % SLOTS
    held: dict[int, np.ndarray] = {}
    limit = max(1, HELD_BYTES // (8 * (width + 2) ** 2))
    for batch in batches:
        fold, design = _design(batch, width)
        design = np.concatenate([np.ones((len(design), 1)), design, (_labels(batch) - shift)[:, None] / scale], axis=1)
        for f in np.unique(fold):
            mine = design[fold == f]
            if f not in held and len(held) >= limit:
                yield _triangles(held, slot)
                held = {}
            held[f] = held.get(f, 0.0) + mine.T @ mine
    if held:
        yield _triangles(held, slot)


def _design(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Folds, and features as a matrix."""
    values = batch.column(batch.schema.get_field_index("features")).flatten().to_numpy(zero_copy_only=False)
    return batch.column(batch.schema.get_field_index("fold")).to_numpy(zero_copy_only=False), values.reshape(batch.num_rows, width)


def _labels(batch: pa.RecordBatch) -> np.ndarray:
    y = batch.column(batch.schema.get_field_index("y")).to_numpy(zero_copy_only=False).astype(float)
    if not np.isfinite(y).all():
        raise ValueError("labels must be present and finite")
    return y


def _triangles(held: dict[int, np.ndarray], slot: int) -> pa.RecordBatch:
    rows = [(int(f), i, m[i, i:]) for f, m in held.items() for i in range(len(m))]
    return pa.RecordBatch.from_arrays([
        pa.array([r[0] for r in rows], pa.int32()), pa.array([slot] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
        pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["fold", "slot", "place", "sums"])


def _added(key: tuple, rows: pa.Table) -> pa.Table:
    sums = rows.column("sums").combine_chunks()
    total = sums.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1).sum(axis=0)
    return pa.table({
        "fold": pa.array([key[0].as_py()], pa.int32()), "slot": pa.array([key[2].as_py() if len(key) > 2 else 0], pa.int32()),
        "place": pa.array([key[1].as_py()], pa.int32()), "sums": pa.array([total], pa.list_(pa.float64()))})


@dataclass
class Side:
    """Covariances of a training side, its numeric columns standardised by its own moments."""

    n: float
    cov: np.ndarray     # of the standardised features
    with_y: np.ndarray  # covariances with the label, in label units
    mean: np.ndarray    # of the encoder's features
    scale: np.ndarray   # by which this side's columns divide them
    y_mean: float
    turn: np.ndarray | None = None  # this side's polynomial terms, put together from the encoder's

    @staticmethod
    def of(total: np.ndarray, encoder: Encoder) -> "Side":
        turn = _own_terms(total, encoder) if encoder.recipe.degree > 1 and encoder.recipe.numeric else None
        if turn is not None:
            total = turn.T @ total @ turn
        n = max(total[0, 0], 1.0)
        mean, y_mean = total[0, 1:-1] / n, total[0, -1] / n
        cov = total[1:-1, 1:-1] / n - np.outer(mean, mean)
        with_y = (total[1:-1, -1] / n - mean * y_mean) * (encoder.label_std or 1.0)
        scale = np.ones(len(mean))
        for j, name in enumerate(encoder.names[: len(encoder.recipe.numeric)] if encoder.recipe.scale and turn is None else []):
            deviation = _deviation(cov[j, j], mean[j], encoder, name)
            if deviation:
                scale[j] = deviation
            else:
                cov[j, :] = cov[:, j] = with_y[j] = 0.0
                scale[j] = 1 / encoder.scales[name]
        with_y = with_y / scale
        y = (encoder.label_mean or 0.0) + (encoder.label_std or 1.0) * y_mean
        return Side(total[0, 0], cov / np.outer(scale, scale), with_y, mean, scale, y, turn)

    def on_encoded(self, b: np.ndarray) -> tuple[np.ndarray, float]:
        """Coefficients and intercept for the encoder's own features."""
        raw = b / self.scale
        start = self.y_mean - float(self.mean @ raw)
        if self.turn is None:
            return raw, start
        return self.turn[1:-1, 1:-1] @ raw, start + float(self.turn[0, 1:-1] @ raw)


def _deviation(variance: float, mean: float, encoder: Encoder, name: str) -> float | None:
    """The encoder's rule on a side's rows: a column that is constant up to rounding is only centred."""
    deviation = max(variance, 0.0) ** 0.5
    centre = encoder.means[name] + encoder.scales[name] * mean
    # below 1e-7 it is rounding
    return deviation if deviation * encoder.scales[name] > 1e-12 * max(1.0, abs(centre)) and deviation > 1e-7 else None


def _own_terms(total: np.ndarray, encoder: Encoder) -> np.ndarray:
    """``[1, features, label]`` with polynomial terms of columns standardised by these rows: a column of weights for each.

    A term of ``(z - m) / s`` is a sum of the encoder's terms of ``z`` of its own and lower degrees. Terms of a column
    that is constant here are nothing but zeros.
    """
    terms = monomials(len(encoder.recipe.numeric), encoder.recipe.degree)
    slot = {tuple(sorted(p.items())): 1 + i for i, p in enumerate(terms)} | {(): 0}
    turn, n = np.eye(len(total)), max(total[0, 0], 1.0)
    centre, scale = {}, {}
    for i, name in enumerate(encoder.recipe.numeric if encoder.recipe.scale else ()):
        at = slot[((i, 1),)]
        centre[i] = total[0, at] / n
        scale[i] = _deviation(total[at, at] / n - centre[i] ** 2, centre[i], encoder, name)
    for powers in terms if encoder.recipe.scale else []:
        own = {(): 1.0}  # weight of each of the encoder's terms
        for i, e in powers.items():
            part = [math.comb(e, d) * (-centre[i]) ** (e - d) / scale[i] ** e for d in range(e + 1)] if scale[i] else []
            own = {tuple(sorted((*p, *([(i, d)] if d else [])))): w * x for p, w in own.items() for d, x in enumerate(part)}
        column = np.zeros(len(total))
        for p, w in own.items():
            column[slot[p]] += w
        turn[:, slot[tuple(sorted(powers.items()))]] = column
    return turn


def ridge(side: Side, penalty: float) -> np.ndarray:
    """Minimiser of ``(1/2n) |y - a - Zb|^2 + penalty/2 |b|^2``."""
    return np.linalg.solve(side.cov + penalty * np.eye(len(side.cov)), side.with_y)


def elastic_nets(
    sides: list[Side], which: np.ndarray, l1: np.ndarray, l2: np.ndarray, tolerance: float = 1e-10, sweeps: int = 5_000,
) -> np.ndarray:
    """Minimisers of ``(1/2n) |y - a - Zb|^2 + l1 |b|_1 + l2/2 |b|^2``, problem ``i`` on ``sides[which[i]]``; a row each.

    Cyclic coordinate descent on the covariances, all problems together; a problem leaves when no
    coefficient of a sweep moved by more than ``tolerance`` of the label's spread.
    """
    cov = np.array([s.cov for s in sides])
    target = np.array([s.with_y for s in sides])
    b = np.zeros((len(which), cov.shape[1]))
    slack = target[which].copy()  # covariance of each column with the residual
    size = np.maximum(np.abs(target).max(axis=1, initial=0.0), 1e-300)[which] if len(which) else np.zeros(0)
    alive = np.arange(len(which))
    for _ in range(sweeps):
        if not len(alive):
            break
        moved = np.zeros(len(alive))
        at, now, left = which[alive], b[alive], slack[alive]
        for j in range(cov.shape[1]):
            own = cov[at, j, j]
            rho = left[:, j] + own * now[:, j]
            below = own + l2[alive]
            new = np.where(below > 0, np.sign(rho) * np.maximum(np.abs(rho) - l1[alive], 0.0) / np.where(below > 0, below, 1.0), 0.0)
            step = new - now[:, j]
            changed = np.flatnonzero(step)
            if len(changed):
                left[changed] -= step[changed, None] * cov[at[changed], j]
                now[:, j] = new
                moved = np.maximum(moved, np.abs(step) * np.maximum(own, 1e-300))
        b[alive], slack[alive] = now, left
        alive = alive[moved > tolerance * size[alive]]
    return b


def penalties(family: str, params: dict, n: float, tiny_ridge: float) -> tuple[float, float]:
    """``(l1, l2)`` of a parameter setting, on the scale of ``(1/2n) * loss``."""
    if family in ("ols", "polynomial"):
        return 0.0, params.get("ridge", tiny_ridge)
    if family == "ridge":
        return 0.0, params.get("alpha", 1.0) / n
    alpha, ratio = params.get("alpha", 0.001), params.get("l1_ratio", 0.8)
    return alpha * ratio, alpha * (1 - ratio)


@dataclass
class Models:
    """Linear models on an encoder's features: of every left-out fold (first axis) and parameter setting."""

    folds: list[int]
    coefficients: np.ndarray  # (folds, settings, width)
    intercepts: np.ndarray    # (folds, settings)
    standardised: np.ndarray  # (folds, settings, width), for the side's own standardised columns
    centre: float             # about which label spreads are summed


def solve(gram: Gram, family: str, settings: list[dict], tiny_ridge: float, whole: bool = False) -> Models:
    """Models of all settings on the training side of every fold, or with ``whole`` on all rows."""
    folds = [-1] if whole else gram.folds
    sides = [gram.side(None if whole else f) for f in folds]
    asked = [[penalties(family, q, max(s.n, 1.0), tiny_ridge) for q in settings] for s in sides]
    width = gram.encoder.width
    found = np.zeros((len(folds), len(settings), width))
    if family == "elastic_net":
        flat = np.array(asked).reshape(-1, 2)
        found[:] = elastic_nets(sides, np.repeat(np.arange(len(folds)), len(settings)), flat[:, 0], flat[:, 1]).reshape(found.shape)
    else:
        for i, side in enumerate(sides):
            for g, (_, l2) in enumerate(asked[i]):
                found[i, g] = ridge(side, l2)
    raw, start = np.zeros_like(found), np.zeros(found.shape[:2])
    for i, side in enumerate(sides):
        for g in range(len(settings)):
            raw[i, g], start[i, g] = side.on_encoded(found[i, g])
    return Models(folds, raw, start, found, gram.encoder.label_mean or 0.0)


def side_by_side(models: list[Models], grams: list[Gram], encoder: Encoder) -> Models:
    """Models on some of an encoder's features each, as settings on all of its features, as these are and not standardised."""
    wide = np.zeros((len(models[0].folds), len(models), encoder.width))
    for i, (m, g) in enumerate(zip(models, grams)):
        wide[:, i, places(g.encoder, encoder)] = m.coefficients[:, 0]
    start = np.concatenate([m.intercepts for m in models], axis=1)
    return Models(models[0].folds, wide, start, wide, models[0].centre)


def scores(rows: DataFrame, models: Models, with_train: bool = False, deviance: bool = True) -> list[tuple]:
    """Errors of every model on the rows of its fold (and with ``with_train`` on the other rows), in one pass over the rows.

    ``(side, fold, setting, n, mse, mae, r2, poisson_deviance)``: a row per model, fold and side reaches the driver.
    """
    sc = rows.sparkSession.sparkContext
    width, out = models.coefficients.shape[2], []
    step = max(1, MODELS_SCORED // max(len(models.folds), 1))
    for start in range(0, models.coefficients.shape[1], step):
        part = slice(start, start + step)
        sent = sc.broadcast((models.folds, models.coefficients[:, part], models.intercepts[:, part]))  # a row per model
        found = rows.select("fold", "y", "features").mapInArrow(
            lambda batches, sent=sent: _errors(batches, width, *sent.value, ErrorSums(models.centre, deviance), with_train), SUMS)
        out += [(side, fold, start + setting, *values) for side, fold, setting, *values in metric_rows(found, deviance)]
        sent.destroy()
    return out


def _errors(batches, width, folds, coefficients, intercepts, sums: ErrorSums, with_train: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fold, design = _design(batch, width)
        y = _labels(batch)
        for i, f in enumerate(folds):
            for side in ("valid", "train") if with_train else ("valid",):
                mine = (fold == f) == (side == "valid")
                if mine.any():
                    sums.add(side, f, y[mine], design[mine] @ coefficients[i].T + intercepts[i])
    yield from sums.batches()


def predictions(rows: DataFrame, models: Models, key: str, with_train: bool = False) -> DataFrame:
    """``key, fold, side, y, yhat``: each row by the model fitted without its fold; with ``with_train`` also by all others.

    With several settings there is a column for each, ``yhat0`` and so on.
    """
    sent = rows.sparkSession.sparkContext.broadcast((models.folds, models.coefficients, models.intercepts))  # a row per fold
    names = ["yhat"] if models.coefficients.shape[1] == 1 else [f"yhat{g}" for g in range(models.coefficients.shape[1])]
    width, kind = models.coefficients.shape[2], rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias(key), "fold", "y", "features").mapInArrow(
        lambda batches: _predicted(batches, width, *sent.value, key, names, with_train),
        f"`{key}` {kind}, fold int, side string, y double, " + ", ".join(f"{name} double" for name in names))


def _predicted(batches, width, folds, coefficients, intercepts, key, names, with_train) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fold, design = _design(batch, width)
        y, keys = _labels(batch), batch.column(0)
        for i, f in enumerate(folds):
            for side in ("valid", "train") if with_train else ("valid",):
                mine = np.flatnonzero((fold == f) == (side == "valid"))
                if len(mine):
                    guess = design[mine] @ coefficients[i].T + intercepts[i]
                    yield pa.RecordBatch.from_arrays([
                        keys.take(pa.array(mine)), pa.array(np.full(len(mine), f), pa.int32()), pa.array([side] * len(mine)), pa.array(y[mine]),
                        *[pa.array(np.ascontiguousarray(guess[:, g])) for g in range(len(names))]], names=[key, "fold", "side", "y", *names])


class Elimination:
    """Least squares with an intercept on a shrinking set of columns, by the sweep operator on their cross-products.

    Swept columns are in the model: their block holds the inverse, their label entries the coefficients, the label's
    corner the residual sum of squares. Sweeping a column once more takes it out.
    """

    def __init__(self, total: np.ndarray):
        """``total``: cross-products of ``[1, features, label]``; raises ``ValueError`` if the columns depend on each other."""
        self.table, self.n = total.copy(), total[0, 0]
        size = np.diag(total).copy()
        centred = size - total[0] ** 2 / max(self.n, 1.0)
        for i in range(len(total) - 1):
            if self.table[i, i] <= 1e-10 * (size[i] if i == 0 else max(centred[i], 1e-300)):
                raise ValueError("no p-values: the columns depend on each other")
            self._sweep(i)
        self.columns = list(range(1, len(total) - 1))

    def _sweep(self, k: int) -> None:
        t, pivot = self.table, self.table[k, k]
        column = t[:, k].copy()
        t[k] = t[k] / pivot
        others = np.arange(len(t)) != k
        t[others] -= np.outer(column[others], t[k])
        t[others, k] = -column[others] / pivot
        t[k, k] = 1 / pivot

    def drop(self, column: int) -> None:
        """Take out a feature, counted from 0."""
        self._sweep(column + 1)
        self.columns.remove(column + 1)

    def p_values(self) -> dict[int, float]:
        """Two-sided p-value of each feature that is left, by Student's t."""
        free = self.n - len(self.columns) - 1
        if free <= 0:
            raise ValueError("no p-values: no degrees of freedom")
        variance = max(self.table[-1, -1], 0.0) / free
        out = {}
        for c in self.columns:
            error = (variance * self.table[c, c]) ** 0.5
            out[c - 1] = student_p(self.table[c, -1] / error, free) if error > 0 else 0.0
        return out


def student_p(t: float, free: float) -> float:
    """Two-sided tail of Student's t: the regularised incomplete beta function of ``free / 2`` and a half at ``free / (free + t^2)``."""
    square, a, b = t * t / free, free / 2, 0.5
    if square == 0.0:
        return 1.0
    x, rest = 1 / (1 + square), square / (1 + square)
    # Log of the ratio of gamma functions at a + 1/2 and a; for large a by its series, since their logarithms cancel.
    ratio = math.lgamma(a + b) - math.lgamma(a) if a < 1000 else 0.5 * math.log(a) - 1 / (8 * a) + 1 / (192 * a**3)
    front = math.exp(ratio - math.lgamma(b) - a * math.log1p(square) + b * math.log(rest))
    if x >= (a + 1) / (a + b + 2):  # the fraction converges fast on the other side
        return max(0.0, 1.0 - front * _beta_fraction(b, a, rest) / b)
    return front * _beta_fraction(a, b, x) / a


def _beta_fraction(a: float, b: float, x: float, rounds: int = 10_000) -> float:
    """Continued fraction of the incomplete beta function, by the modified method of Lentz."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0) or tiny)
    value = d
    for m in range(1, rounds):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + term * d or tiny)
            c = 1.0 + term / c or tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return value
