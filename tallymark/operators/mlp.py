"""Multi-layer perceptron regressor, trained data-parallel.

MLlib has a perceptron classifier only. Each epoch is one Spark job over the cached rows:
every shard starts from the same weights, runs Adam over its own mini-batches and hands on its
weights, which are averaged by rows in two levels. The number of shards follows the number of rows
(``shards_for``), and rows fall into shards by the hash of their key. Several networks (the points of
a grid) go through the same jobs, each batch of rows being read once for all of them.
Per-task memory is one Arrow batch and the networks; what the driver holds depends on the networks alone.
``sync="step"`` instead sums the exact full-batch gradient and takes one Adam step per job.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext, cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tallymark.operators.errors import SUMS, ErrorSums, metric_rows

# The functions below run in Python workers: send them with the tasks, so that executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Adam's usual constants and the stopping rule.
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8
PATIENCE, TOLERANCE = 20, 1e-4
SHARDS, SHARD_ROWS = 8, 500_000  # part of what defines the result, see ``shards_for``
ADDED_TOGETHER = 64              # shards whose weights one task of the first level adds up
PARAMETERS_TOGETHER = 2_000_000  # parameters of the networks that are trained in the same jobs
STEPPED_TOGETHER = 250_000       # numbers that networks of one shape hold a layer when they step as one stack
SEED = 42


def layer_shapes(width: int, hidden: list[int]) -> list[tuple[int, int]]:
    sizes = [width, *hidden, 1]
    return list(zip(sizes[:-1], sizes[1:]))


def parameter_count(shapes: list[tuple[int, int]]) -> int:
    return sum(a * b + b for a, b in shapes)


def unpack(flat: np.ndarray, shapes) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of the flat parameters, of one network or a row each, as one (weights, bias) pair per layer."""
    layers, at = [], 0
    for a, b in shapes:
        layers.append((flat[..., at : at + a * b].reshape(*flat.shape[:-1], a, b), flat[..., at + a * b : at + a * b + b]))
        at += a * b + b
    return layers


def initial_weights(shapes, seed: int = SEED) -> np.ndarray:
    """Glorot-uniform weights and biases."""
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in shapes:
        bound = math.sqrt(6.0 / (a + b))
        parts.append(rng.uniform(-bound, bound, a * b + b))
    return np.concatenate(parts)


def forward(flat: np.ndarray, shapes, x: np.ndarray) -> list[np.ndarray]:
    """Inputs of every layer, then the output."""
    outs = [x]
    layers = unpack(flat, shapes)
    for i, (w, b) in enumerate(layers):
        z = outs[-1] @ w
        z += b[..., None, :]
        outs.append(np.maximum(z, 0.0, out=z) if i < len(layers) - 1 else z)
    return outs


def gradient_sum(flat: np.ndarray, shapes, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float | np.ndarray]:
    """Summed gradient and summed loss of half the squared error; of several networks, a row each, a row and a loss each."""
    outs = forward(flat, shapes, x)
    delta = outs[-1] - y[:, None]
    loss = 0.5 * (delta**2).sum(axis=(-2, -1))
    grads = []
    layers = unpack(flat, shapes)
    for i in range(len(layers) - 1, -1, -1):
        product = np.swapaxes(outs[i], -1, -2) @ delta
        grads.append(np.concatenate([product.reshape(*product.shape[:-2], -1), delta.sum(axis=-2)], axis=-1))
        if i:
            delta = delta @ np.swapaxes(layers[i][0], -1, -2)
            delta *= outs[i] > 0
    return np.concatenate(grads[::-1], axis=-1), loss if flat.ndim > 1 else float(loss)


def weight_mask(shapes) -> np.ndarray:
    """1 for weights, 0 for biases: only weights are penalised."""
    return np.concatenate([np.r_[np.ones(a * b), np.zeros(b)] for a, b in shapes])


@dataclass
class Adam:
    m: np.ndarray
    v: np.ndarray
    t: int = 0

    def step(self, flat: np.ndarray, grad: np.ndarray, rate: float | np.ndarray) -> None:
        self.t += 1
        held = grad - self.m
        held *= 1 - BETA1
        self.m += held
        np.multiply(grad, grad, out=held)
        held -= self.v
        held *= 1 - BETA2
        self.v += held
        np.sqrt(self.v, out=held)
        held += EPSILON
        scaled = rate * math.sqrt(1 - BETA2**self.t) / (1 - BETA1**self.t)
        flat -= np.divide(scaled * self.m, held, out=held)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.empty((0, 0))


@dataclass
class MlpModel:
    """Trained network with the ``transform`` of an ML model."""

    flat: np.ndarray
    shapes: list
    n_iter: int
    loss: float
    valid_r2: float

    @property
    def parameters(self) -> int:
        return parameter_count(self.shapes)

    def transform(self, df: DataFrame) -> DataFrame:
        flat, shapes = self.flat, self.shapes

        @F.pandas_udf("double")
        def predict(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype="float64")
            return pd.Series(forward(flat, shapes, _matrix(features))[-1][:, 0])

        return df.withColumn("prediction", predict(vector_to_array("features")))


def shards_for(rows: int) -> int:
    """Shards that train side by side in an epoch: ``SHARDS``, and more where these would hold over ``SHARD_ROWS`` rows each."""
    return max(SHARDS, -(-rows // SHARD_ROWS))


@dataclass
class _Run:
    """One network in training."""

    q: dict
    shapes: list
    flat: np.ndarray
    adam: Adam
    best: np.ndarray
    best_score: float = -math.inf
    stale: int = 0
    log: list = field(default_factory=list)
    running: bool = True

    @staticmethod
    def of(params: dict, width: int) -> "_Run":
        q = {"hidden": [100], "learning_rate": 0.001, "alpha": 0.0001, "batch_size": "auto", "max_iter": 200,
             "patience": PATIENCE, "tol": TOLERANCE, "sync": "epoch", "early_stopping": True, **params}
        shapes = layer_shapes(width, list(q["hidden"]))
        flat, size = initial_weights(shapes), parameter_count(shapes)
        return _Run(q, shapes, flat, Adam(np.zeros(size), np.zeros(size)), flat.copy(), running=q["max_iter"] > 0)

    def scored(self, weights: np.ndarray, score: float | None) -> None:
        """Note the validation R2 of the weights that the last epoch left."""
        self.log[-1] = (*self.log[-1][:2], score)
        self.stale = 0 if score > self.best_score + self.q["tol"] else self.stale + 1
        if score > self.best_score:
            self.best, self.best_score = weights, score

    def after(self, epoch: int, sums: dict) -> None:
        """Take over what the shards have summed in an epoch."""
        before, score = self.flat, _r2(sums) if sums["s0"] else None
        if self.q["early_stopping"] and score is not None and epoch > 1:  # the score belongs to the weights before this epoch
            self.scored(before, score)
            if self.stale >= self.q["patience"]:
                self.running = False
                return
        n, w, m, v = sums["n"], *(np.array(sums[c]) for c in ("w", "m", "v"))
        if self.q["sync"] == "epoch":
            self.flat, self.adam, loss = w / n, Adam(m / n, v / n, int(sums["t"])), sums["loss"] / n
        else:
            mask, self.flat = weight_mask(self.shapes), before.copy()
            loss = (sums["loss"] + 0.5 * self.q["alpha"] * float((mask * before**2).sum())) / n
            self.adam.step(self.flat, (w + self.q["alpha"] * mask * before) / n, self.q["learning_rate"])
        self.log.append((epoch, loss, None))
        self.running = epoch < self.q["max_iter"]

    def model(self) -> MlpModel:
        best = self.flat if self.best_score == -math.inf else self.best
        return MlpModel(best, self.shapes, len(self.log), self.log[-1][1] if self.log else float("nan"), self.best_score)


def fit_mlp(rows: DataFrame, params: dict, width: int) -> tuple[MlpModel, list]:
    """Train on ``features, __y, __valid[, __place]``; returns the model and one log row per epoch.

    Stops when the validation R2 has not risen by the tolerance for ``patience`` epochs and
    keeps the weights of the best epoch.
    """
    return fit_mlps(rows, [params], width)[0]


def fit_mlps(rows: DataFrame, settings: list[dict], width: int) -> list[tuple[MlpModel, list]]:
    """Train a network for each setting, in the same jobs as long as their parameters are ``PARAMETERS_TOGETHER`` at most.

    ``__place``, a hash of the row key, deals rows to shards and orders them there; without it the row's values do.
    Either way the layout of the table changes nothing.
    """
    place = F.col("__place") if "__place" in rows.columns else F.xxhash64("x", "y", "v")
    kept = ["__place"] if "__place" in rows.columns else []
    data = rows.select(vector_to_array("features").alias("x"), F.col("__y").alias("y"), F.col("__valid").alias("v"), *kept)
    shards = max([q["shards"] for q in settings if "shards" in q] or [shards_for(rows.count())])
    data = data.withColumn("place", place).repartition(shards, "place").sortWithinPartitions("place", "y")
    data = data.select("x", "y", "v").persist()
    runs = [_Run.of(q, width) for q in settings]
    try:
        for together in _groups(runs):
            epoch = 0
            while any(r.running for r in together):
                epoch += 1
                live = [r for r in together if r.running]
                for at, sums in enumerate(_epoch(data, live, epoch, shards)):
                    live[at].after(epoch, sums)
            last = [r for r in together if r.q["early_stopping"] and r.log and len(r.log) == r.q["max_iter"]]
            for r, score in zip(last, _validation_scores(data, last)):  # of the weights after the last epoch
                if score is not None:
                    r.scored(r.flat, score)
    finally:
        data.unpersist()
    return [(r.model(), r.log) for r in runs]


def _groups(runs: list[_Run]) -> list[list[_Run]]:
    out, held = [], 0
    for r in runs:
        if not out or held + len(r.flat) > PARAMETERS_TOGETHER:
            out.append([])
            held = 0
        out[-1].append(r)
        held += len(r.flat)
    return out


def _validation_scores(data: DataFrame, runs: list[_Run]) -> list[float | None]:
    """R2 of each network on the validation rows, from one pass; null if there are none."""
    if not runs:
        return []
    networks = [(r.flat, r.shapes) for r in runs]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros((len(networks), 4))
        for x, y, _ in _batches(frames):
            for (flat, shapes), own in zip(networks, totals):
                e = forward(flat, shapes, x)[-1][:, 0] - y
                own += [len(y), (e**2).sum(), y.sum(), (y**2).sum()]
        yield pd.DataFrame({"run": range(len(networks)), **{f"s{i}": totals[:, i] for i in range(4)}})

    found = data.where("v").mapInPandas(work, "run int, s0 double, s1 double, s2 double, s3 double").groupBy("run").agg(
        *[F.sum(f"s{i}").alias(f"s{i}") for i in range(4)])
    sums = {r["run"]: r for r in found.collect()}  # a row per network
    return [_r2(sums[i]) if i in sums and sums[i]["s0"] else None for i in range(len(runs))]


def _r2(t) -> float:
    spread = t["s3"] - t["s2"] ** 2 / t["s0"]
    return 1 - t["s1"] / spread if spread > 0 else 0.0


# One output row per shard and network: w, m, v hold row-weighted sums (or w the gradient sum).
_SUMS = ("n", "loss", "s0", "s1", "s2", "s3")
_OUT = "run int, shard int, w array<double>, m array<double>, v array<double>, t int, " + ", ".join(f"{c} double" for c in _SUMS)


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for frame in frames:
        if len(frame):
            yield _matrix(frame["x"]), frame["y"].to_numpy(float), frame["v"].to_numpy(bool)


def _batch_size(run: _Run) -> int:
    return 200 if run.q["batch_size"] == "auto" else int(run.q["batch_size"])


def _stacks(runs: list[_Run]) -> list[list[int]]:
    """Numbers of the networks that step together: of one shape and batch size, as many as stay small; the others alone."""
    alike: dict[tuple, list[int]] = {}
    for i, r in enumerate(runs):
        alike.setdefault((tuple(r.shapes), _batch_size(r), r.adam.t) if r.q["sync"] == "epoch" else (i,), []).append(i)
    out = []
    for members in alike.values():
        r = runs[members[0]]
        many = max(1, STEPPED_TOGETHER // max(_batch_size(r) * max(b for _, b in r.shapes), len(r.flat)))
        out += [members[at : at + many] for at in range(0, len(members), many)]
    return out


class _Shard:
    """A shard's share of an epoch of networks of one shape and batch size, which take each step as one stack of matrices."""

    def __init__(self, runs: list[_Run], places: list[int], epoch: int):
        self.runs, self.places, self.shapes = runs, places, runs[0].shapes
        self.sync, self.batch = runs[0].q["sync"], _batch_size(runs[0])
        self.flat = np.stack([r.flat for r in runs])
        self.state = Adam(np.stack([r.adam.m for r in runs]), np.stack([r.adam.v for r in runs]), runs[0].adam.t)
        self.rng = np.random.default_rng(SEED + epoch)
        self.rate = np.array([[r.q["learning_rate"]] for r in runs], dtype=float)
        self.penalty = np.array([[r.q["alpha"]] for r in runs], dtype=float) * weight_mask(self.shapes)
        self.total, self.totals, self.n, self.loss = np.zeros_like(self.flat), np.zeros((len(runs), 4)), 0, np.zeros(len(runs))

    def validate(self, x: np.ndarray, y: np.ndarray) -> None:
        for run, totals in zip(self.runs, self.totals):
            e = forward(run.flat, self.shapes, x)[-1][:, 0] - y
            totals += [len(y), (e**2).sum(), y.sum(), (y**2).sum()]

    def train(self, x: np.ndarray, y: np.ndarray) -> None:
        if self.sync != "epoch":
            grad, part = gradient_sum(self.runs[0].flat, self.shapes, x, y)
            self.total, self.loss, self.n = self.total + grad, self.loss + part, self.n + len(y)
            return
        order = self.rng.permutation(len(y))
        for at in range(0, len(y), self.batch):
            pick = order[at : at + self.batch]
            grad, part = gradient_sum(self.flat, self.shapes, x[pick], y[pick])
            pull = self.penalty * self.flat
            grad += pull
            grad /= len(pick)
            pull *= self.flat
            self.loss += part + 0.5 * pull.sum(axis=1)
            self.state.step(self.flat, grad, self.rate)
            self.n += len(pick)

    def rows(self, shard: int) -> Iterator[dict]:
        epoch, none = self.sync == "epoch", np.zeros(0)
        for i, run in enumerate(self.places):
            w, m, v = (self.flat[i] * self.n, self.state.m[i] * self.n, self.state.v[i] * self.n) if epoch else (self.total[i], none, none)
            sums = dict(zip(_SUMS, (float(self.n), float(self.loss[i]), *map(float, self.totals[i]))))
            yield {"run": run, "shard": shard, "w": w, "m": m, "v": v, "t": self.state.t if epoch else 0, **sums}


def _epoch(data: DataFrame, runs: list[_Run], epoch: int, shards: int) -> list[dict]:
    """One job: every shard trains every network from where it stands; sums over all shards, a dict for each network."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [_Shard([runs[i] for i in together], together, epoch) for together in _stacks(runs)]
        for x, y, v in _batches(frames):
            for p in parts:
                if v.any():
                    p.validate(x[v], y[v])
                if (~v).any():
                    p.train(x[~v], y[~v])
        for p in parts:
            for row in p.rows(TaskContext.get().partitionId()):
                yield pd.DataFrame([row])

    found = data.mapInPandas(work, _OUT)
    if shards > ADDED_TOGETHER:
        found = found.groupBy("run", F.floor(F.col("shard") / ADDED_TOGETHER).alias("slot")).applyInPandas(_added, _OUT)
    sums = {r["run"]: r.asDict() for r in found.groupBy("run").applyInPandas(_added, _OUT).collect()}  # a row per network
    if any(not sums[i]["n"] for i in range(len(runs))):
        raise ValueError("no training rows")
    return [sums[i] for i in range(len(runs))]


def _added(parts: pd.DataFrame) -> pd.DataFrame:
    """Rows of one network added up, in the order of their shards."""
    parts = parts.sort_values("shard")
    out = {c: [parts[c].iloc[0]] for c in ("run", "shard")} | {c: [np.sum(np.stack(parts[c].to_numpy()), axis=0)] for c in ("w", "m", "v")}
    return pd.DataFrame(out | {"t": [parts["t"].max()]} | {c: [parts[c].sum()] for c in _SUMS})


def network_scores(
    rows: DataFrame, models: list[MlpModel], fold: int, side: str, centre: float, deviance: bool = True,
) -> list[tuple]:
    """Metrics of all networks over ``features, y`` in one pass: ``(side, fold, index, n, mse, mae, r2, deviance)``."""
    networks = [(m.flat, m.shapes) for m in models]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = ErrorSums(centre, deviance)
        for frame in frames:
            if len(frame):
                x = _matrix(frame["x"])
                sums.add(side, fold, frame["y"].to_numpy(float), np.column_stack([forward(f, s, x)[-1][:, 0] for f, s in networks]))
        for batch in sums.batches():
            yield batch.to_pandas()

    return metric_rows(rows.select(vector_to_array("features").alias("x"), F.col("y").cast("double").alias("y")).mapInPandas(work, SUMS), deviance)


def training_log(spark, log: list) -> DataFrame:
    return spark.createDataFrame(log, "epoch int, loss double, valid_r2 double")
