"""Boosted regression trees of a whole grid, grown side by side.

MLlib fits one ensemble at a time, with a few short jobs for each level of each tree. Trees see no more of a row than its
bins. Rows with the same bins are a cell, and where the cells are few (two numbers of 32 bins and two columns of five levels
make 25,600, however many rows there are) no job is needed for a level: rows are drawn into the bags of all rounds in one
pass, the bags are added up by cell and round, and a task grows its ensembles over the sums of a block of rounds.
Where the cells are many, all ensembles take a level in one job: every task walks its rows down the trees that
are being grown and sums counts, labels and squares by ensemble, node, feature and bin; the driver chooses the splits.
The method and every draw are those of MLlib's ``GBTRegressor`` (candidate splits from a sample, bags by partition, features
by node), so that an ensemble grown here is the one that MLlib would have fitted to the same partitions; tests compare the two.
"""

from __future__ import annotations

import math
import struct
import sys
import threading
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tallymark.operators.errors import SUMS, ErrorSums, metric_rows
from tallymark.session import staging_root

# Worker functions travel with their tasks: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of MLlib: rows that candidate splits are taken from, and the rounding step of a double.
SAMPLED, EPSILON = 10_000, 2.0 ** -52
COLUMNS = 255            # encoded columns up to which every row carries all its bins
NUMBERS = 4_000_000      # sums that a job hands on for each task at most
ROWS_TOGETHER = 65_536   # rows whose nodes a task holds at a time
ADDED_TOGETHER = 32      # partitions whose sums the driver adds up; more are added by tasks first
KEPT_ROUNDS = 10         # rounds after which the predictions are written to the checkpoint folder, as MLlib does
CELLS = 250_000          # cells up to which ensembles are grown over them
CODES = 4_000_000        # bins of all cells at most
GUESSES = 8_000_000      # predictions of all cells, at every length that is asked for, at most
BLOCK = 2_500_000        # cells times rounds whose sums reach a task that grows ensembles
TOGETHER = 16            # ensembles that a task grows
LANES = 4                # rows that draws are made for at once
STATE = "bins binary, y double, guess binary"
_MASK = (1 << 64) - 1
_BY_LEVELS = threading.Semaphore(2)  # sides grown level by level at once: each keeps predictions of all rows


@dataclass(frozen=True)
class Setting:
    """One ensemble."""

    trees: int
    rate: float
    depth: int


@dataclass
class Tree:
    """Nodes by heap number, the root is 1: a row goes left if its bin is at most ``cut``, or, ``turned``, if it is not."""

    feature: np.ndarray
    cut: np.ndarray
    turned: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(depth: int) -> Tree:
        size = 1 << depth + 1
        return Tree(np.full(size, -1), np.zeros(size, np.uint8), np.zeros(size, bool), np.zeros(size))

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after so many levels."""
        at, rows = np.ones(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            feature = self.feature[at]
            right = (bins[rows, feature] > self.cut[at]) != self.turned[at]
            at = np.where(feature >= 0, 2 * at + right, at)
        return at


@dataclass
class _Growing:
    """An ensemble under way: its trees, and of the last one the nodes that are to be split."""

    setting: Setting
    trees: list[Tree] = field(default_factory=list)
    draws: object = None
    waiting: list[int] = field(default_factory=list)  # a stack, its head first; all are of one level
    features: np.ndarray | None = None                # of each waiting node
    impurity: dict = field(default_factory=dict)      # as the parent's split has found it

    @property
    def weights(self) -> np.ndarray:
        return np.array([1.0] + [self.setting.rate] * (len(self.trees) - 1))


def supported(rows: DataFrame, params: list[dict]) -> bool:
    """Whether every ensemble can be grown here: few enough columns, none but numbers and flags, known options."""
    attributes = _attributes(rows)
    return (
        attributes is not None and all(_width(rows) <= COLUMNS and q.get("max_features", "sqrt") in ("sqrt", "all") and 1 <= q.get("max_depth", 3) <= 8
            and 2 <= q.get("max_bins", 32) <= 100 and 0 < q.get("subsample", 0.8) < 1 for q in params)
        and len({(q.get("max_features", "sqrt"), q.get("max_bins", 32), q.get("subsample", 0.8)) for q in params}) == 1)


def _attributes(rows: DataFrame) -> dict | None:
    found = rows.schema["features"].metadata.get("ml_attr", {}).get("attrs")
    return found if found and set(found) <= {"numeric", "binary"} else None


def _width(rows: DataFrame) -> int:
    return sum(map(len, _attributes(rows).values()))


# --- MLlib's draws ----------------------------------------------------------

class _Shift:
    """Spark's generator of uniform numbers."""

    def __init__(self, seed: int):
        data = struct.pack(">q", seed)
        low = _murmur(data, 0x3C074A61)
        self.state = _murmur(data, low) << 32 | low

    def bits(self, n: int) -> int:
        x = self.state
        x ^= x << 21 & _MASK
        x ^= x >> 35
        x ^= x << 4 & _MASK
        self.state = x
        return x & (1 << n) - 1

    def uniform(self) -> float:
        return ((self.bits(26) << 27) + self.bits(27)) * 2.0 ** -53


def _murmur(data: bytes, seed: int) -> int:
    turn = lambda x, r: (x << r | x >> 32 - r) & 0xFFFFFFFF
    h = seed
    for (k,) in struct.iter_unpack("<I", data):
        h = turn(h ^ turn(k * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF, 13) * 5 + 0xE6546B64 & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


class _Bags:
    """Spark's draws for many seeds, row by row: which of the bags a row is in. The rows of a batch are drawn in ``LANES`` at a time."""

    def __init__(self, seeds: list[int], share: float):
        self.state = np.array([_Shift(s).state for s in seeds], np.uint64)
        self.below = np.uint64(math.ceil(share * 2.0 ** 53))
        self.jumps: dict[int, np.ndarray] = {}

    def draw(self, rows: int) -> np.ndarray:
        """A bit for each bag, ``(rows, bytes)``."""
        out, most = [], 1024
        for at in range(0, rows, most):
            here = min(most, rows - at)
            out += [self._drawn(lanes, n) for lanes, n in ((LANES, here // LANES), (1, here % LANES)) if n]
        return np.concatenate([np.zeros((0, -(-len(self.state) // 8)), np.uint8), *out])

    def _drawn(self, lanes: int, rows: int) -> np.ndarray:
        states = [self.state]
        for _ in range(lanes - 1):
            states.append(_apply(self._jump(rows), states[-1]))
        x, found = np.stack(states), np.empty((lanes, rows, len(self.state)), bool)
        spare, value = np.empty_like(x), np.empty_like(x)
        for row in range(rows):
            _step(x, spare)
            np.left_shift(np.bitwise_and(x, _LOW_26, out=value), _27, out=value)
            _step(x, spare)
            np.bitwise_or(value, np.bitwise_and(x, _LOW_27, out=spare), out=value)
            np.less(value, self.below, out=found[:, row])
        self.state = x[-1].copy()
        return np.packbits(found.reshape(lanes * rows, -1), axis=1)

    def _jump(self, rows: int) -> np.ndarray:
        """What so many rows make of each bit of a state: the step is linear in the bits."""
        if rows not in self.jumps:
            power, total = np.uint64(1) << np.arange(64, dtype=np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)
            spare = np.empty_like(power)
            for _ in range(2):
                _step(power, spare)
            left = rows
            while left:
                if left & 1:
                    total = _apply(power, total)
                power, left = _apply(power, power), left >> 1
            self.jumps[rows] = total
        return self.jumps[rows]


_21, _35, _4, _27, _LOW_26, _LOW_27 = map(np.uint64, (21, 35, 4, 27, (1 << 26) - 1, (1 << 27) - 1))


def _step(x: np.ndarray, spare: np.ndarray) -> None:
    np.bitwise_xor(x, np.left_shift(x, _21, out=spare), out=x)
    np.bitwise_xor(x, np.right_shift(x, _35, out=spare), out=x)
    np.bitwise_xor(x, np.left_shift(x, _4, out=spare), out=x)


def _apply(images: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for bit in range(64):
        out ^= (x >> np.uint64(bit) & np.uint64(1)) * images[bit]
    return out


class _Congruent:
    """Java's generator, for the seeds of the feature draws."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & (1 << 48) - 1

    def _next(self) -> int:
        self.state = self.state * 0x5DEECE66D + 0xB & (1 << 48) - 1
        value = self.state >> 16
        return value - (1 << 32) if value >> 31 else value

    def long(self) -> int:
        value = (self._next() << 32) + self._next() & _MASK
        return value - (1 << 64) if value >> 63 else value


def _drawn_features(width: int, wanted: int, seed: int) -> list[int]:
    """A reservoir sample of the features."""
    kept, draws = list(range(wanted)), _Shift(seed)
    for i in range(wanted, width):
        at = int(draws.uniform() * (i + 1))
        if at < wanted:
            kept[at] = i
    return kept


# --- candidate splits -------------------------------------------------------

def candidate_splits(rows: DataFrame, n: int, max_bins: int, seed: int) -> list[np.ndarray | None]:
    """Thresholds of each feature, from a sample of the rows; null for a flag."""
    flags = {a["idx"] for a in _attributes(rows).get("binary", [])}
    wanted = max(max_bins * max_bins, SAMPLED)
    share = wanted / n if wanted < n else 1.0
    sample = rows.select("features")
    if share < 1:
        bits = _Shift(seed).bits(32)
        sample = _of_rows(sample, sample._jdf.javaRDD().sample(False, share, bits - (1 << 32) if bits >> 31 else bits))
    table = sample.select(vector_to_array("features").alias("x")).toArrow()  # about SAMPLED rows
    x = table.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, _width(rows))
    return [None if i in flags else _thresholds(x[:, i], share * n, min(max_bins, n) - 1) for i in range(_width(rows))]


def _of_rows(df: DataFrame, rows) -> DataFrame:
    """``rows``, a Java RDD of rows of ``df``, as a table whose plan begins there: plans do not grow with the rounds."""
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(rows, df._jdf.schema()), spark)


def _thresholds(x: np.ndarray, expected: float, most: int) -> np.ndarray:
    """Cuts between values so that about as many rows lie between any two; zeros make up for rows the sample is short of."""
    values, counts = np.unique(x[x != 0], return_counts=True)
    if not values.size:
        return np.zeros(0)
    counts, zeros = counts.astype(float), expected - counts.sum()
    if zeros > EPSILON * counts.sum() * 100:
        at = np.searchsorted(values, 0.0)
        values, counts = np.insert(values, at, 0.0), np.insert(counts, at, zeros)
    middle = (values[:-1] + values[1:]) / 2
    if middle.size <= most:
        return middle
    stride = expected / (most + 1)
    out, seen, target = [], counts[0], stride
    for i in range(1, values.size):
        before, seen = seen, seen + counts[i]
        if abs(before - target) < abs(seen - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


def _binned(x: np.ndarray, splits: list[np.ndarray | None]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for i, cuts in enumerate(splits):
        out[:, i] = x[:, i] if cuts is None else np.searchsorted(cuts, x[:, i])
    return out


# --- growing ----------------------------------------------------------------

def grow(rows: DataFrame, settings: list[Setting], params: dict, seed: int) -> tuple[list[list[Tree]], list[np.ndarray | None]]:
    """Trees of all ensembles over ``features, __y``, cached and in fixed partitions, and the features' thresholds."""
    plan = _planned(rows, params, seed)
    cells = _cells(rows, [], plan, len(settings))
    if cells is None:
        return _grown_by_levels(rows, settings, plan), plan.splits
    return _grown_over_cells(rows, cells, settings, [[] for _ in settings], plan, True)[0], plan.splits


def grown_scores(
    rows: DataFrame, sides: list[tuple[str, DataFrame]], settings: list[Setting], lengths: list[list[int]], params: dict, seed: int,
    fold: int, centre: float, deviance: bool = True,
) -> list[tuple]:
    """Ensembles grown over ``rows``, and the metrics of each at its lengths over every side's ``features, y``; see ``scores``."""
    plan = _planned(rows, params, seed)
    cells = _cells(rows, [r for _, r in sides], plan, max(len(settings), sum(map(len, lengths))))
    if cells is None:
        grown = _grown_by_levels(rows, settings, plan)
        return sum([scores(r, grown, settings, lengths, plan.splits, fold, side, centre, deviance) for side, r in sides], [])
    guesses = _grown_over_cells(rows, cells, settings, lengths, plan, False)[1]
    return sum([_cell_scores(r, cells, guesses, plan.splits, fold, side, centre, deviance) for side, r in sides], [])


@dataclass(frozen=True)
class _Plan:
    """What all ensembles of a training side share."""

    splits: list[np.ndarray | None]
    wanted: int  # features that a node draws
    bins: int    # of any feature at most
    share: float
    seed: int

    @property
    def many(self) -> np.ndarray:
        """Candidate splits of each feature."""
        return np.array([1 if c is None else c.size for c in self.splits])

    @property
    def flags(self) -> np.ndarray:
        return np.array([c is None for c in self.splits])


def _planned(rows: DataFrame, params: dict, seed: int) -> _Plan:
    staging_root(rows.sparkSession)  # sees to a folder for checkpoints
    n, max_bins, width = rows.count(), params.get("max_bins", 32), _width(rows)
    if not n:
        raise ValueError("no training rows")
    splits = candidate_splits(rows, n, max_bins, seed)
    wanted = math.ceil(math.sqrt(width)) if params.get("max_features", "sqrt") == "sqrt" else width
    bins = max(2, *(c.size + 1 for c in splits if c is not None), 2)
    return _Plan(splits, wanted, bins, params.get("subsample", 0.8), seed)


def _grown_by_levels(rows: DataFrame, settings: list[Setting], plan: _Plan) -> list[list[Tree]]:
    most = max(1, NUMBERS // ((1 << max(s.depth for s in settings)) * plan.wanted * plan.bins * 3))
    out = []
    with _BY_LEVELS:
        for at in range(0, len(settings), most):
            out += _grown(rows, [_Growing(s) for s in settings[at:at + most]], plan)
    return out


def _grown(rows: DataFrame, ensembles: list[_Growing], plan: _Plan) -> list[list[Tree]]:
    splits, wanted, bins, share, seed = plan.splits, plan.wanted, plan.bins, plan.share, plan.seed
    width, state, parts = len(splits), None, rows.rdd.getNumPartitions()
    for m in range(max(e.setting.trees for e in ensembles)):
        before = state
        state = _advanced(rows if m == 0 else before, ensembles, splits, m)
        if m and m % KEPT_ROUNDS == 0:
            state = state.checkpoint()
        state = _of_rows(state, state._jdf.javaRDD()).persist()
        bagged = state.where(F.rand(seed + m + 1) < share)  # MLlib's draw: the same generator, partition by partition
        growing = [e for e in ensembles if m < e.setting.trees]
        for e in growing:
            e.trees.append(Tree.of(e.setting.depth))
            e.draws, e.waiting, e.impurity = _Congruent(seed + m), [1], {}
        for level in range(max(e.setting.depth for e in growing)):
            active = [e for e in growing if e.waiting]
            if not active:
                break
            for e in active:
                e.features = np.array([
                    _drawn_features(width, wanted, e.draws.long()) if wanted < width else list(range(width)) for _ in e.waiting])
            found = _sums(bagged, ensembles, active, level, width, bins, m, parts)
            for e, sums in zip(active, found):
                best = _best(sums.transpose(1, 2, 0, 3), e.features, np.array([e.impurity.get(x, math.nan) for x in e.waiting]), plan)
                e.waiting = [child for at, node in reversed(list(enumerate(e.waiting))) for child in _split(e, node, best, at, level)]
        if before is not None:
            before.unpersist()
    if state is not None:
        state.unpersist()
    return [e.trees for e in ensembles]


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    """Binary values of one length as the rows of a matrix."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].view(dtype).reshape(len(column), width)


def _packed(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    matrix = np.ascontiguousarray(matrix)
    return pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(matrix.strides[0]), len(matrix), [None, pa.py_buffer(matrix)]).cast(pa.binary())


def _advanced(rows: DataFrame, ensembles: list[_Growing], splits, m: int) -> DataFrame:
    """Rows with their bins and each ensemble's prediction by its trees so far."""
    count = len(ensembles)
    if m == 0:
        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(splits))
                if not np.isfinite(batch.column(1).to_numpy(zero_copy_only=False)).all() or np.isnan(x).any():  # null becomes NaN
                    raise ValueError("labels have to be present and finite, features numbers")
                yield pa.RecordBatch.from_arrays(
                    [_packed(_binned(x, splits)), batch.column(1), _packed(np.zeros((len(x), count)))], ["bins", "y", "guess"])

        return rows.select(vector_to_array("features").alias("x"), "__y").mapInArrow(first, STATE)
    last = [(i, e.trees[m - 1], e.weights[-1], e.setting.depth) for i, e in enumerate(ensembles) if len(e.trees) == m]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins, guess = _matrix(batch.column(0), np.uint8, len(splits)), _matrix(batch.column(2), np.float64, count).copy()
                for i, tree, weight, depth in last:
                    guess[:, i] += weight * tree.value[tree.nodes(bins, depth)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _packed(guess)], ["bins", "y", "guess"])

    return rows.mapInArrow(run, STATE)


def _sums(bagged: DataFrame, ensembles: list[_Growing], active: list[_Growing], level: int, width: int, bins: int, m: int,
          parts: int) -> list[np.ndarray]:
    """Of each active ensemble the count, sum and squares of the labels by waiting node, drawn feature and bin."""
    count = len(ensembles)
    places = {id(e): i for i, e in enumerate(ensembles)}
    work = []
    for e in active:
        slot = np.full(1 << e.setting.depth + 1, -1)
        slot[e.waiting] = np.arange(len(e.waiting))
        work.append((places[id(e)], e.trees[-1], slot, e.features))
    sizes = [f.size * bins for *_, f in work]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((3, size)) for size in sizes]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_TOGETHER):
                part = batch.slice(at, ROWS_TOGETHER)
                own, guess = _matrix(part.column(0), np.uint8, width), _matrix(part.column(2), np.float64, count)
                y = part.column(1).to_numpy(zero_copy_only=False)
                for sums, (i, tree, slot, features) in zip(total, work):
                    label = 2 * (y - guess[:, i]) if m else y  # from the second tree on what squared error leaves to learn
                    node = slot[tree.nodes(own, level)]
                    here = np.flatnonzero(node >= 0)
                    drawn = features.shape[1]
                    key = (node[here, None] * drawn + np.arange(drawn)) * bins + own[here[:, None], features[node[here]]]
                    label = np.repeat(label[here], drawn)
                    for s, weights in zip(sums, (None, label, label * label)):
                        s += np.bincount(key.ravel(), weights=weights, minlength=s.size)
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([np.concatenate([t.ravel() for t in total]).tobytes()], pa.binary())],
            ["task", "sums"])

    found = bagged.mapInArrow(run, "task int, sums binary")
    if parts > ADDED_TOGETHER:
        slots = found.withColumn("slot", F.floor(F.col("task") / ADDED_TOGETHER))
        found = slots.groupBy("slot").applyInArrow(_added, "task int, sums binary")
    total = sum(np.frombuffer(r["sums"]) for r in sorted(found.collect(), key=lambda r: r["task"]))  # numbers by node, feature and bin
    ends = np.cumsum([3 * size for size in sizes])[:-1]
    return [s.reshape(3, *f.shape, bins) for s, (*_, f) in zip(np.split(total, ends), work)]


def _added(rows: pa.Table) -> pa.Table:
    total = 0.0
    rows = rows.sort_by("task")
    for part in rows.column("sums"):
        total = total + np.frombuffer(part.as_buffer())
    return pa.table({"task": rows.column("task")[:1], "sums": pa.array([total.tobytes()], pa.binary())})


def _variance(stats: np.ndarray) -> np.ndarray:
    """Of ``(count, sum, squares)``; 0 without rows."""
    n, s, q = stats
    safe = np.where(n > 0, n, 1.0)
    return np.where(n > 0, (q - s * s / safe) / safe, 0.0)


def _best(stats: np.ndarray, features: np.ndarray, known: np.ndarray, plan: _Plan) -> list[np.ndarray]:
    """The best split of each node from ``(nodes, drawn, 3, bins)``; ``known`` are impurities that the parents' splits have found.

    By node: gain, feature, cut, whether turned, ``(count, sum, squares)`` of the left, the right and all rows, impurity of both sides.
    """
    many, flags = plan.many[features], plan.flags[features]
    n, s = stats[:, :, 0, :2], stats[:, :, 1, :2]
    centre = np.where(n > 0, s / np.where(n > 0, n, 1.0), math.inf)
    turned = flags & (centre[..., 1] < centre[..., 0])
    stats = stats.copy()
    stats[turned, :, :2] = stats[turned][:, :, 1::-1]
    left = np.cumsum(stats, axis=3)
    whole, left = left[..., -1:], left[..., :-1]
    right = whole - left
    parts = [np.moveaxis(x, 2, 0) for x in (left, right, whole)]
    low, high, own = map(_variance, parts)
    impurity = np.where(np.isnan(known)[:, None, None], own, known[:, None, None])
    (under, *_), (over, *_), (count, *_) = parts
    count = np.maximum(count, 1.0)
    gain = impurity - under / count * low - over / count * high
    valid = (np.arange(gain.shape[2]) < many[..., None]) & (under >= 1) & (over >= 1) & (gain >= 0)
    gain = np.where(valid, gain, -math.inf)
    nodes = np.arange(len(gain))
    place, at = np.divmod(gain.reshape(len(gain), -1).argmax(axis=1), gain.shape[2])
    return [gain[nodes, place, at], features[nodes, place], at, turned[nodes, place], left[nodes, place, :, at],
            right[nodes, place, :, at], whole[nodes, place, :, 0], low[nodes, place, at], high[nodes, place, at]]


def _split(e: _Growing, node: int, best: list[np.ndarray], at: int, level: int) -> list[int]:
    """Splits a waiting node of an ensemble, the ``at``-th of ``best``: children that can be split in turn, as they will wait."""
    gain, feature, cut, turned, left, right, whole, low, high = [x[at] for x in best]
    tree, waiting = e.trees[-1], []
    if level == 0:
        tree.value[node] = whole[1] / max(whole[0], 1.0)
    if gain <= 0:
        return waiting
    tree.feature[node], tree.cut[node], tree.turned[node] = feature, cut, turned
    for child, stats, impurity in ((2 * node, left, low), (2 * node + 1, right, high)):
        tree.value[child] = stats[1] / stats[0]
        e.impurity[child] = float(impurity)
        if level + 1 < e.setting.depth and abs(impurity) >= EPSILON:
            waiting.insert(0, child)
    return waiting


# --- growing over cells -----------------------------------------------------

@dataclass(frozen=True)
class _Cells:
    """Distinct bins of all rows, with the training rows of each and a number close to the mean of their labels."""

    bins: np.ndarray
    n: np.ndarray
    centre: np.ndarray


def _cells(rows: DataFrame, others: list[DataFrame], plan: _Plan, predictions: int) -> _Cells | None:
    """The cells of the training rows and of ``others``; nothing if they are too many."""
    width = len(plan.splits)
    most = min(CELLS, CODES // width, GUESSES // max(1, predictions))
    tables = []
    for df, label in [(rows, "__y"), *[(r, None) for r in others]]:
        found = _distinct(df, label, plan.splits, most)
        if found is None:
            return None
        tables.append(found)
    table = pa.concat_tables(tables).group_by("bins").aggregate([("n", "sum"), ("total", "sum")]).sort_by("bins")
    if table.num_rows > most:
        return None
    table = table.take(np.random.default_rng(0).permutation(table.num_rows))  # sums over bins are slow where one bin follows another
    n, total = table.column("n_sum").to_numpy(), table.column("total_sum").to_numpy()
    centre = (total / np.maximum(n, 1)).astype(np.float32).astype(np.float64)  # few digits: labels less this are exact
    return _Cells(_matrix(table.column("bins").combine_chunks(), np.uint8, width).copy(), n, centre)


def _distinct(rows: DataFrame, label: str | None, splits, most: int) -> pa.Table | None:
    """Distinct bins with their rows and sum of labels, no rows and 0 without a label; nothing if there are more than ``most``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if held is not None and held.num_rows > most:
                continue  # enough is known
            x, y = _read(batch, splits, label is not None)
            found = pa.table({"bins": _packed(_binned(x, splits)), "n": np.full(len(x), int(label is not None)), "total": y})
            parts = [found] if held is None else [held, found]
            held = pa.concat_tables(parts).group_by("bins").aggregate([("n", "sum"), ("total", "sum")]).rename_columns(["bins", "n", "total"])
        yield from [] if held is None else held.to_batches(max_chunksize=10_000)

    y = F.lit(0.0).alias("y") if label is None else F.col(label).cast("double").alias("y")
    found = rows.select(vector_to_array("features").alias("x"), y).mapInArrow(run, "bins binary, n long, total double")
    out = found.groupBy("bins").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).limit(most + 1).toArrow()
    return None if out.num_rows > most else out


def _read(batch: pa.RecordBatch, splits, checked: bool) -> tuple[np.ndarray, np.ndarray]:
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(splits))
    y = batch.column(1).to_numpy(zero_copy_only=False)
    if checked and (not np.isfinite(y).all() or np.isnan(x).any()):  # null becomes NaN
        raise ValueError("labels have to be present and finite, features numbers")
    return x, y


def _numbers(x: np.ndarray, splits, known: pa.Array) -> np.ndarray:
    """The cell of each row."""
    return pc.index_in(_packed(_binned(x, splits)), value_set=known).to_numpy(zero_copy_only=False)


def _dealt(rows: DataFrame, sent, plan: _Plan, rounds: int, parts: int) -> DataFrame:
    """Rows by cell, with the bags that they are in; a cell of more rows than a task's share goes to several tasks."""
    splits, share, seed = plan.splits, plan.share, plan.seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, (bins, centre, spans) = TaskContext.get().partitionId(), 0, sent.value
        bags, known = _Bags([seed + m + 1 + task for m in range(rounds)], share), _packed(bins)
        for batch in batches:
            x, y = _read(batch, splits, True)
            cell = _numbers(x, splits, known)
            place = seen + np.arange(len(x))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int32()), pa.array(place % spans[cell]), pa.array((task << 40) + place), pa.array(y - centre[cell]),
                 _packed(bags.draw(len(x)))], ["cell", "salt", "place", "y", "bags"])
            seen += len(x)

    drawn = rows.select(vector_to_array("features").alias("x"), "__y").mapInArrow(
        run, "cell int, salt long, place long, y double, bags binary")
    return drawn.repartition(parts, "cell", "salt").sortWithinPartitions("cell", "place").select("cell", "y", "bags").persist()


def _bag_sums(dealt: DataFrame, first: int, last: int, groups: int) -> DataFrame:
    """Of a block of rounds the count, sum and squares of the labels by round and cell, less the cell's centre."""
    at, width = first // 8, -(-last // 8) - first // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2), np.uint8, width)) for b in batches if b.num_rows]
        if not parts:
            return
        cell, y, bags = map(np.concatenate, zip(*parts))
        cells, local = np.unique(cell, return_inverse=True)
        task, named = TaskContext.get().partitionId(), cells.astype(np.int32).tobytes()
        starts, powers = np.flatnonzero(np.diff(local, prepend=-1)), np.stack([np.ones(len(y)), y, y * y])  # rows come by cell
        for m in range(first, last):
            drawn = ((bags[:, (m - first) // 8] >> (7 - m % 8)) & 1).astype(np.float64)
            if len(y) > 16 * len(cells):  # whichever is faster
                sums = np.add.reduceat(powers * drawn, starts, axis=1).tobytes()
            else:
                sums = np.stack([np.bincount(local, p * drawn, len(cells)) for p in powers]).tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(groups), pa.int32()), pa.array([m] * groups, pa.int32()), pa.array([task] * groups, pa.int32()),
                 pa.array([named] * groups, pa.binary()), pa.array([sums] * groups, pa.binary())], ["part", "round", "task", "cells", "sums"])

    part = F.substring("bags", at + 1, width).alias("bags")
    return dealt.select("cell", "y", part).mapInArrow(run, "part int, round int, task int, cells binary, sums binary")


def _grown_over_cells(rows: DataFrame, cells: _Cells, settings: list[Setting], lengths: list[list[int]], plan: _Plan,
                      kept: bool) -> tuple[list[list[Tree]], np.ndarray]:
    """Trees of all ensembles, if they are to be ``kept``, and predictions for the cells by ensemble and length, ``(cells, all lengths)``."""
    context, parts = rows.sparkSession.sparkContext, rows.rdd.getNumPartitions()
    rounds, count = max(s.trees for s in settings), len(cells.n)
    step = max(8, BLOCK // count // 8 * 8)
    deepest = sorted(range(len(settings)), key=lambda i: -settings[i].depth)
    groups = [deepest[at::-(-len(settings) // TOGETHER)] for at in range(-(-len(settings) // TOGETHER))]
    trees, guesses = [[] for _ in settings], np.zeros((len(settings), count))
    held = {(i, 0): guesses[i] for i in range(len(settings))}
    spans = np.maximum(1, -(-cells.n * parts // max(1, int(cells.n.sum()))))
    sent = context.broadcast((cells.bins, cells.centre, spans))
    dealt = _dealt(rows, sent, plan, rounds, parts)
    try:
        for first in range(0, rounds, step):
            last = min(first + step, rounds)
            state = context.broadcast(guesses)
            sums = _bag_sums(dealt, first, last, len(groups))
            grown = sums.groupBy("part").applyInArrow(
                _grower(sent, state, groups, settings, lengths, plan, first, last, kept), "kind string, ensemble int, trees int, data binary")
            guesses = guesses.copy()
            for r in grown.collect():  # predictions for the cells, and the trees if they are kept
                if r["kind"] == "trees":
                    trees[r["ensemble"]] += _unpacked(r["data"], settings[r["ensemble"]].depth)
                else:
                    held[r["ensemble"], r["trees"]] = guesses[r["ensemble"]] = np.frombuffer(r["data"])
            for i, s in enumerate(settings):
                guesses[i] = held[i, min(last, s.trees)]
            state.destroy()
    finally:
        dealt.unpersist()
        sent.destroy()
    return trees, np.column_stack([held[i, n] for i, own in enumerate(lengths) for n in own] or [np.zeros(count)])


def _grower(sent, state, groups, settings, lengths, plan: _Plan, first: int, last: int, kept: bool):
    """Grows the ensembles of a part by a block of rounds."""
    def run(table: pa.Table) -> pa.Table:
        (bins, centre, _), members = sent.value, groups[table.column("part")[0].as_py()]
        codes = [np.ascontiguousarray(c, np.float64 if flag else np.intp) for c, flag in zip(bins.T, plan.flags)]
        ensembles, guesses = [_Growing(settings[i]) for i in members], [state.value[i].copy() for i in members]
        places = {m: [] for m in range(first, last)}
        table = table.sort_by("task")
        for at, m in enumerate(table.column("round").to_pylist()):
            places[m].append(at)
        cells, sums, out = table.column("cells"), table.column("sums"), []
        for m in range(first, last):
            total = np.zeros((3, len(bins)))
            for at in places[m]:
                total[:, np.frombuffer(cells[at].as_buffer(), np.int32)] += np.frombuffer(sums[at].as_buffer()).reshape(3, -1)
            growing = [(e, g) for e, g in zip(ensembles, guesses) if m < e.setting.trees]
            if not growing:
                break
            _round(growing, codes, total, centre, m, plan)
            for i, e, g in zip(members, ensembles, guesses):
                if m < e.setting.trees and (m + 1 in lengths[i] or m + 1 == min(last, e.setting.trees)):
                    out.append(("guess", i, m + 1, g.tobytes()))
        if kept:
            out += [("trees", i, len(e.trees), _packed_trees(e.trees)) for i, e in zip(members, ensembles)]
        return pa.table({
            "kind": pa.array([k for k, *_ in out], pa.string()), "ensemble": pa.array([i for _, i, *_ in out], pa.int32()),
            "trees": pa.array([n for *_, n, _ in out], pa.int32()), "data": pa.array([d for *_, d in out], pa.binary())})

    return run


def _round(growing: list[tuple[_Growing, np.ndarray]], codes: list[np.ndarray], sums: np.ndarray, centre: np.ndarray, m: int, plan: _Plan) -> None:
    """One more tree of every ensemble, added to its predictions for the cells."""
    width, drawn, factor = len(codes), [], 2.0 if m else 1.0  # from the second tree on what squared error leaves to learn
    draws, (n, first, second) = _Congruent(plan.seed + m), sums
    weights, held, taken = [], [], [0] * len(growing)
    for e, guess in growing:
        off = guess - centre
        shift = n * off
        weights.append(np.stack([n, factor * (first - shift), factor * factor * (second - off * (2 * first - shift))]))
        e.trees.append(Tree.of(e.setting.depth))
        e.waiting, e.impurity = [1], {}
        held.append({1: None})  # all cells
    for level in range(max(e.setting.depth for e, _ in growing)):
        work = [(i, e, node) for i, (e, _) in enumerate(growing) for node in e.waiting]
        if not work:
            break
        features = []
        for i, *_ in work:
            if taken[i] == len(drawn):  # every ensemble draws the same
                drawn.append(_drawn_features(width, plan.wanted, draws.long()) if plan.wanted < width else list(range(width)))
            features.append(drawn[taken[i]])
            taken[i] += 1
        stats = np.empty((len(work), plan.wanted, 3, plan.bins))
        for slot, (i, _, node) in enumerate(work):
            at = held[i][node]
            own = weights[i] if at is None else np.stack([w[at] for w in weights[i]])
            whole = own.sum(axis=1)
            for place, f in enumerate(features[slot]):
                code = codes[f] if at is None else codes[f][at]
                if code.dtype == np.float64:
                    stats[slot, place] = 0.0
                    stats[slot, place, :, 1] = own @ code
                    stats[slot, place, :, 0] = whole - stats[slot, place, :, 1]
                else:
                    for k in range(3):
                        stats[slot, place, k] = np.bincount(code, own[k], plan.bins)
        best = _best(stats, np.array(features), np.array([e.impurity.get(node, math.nan) for _, e, node in work]), plan)
        children: list[list[int]] = [[] for _ in growing]
        for slot, (i, e, node) in enumerate(work):
            children[i] = _split(e, node, best, slot, level) + children[i]
            tree, at = e.trees[-1], held[i][node]
            f = tree.feature[node]
            if f >= 0:
                code = codes[f] if at is None else codes[f][at]
                right = (code > tree.cut[node]) != tree.turned[node]
                for child, side in ((2 * node, ~right), (2 * node + 1, right)):
                    held[i][child] = np.flatnonzero(side) if at is None else at[side]
                del held[i][node]
        for (e, _), waiting in zip(growing, children):
            e.waiting = waiting
    for (e, guess), leaves in zip(growing, held):
        weight = e.setting.rate if m else 1.0
        for node, at in leaves.items():
            guess[slice(None) if at is None else at] += weight * e.trees[-1].value[node]


def _packed_trees(trees: list[Tree]) -> bytes:
    fields = [np.stack([getattr(t, c) for t in trees]).astype(np.float64) for c in ("feature", "cut", "turned", "value")] if trees else []
    return b"".join(f.tobytes() for f in fields)


def _unpacked(data: bytes, depth: int) -> list[Tree]:
    feature, cut, turned, value = np.frombuffer(data).reshape(4, -1, 1 << depth + 1)
    return [Tree(f.astype(int), c.astype(np.uint8), t.astype(bool), v) for f, c, t, v in zip(feature, cut, turned, value)]


# --- scoring ----------------------------------------------------------------

def scores(rows: DataFrame, grown: list[list[Tree]], settings: list[Setting], lengths: list[list[int]], splits,
           fold: int, side: str, centre: float, deviance: bool = True) -> list[tuple]:
    """Metrics of the first trees of every ensemble over ``features, y`` in one pass: ``(side, fold, index, n, mse, mae,
    r2, deviance)``, the index counting the lengths of the first ensemble, then of the next."""
    sent = rows.sparkSession.sparkContext.broadcast((grown, settings, lengths, splits))  # the ensembles alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown, settings, lengths, splits = sent.value
        sums = ErrorSums(centre, deviance)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                bins = _binned(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1), splits)
                guesses = [g for e in zip(grown, settings, lengths) for g in _guesses(bins, *e)]
                sums.add(side, fold, part.column(0).to_numpy(zero_copy_only=False), np.column_stack(guesses))
        yield from sums.batches()

    try:
        data = rows.select(F.col("y").cast("double").alias("y"), vector_to_array("features").alias("x"))
        return metric_rows(data.mapInArrow(run, SUMS), deviance)
    finally:
        sent.destroy()


def _cell_scores(rows: DataFrame, cells: _Cells, guesses: np.ndarray, splits, fold: int, side: str, centre: float, deviance: bool) -> list[tuple]:
    """As ``scores``, from the predictions for the cells."""
    sent = rows.sparkSession.sparkContext.broadcast((cells.bins, guesses))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, guesses = sent.value
        known, sums = _packed(bins), ErrorSums(centre, deviance)
        for batch in batches:
            if batch.num_rows:
                x, y = _read(batch, splits, False)
                cell = _numbers(x, splits, known)
                for at in range(0, len(x), 4096):
                    sums.add(side, fold, y[at:at + 4096], guesses[cell[at:at + 4096]])
        yield from sums.batches()

    try:
        data = rows.select(vector_to_array("features").alias("x"), F.col("y").cast("double").alias("y"))
        return metric_rows(data.mapInArrow(run, SUMS), deviance)
    finally:
        sent.destroy()


def _guesses(bins: np.ndarray, trees: list[Tree], setting: Setting, lengths: list[int]) -> list[np.ndarray]:
    """Predictions of the first trees, for each length."""
    held, total = {0: np.zeros(len(bins))}, np.zeros(len(bins))
    for m, tree in enumerate(trees):
        total = total + (setting.rate if m else 1.0) * tree.value[tree.nodes(bins, setting.depth)]
        held[m + 1] = total
    return [held[n] for n in lengths]
