"""Hard negatives for contrastive training: per anchor and positive the best other-label rows within a band of its score.

Scores are exact integer inner products by the Four-Russians method. Vectors are scaled to integers and cut into groups of
eight dimensions. For an anchor and a group a table holds the sums of all 256 subsets of its eight components; a
candidate's integers are kept as bit planes, eight dimensions to a byte, so that a plane's share of the product is one
lookup per group, and the planes, sign plane first, are shifted together into the full score.

All anchors meet all candidates, block by block: anchors are broadcast ``ANCHOR_VALUES`` components at a time, candidates
are tiles of packed planes spread over the tasks. A task hands on its best few for each anchor, never a score per pair.

Defined results. Rows with a null id, label or vector, or a null or non-finite component take no part. A shorter vector
is read as if zeros followed. Ties go to the smaller id. Repeated rows are candidates each; rows that share an
id divisible as an anchor's give one anchor, of the least label and then the least vector; an anchor never meets rows of its own
id as positives. No anchor, positive or negative: no rows. Scores must fit in 50 bits; larger components are an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallymark.llm.common import stage
from tallymark.operators.ordering import ranked

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90           # a negative's score lies within these percentages of the positive's
TILE = 4096                  # candidates of a tile
ANCHOR_TILE = 64             # anchors scored together: their tables fit a core's cache
ANCHOR_VALUES = 2_000_000    # anchor components broadcast at a time
TASK_TILES = 32              # tiles a task holds and scores together
SCORE_BITS = 50
NONE = np.iinfo(np.int64).min

TILES = "size int, bits int, ids binary, labels binary, planes binary"


def mine(
    rows: DataFrame, is_anchor: Column, id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are the rows for which ``is_anchor`` holds; their positives are the first other rows of their label; each
    positive's negatives are the first rows of other labels with ``low * p <= 100 * n <= high * p``.
    """
    whole = F.col("vector").isNotNull() & F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.select(
        F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"), is_anchor.alias("anchor"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & whole)
    anchors = rows.filter("anchor").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("of"))
    anchors = stage(ranked(anchors.select("id", "of.label", "of.vector"), ["id"], "place"))
    tiles = _spread(rows.select("id", "label", "vector"), scale)
    count, longest = anchors.agg(F.count("*"), F.max(F.size("vector"))).first()
    step = max(1, ANCHOR_VALUES // max(longest or 0, 8))
    found = None
    for start in range(0, max(count, 1), step):
        part = _mined(anchors, start, step, tiles, scale, positives, negatives, low, high)
        found = part if found is None else found.unionByName(part)
    return found


def _spread(rows: DataFrame, scale: int) -> DataFrame:
    """Staged tiles of packed candidates, dealt out to as many tasks as there are cores, or tiles for a task each."""
    tiles = stage(rows.mapInArrow(lambda batches: _packed(batches, scale), TILES))
    n, cores = tiles.count(), rows.sparkSession.sparkContext.defaultParallelism
    return stage(tiles.repartition(max(1, math.ceil(n / TASK_TILES), min(n, cores))))


def _mined(anchors: DataFrame, start: int, step: int, tiles: DataFrame, scale, positives, negatives, low, high) -> DataFrame:
    spark = tiles.sparkSession
    chosen = anchors.filter(F.col("place").between(start + 1, start + step))
    held = chosen.orderBy("place").collect()  # at most ANCHOR_VALUES components, or one anchor
    block = Anchors.of([r.id for r in held], [r.label for r in held], [r.vector for r in held], scale)
    sent = spark.sparkContext.broadcast(block)
    near = tiles.mapInArrow(lambda batches, sent=sent: _positives(batches, sent.value, positives), "anchor int, id long, score long")
    near = stage(_first(near, ["anchor"], positives, "place"))
    scores = np.full((len(held), positives), NONE)
    for r in near.select("anchor", "place", "score").collect():  # at most `positives` for each anchor of the block
        scores[r.anchor, r.place - 1] = r.score
    limits = spark.sparkContext.broadcast(_bands(scores, low, high))
    far = tiles.mapInArrow(
        lambda batches, sent=sent, limits=limits: _negatives(batches, sent.value, *limits.value, negatives),
        "anchor int, place int, id long, score long")
    far = _first(far, ["anchor", "place"], negatives, "rank")
    names = chosen.select((F.col("place") - start - 1).cast("int").alias("anchor"), F.col("id").alias("anchor_id"))
    pairs = near.join(names, "anchor").select("anchor", "anchor_id", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = stage(far.join(pairs, ["anchor", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    sent.destroy()
    limits.destroy()
    return out


def _first(rows: DataFrame, by: list[str], n: int, rank: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "id"))
    return rows.withColumn(rank, place).filter(F.col(rank) <= n)


def scaled(vectors: list, scale: int) -> np.ndarray:
    """Vectors as rows of integers, zeros behind shorter ones, a multiple of eight columns."""
    longest = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), max(8, -(-longest // 8) * 8)))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    out = np.floor(scale * out)
    if np.abs(out).max(initial=0) >= 2**31:
        raise ValueError("components beyond 31 bits have no exact score")
    return out.astype(np.int64)


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes ``(bits, groups, rows)`` of two's complement integers, dimension ``i`` of a group as bit ``i`` of its byte."""
    bits = int(np.where(values < 0, ~values, values).max(initial=0)).bit_length() + 1
    split = values.reshape(len(values), -1, 8)
    return np.stack([np.packbits((split >> b & 1).astype(np.uint8), axis=2, bitorder="little")[:, :, 0].T for b in range(bits)])


@dataclass
class Anchors:
    ids: np.ndarray
    labels: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(ids, labels, vectors, scale: int) -> "Anchors":
        return Anchors(np.array(ids, np.int64), np.array(labels, np.int64), scaled(vectors, scale))


def subset_sums(values: np.ndarray) -> np.ndarray:
    """Tables ``(groups, 256, anchors)``: the sum of every subset of eight components, built by doubling."""
    split = values.reshape(len(values), -1, 8).transpose(1, 2, 0)
    tables = np.zeros((len(split), 256, len(values)), values.dtype)
    for i in range(8):
        np.add(tables[:, :1 << i], split[:, i:i + 1], out=tables[:, 1 << i:2 << i])
    return tables


def score(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Exact products ``(candidates, anchors)``: lookups of each plane summed over the groups, planes shifted together."""
    bits, groups, n = packed.shape
    groups = min(groups, len(tables))  # beyond the shorter vectors there are only zeros
    total = np.zeros((n, tables.shape[2]), tables.dtype)
    found = np.empty_like(total)
    for b in range(bits - 1, -1, -1):
        if b < bits - 1:
            np.left_shift(total, 1, out=total)
        for g in range(groups):
            np.take(tables[g], packed[b, g], axis=0, out=found, mode="clip")
            np.add(total, found, out=total)
        if b == bits - 1:
            np.negative(total, out=total)
    return total


@dataclass
class Tile:
    ids: np.ndarray
    labels: np.ndarray
    planes: np.ndarray


def _packed(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    ids, labels, vectors = [], [], []
    for batch in batches:
        for i in range(0, len(batch), TILE):
            part = batch.slice(i, TILE)
            ids += part.column(0).to_pylist()
            labels += part.column(1).to_pylist()
            vectors += _rows(part.column(2))
            while len(ids) >= TILE:
                yield _tile(ids[:TILE], labels[:TILE], vectors[:TILE], scale)
                ids, labels, vectors = ids[TILE:], labels[TILE:], vectors[TILE:]
    if ids:
        yield _tile(ids, labels, vectors, scale)


def _rows(column: pa.Array) -> list[np.ndarray]:
    values, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(values, ends[:-1])


def _tile(ids: list, labels: list, vectors: list, scale: int) -> pa.RecordBatch:
    order = np.argsort(np.array(ids, np.int64), kind="stable")  # by id, so that of equal scores the first place is the smaller id
    packed = planes(scaled(vectors, scale)[order])
    return pa.RecordBatch.from_arrays([
        pa.array([len(ids)], pa.int32()), pa.array([len(packed)], pa.int32()), pa.array([np.array(ids, np.int64)[order].tobytes()], pa.binary()),
        pa.array([np.array(labels, np.int64)[order].tobytes()], pa.binary()), pa.array([packed.tobytes()], pa.binary()),
    ], names=["size", "bits", "ids", "labels", "planes"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Tile]]:
    held = []
    for batch in batches:
        for row in batch.to_pylist():
            held.append(Tile(
                np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64),
                np.frombuffer(row["planes"], np.uint8).reshape(row["bits"], -1, row["size"])))
            if len(held) == TASK_TILES:
                yield held
                held = []
    if held:
        yield held


def _scored(tiles: list[Tile], anchors: Anchors) -> Iterator[tuple[slice, Tile, np.ndarray]]:
    """Scores ``(anchors, candidates)`` of every tile with every few anchors, whose tables are built once for all tiles."""
    for start in range(0, len(anchors.ids), ANCHOR_TILE):
        part = slice(start, start + ANCHOR_TILE)
        values = anchors.values[part]
        sums = np.abs(values).sum(axis=1).max(initial=0)
        narrow = wide = None
        for tile in tiles:
            bits = int(sums).bit_length() + len(tile.planes)
            if bits > SCORE_BITS:
                raise ValueError(f"scores may take more than {SCORE_BITS} bits")
            if bits < 31:
                narrow = subset_sums(values.astype(np.int32)) if narrow is None else narrow
            else:
                wide = subset_sums(values) if wide is None else wide
            yield part, tile, np.ascontiguousarray(score(narrow if bits < 31 else wide, tile.planes).T)


class _Best:
    """The first ``k`` of each row by score and id, of all that was offered."""

    def __init__(self, rows: int, k: int):
        self.k, self.scores, self.ids = k, np.full((rows, k), NONE), np.zeros((rows, k), np.int64)

    def offer(self, rows: slice, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` of a stretch of rows with candidates in ascending order of id; only ``allowed`` ones count."""
        n = scores.shape[1]
        good = allowed & (scores >= self.scores[rows, -1:])
        hits = int(np.count_nonzero(good))
        if not hits:
            return
        if hits > 4 * self.k * len(scores) and n > self.k:  # many: the first k of each row, places breaking ties
            key = np.where(good, scores.astype(np.int64) * n + np.arange(n - 1, -1, -1), NONE)
            first = np.argpartition(key, n - self.k, axis=1)[:, n - self.k:]
            row = np.repeat(np.arange(len(scores)), self.k)
            place = first.ravel()
            kept = good[row, place]
            row, place = row[kept], place[kept]
        else:
            row, place = np.nonzero(good)
        old = np.nonzero(self.scores[rows] != NONE)
        row = np.r_[old[0], row]
        value = np.r_[self.scores[rows][old], scores[row[len(old[0]):], place]]
        id = np.r_[self.ids[rows][old], ids[place]]
        order = np.lexsort((id, -value, row))
        row, value, id = row[order], value[order], id[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        self.scores[rows][row[keep], rank[keep]] = value[keep]
        self.ids[rows][row[keep], rank[keep]] = id[keep]


def _positives(batches: Iterator[pa.RecordBatch], anchors: Anchors, k: int) -> Iterator[pa.RecordBatch]:
    best = _Best(len(anchors.ids), k)
    for tiles in _tiles(batches):
        for part, tile, scores in _scored(tiles, anchors):
            same = (anchors.labels[part, None] == tile.labels) & (anchors.ids[part, None] != tile.ids)
            best.offer(part, scores, same, tile.ids)
    row, place = np.nonzero(best.scores != NONE)
    yield pa.RecordBatch.from_arrays(
        [pa.array(row, pa.int32()), pa.array(best.ids[row, place]), pa.array(best.scores[row, place])], names=["anchor", "id", "score"])


def _bands(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest score of a negative for each positive's score; an empty band where there is no positive."""
    real = np.where(scores == NONE, 0, scores)
    least, most = -(-low * real // 100), high * real // 100
    return least, np.where(scores == NONE, least - 1, most)


def _negatives(batches: Iterator[pa.RecordBatch], anchors: Anchors, least: np.ndarray, most: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    best = [_Best(len(anchors.ids), k) for _ in range(least.shape[1])]
    for tiles in _tiles(batches):
        for part, tile, scores in _scored(tiles, anchors):
            other = anchors.labels[part, None] != tile.labels
            for place, of in enumerate(best):
                of.offer(part, scores, other & (scores >= least[part, place, None]) & (scores <= most[part, place, None]), tile.ids)
    for place, of in enumerate(best):
        row, at = np.nonzero(of.scores != NONE)
        yield pa.RecordBatch.from_arrays(
            [pa.array(row, pa.int32()), pa.array(np.full(len(row), place + 1), pa.int32()), pa.array(of.ids[row, at]), pa.array(of.scores[row, at])],
            names=["anchor", "place", "id", "score"])
