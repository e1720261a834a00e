"""Best-fit packing of token sequences by hierarchical residual rounds.

Partitions pack their pieces by best fit, longest first. Bins that are nearly full are final; each
other bin becomes one item of the next round, dealt out anew to fewer partitions, until one partition
holds all that is left or a round no longer saves bins.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallymark.llm.common import chunks, stage
from tallymark.llm.tokens import Encoder, vocabulary_path

CAPACITY = 2048
NEARLY_FULL = 2040
ITEMS_PER_TASK = 50_000
WORTHWHILE = 0.001
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(df: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Pieces of every document's ids followed by id 0: only longer documents are cut, each ``capacity`` ids."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for doc_ids, texts in chunks(batches):
            ids, counts = encoder.encode(texts)
            ends = np.cumsum(counts)
            closed = np.insert(ids, ends, 0).astype("<u4")  # every document is followed by id 0
            lengths = counts + 1
            firsts = np.cumsum(lengths) - lengths
            pieces = -(-lengths // capacity)
            doc = np.repeat(np.arange(len(doc_ids)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(lengths[doc] - start, capacity)
            data, at = memoryview(closed.tobytes()), 4 * (firsts[doc] + start)
            sums = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                 pa.array(sums, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each item, longest first, each into the fullest bin that still takes it."""
    bins, offsets = np.empty(sizes.size, dtype=np.int64), np.empty(sizes.size, dtype=np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, used = 0, 0  # bit r of free: some bin has exactly r places left
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = free >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                free ^= 1 << left
        else:
            b, left, used = used, capacity, used + 1
        bins[i], offsets[i] = b, capacity - left
        room[left - size].append(b)
        free |= 1 << (left - size)
    return bins, offsets


def _pack(items: DataFrame, tasks: int, level: int, capacity: int) -> DataFrame:
    """``(item, bin, at, fill)``: items dealt out to ``tasks`` groups by a hash of their number and the level."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(frames)
        if not held:
            return
        whole = pd.concat(held, ignore_index=True)
        for group, own in whole.groupby("task", sort=True):
            sizes = own["size"].to_numpy()
            bins, at = best_fit(sizes, capacity)
            fill = np.bincount(bins, weights=sizes).astype(np.int64)
            yield pd.DataFrame({"item": own["item"].to_numpy(), "bin": (int(group) << 32) + bins, "at": at, "fill": fill[bins]})

    dealt = items.withColumn("task", F.pmod(F.xxhash64(F.lit(level), "item"), F.lit(tasks)))
    return dealt.repartition(tasks, "task").mapInPandas(run, "item long, bin long, at long, fill long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, nearly_full: int = NEARLY_FULL,
         items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """``pieces`` (a column ``length`` from 1 to ``capacity``) plus ``sequence_id`` and ``offset``.

    Every row is placed exactly once, repeated rows too; offsets in a sequence leave no gap. An empty table
    gives an empty one. A task holds about ``items_per_task`` numbers, never texts. Ties in length go to the
    row written first. Rounds end when one group is left or when a round saves under one bin in a thousand.
    """
    rows = stage(pieces.withColumn("__row", F.monotonically_increasing_id()))
    items, level = rows.select(F.col("__row").alias("item"), F.col("length").alias("size")), 0
    placed = None  # (item, bin, at): where each row stands after the rounds so far
    while True:
        n = items.count()
        tasks = max(1, math.ceil(n / items_per_task))
        packed = stage(_pack(items, tasks, level, capacity).withColumn("bin", F.col("bin") * 64 + level))
        step = packed.select("item", "bin", "at")
        if placed is None:
            placed = step
        else:
            moved = step.select(F.col("item").alias("bin"), F.col("bin").alias("__to"), F.col("at").alias("__by"))
            placed = stage(placed.join(moved, "bin", "left").select(
                "item", F.coalesce("__to", "bin").alias("bin"), (F.col("at") + F.coalesce("__by", F.lit(0))).alias("at")))
        if tasks == 1:
            break
        open_bins = packed.filter(F.col("fill") < nearly_full).select(F.col("bin").alias("item"), F.col("fill").alias("size")).distinct()
        made = packed.agg(F.countDistinct("bin")).first()[0]
        if level and n - made < max(1, WORTHWHILE * n):
            break
        items, level = open_bins, level + 1
    where = placed.select(F.col("item").alias("__row"), F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    return rows.join(where, "__row").drop("__row")


def pack_documents(df: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places; see ``pack``. Null texts are empty: one piece, id 0 alone."""
    return pack(token_pieces(df, capacity), capacity)
