"""Exact k nearest neighbours among the rows of a table.

Points are assigned to the nearest of a few pivots; cells are cut into blocks of bounded size
by hash, so a dense cell is never one task. Each point first searches its own block, which
bounds the distance of its k-th neighbour; the triangle inequality then rules out every cell
that cannot hold anything nearer, and the rest is searched block by block. Nothing is
approximated or capped: a block is skipped only when it provably cannot matter.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tallymark.functions.columns import hash32
from tallymark.session import stage

# The functions below run in Python workers: send them with the tasks, so that executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_PIVOTS = 256
_FOUND = "pid string, nn string, dist double"
_HELD = 1_000_000  # distances that a search holds at a time
_SLACK = 1 + 1e-9  # keeps rounding from ruling out a tie


def distances(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by plain differences, in slices of bounded memory."""
    out = np.empty((len(q), len(b)))
    rows = max(1, 2_000_000 // max(1, b.size))
    for at in range(0, len(q), rows):
        out[at : at + rows] = np.sqrt(((q[at : at + rows, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    return out


def _search(queries: pd.DataFrame, block: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest block members of each query, itself left out; ties by id."""
    block = block.sort_values("pid")
    ids, members = block["pid"].to_numpy(), np.stack(block["vec"].to_numpy())
    found, rows = [], max(1, _HELD // len(ids))
    for at in range(0, len(queries), rows):
        own = queries["pid"].to_numpy()[at : at + rows]
        d = distances(np.stack(queries["vec"].to_numpy()[at : at + rows]), members)
        d[own[:, None] == ids[None, :]] = np.inf
        best = np.argsort(d, axis=1, kind="stable")[:, :k]
        near = np.take_along_axis(d, best, axis=1)
        keep = np.isfinite(near)
        found.append((np.repeat(own, keep.sum(axis=1)), ids[best][keep], near[keep]))
    return pd.DataFrame(dict(zip(("pid", "nn", "dist"), map(np.concatenate, zip(*found)))))


def nearest(points: DataFrame, k: int, block_rows: int = 4096) -> DataFrame:
    """``(pid, nn, dist, place)`` for ``points (pid string, vec array<double>)`` with distinct ids."""
    pts = stage(points.select("pid", "vec"))
    n = pts.count()
    wanted = min(MAX_PIVOTS, max(1, math.ceil(n / block_rows)))
    chosen = pts.orderBy(hash32("pivot", "pid"), "pid").limit(wanted).collect()  # at most MAX_PIVOTS rows
    pivots = np.array([r["vec"] for r in chosen], dtype=float)
    if not len(pivots):
        return pts.sparkSession.createDataFrame([], _FOUND + ", place int")

    @F.pandas_udf("cell int, reach double")
    def assign(vec: pd.Series) -> pd.DataFrame:
        if not len(vec):
            return pd.DataFrame({"cell": pd.Series([], dtype="int32"), "reach": pd.Series([], dtype="float64")})
        d = distances(np.stack(vec.to_numpy()), pivots)
        cell = d.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "reach": d[np.arange(len(cell)), cell]})

    placed = pts.withColumn("a", assign("vec")).select("pid", "vec", F.col("a.cell").alias("cell"), F.col("a.reach").alias("reach"))
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("reach").alias("lo"), F.max("reach").alias("hi")).collect()
    blocks_of = {r["cell"]: max(1, math.ceil(r["n"] / block_rows)) for r in cells}  # one entry per pivot
    cuts = F.create_map(*[F.lit(v) for pair in blocks_of.items() for v in pair])
    blocked = stage(placed.withColumn("block", (hash32("block", "pid") % cuts[F.col("cell")]).cast("int")))

    def own_block(pdf: pd.DataFrame) -> pd.DataFrame:
        return _search(pdf, pdf, k)

    local = stage(blocked.groupBy("cell", "block").applyInPandas(own_block, _FOUND))
    bounds = local.groupBy("pid").agg(F.count("*").alias("c"), F.max("dist").alias("far"))
    asking = blocked.join(bounds, "pid", "left").withColumn(
        "bound", F.when(F.coalesce("c", F.lit(0)) < k, F.lit(float("inf"))).otherwise(F.col("far")))

    ids = np.array([r["cell"] for r in cells])
    lows, highs = np.array([r["lo"] for r in cells]), np.array([r["hi"] for r in cells])

    @F.pandas_udf("array<int>")
    def targets(vec: pd.Series, bound: pd.Series) -> pd.Series:
        """Cells, of which there are ``MAX_PIVOTS`` at most; their blocks, which grow with the rows, are listed by Spark."""
        if not len(vec):
            return pd.Series([], dtype=object)
        d = distances(np.stack(vec.to_numpy()), pivots[ids])
        gap = np.maximum(0.0, np.maximum(d - highs, lows - d))  # least distance to a member of each cell
        return pd.Series([ids[row].astype(np.int32) for row in gap <= (bound.to_numpy() * _SLACK)[:, None]])

    to_cells = asking.select("pid", "vec", "cell", "block", F.explode(targets("vec", "bound")).alias("to"))
    visits = to_cells.withColumn("at", F.explode(F.sequence(F.lit(0), cuts[F.col("to")] - 1))).where(
        "NOT (to = cell AND at = block)").select("pid", "vec", F.col("to").alias("cell"), F.col("at").alias("block"))
    # Callers of one block are cut into chunks as well, and the block is copied to each chunk.
    per_block = visits.groupBy("cell", "block").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("chunks"))
    callers = visits.join(per_block, ["cell", "block"]).withColumn("chunk", (hash32("chunk", "pid") % F.col("chunks")).cast("int"))
    called = blocked.select("pid", "vec", "cell", "block").join(per_block, ["cell", "block"]).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

    def other_block(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(b):
            return pd.DataFrame({"pid": [], "nn": [], "dist": []})
        return _search(q, b, k)

    parts = ["cell", "block", "chunk"]
    # Both sides come from one table: fresh names keep their columns apart.
    called = called.select("pid", "vec", *parts).toDF("pid", "vec", *[f"of_{c}" for c in parts])
    callers = callers.select("pid", "vec", *parts).toDF("pid", "vec", *[f"by_{c}" for c in parts])
    remote = callers.groupBy(*[f"by_{c}" for c in parts]).cogroup(
        called.groupBy(*[f"of_{c}" for c in parts])).applyInPandas(other_block, _FOUND)
    order = Window.partitionBy("pid").orderBy("dist", "nn")
    return local.unionByName(remote).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def nearest_by(points: DataFrame, group: str, k: int, block_rows: int = 4096) -> DataFrame:
    """``(group, pid, nn, dist, place)``: neighbours within each group, ids being distinct there.

    Groups of up to ``block_rows`` points are searched in one job, a task each. Larger ones, of which a table has
    one in ``block_rows`` rows at most, are searched block by block.
    """
    pts = stage(points.where(F.col(group).isNotNull()).select(group, "pid", "vec"))
    kind = pts.schema[group].dataType
    large = [r[group] for r in pts.groupBy(group).count().where(F.col("count") > block_rows).collect()]
    small = pts.join(F.broadcast(pts.sparkSession.createDataFrame([(v,) for v in large], T.StructType([T.StructField(group, kind)]))),
                     group, "left_anti")  # one row per large group

    def own_group(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _search(pdf, pdf, k)
        found.insert(0, group, [pdf[group].iloc[0]] * len(found))
        return found

    order = Window.partitionBy(group, "pid").orderBy("dist", "nn")
    out = small.groupBy(group).applyInPandas(own_group, f"`{group}` {kind.simpleString()}, {_FOUND}").withColumn(
        "place", F.row_number().over(order))
    for value in large:
        found = nearest(pts.where(F.col(group) == F.lit(value)), k, block_rows)
        out = out.unionByName(found.withColumn(group, F.lit(value).cast(kind)))
    return out
