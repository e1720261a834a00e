"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallymark.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """``(x, component)``: for every end of an edge ``(a, b)`` the smallest end it is connected with.

    Each round every vertex joins its smallest neighbour below it; edges are rewritten to the roots and merged
    before the next round, so at least half of a component's vertices go each round. Rounds are staged.
    """
    labels = None
    edges = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    while True:
        parent = stage(edges.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("p")))
        parent = _jumped(parent)
        if labels is None:
            ends = edges.select(F.col("a").alias("x")).union(edges.select("b")).distinct()
            labels = _relabelled(ends.withColumn("component", F.col("x")), parent)
        else:
            labels = _relabelled(labels, parent)
        labels = stage(labels)
        ends = parent.withColumnRenamed("x", "a").withColumnRenamed("p", "pa")
        moved = edges.join(ends, "a").select(F.col("pa").alias("a"), "b")
        moved = moved.join(parent.withColumnRenamed("x", "b").withColumnRenamed("p", "pb"), "b", "left")
        moved = moved.select("a", F.coalesce("pb", "b").alias("b"))
        edges = stage(moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
        if edges.isEmpty():
            return labels


def _jumped(parent: DataFrame) -> DataFrame:
    """Each vertex's parent's parent: parents without one are roots."""
    up = parent.select(F.col("x").alias("p"), F.col("p").alias("q"))
    return stage(parent.join(up, "p", "left").select("x", F.coalesce("q", "p").alias("p")))


def _relabelled(labels: DataFrame, parent: DataFrame) -> DataFrame:
    up = parent.select(F.col("x").alias("component"), "p")
    return labels.join(up, "component", "left").select("x", F.coalesce("p", "component").alias("component"))
