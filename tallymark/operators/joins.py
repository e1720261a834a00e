"""Joins that no key overloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HOT_SHARE = 1_000  # a key with more than one row in this many is looked up by broadcast, not by shuffle


def looked_up(rows: DataFrame, groups: DataFrame, key: str, count: str = "n") -> DataFrame:
    """Left join with staged ``groups``: one row per string ``key``, which about ``count`` of the ``rows`` hold.

    Keys of more than one row in ``HOT_SHARE`` are fewer than ``HOT_SHARE`` and are broadcast. Their rows, and
    rows without a key, pass the other join under keys of their own, which match nothing.
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    values = [c for c in groups.columns if c not in (key, count)]
    hot = F.col(count) * HOT_SHARE > total
    few = groups.filter(hot).select(F.col(key).alias("__few"), *[F.col(v).alias(f"__few_{v}") for v in values])
    rest = groups.filter(~hot).select(F.col(key).alias("__key"), *[F.col(v).alias(f"__rest_{v}") for v in values])
    met = rows.join(F.broadcast(few), F.col(key) == F.col("__few"), "left")  # fewer than HOT_SHARE rows
    alone = F.col("__few").isNotNull() | F.col(key).isNull()
    met = met.withColumn("__own", F.when(alone, F.concat(F.lit("row "), F.monotonically_increasing_id())).otherwise(F.col(key)))
    met = met.join(rest, F.col("__own") == F.col("__key"), "left")
    found = [F.when(alone, F.col(f"__few_{v}")).otherwise(F.col(f"__rest_{v}")).alias(v) for v in values]
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], *found)
