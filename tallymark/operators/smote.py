"""SMOTE: grow each smaller class by points between a row and one of its near neighbours of the same class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallymark.functions.columns import hash32, hash_unit
from tallymark.operators.neighbours import nearest_by
from tallymark.operators.splits import SEED, smallest_hashes
from tallymark.session import stage

HOT_SHARE = 1000  # a point with more than 1/1000 of the rows as copies is hot: fewer than 1000 points can be
COPIES = 100_000  # copies of a row that are asked for at a time


def smote(
    df: DataFrame, key: str, label: str, features: list[str], k: int = 5, seed: int = SEED, block_rows: int = 4096,
) -> DataFrame:
    """All rows plus synthetic ones, every class as large as the largest.

    Columns ``key`` (text), ``label``, the features, and for synthetic rows ``base`` and
    ``neighbour`` (the keys' point ids) and ``step`` (the fraction of the way). All classes grow in the same jobs;
    rows without a label are no class.
    """
    rows = df.select(F.col(key).cast("string").alias(key), label, *[F.col(c).cast("double").alias(c) for c in features])
    counts = stage(rows.groupBy(label).agg(F.count("*").alias("__n")))
    most = counts.agg(F.max("__n").alias("most"), F.sum("__n").alias("all")).first()
    none = F.lit(None).cast("string")
    out = rows.select(key, label, *features, none.alias("base"), none.alias("neighbour"), F.lit(None).cast("double").alias("step"))
    short = counts.where(F.col(label).isNotNull() & (F.col("__n") < (most["most"] or 0)))
    if short.isEmpty():
        return out
    members = rows.join(short.withColumn("__need", F.lit(most["most"]) - F.col("__n")), label)  # a staged row per class: broadcast if small
    return out.unionByName(_grow(members, key, label, features, most["all"], k, seed, block_rows))


def _grow(members: DataFrame, key: str, label: str, features: list[str], total: int, k: int, seed: int, block_rows: int) -> DataFrame:
    """``__need`` synthetic rows from the ``__n`` members of each class, spread evenly over them."""
    vec = F.array(*features)
    pid = F.md5(F.concat_ws(",", *[(F.col(c) + F.lit(0.0)).cast("string") for c in features]))
    base = stage(members.select(key, label, "__n", "__need", vec.alias("vec"), pid.alias("pid")))
    points = base.groupBy(label, "pid").agg(F.first("vec").alias("vec"), F.count("*").alias("copies"))  # copies collapse here
    points = stage(points)
    near = nearest_by(points, label, k, block_rows)

    # Slots of a point: its own copies first, then its neighbours with their copies; k at most.
    own = points.where("copies > 1").select(label, "pid", F.lit(0).alias("place"), F.col("pid").alias("nn"),
                                            F.col("vec").alias("nn_vec"), (F.col("copies") - 1).alias("weight"))
    other = near.join(points.select(label, F.col("pid").alias("nn"), F.col("vec").alias("nn_vec"), F.col("copies").alias("weight")), [label, "nn"])
    slots = own.unionByName(other.select(label, "pid", "place", "nn", "nn_vec", "weight")).groupBy(label, "pid").agg(
        F.array_sort(F.collect_list(F.struct("place", "nn", "weight", "nn_vec"))).alias("slots"))  # k + 1 entries at most
    slots = stage(slots.join(points.select(label, "pid", "copies"), [label, "pid"]))

    # Rows that get one synthetic row more than the others.
    extra = smallest_hashes(base.select(key, label, "__n", "__need"), key, F.col("__need") % F.col("__n"), [label], f"smote:{seed}").select(
        key, F.lit(1).alias("more"))
    times = F.floor(F.col("__need") / F.col("__n")) + F.coalesce("more", F.lit(0))
    asked = base.join(extra, key, "left").withColumn("times", times).where("times > 0")
    asked = asked.withColumn("from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"), F.lit(COPIES).cast("long"))))
    asked = asked.withColumn("copy", F.explode(F.sequence("from", F.least("times", F.col("from") + COPIES - 1)))).withColumn(
        "copy", F.col("copy").cast("int")).drop("from", "times")
    joined = _join_hot(asked, slots, label, total)

    reach = F.aggregate("slots", F.lit(0).cast("long"), lambda a, s: a + s["weight"])
    pick = hash32(f"smote-pick:{seed}", key, "copy") % F.least(F.lit(k).cast("long"), F.col("total"))
    chosen = joined.withColumn("total", reach).withColumn("pick", pick).withColumn("hit", _slot_at("slots", "pick"))
    u = hash_unit(f"smote-step:{seed}", key, "copy")
    moved = chosen.withColumn("step", u).withColumn("x", F.zip_with(
        "vec", F.coalesce(F.col("hit.nn_vec"), F.col("vec")), lambda a, b: a + F.col("step") * (b - a)))
    return moved.select(
        F.concat_ws("#", key, F.col("copy")).alias(key), label, *[F.col("x")[i].alias(c) for i, c in enumerate(features)],
        F.col("pid").alias("base"), F.coalesce(F.col("hit.nn"), F.col("pid")).alias("neighbour"), "step")


def _slot_at(slots: str, pick: str) -> Column:
    """Entry whose run of slots contains ``pick`` (weights laid end to end)."""
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).alias("index"), F.lit(-1).alias("found"))
    walked = F.aggregate(slots, start, lambda a, s: F.struct(
        (a["seen"] + s["weight"]).alias("seen"), (a["index"] + 1).alias("index"),
        F.when((a["found"] < 0) & (F.col(pick) < a["seen"] + s["weight"]), a["index"] + 1).otherwise(a["found"]).alias("found")))
    return F.get(slots, walked["found"])


def _join_hot(rows: DataFrame, slots: DataFrame, label: str, total: int) -> DataFrame:
    """Left join on class and ``pid``; points with a large share of all rows are broadcast, fewer than 1000 of them."""
    hot = F.col("copies") > total / HOT_SHARE
    few = slots.where(hot).drop("copies")
    rest = slots.where(~hot).drop("copies")
    by = [label, "pid"]
    marked = rows.join(F.broadcast(few.select(*by, F.lit(True).alias("__hot"))), by, "left")
    heavy = marked.where("__hot").drop("__hot").join(F.broadcast(few), by)
    light = marked.where("__hot IS NULL").drop("__hot").join(rest, by, "left")
    return heavy.unionByName(light)
