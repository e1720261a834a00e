"""Hold-out split, folds and resampling, all decided by a hash of the row key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallymark.functions.columns import hash32
from tallymark.operators.ordering import ranked
from tallymark.session import stage

SEED = 42


def holdout_side(key: str, test_percent: int = 20, seed: int = SEED) -> Column:
    return F.when(hash32(str(seed), key) % 100 < test_percent, "test").otherwise("train")


def with_split(df: DataFrame, key: str, test_percent: int = 20, seed: int = SEED) -> DataFrame:
    return df.withColumn("split", holdout_side(key, test_percent, seed))


def with_folds(df: DataFrame, key: str, k: int = 10, seed: int = SEED) -> DataFrame:
    return df.withColumn("fold", (hash32(f"fold:{seed}", key) % k).cast("int"))


def with_contiguous_folds(df: DataFrame, key: str, k: int = 5) -> DataFrame:
    """Unshuffled folds of consecutive rows in key order; the first ``n mod k`` hold one row more.

    Only the keys are ordered, to find those at which the folds begin; the rows are then merely compared with
    these. Rows that share a key stay in one fold; rows without a key are in the first.
    """
    keys = ranked(df.select(key), [key], "__rank")
    n = keys.count()
    size, extra = divmod(n, k)
    starts = [i * size + min(i, extra) + 1 for i in range(1, k)]
    found = {r["__rank"]: r[key] for r in keys.where(F.col("__rank").isin(starts)).collect()}  # a key per fold
    fold = F.lit(0)
    for start in starts:
        if start > n:
            break  # fewer rows than folds
        at = found[start]
        reached = F.col(f"`{key}`").isNotNull() if at is None else F.col(f"`{key}`") >= F.lit(at)
        fold = fold + F.coalesce(reached, F.lit(False)).cast("int")
    return df.withColumn("fold", fold.cast("int"))


def validation_slice(key: str, percent: int = 10, seed: int = SEED) -> Column:
    """True for the rows kept aside to decide when training stops."""
    return hash32(f"valid:{seed}", key) % 100 < percent


def smallest_hashes(df: DataFrame, key: str, wanted: Column, by: list[str], salt: str) -> DataFrame:
    """Keep exactly ``wanted`` rows (a column, constant per group) with the lowest hash in each group.

    Stage one counts rows per group and hash slot (65,536 slots at most) and finds the slot
    where the count is reached; stage two ranks only the rows of that slot.
    """
    marked = df.withColumn("__h", hash32(salt, key)).withColumn("__slot", F.shiftright("__h", 16).cast("int"))
    marked = marked.withColumn("__want", wanted)
    per_slot = marked.groupBy(*by, "__slot").agg(F.count("*").alias("__c"), F.first("__want").alias("__w"))
    # at most 65,536 rows per group
    upto = Window.partitionBy(*by).orderBy("__slot").rowsBetween(Window.unboundedPreceding, 0)
    per_slot = per_slot.withColumn("__cum", F.sum("__c").over(upto))
    edge = (
        per_slot.where((F.col("__cum") - F.col("__c") < F.col("__w")) & (F.col("__w") <= F.col("__cum")))
        .select(*by, F.col("__slot").alias("__edge"), (F.col("__w") - F.col("__cum") + F.col("__c")).alias("__left"))
    )
    joined = marked.join(stage(edge), by, "left")  # one staged row per group: broadcast if small
    inside = joined.where(F.col("__edge").isNull() & (F.col("__want") > 0) | (F.col("__slot") < F.col("__edge")))
    in_slot = Window.partitionBy(*by, "__slot").orderBy("__h", key)
    at_edge = (
        joined.where(F.col("__slot") == F.col("__edge"))
        .withColumn("__rn", F.row_number().over(in_slot))
        .where(F.col("__rn") <= F.col("__left"))
        .drop("__rn")
    )
    return inside.unionByName(at_edge).select(*df.columns)


def undersample(df: DataFrame, key: str, label: str, seed: int = SEED) -> DataFrame:
    """Random undersampling: every class is cut to the size of the smallest one; rows without a label are left out."""
    df = df.where(F.col(label).isNotNull())
    smallest = df.groupBy(label).agg(F.count("*").alias("__c")).agg(F.min("__c")).scalar()
    return smallest_hashes(df, key, smallest, [label], f"under:{seed}")

