"""Session set-up for tests and the bench, and the staging folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, memory: str = "8g", name: str = "tallymark") -> SparkSession:
    """A local session. On a cluster use the session the cluster hands out."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def staging_root(spark: SparkSession) -> str:
    """Shared folder for staged tables: the cluster's ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder of its own;
    a cluster session without it is an error, since executors could not share one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    root = tempfile.mkdtemp(prefix="tallymark-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the staging folder and read it back.

    Fixes values that depend on the physical layout, gives Catalyst true sizes, and
    keeps results when executors are lost, because the files live outside them.
    """
    spark = df.sparkSession
    path = os.path.join(staging_root(spark), f"stage-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cache_spread(df: DataFrame) -> DataFrame:
    """Cache rows that will be read many times, in no fewer partitions than there are cores.

    A small or badly split input would keep most cores idle in every pass. It is then dealt
    out once more; a large table already has more partitions and is cached as it comes, with
    no shuffle. Asking for the number of partitions is also what fills the cache.
    """
    cached = df.persist()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if cached.rdd.getNumPartitions() >= cores:
        return cached
    spread = cached.repartition(cores).persist()
    spread.count()
    cached.unpersist()
    return spread
