"""Sinks: text reports, the metrics registry and the layout of run artifacts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, functions as F


def artifact_path(root: str, family: str, model: str, number: int | None = None, best: bool = False) -> str:
    """``root/best/<model>``, ``root/non_best/<model>`` for numbered models, else ``root/<family>``."""
    if best:
        return os.path.join(root, "best", model)
    return os.path.join(root, "non_best", model) if number is not None else os.path.join(root, family)


def write_report(lines: DataFrame, path: str) -> None:
    """Ordered lines as one text file. Reports have tens of lines, so one task is enough."""
    lines.coalesce(1).sortWithinPartitions("section_no", "line_no").select("text").write.mode("overwrite").text(path)


def write_metrics(metrics: DataFrame, root: str, run: str, family: str, best: bool = False) -> None:
    """Append a tidy metrics table to the registry, partitioned by family, model and run."""
    (metrics.withColumn("family", F.lit(family)).withColumn("is_best", F.lit(best)).withColumn("run", F.lit(run))
     .write.mode("append").partitionBy("family", "model", "is_best", "run").parquet(root))


def write_table(df: DataFrame, root: str, family: str, name: str, run: str, best: bool = False) -> str:
    """Write a prediction or chart table under its artifact folder."""
    path = os.path.join(artifact_path(root, family, name, best=best), f"run={run}")
    df.write.mode("overwrite").parquet(path)
    return path
