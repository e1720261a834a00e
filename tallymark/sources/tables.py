"""Readers: parquet tables and CSV files with the usual missing-value tokens."""

from __future__ import annotations

import csv
import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# The tokens a CSV reader of the pandas kind takes for "missing".
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, rejects: str = "fail") -> DataFrame:
    """CSV with headers; missing-value tokens become null.

    Columns are matched by each file's own header, so files may order them differently. A row with too few or
    too many fields is an error. So is a value that its type does not take, unless ``rejects`` is "null".
    Without a ``schema``, types are inferred as integer, then double, then string in one extra pass over the
    text columns.
    """
    parts = [
        spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).option("columnPruning", False).csv(
            paths, header=True, mode="FAILFAST")
        for names, paths in _by_header(spark, path)]
    raw = parts[0]
    for part in parts[1:]:
        raw = raw.unionByName(part)
    names = schema.fieldNames() if schema else raw.columns
    clean = raw.select([F.when(~F.trim(n).isin(MISSING_TOKENS), F.col(n)).alias(m) for n, m in zip(_quoted(names), names)])
    if schema is None:
        schema = _infer(clean)
    return clean.select([_typed(f, rejects).alias(f.name) for f in schema.fields])


def _typed(f: T.StructField, rejects: str) -> Column:
    text = F.col(f"`{f.name}`")
    value = F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})")
    if rejects == "null":
        return value
    message = F.concat(F.lit(f"column {f.name} takes no "), text)
    return F.when(text.isNotNull() & value.isNull(), F.raise_error(message).cast(f.dataType)).otherwise(value)


def _by_header(spark: SparkSession, path: str) -> list[tuple[list[str], list[str]]]:
    """Files grouped by their header line, which is the first line of the file's first split."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start").withColumn(
        "place", F.monotonically_increasing_id())
    first = lines.where("file_block_start = 0").groupBy("file_path").agg(
        F.min_by("value", "place").alias("header")).collect()  # one row per file
    files: dict[str, list[str]] = {}
    for r in sorted(first, key=lambda r: r.file_path):
        files.setdefault(r.header.rstrip("\r"), []).append(r.file_path)
    if not files:
        raise ValueError(f"no file with a header in {path}")
    return [(next(csv.reader([header])), paths) for header, paths in files.items()]


def _quoted(names: list[str]) -> list[str]:
    return [f"`{n}`" for n in names]


def _infer(text: DataFrame) -> T.StructType:
    checks = []
    for i, n in enumerate(_quoted(text.columns)):
        bad = lambda kind: F.max((F.col(n).isNotNull() & F.expr(f"try_cast({n} AS {kind})").isNull()).cast("int"))
        checks += [bad("bigint").alias(f"i{i}"), bad("double").alias(f"d{i}"), F.count(n).alias(f"n{i}"),
                   F.count("*").alias(f"a{i}")]
    found = text.agg(*checks).first()
    fields = []
    for i, n in enumerate(text.columns):
        if found[f"i{i}"] in (0, None) and found[f"n{i}"] == found[f"a{i}"]:
            kind: T.DataType = T.LongType()
        elif found[f"d{i}"] in (0, None):
            kind = T.DoubleType()  # also whole numbers with gaps and all-missing columns
        else:
            kind = T.StringType()
        fields.append(T.StructField(n, kind))
    return T.StructType(fields)


def drop_incomplete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop rows with a null in ``columns`` (all columns if not given; naming them keeps column pruning)."""
    return df.na.drop("any", subset=columns)
