"""Helpers shared by the operators: text batches for Arrow functions, bucketed ids, staging."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallymark.session import stage  # noqa: F401
from tallymark.sources.tables import table  # noqa: F401

CHUNK_CHARS = 4_000_000


def chunks(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = CHUNK_CHARS) -> Iterator[list[list]]:
    """Columns as lists, cut so that the texts of one chunk stay near ``limit`` bytes.

    Null texts become empty. A text longer than the limit is a chunk of its own and is never cut.
    """
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield _lists(batch.slice(start, i - start), text)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield _lists(batch.slice(start), text)


def _lists(batch: pa.RecordBatch, text: int) -> list[list]:
    out = [c.to_pylist() for c in batch.columns]
    out[text] = [t or "" for t in out[text]]
    return out


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "documents").select(*columns)


def id_bucket(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % modulus


def widths(df: DataFrame) -> int:
    """Partitions for a shuffle of what ``df`` holds: the session's setting, which the cluster sizes by its input."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
