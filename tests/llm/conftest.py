import pytest
from pyspark.sql import functions as F

CLASHES = ["score", "lang_pred", "component_id", "kept", "key", "mark", "bin", "item", "spans", "base", "rep", "words", "p", "x", "own", "bucket"]


@pytest.fixture
def table_of(spark):
    """Rows ``(doc_id, text)`` as a table in several partitions, with further columns whose names operators use themselves."""

    def make(rows, parts=3):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES])

    return make


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents of the smallest scale as ``{doc_id: text}``."""
    return {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}


LONG = "lorem ipsum dolor sit amet " * 40_000
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "Hello world"), (4, "Hello world"), (None, "no id here"), (5, LONG), (6, "\U0001f600 日本 ﬁ \x1c\x00 é"), (7, "a"), (8, "x" * 50_000)]
