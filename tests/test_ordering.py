import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.operators.ordering import exact_quantiles, ranked, running_totals
from tallymark.operators.profile import ecdf, histogram, mode, summary
from tallymark.operators.splits import (
    holdout_side, smallest_hashes, undersample, with_contiguous_folds, with_folds, with_split,
)


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share one value, a third of the rows one group."""
    return spark.range(3000).select(
        F.col("id").alias("key"),
        F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.sin(F.col("id") * 1.7) * 50).alias("v"),
        F.when(F.col("id") % 3 == 1, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g")).repartition(6)


@pytest.fixture()
def many_partitions(spark):
    """Without coalescing, so that ranges really span partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_ranked(hot, many_partitions):
    got = ranked(hot, ["v", "key"], "rank").toPandas().sort_values(["v", "key"])
    assert got["rank"].tolist() == list(range(1, 3001))


def test_running_totals(hot, many_partitions):
    counts = hot.groupBy("g", "v").agg(F.count("*").alias("n"))
    got = running_totals(counts, ["v"], ["n"], ["g"]).toPandas().sort_values(["g", "v"])
    assert (got.groupby("g")["n"].cumsum() == got["cum_n"]).all()
    whole = running_totals(counts, ["g", "v"], ["n"]).toPandas().sort_values(["g", "v"])
    assert (whole["n"].cumsum() == whole["cum_n"]).all()


def test_quantiles(hot, many_partitions):
    """Groups ordered whole, and large groups ordered only around the wanted places."""
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    pdf = hot.toPandas()
    for r in exact_quantiles(hot, "v", probs, ["g"]).collect():
        want = np.quantile(pdf[pdf.g == r["g"]]["v"], probs)
        assert np.allclose([r[f"q{i}"] for i in range(len(probs))], want)
    r = exact_quantiles(hot, "v", probs, []).first()
    assert r["n"] == 3000 and np.allclose([r[f"q{i}"] for i in range(len(probs))], np.quantile(pdf["v"], probs))


def test_quantiles_of_large_groups(spark, many_partitions):
    df = spark.range(200_000).select((F.col("id") % 2).alias("g"), F.sin(F.col("id") * 0.77).alias("v")).repartition(7)
    pdf, probs = df.toPandas(), [0.25, 0.5, 0.75]
    for r in exact_quantiles(df, "v", probs, ["g"]).collect():
        assert np.allclose([r[f"q{i}"] for i in range(3)], np.quantile(pdf[pdf.g == r["g"]]["v"], probs), atol=1e-12)


def test_profile_edges(spark):
    one = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (2.0,), (None,)], "x double")
    assert mode(one.where("x is not null"), "x").first()["x"] == 1.0
    assert [r["percent"] for r in ecdf(one, "x").orderBy("value").collect()] == [50.0, 100.0]
    flat = spark.createDataFrame([(3.0,)] * 4, "x double")
    bins = histogram(flat, "x", 10).collect()
    assert sum(r["n"] for r in bins) == 4 and len(bins) == 10
    s = summary(flat, ["x"]).first()
    assert s["std"] == 0 and s["median"] == 3.0
    allnull = spark.createDataFrame([(None,), (None,)], "x double")
    assert summary(allnull, ["x"]).first()["n"] == 0


def test_split_ignores_layout(spark):
    df = spark.range(5000).withColumnRenamed("id", "key")
    a = with_folds(with_split(df, "key"), "key", 10).toPandas().sort_values("key")
    b = with_folds(with_split(df.repartition(13), "key"), "key", 10).toPandas().sort_values("key")
    assert a["split"].tolist() == b["split"].tolist() and a["fold"].tolist() == b["fold"].tolist()
    assert 0.17 < (a["split"] == "test").mean() < 0.23
    assert set(a["fold"]) == set(range(10))
    # The salts differ: the test side does not sit in a few folds.
    assert set(a[a["split"] == "test"]["fold"]) == set(range(10))
    assert df.where(holdout_side("key") == "test").count() == (a["split"] == "test").sum()


@pytest.mark.parametrize("n,k", [(10, 3), (9, 3), (2, 5)])
def test_contiguous_folds(spark, n, k):
    got = with_contiguous_folds(spark.range(n).withColumnRenamed("id", "key"), "key", k).toPandas().sort_values("key")
    want = np.concatenate([[i] * len(part) for i, part in enumerate(np.array_split(np.arange(n), k))]).astype(int)
    assert got["fold"].tolist() == want.tolist()


def test_smallest_hashes(spark):
    df = spark.range(20000).select(F.col("id").alias("key"), (F.col("id") % 4 == 0).cast("int").alias("c"))
    cut = smallest_hashes(df, "key", F.lit(1234), ["c"], "s").groupBy("c").count().toPandas()
    assert cut["count"].tolist() == [1234, 1234]
    assert smallest_hashes(df, "key", F.lit(0), ["c"], "s").count() == 0
    assert smallest_hashes(df, "key", F.lit(10**6), ["c"], "s").count() == 20000
    balanced = undersample(df, "key", "c").groupBy("c").count().toPandas()
    assert balanced["count"].tolist() == [5000, 5000]


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


@pytest.mark.parametrize("n,k", [(23, 5), (20, 4), (3, 7), (0, 3), (1, 1)])
def test_contiguous_folds_order_keys_only(spark, n, k):
    rows = [(f"k{(i * 37) % 101:03d}", i, "wide " * 50) for i in range(n)]
    df = spark.createDataFrame(rows, "key string, i int, wide string").repartition(3)
    folded = with_contiguous_folds(df, "key", k)
    got = [r["fold"] for r in folded.orderBy("key").collect()]
    size, extra = divmod(n, k)
    assert got == [f for f in range(k) for _ in range(size + (f < extra))]
    assert "rangepartitioning" not in plan(folded) and folded.columns == ["key", "i", "wide", "fold"]


def test_contiguous_folds_with_equal_and_missing_keys(spark):
    df = spark.createDataFrame([(None, i) for i in range(6)] + [(1, 10), (2, 11), (2, 12), (2, 13), (3, 14), (4, 15)], "key long, i int")
    got = {r["i"]: r["fold"] for r in with_contiguous_folds(df, "key", 4).collect()}
    assert {got[i] for i in range(6)} == {0} and len({got[11], got[12], got[13]}) == 1
    assert got[10] <= got[11] <= got[14] <= got[15] == 3


def test_summary_reads_its_source_twice(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5000).select((F.col("id") * F.col("id") % 977).cast("double").alias("a"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("b")).write.parquet(path)
    reads = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        reads.add(1)
        return x

    df = spark.read.parquet(path).withColumn("a", counted("a"))
    got = {r["column"]: r for r in summary(df, ["a", "b"]).collect()}
    values = sorted(i * i % 977 for i in range(5000))
    assert got["a"]["median"] == (values[2499] + values[2500]) / 2 and got["b"]["n"] == 3333 and got["a"]["max"] == 976
    assert reads.value <= 2 * 5000
