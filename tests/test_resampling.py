import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallymark.operators import neighbours
from tallymark.operators.neighbours import nearest, nearest_by
from tallymark.operators.smote import smote


@pytest.mark.parametrize("block_rows,dims", [(4096, 3), (40, 3), (25, 12)])
def test_nearest_matches_brute_force(spark, block_rows, dims):
    """Clustered points, a third of them in one tight cluster, in few and in many blocks."""
    rng = np.random.default_rng(dims)
    centres = rng.normal(0, 20, (6, dims))
    which = np.where(np.arange(300) % 3 == 0, 0, rng.integers(1, 6, 300))
    x = centres[which] + rng.normal(0, np.where(which == 0, 0.01, 2.0)[:, None], (300, dims))
    ids = [f"p{i:03d}" for i in range(300)]
    points = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x)], "pid string, vec array<double>")
    got = nearest(points, 5, block_rows).toPandas().sort_values(["pid", "place"])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert len(got) == 1500
    for i, rows in got.groupby("pid"):
        order = np.argsort(d[ids.index(i)], kind="stable")[:5]
        assert [ids[j] for j in order] == rows["nn"].tolist()


def test_fewer_points_than_neighbours(spark):
    points = spark.createDataFrame([("a", [0.0]), ("b", [1.0])], "pid string, vec array<double>")
    assert sorted(map(tuple, nearest(points, 5).select("pid", "nn").collect())) == [("a", "b"), ("b", "a")]


def test_smote(spark):
    """A third of the small class are copies of one row; synthetic rows lie between two rows of the class."""
    rng = np.random.default_rng(1)
    rows = [(i, 1, 1.0, 2.0) if i % 3 == 0 else (i, 1, float(rng.normal()), float(rng.normal())) for i in range(60)]
    rows += [(i, 0, float(rng.normal(9)), float(rng.normal(9))) for i in range(60, 260)]
    df = spark.createDataFrame(rows, "key long, c int, a double, b double").repartition(5)
    out = smote(df, "key", "c", ["a", "b"]).toPandas()
    assert (out["c"] == 1).sum() == (out["c"] == 0).sum() == 200
    made = out[out["step"].notna()]
    assert len(made) == 140 and set(made["c"]) == {1} and out["key"].is_unique
    assert made["step"].between(0, 1, inclusive="left").all()
    small = np.array([[r[2], r[3]] for r in rows[:60]])
    base = {str(r[0]): np.array(r[2:]) for r in rows}
    for r in made.itertuples():
        start, at = base[r.key.split("#")[0]], np.array([r.a, r.b])
        if r.step > 1e-6:
            end = start + (at - start) / r.step
            assert np.min(np.abs(small - end).sum(axis=1)) < 1e-6
    again = smote(df.repartition(3), "key", "c", ["a", "b"]).toPandas()
    assert np.allclose(again.sort_values("key")["a"], out.sort_values("key")["a"])
    lonely = df.where("c = 0 OR key = 1")
    grown = smote(lonely, "key", "c", ["a", "b"])
    assert grown.where("c = 1").agg(F.countDistinct("a")).first()[0] == 1 and grown.where("c = 1").count() == 200


def test_all_classes_grow_in_one_job(spark):
    """More classes than any limit, of one to four rows, and rows without a label."""
    rows = [(c * 10 + i, c, float(c + i), float(i)) for c in range(1200) for i in range(1 + c % 4)] + [(90_000, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "key long, c int, a double, b double").repartition(4)
    out = smote(df, "key", "c", ["a", "b"], k=2)
    got = {r["c"]: (r["n"], r["low"], r["high"], r["made"]) for r in out.groupBy("c").agg(
        F.count("*").alias("n"), F.min(F.col("a") - F.col("c")).alias("low"), F.max(F.col("a") - F.col("c")).alias("high"), F.count("step").alias("made")).collect()}
    assert got.pop(None) == (1, None, None, 0)
    assert got == {c: (4, 0.0, float(c % 4), 3 - c % 4) for c in range(1200)}
    assert out.select("key").distinct().count() == 4801


@pytest.mark.parametrize("block_rows", [1000, 30])
def test_neighbours_within_groups(spark, block_rows):
    rng = np.random.default_rng(8)
    x, g = rng.normal(size=(150, 3)), rng.choice(["a", "b", "c"], 150, p=[0.6, 0.3, 0.1])
    points = spark.createDataFrame([(v, f"p{i:03d}", [float(w) for w in r]) for i, (v, r) in enumerate(zip(g, x))], "g string, pid string, vec array<double>")
    got = nearest_by(points, "g", 4, block_rows).toPandas().sort_values(["pid", "place"])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    d[g[:, None] != g[None]] = np.inf
    np.fill_diagonal(d, np.inf)
    for pid, rows in got.groupby("pid"):
        assert rows["nn"].tolist() == [f"p{j:03d}" for j in np.argsort(d[int(pid[1:])], kind="stable")[:4]]
    assert len(got) == 600


def test_a_search_holds_few_distances_at_a_time():
    """A block of 4,096 points against itself: all distances and their order at once would take 256 MB."""
    rng = np.random.default_rng(0)
    block = pd.DataFrame({"pid": [f"{i:04d}" for i in range(4096)], "vec": list(rng.random((4096, 3)))})
    tracemalloc.start()
    try:
        found = neighbours._search(block, block, 2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found) == 8192 and peak < 100e6
