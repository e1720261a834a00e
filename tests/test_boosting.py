"""Ensembles grown side by side equal MLlib's, and take as many jobs for a large grid as for a small one."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.operators import boosting
from tallymark.operators.encode import fit_encoder
from tallymark.operators.estimators import SEED, Spec, fit_rows, training_rows
from tallymark.plans import grid as G

COLUMNS = ("a", "b", "few", "flat", "g", "h")


@pytest.fixture(scope="module")
def data(spark):
    i = F.col("id")
    df = spark.range(0, 12_500, 1, 5).select(
        i.alias("key"), F.sin(i * 1.37).alias("a"), F.greatest(F.cos(i * 0.61), F.lit(0.0)).alias("b"), (i % 4).cast("double").alias("few"),
        F.lit(3.0).alias("flat"), F.concat(F.lit("g"), (i * 7 % 5).cast("string")).alias("g"), F.concat(F.lit("h"), (i * 11 % 3).cast("string")).alias("h"))
    y = F.round(3 * F.col("a") + F.when(F.col("g") == "g2", 2 * F.col("b")).otherwise(-F.col("few")) + F.sin(F.col("key") * 2.9), 3)
    return df.withColumn("y", y).persist()


@pytest.mark.parametrize("scale", [True, False])
def test_every_ensemble_is_the_one_that_mllib_fits(data, scale):
    """More rows than the sample for candidate splits, several partitions, zeros, flags, and checkpoints under way."""
    spec = Spec("m", "gbt", "y", COLUMNS)
    recipe = spec.recipe(data)
    encoder = fit_encoder(data, recipe if scale else type(recipe)(**{**recipe.__dict__, "scale": False}), "y")
    rows = training_rows(data, spec, encoder).persist()
    settings = [boosting.Setting(12, 0.3, 1), boosting.Setting(4, 0.1, 4), boosting.Setting(2, 0.5, 3)]
    grown, splits = boosting.grow(rows, settings, {}, SEED)
    local = rows.collect()
    bins = boosting._binned(np.array([r["features"].toArray() for r in local]), splits)
    for trees, s in zip(grown, settings):
        model = fit_rows(rows, spec.with_params(n_estimators=s.trees, learning_rate=s.rate, max_depth=s.depth), encoder).model
        want = [r["prediction"] for r in model.transform(rows).collect()]
        assert np.allclose(boosting._guesses(bins, trees, s, [s.trees])[0], want, rtol=1e-9, atol=1e-9)
    rows.unpersist()


def test_sums_of_many_partitions_are_added_by_tasks(data):
    spec = Spec("m", "gbt", "y", COLUMNS)
    encoder = fit_encoder(data, spec.recipe(data), "y")
    rows = training_rows(data.where("key < 2000"), spec, encoder).repartition(boosting.ADDED_TOGETHER + 8).persist()
    setting = boosting.Setting(2, 0.5, 2)
    grown, splits = boosting.grow(rows, [setting], {}, SEED)
    local = rows.collect()
    want = fit_rows(rows, spec.with_params(n_estimators=2, learning_rate=0.5, max_depth=2), encoder).model.transform(rows).collect()
    bins = boosting._binned(np.array([r["features"].toArray() for r in local]), splits)
    assert np.allclose(boosting._guesses(bins, grown[0], setting, [2])[0], [r["prediction"] for r in want], rtol=1e-9, atol=1e-9)
    rows.unpersist()


def test_a_larger_grid_takes_no_more_jobs(spark, data):
    def jobs(rates: list[float]) -> int:
        group = f"grid of {len(rates)}"
        spark.sparkContext.setJobGroup(group, group)
        grid = {"n_estimators": [2, 3], "learning_rate": rates, "max_depth": [2]}
        found = G.grid_search(data, Spec("m", "gbt", "y", COLUMNS), grid, "key", 2).collect()
        assert len(found) == 4 * len(rates) and all(json.loads(r["params"]) == G.expand(grid)[r["grid_index"]] for r in found)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    try:
        assert jobs([0.1, 0.2, 0.3, 0.4]) <= jobs([0.1]) + 2
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_columns_beyond_a_byte_are_left_to_mllib(spark):
    rows = spark.range(4).select(F.col("id").cast("double").alias("y"), *[(F.col("id") * (i + 1)).cast("double").alias(f"x{i}") for i in range(300)])
    spec = Spec("m", "gbt", "y", tuple(c for c in rows.columns if c != "y"))
    assert not boosting.supported(training_rows(rows, spec, fit_encoder(rows, spec.recipe(rows), "y")), [{}])
    narrow = Spec("m", "gbt", "y", ("x0", "x1"))
    train = training_rows(rows, narrow, fit_encoder(rows, narrow.recipe(rows), "y"))
    assert boosting.supported(train, [{}]) and not boosting.supported(train, [{"max_features": "log2"}])


def test_missing_labels_are_an_error(spark):
    rows = spark.range(40).select(F.col("id").cast("double").alias("x"), F.when(F.col("id") != 7, F.col("id").cast("double")).alias("y"))
    spec = Spec("m", "gbt", "y", ("x",))
    train = training_rows(rows, spec, fit_encoder(rows, spec.recipe(rows), "y"))
    with pytest.raises(Exception, match="present and finite"):
        boosting.grow(train, [boosting.Setting(1, 0.1, 1)], {}, SEED)


def test_the_registered_grid_is_the_published_one_over_ten_folds(spark, folder, monkeypatch):
    """Every point as published, none shortened; the search itself is looked at, not run."""
    from tallymark.queries import QUERIES, selecting

    seen = []
    monkeypatch.setattr(selecting.G, "grid_search", lambda df, spec, grid, key, k, **_: seen.append((spec.family, grid, k)) or "found")
    monkeypatch.setattr(selecting.G, "summarise", lambda found: found)
    monkeypatch.setattr(selecting, "rounded", lambda found: found)
    assert QUERIES["h4_boosting_grid"](spark, folder) == "found"
    assert seen == [("gbt", {"n_estimators": [300, 500, 800, 1200], "learning_rate": [0.01, 0.03, 0.05, 0.1], "max_depth": [1, 2, 3, 4]}, 10)]


@pytest.mark.parametrize("bound", ["CELLS", "CODES", "GUESSES"])
def test_many_cells_are_grown_level_by_level(data, monkeypatch, bound):
    """Over cells and over rows the same trees grow, in several blocks of rounds and with ensembles of several tasks."""
    spec = Spec("m", "gbt", "y", COLUMNS)
    rows = training_rows(data.where("key < 1500"), spec, fit_encoder(data, spec.recipe(data), "y")).persist()
    settings = [boosting.Setting(n, 0.3, d) for n, d in [(9, 1), (3, 2), (10, 3)]]
    monkeypatch.setattr(boosting, "TOGETHER", 2)
    monkeypatch.setattr(boosting, "BLOCK", 8)
    grown, splits = boosting.grow(rows, settings, {}, SEED)
    monkeypatch.setattr(boosting, bound, 0)
    by_levels, _ = boosting.grow(rows, settings, {}, SEED)
    bins = boosting._binned(np.array([r["features"].toArray() for r in rows.collect()]), splits)
    for trees, others, s in zip(grown, by_levels, settings):
        assert len(trees) == len(others) == s.trees
        for a, b in zip(boosting._guesses(bins, trees, s, [1, s.trees]), boosting._guesses(bins, others, s, [1, s.trees])):
            assert np.allclose(a, b, rtol=1e-9, atol=1e-9)
    rows.unpersist()


def test_a_hundred_times_the_rounds_take_few_more_jobs(spark, data):
    def jobs(length: int) -> int:
        group = f"{length} rounds"
        spark.sparkContext.setJobGroup(group, group)
        grid = {"n_estimators": [length, length // 3], "learning_rate": [0.1], "max_depth": [1, 2]}
        assert G.grid_search(data.where("key < 600"), Spec("m", "gbt", "y", COLUMNS), grid, "key", 2).count() == 8
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    try:
        assert jobs(300) <= jobs(3) + 2
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_scores_from_cells_are_those_from_trees(data, monkeypatch):
    """Also for rows whose bins no training row has, for a length of 0, and with the training side."""
    grid = {"n_estimators": [0, 2, 5], "learning_rate": [0.3], "max_depth": [1, 3]}
    search = lambda: sorted(G.grid_search(data.where("key < 900"), Spec("m", "gbt", "y", COLUMNS), grid, "key", 2, with_train=True).collect())
    found = search()
    monkeypatch.setattr(boosting, "CELLS", 0)
    want = search()
    assert len(found) == len(want) == 6 * 2 * 2
    for a, b in zip(found, want):
        assert a[:5] == b[:5] and np.allclose([x for x in a[5:] if x is not None], [x for x in b[5:] if x is not None], rtol=1e-9)


def test_bags_are_sparks_draws():
    bags = boosting._Bags([7, 8, -3], 0.8)
    drawn = np.unpackbits(np.concatenate([bags.draw(n) for n in (5, 0, 1500, 2)]), axis=1, count=3)
    for i, seed in enumerate((7, 8, -3)):
        single = boosting._Shift(seed)
        assert [single.uniform() < 0.8 for _ in range(len(drawn))] == drawn[:, i].astype(bool).tolist()


def test_a_cell_of_most_rows_goes_to_several_tasks(spark):
    """Nine rows in ten have the same bins; their bags are dealt out, and the trees are MLlib's still."""
    i = F.col("id")
    rows = spark.range(0, 4000, 1, 8).select(F.when(i % 10 == 0, i % 7).otherwise(3).cast("double").alias("x"), (F.sin(i * 1.0) + i % 3).alias("y"))
    spec = Spec("m", "gbt", "y", ("x",))
    encoder = fit_encoder(rows, spec.recipe(rows), "y")
    train = training_rows(rows, spec, encoder).persist()
    plan = boosting._planned(train, {}, SEED)
    cells = boosting._cells(train, [], plan, 1)
    hot = cells.n.max()
    sent = spark.sparkContext.broadcast((cells.bins, cells.centre, np.maximum(1, -(-cells.n * 8 // 4000))))
    dealt = boosting._dealt(train, sent, plan, 2, 8)
    largest = max(r["n"] for r in dealt.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect())
    assert hot > 3000 and largest < hot * 0.6
    dealt.unpersist()
    (trees,), splits = boosting.grow(train, [boosting.Setting(3, 0.5, 2)], {}, SEED)
    model = fit_rows(train, spec.with_params(n_estimators=3, learning_rate=0.5, max_depth=2), encoder).model
    bins = boosting._binned(np.array([r["features"].toArray() for r in train.collect()]), splits)
    want = [r["prediction"] for r in model.transform(train).collect()]
    assert np.allclose(boosting._guesses(bins, trees, boosting.Setting(3, 0.5, 2), [3])[0], want, rtol=1e-9, atol=1e-9)
    train.unpersist()
