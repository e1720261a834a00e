"""Levels that stay in Spark: the dictionary, joins by it, and models on sparse vectors."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tallymark.operators import encode, estimators as E
from tallymark.operators.encode import Recipe, WideEncoder, fit_encoder, fit_encoders
from tallymark.operators.estimators import Spec, fit
from tallymark.operators.joins import looked_up
from tallymark.session import stage


def vectors(encoder, df, key="id"):
    rows = encoder.transform(df).select(key, vector_to_array("features").alias("v"))
    return {r[key]: r["v"] for r in rows.collect()}


@pytest.fixture(scope="module")
def mixed(spark):
    """A column of many levels, one level in a third of the rows, nulls, and a column of few levels."""
    level = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") == 7, F.lit(None)).otherwise(F.concat(F.lit("l"), F.col("id") % 40))
    return spark.range(300).select("id", level.alias("g"), (F.col("id") % 2).cast("string").alias("h"), (F.col("id") * 0.5).alias("x"),
                                   (F.col("id") % 5).cast("double").alias("p")).cache()


@pytest.mark.parametrize("levels", ["all", "drop_first"])
def test_wide_and_listed_encoders_agree(spark, mixed, monkeypatch, levels):
    recipe = Recipe(("x",), ("g", "h"), levels=levels, passthrough=("p",))
    listed = fit_encoder(mixed, recipe, "p")
    monkeypatch.setattr(encode, "LISTED_LEVELS", 10)
    wide = fit_encoder(mixed, recipe, "p")
    assert isinstance(wide, WideEncoder) and wide.width == listed.width and (wide.label_mean, wide.label_std) == (listed.label_mean, listed.label_std)
    other = mixed.where("id > 250").union(spark.createDataFrame([(1000, "new", "0", 1.0, 2.0)], mixed.schema))
    ours, theirs = vectors(wide, other), vectors(listed, other)
    assert ours.keys() == theirs.keys() and all(np.allclose(ours[k], theirs[k]) for k in ours)
    names = [(r["slot"], r["feature"], r["source"]) for r in wide.names_table(spark).orderBy("slot").collect()]
    assert names == list(zip(range(listed.width), listed.names, listed.sources))


def test_folds_and_unknown_levels(mixed, monkeypatch):
    monkeypatch.setattr(encode, "LISTED_LEVELS", 10)
    folded = mixed.withColumn("fold", (F.col("id") % 4).cast("int"))
    encoders = fit_encoders(folded, Recipe(("x",), ("g",)), "fold", "p")
    assert set(encoders) == {-1, 0, 1, 2, 3} and len({e.width for e in encoders.values()}) == 1
    assert abs(encoders[2].means["x"] - folded.where("fold <> 2").agg(F.avg("x")).first()[0]) < 1e-9
    strict = fit_encoder(mixed.where("id < 30"), Recipe(categorical=("g",), unknown="error"))
    assert strict.transform(mixed.where("id < 30 AND id <> 7")).count() == 29
    with pytest.raises(Exception, match="unseen level in g"):
        strict.transform(mixed).select("features").collect()
    with pytest.raises(Exception, match="null in a numeric predictor"):
        fit_encoder(mixed, Recipe(("x",), ("g",))).transform(mixed.withColumn("x", F.lit(None).cast("double"))).select("features").collect()


def test_models_on_wide_vectors(spark, mixed, monkeypatch):
    spec = Spec("m", "ridge", "y", ("x", "g", "h"), {"alpha": 2.0})
    df = mixed.where("g IS NOT NULL").withColumn("y", F.col("x") * 0.1 + F.when(F.col("g") == "hot", 3.0).otherwise(0.0) + F.sin("id"))
    listed = {r["feature"]: r["coefficient"] for r in E.coefficient_table(fit(df, spec), spark).collect()}
    monkeypatch.setattr(encode, "LISTED_LEVELS", 10)
    fitted = fit(df, spec)
    wide = {r["feature"]: r["coefficient"] for r in E.coefficient_table(fitted, spark).collect()}
    assert wide.keys() == listed.keys() and all(abs(wide[k] - listed[k]) < 1e-6 for k in wide)
    assert fitted.predict(df).where("yhat IS NULL").count() == 0


def test_a_million_levels(spark):
    n = 1_000_000
    df = spark.range(0, n + 200, 1, 16).select("id", F.when(F.col("id") < n, F.format_string("u%07d", "id")).otherwise(F.lit("u0000005")).alias("g"))
    e = fit_encoder(df, Recipe(categorical=("g",)))
    assert isinstance(e, WideEncoder) and e.width == n and e.counts == {"g": n}
    ones = e.transform(df).select("id", F.get_json_object(F.to_json(F.struct("features")), "$.features.indices[0]").cast("int").alias("slot"))
    wrong = ones.where(F.col("slot") != F.when(F.col("id") < n, F.col("id")).otherwise(F.lit(5)))
    assert wrong.count() == 0
    held = [v for v in vars(e).values() if isinstance(v, (list, dict, set))]
    assert sum(len(v) for v in held) <= 1


def test_no_key_overloads_a_lookup(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"), F.lit("kept").alias("v"))
    groups = stage(rows.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")))
    got = looked_up(rows, groups, "k")
    assert got.columns == ["id", "k", "v", "top"] and got.count() == 6000
    wrong = got.where(~F.col("top").eqNullSafe(F.when(F.col("k") == "hot", 5997).when(F.col("k").isNotNull(), F.col("id"))))
    assert wrong.count() == 0
    assert looked_up(rows, stage(groups.where("false")), "k").where("top IS NOT NULL").count() == 0
