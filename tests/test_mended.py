"""Cases that once gave wrong results."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F, types as T

from tallymark.operators.diagnostics import metric_bars
from tallymark.operators.encode import Recipe, fit_encoder, fit_encoders
from tallymark.operators.estimators import Spec, training_rows
from tallymark.operators.mlp import fit_mlp
from tallymark.operators.splits import undersample
from tallymark.sources.tables import read_csv

PAIR = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.DoubleType())])


def write(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_csv_matches_columns_by_each_header(spark, tmp_path):
    path = write(tmp_path, a="k,v\n1,2.5\n", b="v,k\n20,3\n", c='"v","k"\n,4\n')
    assert sorted((r.k, r.v) for r in read_csv(spark, path, PAIR).collect() if r.v) == [(1, 2.5), (3, 20.0)]
    assert read_csv(spark, path).count() == 3


@pytest.mark.parametrize("row", ["1,abc", "1,1_000", "x,1", "1", "1,2,3"])
def test_csv_refuses_what_it_cannot_hold(spark, tmp_path, row):
    path = write(tmp_path, a=f"k,v\n1,2\n{row}\n")
    with pytest.raises(Exception):
        read_csv(spark, path, PAIR).collect()


def test_csv_rejects_become_null_on_request(spark, tmp_path):
    path = write(tmp_path, a="k,v\n1,abc\n")
    assert read_csv(spark, path, PAIR, rejects="null").first().v is None


def test_encoder_moments_skip_nulls(spark):
    df = spark.createDataFrame([(1.0, 0), (3.0, 0), (None, 0), (None, 0), (None, 1)], "x double, fold int")
    assert fit_encoder(df, Recipe(("x",))).scales["x"] == 1.0
    encoders = fit_encoders(df, Recipe(("x",)), "fold")  # fold 1 has no value at all
    assert encoders[1].means["x"] == 2.0 and encoders[0].means["x"] == 0.0


def test_undersampling_leaves_out_rows_without_a_label(spark):
    df = spark.range(1000).select(F.col("id").alias("key"), F.when(F.col("id") < 100, "a").when(F.col("id") < 600, "b").alias("c"))
    assert {r.c: r["count"] for r in undersample(df, "key", "c").groupBy("c").count().collect()} == {"a": 100, "b": 100}


@pytest.mark.parametrize("family", ["linear", "ols", "ridge", "polynomial"])
def test_linear_models_show_three_bars(spark, family):
    rows = [("m", side, metric, value) for side in ("cv", "test") for metric, value in (("mse", 2.0), ("mae", 1.0), ("r2", 0.5))]
    bars = metric_bars(spark.createDataFrame(rows, "model string, split string, metric string, value double"), family).collect()
    assert {(r.metric, r.cv, r.test) for r in bars} == {("mse", 2.0, 2.0), ("mae", 1.0, 1.0), ("primary_metric", 2.0, 2.0)}


@pytest.fixture(scope="module")
def network_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 3))
    y = x @ [1.0, -2.0, 0.5] + 0.1 * rng.normal(size=800)
    return spark.createDataFrame([(Vectors.dense(a), float(b), i % 10 == 0) for i, (a, b) in enumerate(zip(x, y))], ["features", "__y", "__valid"])


def test_network_does_not_depend_on_the_layout(network_rows):
    found = [fit_mlp(network_rows.repartition(n), {"hidden": [6], "max_iter": 3, "batch_size": 50}, 3)[0].flat for n in (4, 8, 16)]
    assert np.allclose(found[0], found[1], atol=1e-9) and np.allclose(found[0], found[2], atol=1e-9)


def test_network_scores_its_last_epoch(network_rows):
    model, log = fit_mlp(network_rows, {"hidden": [6], "max_iter": 3, "batch_size": 50, "learning_rate": 0.05}, 3)
    assert all(score is not None for _, _, score in log)
    assert model.valid_r2 == max(score for _, _, score in log)


def test_encoder_takes_any_number_of_levels(spark):
    df = spark.range(6000).select(F.concat(F.lit("level"), "id").alias("c"))
    encoder = fit_encoder(df, Recipe(categorical=("c",)))
    assert encoder.width == 6000
    row = encoder.transform(df.where("c = 'level4321'")).first()
    assert [encoder.names[i] for i in row["features"].indices] == ["c_level4321"]


def test_report_compares_with_the_majority_class(spark):
    from tallymark.operators.estimators import Spec
    from tallymark.plans.report import report_lines

    values = {"test": {"accuracy": 0.9, "f1": 0.5, "roc_auc": 0.75}, "baseline": {"majority_class": 0.0, "accuracy": 0.8, "f1": 0.0, "roc_auc": 0.5}}
    rows = [("m", split, None, metric, v) for split, own in values.items() for metric, v in own.items()]
    metrics = spark.createDataFrame(rows, "model string, split string, fold int, metric string, value double")
    lines = [r.text for r in report_lines(metrics, Spec("m", "logistic", "y", ("x",)), "now").collect() if r.section == "majority baseline"]
    assert [" ".join(t.split()) for t in lines] == [
        "Always class 0", "Accuracy: 0.8000", "F1 Score: 0.0000", "ROC-AUC: 0.5000", "Accuracy gain: +12.50%", "F1 Score gain: N/A", "ROC-AUC gain: +50.00%"]


def test_training_puts_the_baseline_among_the_metrics(spark):
    from tallymark.operators.estimators import Spec
    from tallymark.plans.train import train_and_score

    df = spark.range(600).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 7 > 4).cast("int").alias("y"))
    metrics = train_and_score(df, Spec("m", "logistic", "y", ("x",)), "id", k=3).metrics
    own = {r.metric: r.value for r in metrics.where("split = 'baseline'").collect()}
    assert own["majority_class"] == 0.0 and own["f1"] == 0.0 and own["roc_auc"] == 0.5 and 0.6 < own["accuracy"] < 0.8


@pytest.mark.parametrize("family", ["gbt", "forest"])
def test_tasks_of_a_tree_model_hold_no_more_rows_as_the_table_grows(spark, family):
    df = spark.range(0, 1_000_001, 1, 1).select((F.col("id") % 2).cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    spec = Spec("m", family, "y", ("x",))
    rows = training_rows(df, spec, fit_encoder(df, spec.recipe(df), "y"))
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 250_000 and sum(sizes) == 1_000_001
