import pytest
from pyspark.sql import functions as F, types as T

from tallymark.operators.estimators import Spec, fit
from tallymark.plans import grid as G, train as P
from tallymark.plans.catalogue import PREDICTOR_SETS
from tallymark.plans.eda import explore
from tallymark.plans.main import analyse
from tallymark.plans.report import report_lines
from tallymark.sources.fixtures import COUNT, KEY, LOG, order_fact
from tallymark.sources.sinks import artifact_path, write_report
from tallymark.sources.tables import read_csv
from tallymark.streaming import score_stream


@pytest.fixture(scope="module")
def orders(spark, folder):
    return order_fact(spark, folder).cache()


def test_oof_covers_every_row_once(orders):
    spec = Spec("m", "ols", COUNT, ("o_totalprice",))
    oof = P.out_of_fold(orders, spec, KEY, 5)
    assert oof.count() == oof.select(KEY).distinct().count() == orders.count()


def test_empty_fold(spark, orders):
    """More folds than rows in a small table: missing folds are simply not fitted."""
    few = orders.orderBy(KEY).limit(12)
    oof = P.out_of_fold(few, Spec("m", "ols", COUNT, ("o_totalprice",)), KEY, 50)
    assert oof.count() == 12


def test_grid_ranks_by_error(orders):
    spec = Spec("m", "ridge", COUNT, ("o_totalprice", "c_acctbal"))
    s = G.summarise(G.grid_search(orders, spec, {"alpha": [1.0, 1e7]}, KEY, 3, with_train=True)).orderBy("rank").collect()
    assert [r["rank"] for r in s] == [1, 2] and s[0]["cv_mse"] <= s[1]["cv_mse"] and s[0]["train_mse"] is not None
    assert len(G.expand(G.GRIDS["gbt"])) == 64 and len(G.expand(G.GRIDS["forest"])) == 432
    assert len(G.expand(G.GRIDS["mlp"])) == 800 and len(G.expand(G.GRIDS["elastic_net"])) == 20


def test_analysis(spark, orders, tmp_path):
    a = analyse(orders, "2020-01-01 00:00:00", PREDICTOR_SETS[:2], k=2)
    assert set(a.best) == {"poisson", "ols", "logistic"}
    assert a.comparison.count() == 9
    text = [r["text"] for r in a.reports[f"{a.best['logistic'].spec.name}_best"].collect()]
    assert any("BEST MODEL" in t for t in text) and any("ROC-AUC" in t for t in text)
    path = str(tmp_path / "report")
    write_report(a.reports["baseline"], path)
    assert "Poisson Deviance" in "\n".join(r["value"] for r in spark.read.text(path).collect())


def test_log_report_has_original_scale(orders):
    spec = Spec("log_model", "ols", LOG, ("o_totalprice",), log_label=True)
    result = P.train_and_score(orders, spec, KEY, 2)
    sections = {r["section"] for r in report_lines(result.metrics, spec, "now").collect()}
    assert {"test set, original scale", "cross-validation, original scale", "warnings"} <= sections


def test_tune_and_train(orders):
    sides = P.with_split(orders, KEY)
    summary, results = G.tune_and_train(
        sides, Spec("net", "elastic_net", COUNT, ("o_totalprice", "c_acctbal")), {"alpha": [0.01, 0.1], "l1_ratio": [0.5]}, KEY, 2, 2)
    assert summary.count() == 2 and [r.spec.name for r in results] == ["net_rank1", "net_rank2"]


def test_explore(orders):
    tables = explore(orders, ["o_totalprice", "c_acctbal", "o_orderpriority"], COUNT, LOG)
    assert tables["correlations"].count() == 4 and tables["effects"].count() == 1
    assert {r["strength"] for r in tables["correlations"].collect()} <= {"strong", "moderate", "weak"}


def test_csv(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    with open(path, "w") as f:
        f.write("a,b,c,d\n1,2.5,x,NA\n2,,NaN,3\nN/A,4,y,\n")
    df = read_csv(spark, path)
    assert [f.dataType for f in df.schema.fields] == [T.DoubleType(), T.DoubleType(), T.StringType(), T.DoubleType()]
    assert [tuple(r) for r in df.collect()] == [(1.0, 2.5, "x", None), (2.0, None, None, 3.0), (None, 4.0, "y", None)]


def test_artifact_path():
    assert artifact_path("r", "boosting", "m") == "r/boosting"
    assert artifact_path("r", "poisson", "m", 3) == "r/non_best/m"
    assert artifact_path("r", "poisson", "m", best=True) == "r/best/m"


def test_streamed_scores_equal_batch(spark, orders, tmp_path):
    spec = Spec("m", "poisson", COUNT, ("o_totalprice", "o_orderpriority"))
    fitted = fit(orders, spec)
    rows = orders.select(KEY, *spec.predictors)
    source = str(tmp_path / "in")
    rows.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    q = (score_stream(stream, fitted).writeStream.format("memory").queryName("scores")
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = spark.table("scores").agg(F.count("*").alias("n"), F.round(F.sum("yhat"), 6).alias("s")).first()
    want = fitted.predict(rows).agg(F.count("*").alias("n"), F.round(F.sum("yhat"), 6).alias("s")).first()
    assert got == want
    with pytest.raises(ValueError):
        score_stream(rows, fitted)
