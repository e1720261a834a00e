import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.functions.columns import normal_quantile, split_by_type
from tallymark.operators import diagnostics as D, metrics as M


@pytest.fixture(scope="module")
def preds(spark):
    rng = np.random.default_rng(5)
    y = rng.poisson(3, 300)
    yhat = np.exp(rng.normal(1, 0.3, 300))
    p = rng.random(300).round(2)
    b = (rng.random(300) < p).astype(int)
    rows = [(i, float(a), float(m), float(q), int(c)) for i, (a, m, q, c) in enumerate(zip(y, yhat, p, b))]
    return spark.createDataFrame(rows, "key long, y double, yhat double, p double, b int").cache(), y, yhat, p, b


def test_regression(preds):
    df, y, m, *_ = preds
    r = M.evaluate(df, M.COUNT).first()
    dev = np.mean(2 * (np.where(y > 0, y * np.log(np.maximum(y, 1) / m), 0) - y + m))
    assert np.isclose(r["mse"], np.mean((y - m) ** 2)) and np.isclose(r["poisson_deviance"], dev)
    assert np.isclose(r["r2"], 1 - np.sum((y - m) ** 2) / np.sum((y - y.mean()) ** 2)) and r["r2"] <= 1
    moved = D.residuals(df.withColumn("yhat", F.col("yhat") + 2)).agg(F.avg("residual")).first()[0]
    assert np.isclose(moved, np.mean(y - m) - 2)


def test_degenerate(spark, preds):
    flat = spark.createDataFrame([(2.0, 2.0), (2.0, 3.0)], "y double, yhat double")
    r = M.evaluate(flat, M.COUNT).first()
    assert r["r2"] == 0.0 and r["pseudo_r2"] is None
    exact = spark.createDataFrame([(2.0, 2.0)] * 2, "y double, yhat double")
    assert M.evaluate(exact, M.REGRESSION).first()["r2"] == 1.0
    zero = spark.createDataFrame([(0.0, -1.0)], "y double, yhat double")
    assert np.isclose(M.evaluate(zero, {"d": M.poisson_deviance}).first()["d"], 2e-9)
    small = spark.createDataFrame([(1.0, 0.5), (2.0, 1.5)], "y double, yhat double")
    assert M.with_adjusted_r2(M.evaluate(small, M.REGRESSION), 1).first()["adj_r2"] is None
    nobody = spark.createDataFrame([(1, 0, 0.1), (0, 0, 0.2)], "y int, yhat int, p double")
    c = M.classification(nobody, "y", "yhat").first()
    assert c["precision"] == 0 and c["f1"] == 0
    single = spark.createDataFrame([(1, 0.1), (1, 0.2)], "y int, p double")
    assert M.roc_auc(single, "y", "p").first()["roc_auc"] is None
    assert M.best_threshold(spark.createDataFrame([(0, 0.05)], "y int, p double"), "y", "p").first()["threshold"] == 0.5


def test_auc_and_invariance(preds):
    df, _, _, p, b = preds
    pos, neg = p[b == 1], p[b == 0]
    want = np.mean((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None]))
    assert np.isclose(M.roc_auc(df, "b", "p").first()["roc_auc"], want)
    curved = df.withColumn("p", F.exp(F.col("p") * 3))
    assert np.isclose(M.roc_auc(curved, "b", "p").first()["roc_auc"], want)
    pts = M.roc_curve(df, "b", "p").toPandas().sort_values("threshold", ascending=False)
    f, t = np.r_[0, pts["fpr"]], np.r_[0, pts["tpr"]]
    assert np.isclose(np.sum(np.diff(f) * (t[1:] + t[:-1]) / 2), want)


@pytest.mark.parametrize("metric", ["f1", "precision", "recall", "balanced"])
def test_threshold(preds, metric):
    df, _, _, p, b = preds
    best, at = 0.0, 0.5
    for t in np.linspace(0.1, 0.9, 81):
        hat = p >= t
        tp, fp, fn = (hat & (b == 1)).sum(), (hat & (b == 0)).sum(), (~hat & (b == 1)).sum()
        s = {"f1": 2 * tp / (2 * tp + fp + fn), "balanced": 2 * tp / (2 * tp + fp + fn),
             "precision": tp / (tp + fp) if tp + fp else 0, "recall": tp / (tp + fn)}[metric]
        if s > best:
            best, at = s, t
    r = M.best_threshold(df, "b", "p", metric).first()
    assert np.isclose(r["threshold"], at) and np.isclose(r["score"], best)


def test_normal_quantile(spark):
    ps = [1e-12, 1e-6, 0.01, 0.07, 0.3, 0.5, 0.9, 0.975, 1 - 1e-9]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal_quantile("p").alias("z")).collect()
    for r in got:
        assert math.isclose(r["z"], NormalDist().inv_cdf(r["p"]), rel_tol=1e-9, abs_tol=1e-12)


def test_qq(preds):
    df, y, *_ = preds
    got = D.qq_points(df, "y", "key").toPandas().sort_values("rank")
    n = len(y)
    med = (np.arange(1, n + 1) - 0.3175) / (n + 0.365)
    med[-1] = 0.5 ** (1 / n)
    med[0] = 1 - med[-1]
    want = np.array([NormalDist().inv_cdf(v) for v in med])
    assert np.allclose(got["theoretical"], want) and np.allclose(got["ordered"], np.sort(y))
    line = D.qq_line(D.qq_points(df, "y", "key")).first()
    assert np.allclose([line["slope"], line["intercept"]], np.polyfit(want, np.sort(y), 1))


def test_count_panel_needs_two_classes(spark):
    one = spark.createDataFrame([(1.0, 1.0), (2.0, 5.0)], "y double, yhat double")
    assert M.count_panel(one, "y", "yhat", 3).count() == 0
    two = spark.createDataFrame([(1.0, 1.0), (4.0, 5.0)], "y double, yhat double")
    assert sorted(tuple(r) for r in M.count_panel(two, "y", "yhat", 3).collect()) == [(0, 0, 0.2), (1, 1, 1.0)]


def test_kinds(spark):
    df = spark.createDataFrame([(True, 1, "a")], "flag boolean, n int, s string")
    assert split_by_type(df) == (["flag", "n"], ["s"])
