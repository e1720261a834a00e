"""Fitted optima against direct NumPy computations."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tallymark.operators import estimators as E
from tallymark.operators.encode import Recipe, fit_encoder, fit_encoders, monomials
from tallymark.operators.estimators import Spec, fit
from tallymark.operators import mlp
from tallymark.operators.mlp import (
    Adam, fit_mlp, fit_mlps, forward, gradient_sum, initial_weights, layer_shapes, network_scores, parameter_count, shards_for,
    weight_mask,
)
from tallymark.operators.selection import backward_selection, drop_redundant
from tallymark.operators.splits import with_folds


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 400
    x1, x2, x3 = rng.normal(5, 2, n), rng.normal(0, 1, n), rng.normal(-3, 0.5, n)
    g = rng.choice(["a", "b", "c_1"], n)
    shift = np.select([g == "a", g == "b"], [0.4, -0.3], 0.0)
    y = rng.poisson(np.exp(0.3 + 0.1 * (x1 - 5) + 0.3 * x2 + shift))
    z = (rng.random(n) < 1 / (1 + np.exp(-(0.8 * x2 + shift - 0.7)))).astype(int)
    rows = [(i, float(a), float(b), float(c), str(d), int(e), int(f)) for i, (a, b, c, d, e, f) in enumerate(zip(x1, x2, x3, g, y, z))]
    df = spark.createDataFrame(rows, "key long, x1 double, x2 double, x3 double, g string, y int, z int").repartition(4).cache()
    design = np.column_stack([(v - v.mean()) / v.std() for v in (x1, x2, x3)] + [(g == v).astype(float) for v in ("a", "b", "c_1")])
    return df, design, y.astype(float), z.astype(float)


PREDICTORS = ("x1", "x2", "x3", "g")


def coefs(fitted):
    return np.array(fitted.model.coefficients.toArray()), float(fitted.model.intercept)


def test_poisson_penalty(data):
    df, x, y, _ = data
    b, a, alpha = np.zeros(x.shape[1]), np.log(y.mean()), 0.7
    full = np.column_stack([np.ones(len(y)), x])
    w = np.r_[a, b]
    for _ in range(100):
        mu = np.exp(full @ w)
        grad = full.T @ (mu - y) / len(y) + alpha * np.r_[0, w[1:]]
        hess = (full.T * mu) @ full / len(y) + alpha * np.diag(np.r_[0, np.ones(x.shape[1])])
        w -= np.linalg.solve(hess, grad)
    got, icpt = coefs(fit(df, Spec("m", "poisson", "y", PREDICTORS, {"alpha": alpha})))
    assert np.allclose(got, w[1:], atol=1e-5) and abs(icpt - w[0]) < 1e-5


def test_ridge_and_ols(data):
    df, x, y, _ = data
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 30 * np.eye(x.shape[1]), xc.T @ yc)
    got, _ = coefs(fit(df, Spec("m", "ridge", "y", PREDICTORS, {"alpha": 30.0})))
    assert np.allclose(got, want, atol=1e-6)
    least = np.linalg.lstsq(xc, yc, rcond=None)[0]  # smallest solution of a singular system
    got, _ = coefs(fit(df, Spec("m", "ols", "y", PREDICTORS)))
    assert np.allclose(got, least, atol=1e-5)


def test_elastic_net(data):
    df, x, y, _ = data
    alpha, ratio = 0.1, 0.6
    xc, yc, n = x - x.mean(0), y - y.mean(), len(y)
    w = np.zeros(x.shape[1])
    for _ in range(5000):
        for j in range(len(w)):
            r = yc - xc @ w + xc[:, j] * w[j]
            rho = xc[:, j] @ r / n
            w[j] = np.sign(rho) * max(abs(rho) - alpha * ratio, 0) / (xc[:, j] @ xc[:, j] / n + alpha * (1 - ratio))
    got, _ = coefs(fit(df, Spec("m", "elastic_net", "y", PREDICTORS, {"alpha": alpha, "l1_ratio": ratio})))
    assert np.allclose(got, w, atol=1e-4)


def test_logistic_balanced(data):
    df, x, _, z = data
    weight = np.where(z == 1, len(z) / (2 * z.sum()), len(z) / (2 * (1 - z).sum()))
    full, w, c = np.column_stack([np.ones(len(z)), x]), np.zeros(x.shape[1] + 1), 1.0
    penal = np.diag(np.r_[0, np.ones(x.shape[1])])
    for _ in range(100):
        p = 1 / (1 + np.exp(-full @ w))
        grad = c * full.T @ (weight * (p - z)) + penal @ w
        w -= np.linalg.solve(c * (full.T * (weight * p * (1 - p))) @ full + penal, grad)
    fitted = fit(df, Spec("m", "logistic", "z", PREDICTORS))
    got, icpt = coefs(fitted)
    assert np.allclose(got, w[1:], atol=1e-4) and abs(icpt - w[0]) < 1e-4
    rows = fitted.predict(df.select("key", *PREDICTORS)).toPandas().sort_values("key")
    assert np.allclose(rows["p"], 1 / (1 + np.exp(-full @ w)), atol=1e-4)
    assert ((rows["p"] >= 0.4).astype(int) == rows["yhat"]).all()


def test_inference(data):
    df, x, y, _ = data
    design = np.column_stack([np.ones(len(y)), x[:, :3], x[:, 4:]])  # first level dropped
    w = np.zeros(design.shape[1])
    for _ in range(50):
        mu = np.exp(design @ w)
        w += np.linalg.solve((design.T * mu) @ design, design.T @ (y - mu))
    se = np.sqrt(np.diag(np.linalg.inv((design.T * np.exp(design @ w)) @ design)))
    from statistics import NormalDist

    want = [2 * (1 - NormalDist().cdf(abs(v))) for v in (w / se)[1:]]
    rows = df.withColumn("__y", F.col("y").cast("double"))
    e = fit_encoder(rows, Recipe.of(rows, list(PREDICTORS), levels="drop_first"))
    got = E.p_values(e.transform(rows), e.names, "poisson")
    assert e.names == ["x1", "x2", "x3", "g_b", "g_c_1"]
    assert np.allclose(list(got.values()), want, atol=1e-5)


def test_backward_selection(spark, data):
    df, *_ = data
    s = backward_selection(df, list(PREDICTORS), "y", "poisson")
    assert "x2" in s.selected and "g" in s.selected  # a level name with "_" keeps its source
    assert [t[3] for t in s.trace if t[4]] == [t[3] for t in s.trace][: sum(t[4] for t in s.trace)]
    twin = df.withColumn("x2_twin", F.col("x2") * 2)
    stopped = backward_selection(twin, ["x2", "x2_twin"], "y", "linear")
    assert stopped.outcome.startswith("stopped") and stopped.selected == ["x2", "x2_twin"]
    noise = df.withColumn("n1", F.sin(F.col("key") * 12.9898)).withColumn("n2", F.cos(F.col("key") * 78.233))
    none = backward_selection(noise, ["n2", "n1"], "y", "linear", 1e-12)
    assert none.outcome == "all eliminated" and none.selected == ["n2", "n1"]
    assert drop_redundant(["a", "b", "c"], [("a", "b"), ("x", "c")]) == ["b", "c"]


def test_fold_encoders_match_single_fits(data):
    df, *_ = data
    folded = with_folds(df, "key", 4).cache()
    recipe = Recipe.of(folded, list(PREDICTORS))
    together = fit_encoders(folded, recipe, "fold", "y")
    for i in range(4):
        alone = fit_encoder(folded.where(F.col("fold") != i), recipe, "y")
        assert together[i].names == alone.names and together[i].n == alone.n
        assert np.allclose(list(together[i].means.values()), list(alone.means.values()))
        assert np.allclose(list(together[i].scales.values()), list(alone.scales.values()))
        assert abs(together[i].label_mean - alone.label_mean) < 1e-12
        assert abs(together[i].label_std - alone.label_std) < 1e-12


def test_encoder_edges(spark, data):
    df, *_ = data
    flat = df.withColumn("one", F.lit(3.0))
    e = fit_encoder(flat, Recipe(("one",)))
    assert e.transform(flat).select("one__z").distinct().collect() == [(0.0,)]
    strict = fit_encoder(df.where("g <> 'a'"), Recipe(categorical=("g",), unknown="error"))
    with pytest.raises(Exception, match="unseen level"):
        strict.transform(df).select("features").collect()
    many = spark.range(5000).select(F.col("id").cast("string").alias("c"))
    wide = fit_encoder(many, Recipe(categorical=("c",)))
    assert wide.width == 5000 and wide.names[:2] == ["c_0", "c_1"]
    ones = wide.transform(many).select(vector_to_array("features").alias("v"), "c").select(F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("s"), F.array_position("v", 1.0).alias("at"), "c")
    assert {(r["s"], wide.names[r["at"] - 1] == f"c_{r['c']}") for r in ones.collect()} == {(1.0, True)}
    assert monomials(3, 2)[:3] == [{0: 1}, {0: 2}, {1: 1}] and len(monomials(13, 4)) == 2379


def test_expansion_order(spark):
    df = spark.createDataFrame([(2.0, 3.0, 5.0)], "a double, b double, c double")
    e = fit_encoder(df, Recipe(("a", "b", "c"), scale=False, degree=3))
    got = e.transform(df).first()["features"].toArray()
    want = [np.prod([(2.0, 3.0, 5.0)[i] ** p for i, p in m.items()]) for m in monomials(3, 3)]
    assert np.allclose(got, want) and len(e.names) == len(want)


def test_trees(spark, data):
    df, *_ = data
    forest = fit(df, Spec("m", "forest", "y", PREDICTORS, {"n_estimators": 5, "max_depth": None, "min_samples_split": 10}))
    assert abs(sum(r["importance"] for r in E.importance_table(forest, spark).collect()) - 1) < 1e-9
    assert forest.model.getOrDefault("minInstancesPerNode") == 5 and forest.model.getOrDefault("maxDepth") == 30
    boosted = fit(df, Spec("m", "gbt", "y", PREDICTORS, {"n_estimators": 20, "max_depth": 2}))
    r = boosted.predict(df).agg(F.avg(F.pow(F.col("y") - F.col("yhat"), 2)).alias("mse"), F.var_pop("y").alias("v")).first()
    assert r["mse"] < 0.9 * r["v"]


def test_paths(spark, data):
    df, *_ = data
    p = E.coefficient_paths(df, Spec("m", "elastic_net", "y", PREDICTORS), [0.001, 10.0], [0.5])
    norms = {r["alpha"]: r["l1_norm"] for r in E.l1_norms(p).collect()}
    assert norms[10.0] == 0.0 and norms[0.001] > 0.3
    assert E.largest_paths(p, 2).select("feature").distinct().count() == 2


def test_gradient_matches_differences():
    shapes = layer_shapes(3, [4, 2])
    flat = initial_weights(shapes)
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(7, 3)), rng.normal(size=7)
    grad, loss = gradient_sum(flat, shapes, x, y)
    for i in range(0, len(flat), 3):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (gradient_sum(up, shapes, x, y)[1] - gradient_sum(down, shapes, x, y)[1]) / 2e-6
        assert abs(slope - grad[i]) < 1e-5
    assert abs(loss - 0.5 * ((forward(flat, shapes, x)[-1][:, 0] - y) ** 2).sum()) < 1e-12
    assert parameter_count(layer_shapes(84, [100])) == 8601


def test_mlp_exact_steps(data):
    """Summed gradients of all partitions give the same steps as one array."""
    df, *_ = data
    spec = Spec("m", "mlp", "y", PREDICTORS, key="key")
    e = fit_encoder(df, spec.recipe(df), "y")
    rows = E.training_rows(df, spec, e).withColumn("__valid", F.lit(False)).cache()
    model, log = fit_mlp(rows, {"hidden": [5], "sync": "step", "max_iter": 8, "early_stopping": False, "alpha": 0.01, "learning_rate": 0.05}, e.width)
    pdf = rows.toPandas()
    x, y = np.stack([v.toArray() for v in pdf["features"]]), pdf["__y"].to_numpy()
    shapes = layer_shapes(e.width, [5])
    flat, mask = initial_weights(shapes), weight_mask(shapes)
    adam = Adam(np.zeros(len(flat)), np.zeros(len(flat)))
    for _ in range(8):
        grad, _ = gradient_sum(flat, shapes, x, y)
        adam.step(flat, (grad + 0.01 * mask * flat) / len(y), 0.05)
    assert np.allclose(model.flat, flat, atol=1e-9) and len(log) == 8


def test_mlp_learns_and_stops(data):
    df, *_ = data
    spec = Spec("m", "mlp", "y", PREDICTORS, {"hidden": [8], "learning_rate": 0.05, "max_iter": 40, "batch_size": 32}, key="key")
    fitted = fit(df, spec)
    r = fitted.predict(df).agg(F.avg(F.pow(F.col("y") - F.col("yhat"), 2)).alias("mse"), F.var_pop("y").alias("v")).first()
    assert r["mse"] < r["v"] and fitted.model.n_iter == len(fitted.log) <= 40
    assert fitted.model.valid_r2 == max(s for *_, s in fitted.log if s is not None)
    with pytest.raises(ValueError, match="Spec.key"):
        fit(df, Spec("m", "mlp", "y", PREDICTORS))


def test_mlp_shards_follow_the_rows_not_the_layout(data, monkeypatch):
    df, *_ = data
    spec = Spec("m", "mlp", "y", PREDICTORS, {"hidden": [6], "max_iter": 3, "batch_size": 16}, key="key")
    assert (shards_for(10), shards_for(4_000_000), shards_for(4_000_001)) == (8, 8, 9)
    two, forty = (fit(df.repartition(n), spec).model.flat for n in (2, 40))
    assert np.allclose(two, forty, rtol=1e-12, atol=0)
    monkeypatch.setattr(mlp, "SHARD_ROWS", 5)  # 80 shards: two levels of sums
    many = fit(df, spec).model.flat
    monkeypatch.setattr(mlp, "ADDED_TOGETHER", 1000)
    assert np.allclose(many, fit(df, spec).model.flat, atol=1e-9) and not np.allclose(many, two, atol=1e-6)


def test_repeated_rows_spread_over_shards(spark):
    """Rows that are alike in all but their key do not pile up in one shard."""
    df = spark.range(400).select(F.col("id").alias("key"), F.lit(1.0).alias("a"), F.lit(2.0).alias("y"))
    spec = Spec("m", "mlp", "y", ("a",), {"hidden": [2], "max_iter": 2}, key="key")
    e = fit_encoder(df, spec.recipe(df), "y")
    rows = E.training_rows(df, spec, e)
    sizes = rows.repartition(8, "__place").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 100
    assert fit_mlp(rows, spec.params, e.width)[0].n_iter == 2


def test_networks_step_as_one_stack_and_are_validated_in_one_job(data):
    """Twelve networks of two shapes take as many jobs as one, and end as each does alone."""
    df, *_ = data
    spec = Spec("m", "mlp", "y", PREDICTORS, key="key")
    e = fit_encoder(df, spec.recipe(df), "y")
    rows = E.training_rows(df, spec, e).cache()
    settings = [{"hidden": h, "max_iter": 2, "learning_rate": r, "alpha": a, "batch_size": 16} for h in ([4], [3, 2]) for r in (0.01, 0.05) for a in (0, 0.1, 1)]
    sc, jobs = df.sparkSession.sparkContext, []
    rows.count()
    for own in (settings[:1], settings):
        sc.setJobGroup(f"stack-{len(own)}", "")
        found = fit_mlps(rows, own, e.width)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"stack-{len(own)}")))
    sc.setJobGroup("", "")
    assert jobs[0] == jobs[1]
    assert [len(s) for s in mlp._stacks([mlp._Run.of(q, e.width) for q in settings])] == [6, 6]
    for i in (0, 5, 6, 11):
        alone = fit_mlps(rows, settings[i:i + 1], e.width)[0][0]
        assert np.allclose(found[i][0].flat, alone.flat, atol=1e-12) and abs(found[i][0].valid_r2 - alone.valid_r2) < 1e-12


def test_networks_trained_together_equal_separate_ones(data, monkeypatch):
    df, *_ = data
    spec = Spec("m", "mlp", "y", PREDICTORS, key="key")
    e = fit_encoder(df, spec.recipe(df), "y")
    rows = E.training_rows(df, spec, e).cache()
    settings = [{"hidden": [4], "max_iter": 5, "learning_rate": 0.05}, {"hidden": [3, 2], "max_iter": 2, "batch_size": 16},
                {"hidden": [4], "max_iter": 30, "patience": 1, "tol": 1.0}, {"hidden": [4], "max_iter": 3, "sync": "step"}]
    together = fit_mlps(rows, settings, e.width)
    monkeypatch.setattr(mlp, "PARAMETERS_TOGETHER", 1)
    for (model, log), (alone, own) in zip(together, fit_mlps(rows, settings, e.width)):
        assert np.allclose(model.flat, alone.flat, atol=1e-12) and log == own
    assert [len(log) for _, log in together] == [5, 2, len(together[2][1]), 3] and len(together[2][1]) < 30
    labelled = rows.select("features", F.col("__y").alias("y"))
    for _, _, at, n, mse, *_ in network_scores(labelled, [m for m, _ in together], 0, "valid", 1.0):
        direct = together[at][0].transform(labelled).agg(F.count("*").alias("n"), F.avg((F.col("prediction") - F.col("y")) ** 2).alias("mse")).first()
        assert n == direct["n"] and abs(mse - direct["mse"]) < 1e-9
