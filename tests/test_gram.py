"""Squared-error models from cross-products by fold against NumPy and against MLlib's distributed fits."""

import json
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.operators import estimators as E, gram
from tallymark.operators.encode import fit_encoder
from tallymark.operators.ensembles import prefix_scores
from tallymark.operators.estimators import Spec, fit
from tallymark.operators.selection import backward_selection
from tallymark.operators.splits import holdout_side, with_folds
from tallymark.plans import grid as G, train as T

PREDICTORS = ("x1", "x2", "flat", "g")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n = 300
    x1, x2, g = rng.normal(1e5, 30, n), rng.normal(0, 1, n), rng.choice(["a", "b", "c"], n)
    y = 1000 + 0.02 * (x1 - 1e5) + 2 * x2 + np.select([g == "a", g == "b"], [1.0, -0.5], 0.0) + rng.normal(0, 0.7, n)
    rows = [(i, *map(float, v[:2]), 4.0, str(v[2]), float(v[3])) for i, v in enumerate(zip(x1, x2, g, y))]
    df = spark.createDataFrame(rows, "key long, x1 double, x2 double, flat double, g string, y double").repartition(5).cache()
    return df, np.column_stack([x1, x2]), g, y


def design(x, g, mine):
    """Standardised by the chosen rows, as the encoder does."""
    z = (x - x[mine].mean(axis=0)) / x[mine].std(axis=0)
    return np.column_stack([z, np.zeros(len(z)), *[(g == v).astype(float) for v in "abc"]])


def net(z, y, alpha, ratio):
    zc, yc, w = z - z.mean(0), y - y.mean(), np.zeros(z.shape[1])
    for _ in range(3000):
        for j in range(len(w)):
            own = zc[:, j] @ zc[:, j] / len(y)
            rho = zc[:, j] @ (yc - zc @ w) / len(y) + own * w[j]
            w[j] = np.sign(rho) * max(abs(rho) - alpha * ratio, 0) / (own + alpha * (1 - ratio))
    return w, y.mean() - z.mean(0) @ w


def by_key(df):
    return {r["key"]: r for r in df.collect()}


def test_grid_over_folds(data):
    df, x, g, y = data
    grid = {"alpha": [0.01, 0.5], "l1_ratio": [0.2, 0.9]}
    fold = {r["key"]: r["fold"] for r in with_folds(df, "key", 3).collect()}
    folds = np.array([fold[i] for i in range(len(y))])
    found = G.grid_search(df, Spec("m", "elastic_net", "y", PREDICTORS), grid, "key", 3, contiguous=False, with_train=True)
    for r in found.collect():
        mine = folds != r["fold"]
        z, q = design(x, g, mine), json.loads(r["params"])
        w, a = net(z[mine], y[mine], q["alpha"], q["l1_ratio"])
        side = ~mine if r["side"] == "valid" else mine
        e = y[side] - a - z[side] @ w
        assert r["n"] == side.sum()
        assert np.allclose([r["mse"], r["mae"], r["r2"]], [(e**2).mean(), abs(e).mean(), 1 - (e**2).mean() / y[side].var()], rtol=1e-6)
        assert abs(r["poisson_deviance"] - (2 * (y[side] * np.log(y[side] / (y[side] - e)) - e)).mean()) < 1e-9
    assert found.count() == 4 * 3 * 2


@pytest.mark.parametrize("family,params", [("ols", {}), ("ridge", {"alpha": 25.0}), ("elastic_net", {"alpha": 0.05, "l1_ratio": 0.4})])
def test_out_of_fold_equals_distributed_fits(data, monkeypatch, family, params):
    """Both ways beyond and below the width limit give the same predictions."""
    df, *_ = data
    spec = Spec("m", family, "y", PREDICTORS, params)
    ours = by_key(T.out_of_fold(df, spec, "key", 4))
    monkeypatch.setattr(gram, "GRAM_COLUMNS", 0)
    theirs = by_key(T.out_of_fold(df, spec, "key", 4))
    assert all(ours[k]["fold"] == theirs[k]["fold"] and abs(ours[k]["yhat"] - theirs[k]["yhat"]) < 1e-4 for k in theirs) and len(ours) == len(theirs)


@pytest.mark.parametrize("limit", [0, 10_000])
def test_wide_and_narrow_solvers(data, monkeypatch, limit):
    """MLlib's one-step and iterative solvers, told apart by ``NORMAL_EQUATIONS``, against NumPy."""
    df, x, g, y = data
    monkeypatch.setattr(E, "NORMAL_EQUATIONS", limit)
    z = design(x, g, np.ones(len(y), bool))
    zc, yc = z - z.mean(0), y - y.mean()
    got = fit(df, Spec("m", "ridge", "y", PREDICTORS, {"alpha": 30.0})).model
    assert np.allclose(got.coefficients.toArray(), np.linalg.solve(zc.T @ zc + 30 * np.eye(6), zc.T @ yc), atol=1e-4)


def test_layout_and_flushes_change_nothing(data, monkeypatch):
    df, *_ = data
    spec = Spec("m", "ridge", "y", PREDICTORS)
    folded = with_folds(df, "key", 4)
    encoder = fit_encoder(folded, spec.recipe(folded), "y")
    rows = gram.encoded(folded, encoder, "y", "fold")
    whole = gram.cross_products(rows, encoder)
    monkeypatch.setattr(gram, "HELD_BYTES", 1)
    split = gram.cross_products(rows.repartition(40), encoder)
    assert whole.folds == split.folds == [0, 1, 2, 3] and np.allclose(whole.parts, split.parts, rtol=1e-12, atol=1e-9)
    assert whole.parts[:, 0, 0].sum() == 300


def test_paths_follow_the_optimum(spark, data):
    df, x, g, y = data
    paths = E.coefficient_paths(df, Spec("m", "elastic_net", "y", PREDICTORS), E.alpha_grid(7), [0.1, 0.9])
    z = design(x, g, np.ones(len(y), bool))
    names = ["x1", "x2", "flat", "g_a", "g_b", "g_c"]
    for alpha in E.alpha_grid(7):
        for ratio in (0.1, 0.9):
            got = {r["feature"]: r["coefficient"] for r in paths.where((F.col("alpha") == alpha) & (F.col("l1_ratio") == ratio)).collect()}
            assert np.allclose([got[n] for n in names], net(z, y, alpha, ratio)[0], atol=1e-6)


def test_a_column_that_is_constant_on_one_side(spark):
    rows = [(i, float(i % 7), 5.0 if i % 4 else float(i), "u" if i % 4 else "v", float(i % 5)) for i in range(80)]
    df = spark.createDataFrame(rows, "key long, a double, b double, g string, y double").withColumn("fold", (F.col("key") % 4).cast("int"))
    encoder = fit_encoder(df, Spec("m", "ridge", "y", ("a", "b", "g")).recipe(df), "y")
    models = gram.solve(gram.cross_products(gram.encoded(df, encoder, "y", "fold"), encoder), "ridge", [{"alpha": 1.0}], E.TINY_RIDGE)
    b = dict(zip(encoder.names, models.standardised[0, 0]))
    assert b["b"] == 0.0 and abs(b["g_v"]) < 1e-9 and abs(b["a"]) > 1e-4


def test_missing_labels_are_an_error(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 1.0)], "key long, a double, y double")
    with pytest.raises(Exception, match="present and finite"):
        T.out_of_fold(df, Spec("m", "ols", "y", ("a",)), "key", 2).collect()


@pytest.mark.parametrize("rate,depth", [(0.1, 2), (0.5, 1)])
def test_short_ensembles_are_the_beginning_of_long_ones(data, rate, depth):
    """Every length scored from one fit equals a fit of its own."""
    df, *_ = data
    spec = Spec("m", "gbt", "y", PREDICTORS, {"learning_rate": rate, "max_depth": depth})
    long = fit(df, spec.with_params(n_estimators=9))
    rows = long.encoder.transform(df).select("features", "y")
    got = prefix_scores(rows, long.model, [2, 9, 5, 1], 3, "valid", 1000.0)
    for at, n in enumerate([2, 9, 5, 1]):
        e = fit(df, spec.with_params(n_estimators=n)).predict(df).select((F.col("y") - F.col("yhat")).alias("e"), "y")
        want = e.agg(F.count("*"), F.avg(F.col("e") ** 2), F.avg(F.abs("e")), 1 - F.avg(F.col("e") ** 2) / F.var_pop("y")).first()
        assert got[at][:3] == ("valid", 3, at) and np.allclose(got[at][3:7], list(want), rtol=1e-9)


def test_boosting_grid_covers_all_points(data):
    df, *_ = data
    grid = {"n_estimators": [1, 4, 2], "learning_rate": [0.1, 0.3], "max_depth": [1]}
    found = G.grid_search(df, Spec("m", "gbt", "y", PREDICTORS), grid, "key", 2, with_train=True).collect()
    assert {(r["grid_index"], r["fold"], r["side"]) for r in found} == {(g, f, s) for g in range(6) for f in (0, 1) for s in ("valid", "train")}
    points = G.expand(grid)
    assert all(json.loads(r["params"]) == points[r["grid_index"]] for r in found)
    train = {(json.loads(r["params"])["n_estimators"], r["grid_index"] % 2, r["fold"]): r["mse"] for r in found if r["side"] == "train"}
    assert all(train[4, i, f] < train[1, i, f] for i in (0, 1) for f in (0, 1))


def test_elimination_equals_distributed_fits(spark, data, monkeypatch):
    df, *_ = data
    noisy = df.drop("flat").select("*", *[F.sin(F.col("key") * (7.1 + i)).alias(f"n{i}") for i in range(7)])
    names = ["x1", "x2", "g", *[f"n{i}" for i in range(7)]]
    ours = backward_selection(noisy, names, "y", "linear", 0.05)
    monkeypatch.setattr(gram, "GRAM_COLUMNS", 0)
    theirs = backward_selection(noisy, names, "y", "linear", 0.05)
    assert ours.selected == theirs.selected and ours.outcome == theirs.outcome and len(ours.trace) >= 5
    assert [t[:3] + t[4:] for t in ours.trace] == [t[:3] + t[4:] for t in theirs.trace]
    assert np.allclose([t[3] for t in ours.trace], [t[3] for t in theirs.trace], rtol=1e-6, atol=1e-12)


def test_sweeping_twice_takes_a_column_out():
    rng = np.random.default_rng(2)
    a = np.column_stack([np.ones(50), rng.normal(size=(50, 4)), rng.normal(size=50)])
    model = gram.Elimination(a.T @ a)
    model.drop(2)
    kept = [0, 1, 2, 4]
    b = np.linalg.lstsq(a[:, kept], a[:, -1], rcond=None)[0]
    assert np.allclose(model.table[kept, -1], b) and abs(model.table[-1, -1] - ((a[:, -1] - a[:, kept] @ b) ** 2).sum()) < 1e-9
    with pytest.raises(ValueError, match="depend"):
        twin = np.column_stack([a[:, :2], 3 * a[:, 1] + 1, a[:, -1]])
        gram.Elimination(twin.T @ twin)
    with pytest.raises(ValueError, match="freedom"):
        gram.Elimination(a[:6].T @ a[:6] + np.diag([0] + [1e-6] * 5)).__class__(a[:5].T @ a[:5] + np.diag([0] + [1e-3] * 5)).p_values()


def test_student_tails():
    """Against closed forms: one, two and very many degrees of freedom."""
    from math import atan, pi, sqrt
    from statistics import NormalDist

    for t in (0.0, 0.3, 1.0, 2.5, 12.0):
        assert abs(gram.student_p(t, 1) - (1 - 2 * atan(t) / pi)) < 1e-12
        assert abs(gram.student_p(-t, 2) - (1 - t / sqrt(2 + t * t))) < 1e-12
        assert abs(gram.student_p(t, 1e9) - 2 * (1 - NormalDist().cdf(t))) < 1e-7


@pytest.mark.parametrize("scale", [1.0, 0.0])
def test_degrees_from_one_pass_equal_distributed_fits(spark, data, monkeypatch, scale):
    """Degrees solved from the cross-products of the highest, and MLlib's own fits; a column may be constant but for one fold."""
    df, *_ = data
    df = df.withColumn("c", F.when(F.expr("hash(key) % 5 = 0") | F.lit(scale > 0), F.cos("key")).otherwise(2.0))
    spec = Spec("p", "polynomial", "y", ("x1", "x2", "c", "g"))
    ours = G.compare_degrees(df, spec, [1, 3, 2], "key", 3)
    alone = T.out_of_fold(df.where("key % 7 > 0"), replace(spec, params={"degree": 2}), "key", 3)
    monkeypatch.setattr(gram, "GRAM_COLUMNS", 0)
    theirs = G.compare_degrees(df, spec, [1, 3, 2], "key", 3)
    assert [r.spec.name for r in ours] == [r.spec.name for r in theirs] == ["poly_deg_1", "poly_deg_3", "poly_deg_2"]
    for a, b in zip(ours, theirs):
        for x, y in ((a.oof, b.oof), (a.predictions, b.predictions)):
            x, y = by_key(x), by_key(y)
            assert len(x) == len(y) and all(abs(x[k]["yhat"] - y[k]["yhat"]) < 1e-4 for k in y)
        assert np.allclose(a.fitted.model.coefficients.toArray(), b.fitted.model.coefficients.toArray(), atol=1e-3)
        assert a.metrics.columns == b.metrics.columns and a.metrics.count() == b.metrics.count()
    other = by_key(T.out_of_fold(df.where("key % 7 > 0"), replace(spec, params={"degree": 2}), "key", 3))
    alone = by_key(alone)
    assert len(alone) == len(other) and all(abs(alone[k]["yhat"] - other[k]["yhat"]) < 1e-4 for k in other)


def test_terms_of_a_column_constant_in_all_folds_but_one(spark):
    """What the side without that fold cannot learn has no weight, as when it is encoded on its own."""
    rows = [(i, float(i * i % 11), 5.0 if i % 4 else float(i), float(i % 5)) for i in range(80)]
    df = spark.createDataFrame(rows, "key long, a double, b double, y double").withColumn("fold", (F.col("key") % 4).cast("int"))
    spec = Spec("p", "polynomial", "y", ("a", "b"), {"degree": 3})
    encoder = fit_encoder(df, spec.recipe(df), "y")
    encoded = gram.encoded(df, encoder, "y", "key", "fold")
    models = gram.solve(gram.cross_products(encoded, encoder), "polynomial", [spec.params], E.TINY_RIDGE)
    ours = by_key(gram.predictions(encoded, models, "key"))
    theirs = by_key(fit(df.where("fold <> 0"), spec).predict(df.where("fold = 0")))
    assert all(abs(ours[k]["yhat"] - theirs[k]["yhat"]) < 1e-5 for k in theirs)


def test_final_polynomials_read_no_rows(data, monkeypatch):
    """Models of all rows come from the cross-products of the folds."""
    df, *_ = data
    spec = Spec("m", "polynomial", "y", ("x1", "x2", "flat"), {"degree": 2})
    monkeypatch.setattr(T, "fit", None)
    ours = T.train_degrees(df, spec, [2], "key", 3)[0].fitted
    theirs = fit(df.where(holdout_side("key") == "train"), spec)
    assert np.allclose(ours.model.coefficients.toArray(), theirs.model.coefficients.toArray(), atol=1e-5)
    assert abs(ours.model.intercept - theirs.model.intercept) < 1e-5
