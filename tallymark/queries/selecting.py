"""Cross-validation, grids, selection and thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tallymark.operators import metrics as M
from tallymark.operators.estimators import Spec
from tallymark.operators.selection import backward_selection, selection_table
from tallymark.operators.splits import with_split
from tallymark.plans import grid as G, train as T
from tallymark.plans.catalogue import PREDICTOR_SETS, REDUNDANT_PAIRS, specs
from tallymark.queries.registry import query, rounded, with_tables
from tallymark.queries.scoring import _DEV, _labels, _LABELS_SQL
from tallymark.sources.fixtures import BINARY, COUNT, KEY, LOG, SIDES_SQL, line_value, order_fact

EVERYTHING = PREDICTOR_SETS[-1].columns


def _sides(spark, d):
    return with_split(order_fact(spark, d), KEY)


def _train(spark, d):
    return _sides(spark, d).where("split = 'train'")


# Out-of-fold means per level: the closed form of a one-hot regression in each fold.
_OOF_SQL = SIDES_SQL + """,
tr AS (SELECT * FROM sides WHERE split = 'train'),
cell AS (SELECT {g} AS v, fold, sum({y}) AS s, count(*) AS c FROM tr GROUP BY ALL),
lvl AS (SELECT v, sum(s) AS s, sum(c) AS c FROM cell GROUP BY v),
oof AS (SELECT o_orderkey, tr.fold, tr.{y}::DOUBLE AS y, (lvl.s - cell.s) / (lvl.c - cell.c) AS yhat
        FROM tr JOIN cell ON tr.{g} = cell.v AND tr.fold = cell.fold JOIN lvl ON lvl.v = cell.v)"""
_OOF_COUNT = _OOF_SQL.format(g="o_orderpriority", y="n_lines")
_OOF_LOG = _OOF_SQL.format(g="o_month", y="log_lines")


@query("h1_cross_validation", with_tables(_OOF_COUNT, f"""
, f AS (SELECT fold, avg({_DEV}) AS dev, avg((y - yhat) ^ 2) AS mse, avg(abs(y - yhat)) AS mae FROM oof GROUP BY fold)
SELECT 'poisson_deviance' AS metric, round(avg(dev), 4) AS value FROM f UNION ALL SELECT 'mse', round(avg(mse), 4) FROM f
UNION ALL SELECT 'mae', round(avg(mae), 4) FROM f"""))
def h1_cross_validation(spark, d):
    """Mean over ten folds, refitted in each; one-hot Poisson, so the oracle is exact."""
    spec = Spec("m", "poisson", COUNT, ("o_orderpriority",), {"alpha": 1e-9}, levels="drop_first")
    m = T.cv_metrics(T.out_of_fold(_train(spark, d), spec, KEY, 10), spec)
    return rounded(m.where("metric IN ('poisson_deviance', 'mse', 'mae')").select("metric", "value"), 4)


@query("h2_train_scores", with_tables(_OOF_COUNT, """
, lm AS (SELECT k.fold, t.o_orderpriority AS v, avg(t.n_lines) AS mu FROM tr t, (SELECT DISTINCT fold FROM tr) k WHERE t.fold <> k.fold GROUP BY ALL)
SELECT 'train' AS side, k.fold, count(*) AS n, round(avg((t.n_lines - lm.mu) ^ 2), 4) AS mse
FROM (SELECT DISTINCT fold FROM tr) k JOIN tr t ON t.fold <> k.fold JOIN lm ON lm.fold = k.fold AND lm.v = t.o_orderpriority GROUP BY ALL
UNION ALL SELECT 'valid', fold, count(*), round(avg((y - yhat) ^ 2), 4) FROM oof GROUP BY fold"""))
def h2_train_scores(spark, d):
    spec = Spec("m", "ols", COUNT, ("o_orderpriority",))
    oof = T.out_of_fold(_train(spark, d), spec, KEY, 10, with_train=True)
    return rounded(T.fold_metrics(oof, spec).select("side", "fold", "n", "mse"), 4)


@query("h3_out_of_fold", with_tables(_OOF_LOG, """
, b AS (SELECT exp(y) - 1 AS y, greatest(exp(yhat) - 1, 0) AS yhat FROM oof)
SELECT count(*) AS n, round(avg((y - yhat) ^ 2), 4) AS mse, round(sqrt(avg((y - yhat) ^ 2)), 4) AS rmse, round(avg(abs(y - yhat)), 4) AS mae FROM b"""))
def h3_out_of_fold(spark, d):
    """Pooled out-of-fold predictions of a log model on the original scale."""
    spec = Spec("m", "ols", LOG, ("o_month",), log_label=True)
    oof = T.out_of_fold(_train(spark, d), spec, KEY, 10)
    return rounded(M.original_scale(oof, "y", "yhat").select("n", "mse", "rmse", "mae"), 4)


@query("h3_predictions", with_tables(_OOF_LOG, "SELECT o_orderkey, fold, round(yhat, 5) AS yhat FROM oof"))
def h3_predictions(spark, d):
    spec = Spec("m", "ols", LOG, ("o_month",), log_label=True)
    return rounded(T.out_of_fold(_train(spark, d), spec, KEY, 10).select(KEY, "fold", "yhat"), 5)


def _search(spark, d, family, grid, predictors=("o_totalprice", "c_acctbal", "o_orderpriority", "r_name"), k=3):
    spec = Spec("m", family, COUNT, predictors, key=KEY)
    return G.grid_search(_train(spark, d), spec, grid, KEY, k)


@query("h4_boosting_grid")
def h4_boosting_grid(spark, d):
    """The published grid at its full lengths over ten folds, as published: 64 points from 16 ensembles of 1,200 trees a fold."""
    return rounded(G.summarise(_search(spark, d, "gbt", G.GRIDS["gbt"], k=10)))


@query("h5_forest_grid")
def h5_forest_grid(spark, d):
    grid = {"n_estimators": [5], "max_depth": [3, 5], "min_samples_split": [2, 10], "min_samples_leaf": [1], "max_features": ["sqrt"]}
    return rounded(G.summarise(_search(spark, d, "forest", grid, k=2)))


@query("h6_mlp_grid")
def h6_mlp_grid(spark, d):
    """All published learning rates, penalties and batch sizes of the smallest network, trained side by side for two epochs."""
    grid = {**G.GRIDS["mlp"], "hidden": G.GRIDS["mlp"]["hidden"][:1], "max_iter": [2]}
    return rounded(G.summarise(_search(spark, d, "mlp", grid, k=2)))


_NET_SQL = """
WITH t AS (SELECT l_orderkey, l_quantity AS x, ln(1 + l_extendedprice) AS y, row_number() OVER (ORDER BY line_key) - 1 AS pos, count(*) OVER () AS n
           FROM (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS line_key FROM lineitem)),
f AS (SELECT x, y, (CASE WHEN pos < (n % 10) * (n // 10 + 1) THEN pos // (n // 10 + 1) ELSE n % 10 + (pos - (n % 10) * (n // 10 + 1)) // (n // 10) END)::INT AS fold FROM t),
st AS (SELECT k, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, covar_pop(x, y) / stddev_pop(x) AS c FROM f, range(10) AS r(k) WHERE fold <> k GROUP BY k),
g AS (SELECT row_number() OVER (ORDER BY a, r) - 1 AS grid_index, a, r FROM (VALUES (0.01::DOUBLE), (0.1), (1.0), (10.0)) AS v(a),
      (VALUES (0.1::DOUBLE), (0.3), (0.5), (0.7), (0.9)) AS w(r)),
fit AS (SELECT grid_index, st.*, sign(c) * greatest(abs(c) - a * r, 0) / (1 + a * (1 - r)) AS b FROM g, st),
e AS (SELECT grid_index, k, avg((y - my - b * (x - mx) / sx) ^ 2) AS mse FROM fit JOIN f ON f.fold = fit.k GROUP BY ALL)"""


def _net_grid(spark, d):
    spec = Spec("m", "elastic_net", "log_price", ("l_quantity",), log_label=True)
    return G.grid_search(line_value(spark, d), spec, G.GRIDS["elastic_net"], "line_key", 10)


@query("h7_elastic_net_grid", _NET_SQL + """
SELECT grid_index::INT AS grid_index, round(avg(mse), 4) AS cv_mse, round(sqrt(avg(mse)), 4) AS cv_rmse FROM e GROUP BY 1""")
def h7_elastic_net_grid(spark, d):
    """The full grid over ten contiguous folds, one predictor: closed form in every fold."""
    found = _net_grid(spark, d)
    return rounded(G.summarise(found).select("grid_index", "cv_mse", "cv_rmse"), 4)


@query("h7_poisson_grid")
def h7_poisson_grid(spark, d):
    found = _search(spark, d, "poisson", G.GRIDS["poisson"], k=2)
    return rounded(G.summarise(found, "cv_deviance").select("grid_index", "params", "cv_deviance", "cv_mse", "rank"))


@query("h8_ranked_grid", _NET_SQL + """
SELECT grid_index::INT AS grid_index, round(avg(mse), 4) AS cv_mse, (row_number() OVER (ORDER BY round(avg(mse), 9), grid_index))::INT AS rank
FROM e GROUP BY grid_index ORDER BY rank LIMIT 5""")
def h8_ranked_grid(spark, d):
    """Many points of the full grid leave no coefficient and tie: the first of them ranks first."""
    return rounded(G.top_points(G.summarise(_net_grid(spark, d)), 5).select("grid_index", "cv_mse", "rank"), 4)


@query("h9_train_and_score", with_tables(_OOF_COUNT, f"""
, te AS (SELECT n_lines::DOUBLE AS y, m.mu AS yhat FROM sides JOIN (SELECT o_orderpriority, avg(n_lines) AS mu FROM tr GROUP BY 1) m USING (o_orderpriority) WHERE split = 'test'),
f AS (SELECT fold, avg((y - yhat) ^ 2) AS mse, avg(abs(y - yhat)) AS mae FROM oof GROUP BY fold)
SELECT 'cv' AS split, 'mse' AS metric, round(avg(mse), 4) AS value FROM f UNION ALL SELECT 'cv', 'mae', round(avg(mae), 4) FROM f
UNION ALL SELECT 'test', 'mse', round(avg((y - yhat) ^ 2), 4) FROM te UNION ALL SELECT 'test', 'mae', round(avg(abs(y - yhat)), 4) FROM te
UNION ALL SELECT 'test', 'r2', round(1 - avg((y - yhat) ^ 2) / var_pop(y), 4) FROM te"""))
def h9_train_and_score(spark, d):
    spec = Spec("m", "ols", COUNT, ("o_orderpriority",))
    m = T.train_and_score(_sides(spark, d), spec, KEY).metrics
    return rounded(m.where("metric IN ('mse', 'mae') OR (metric = 'r2' AND split = 'test')").select("split", "metric", "value"), 4)


_SINGLE = ("o_orderpriority", "o_orderstatus", "o_month")


@query("h10_best_model", "WITH " + SIDES_SQL.strip() + ", tr AS (SELECT * FROM sides WHERE split = 'train')" + "".join(f""",
c{i} AS (SELECT {g} AS v, fold, sum(n_lines) AS s, count(*) AS c FROM tr GROUP BY ALL), l{i} AS (SELECT v, sum(s) AS s, sum(c) AS c FROM c{i} GROUP BY v),
f{i} AS (SELECT tr.fold, avg((n_lines - (l{i}.s - c{i}.s) / (l{i}.c - c{i}.c)) ^ 2) AS mse
         FROM tr JOIN c{i} ON tr.{g} = c{i}.v AND tr.fold = c{i}.fold JOIN l{i} ON l{i}.v = c{i}.v GROUP BY tr.fold)""" for i, g in enumerate(_SINGLE))
    + " SELECT model, 'mse' AS metric, round(value, 4) AS value FROM (" + " UNION ALL ".join(
        f"SELECT '{g}' AS model, {i} AS o, avg(mse) AS value FROM f{i}" for i, g in enumerate(_SINGLE)) + ") ORDER BY value, o LIMIT 1")
def h10_best_model(spark, d):
    """Smallest CV error among three one-predictor models."""
    train = _train(spark, d)
    tables = [T.cv_metrics(T.out_of_fold(train, s, KEY, 10), s) for s in (Spec(g, "ols", COUNT, (g,)) for g in _SINGLE)]
    return rounded(T.best_model(reduce(DataFrame.unionByName, tables), "mse"), 4)


@query("h11_backward_selection")
def h11_backward_selection(spark, d):
    """Trace of the elimination on the logistic target."""
    s = backward_selection(_train(spark, d), ["o_totalprice", "c_acctbal", "o_orderstatus", "c_mktsegment"], BINARY,
                           "logistic", 0.1, REDUNDANT_PAIRS)
    return rounded(selection_table(spark, s))


@query("h11_backward_linear", """
SELECT 'l_quantity' AS feature, (abs(regr_slope(l_extendedprice, l_quantity) / sqrt((regr_syy(l_extendedprice, l_quantity)
  - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity)) / (count(*) - 2) / regr_sxx(l_extendedprice, l_quantity))) < 1.6449)::INT AS eliminated
FROM lineitem""")
def h11_backward_linear(spark, d):
    """One predictor: eliminated exactly if its t statistic is below the 10 % point."""
    s = backward_selection(line_value(spark, d), ["l_quantity"], "l_extendedprice", "linear", 0.1)
    return selection_table(spark, s).select("feature", F.col("eliminated").cast("int").alias("eliminated"))


@query("h11_backward_pair", """
WITH s AS (SELECT count(*) AS n, var_pop(l_quantity) AS s11, var_pop(l_discount) AS s22, covar_pop(l_quantity, l_discount) AS s12,
  covar_pop(l_extendedprice, l_quantity) AS t1, covar_pop(l_extendedprice, l_discount) AS t2, var_pop(l_extendedprice) AS syy FROM lineitem),
b AS (SELECT *, s11 * s22 - s12 * s12 AS det, (t1 * s22 - t2 * s12) / (s11 * s22 - s12 * s12) AS b1, (t2 * s11 - t1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s),
fits AS (SELECT *, abs(b1) / sqrt((syy - b1 * t1 - b2 * t2) / (n - 3) * s22 / det) AS z1, abs(b2) / sqrt((syy - b1 * t1 - b2 * t2) / (n - 3) * s11 / det) AS z2 FROM b),
worst AS (SELECT *, z1 < z2 AS one, least(z1, z2) < 1.6449 AS gone FROM fits),
alone AS (SELECT one, CASE WHEN one THEN abs(t2) / sqrt(s22) / sqrt((syy - t2 * t2 / s22) / (n - 2))
                          ELSE abs(t1) / sqrt(s11) / sqrt((syy - t1 * t1 / s11) / (n - 2)) END AS z FROM worst WHERE gone)
SELECT 1 AS step, CASE WHEN one THEN 'l_quantity' ELSE 'l_discount' END AS feature, gone::INT AS eliminated FROM worst UNION ALL
SELECT 2, CASE WHEN one THEN 'l_discount' ELSE 'l_quantity' END, (z < 1.6449)::INT FROM alone""")
def h11_backward_pair(spark, d):
    """Two predictors: the trace follows from their covariances."""
    s = backward_selection(line_value(spark, d), ["l_quantity", "l_discount"], "l_extendedprice", "linear", 0.1)
    return selection_table(spark, s).select("step", "feature", F.col("eliminated").cast("int").alias("eliminated"))


@query("h11_backward_many")
def h11_backward_many(spark, d):
    """A linear trace over numbers and levels from one pass; compared with distributed fits in the tests."""
    predictors = ["o_totalprice", "c_acctbal", "avg_disc", "o_orderpriority", "o_orderstatus", "c_mktsegment", "r_name", "o_month"]
    train = _train(spark, d).where("avg_disc IS NOT NULL")
    return rounded(selection_table(spark, backward_selection(train, predictors, COUNT, "linear", 0.1, REDUNDANT_PAIRS)))


@query("h12_compare_selection")
def h12_compare_selection(spark, d):
    """CV score with all and with selected predictors, and the difference."""
    train = _train(spark, d)
    wanted = ("o_totalprice", "o_orderstatus", "c_mktsegment")
    chosen = backward_selection(train, list(wanted), BINARY, "logistic", 0.1).selected
    rows = [T.cv_metrics(T.out_of_fold(train, s, KEY, 5, contiguous=True), s) for s in (
        Spec("all", "logistic", BINARY, wanted), Spec("selected", "logistic", BINARY, tuple(chosen)))]
    both = rows[0].unionByName(rows[1]).where("metric = 'roc_auc'").groupBy("metric").pivot("model", ["all", "selected"]).agg(F.first("value"))
    return rounded(both.withColumn("difference", F.col("selected") - F.col("all")))


_GRID_SQL = _LABELS_SQL + """,
th AS (SELECT i, i * ((0.9 - 0.1)::DOUBLE / 80) + 0.1::DOUBLE AS t FROM range(81) AS r(i)),
sw AS (SELECT i, t, count(*) FILTER (y = 1 AND p >= t) AS tp, count(*) FILTER (y = 0 AND p >= t) AS fp,
              count(*) FILTER (y = 1 AND p < t) AS fn, count(*) FILTER (y = 0 AND p < t) AS tn FROM th, lab GROUP BY ALL)"""


@query("h13_threshold_sweep", with_tables(_GRID_SQL, """
SELECT round(t, 6) AS threshold, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
       round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
       round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(2 * tp / (2 * tp + fp + fn), 6) AS balanced FROM sw"""))
def h13_threshold_sweep(spark, d):
    return rounded(M.threshold_table(_labels(spark, d), "y", "p"))


@query("h13_best_threshold", with_tables(_GRID_SQL, """
, s AS (SELECT *, 2 * tp / (2 * tp + fp + fn) AS f1 FROM sw)
SELECT 'f1' AS metric, round(t, 6) AS threshold, round(f1, 6) AS score FROM s ORDER BY f1 DESC, t LIMIT 1"""))
def h13_best_threshold(spark, d):
    return rounded(M.best_threshold(_labels(spark, d), "y", "p", "f1"))


@query("h14_degree_comparison")
def h14_degree_comparison(spark, d):
    spec = Spec("poly", "polynomial", COUNT, ("o_totalprice", "c_acctbal"))
    results = G.compare_degrees(_sides(spark, d), spec, [1, 2], KEY, k=3)
    table = reduce(DataFrame.unionByName, [r.metrics for r in results])
    return rounded(T.side_by_side(table, ["mse", "rmse"]))


@query("h14_degree_errors", with_tables(SIDES_SQL, """
, st AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM sides WHERE split = 'train'),
z AS (SELECT split, n_lines AS y, (o_totalprice - m) / s AS z FROM sides, st),
c AS (SELECT var_pop(z) AS s11, var_pop(z * z) AS s22, covar_pop(z, z * z) AS s12, covar_pop(y, z) AS t1, covar_pop(y, z * z) AS t2,
             avg(y) AS my, avg(z) AS mz, avg(z * z) AS mzz FROM z WHERE split = 'train'),
b AS (SELECT *, (t1 * s22 - t2 * s12) / (s11 * s22 - s12 * s12) AS b1, (t2 * s11 - t1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM c),
e AS (SELECT y - my - t1 / s11 * (z - mz) AS one, y - my - b1 * (z - mz) - b2 * (z * z - mzz) AS two FROM z, b WHERE split = 'test')
SELECT 'poly_deg_1' AS model, round(avg(one ^ 2), 4) AS test_mse, round(avg(abs(one)), 4) AS test_mae FROM e UNION ALL
SELECT 'poly_deg_2', round(avg(two ^ 2), 4), round(avg(abs(two)), 4) FROM e"""))
def h14_degree_errors(spark, d):
    """One predictor at degrees one and two, on the test side: closed forms."""
    results = G.compare_degrees(_sides(spark, d), Spec("poly", "polynomial", COUNT, ("o_totalprice",)), [1, 2], KEY, k=2)
    table = reduce(DataFrame.unionByName, [r.metrics for r in results])
    return rounded(T.side_by_side(table, ["mse", "mae"]).select("model", "test_mse", "test_mae"), 4)


@query("h15_side_by_side")
def h15_side_by_side(spark, d):
    """Two predictor sets of each of the three families next to each other."""
    sides = _sides(spark, d)
    picked = [s for family in ("poisson", "ols", "logistic") for s in specs(family, PREDICTOR_SETS[:2])]
    table = reduce(DataFrame.unionByName, [r.metrics for r in T.train_all(sides, picked, KEY, 3)])
    return rounded(T.side_by_side(table, ["poisson_deviance", "mse", "r2", "roc_auc", "f1"]))
