"""Model fits. Where a fit has a closed form on some predictors, that form is the oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.operators import estimators as E, metrics as M
from tallymark.operators.encode import Recipe, fit_encoder
from tallymark.operators.estimators import Spec, fit
from tallymark.operators.mlp import training_log
from tallymark.operators.splits import with_split
from tallymark.plans.catalogue import PREDICTOR_SETS
from tallymark.plans.grid import compare_degrees
from tallymark.queries.registry import query, rounded, with_tables
from tallymark.sources.fixtures import (
    BINARY, COUNT, KEY, LOG, SIDES_SQL, emb_label, event_value, line_value, order_fact,
)
from tallymark.sources.tables import drop_incomplete

EVERYTHING = PREDICTOR_SETS[-1].columns


def _sides(spark, d):
    return with_split(order_fact(spark, d), KEY)


def _train(spark, d):
    return _sides(spark, d).where("split = 'train'")


_FLAGSHIP_SQL = SIDES_SQL + """,
ok AS (SELECT * FROM sides WHERE avg_qty IS NOT NULL AND avg_disc IS NOT NULL),
m AS (SELECT o_month, avg(n_lines) AS mu FROM ok WHERE split = 'train' GROUP BY 1),
t AS (SELECT n_lines AS y, mu FROM ok JOIN m USING (o_month) WHERE split = 'test'),
b AS (SELECT avg(y) AS ybar FROM t)
SELECT count(*) AS n, round(avg((y - mu) ^ 2), 4) AS mse, round(sqrt(avg((y - mu) ^ 2)), 4) AS rmse, round(avg(abs(y - mu)), 4) AS mae,
       round(1 - avg((y - mu) ^ 2) / var_pop(y), 4) AS r2,
       round(avg(2 * (y * ln(y / mu) - y + mu)), 4) AS poisson_deviance,
       round(1 - avg(2 * (y * ln(y / mu) - y + mu)) / avg(2 * (y * ln(y / ybar) - y + ybar)), 4) AS pseudo_r2
FROM t, b"""


@query("flagship_poisson_holdout", "WITH " + _FLAGSHIP_SQL.strip())
def flagship_poisson_holdout(spark, d):
    """Null drop, key-hash split, one-hot Poisson fit on the train side, hold-out metrics."""
    df = drop_incomplete(_sides(spark, d), ["avg_qty", "avg_disc"]).select(KEY, "split", COUNT, "o_month")
    fitted = fit(df.where("split = 'train'"), Spec("flagship", "poisson", COUNT, ("o_month",), {"alpha": 1e-9}, levels="drop_first"))
    scored = fitted.predict(df.where("split = 'test'")).withColumn("y", F.col(COUNT).cast("double"))
    return rounded(M.evaluate(scored, M.COUNT), 4)


@query("g1_poisson_group_means", with_tables(SIDES_SQL, """
SELECT o_orderpriority, round(avg(n_lines), 4) AS yhat, count(*) AS n FROM sides WHERE split = 'train' GROUP BY 1"""))
def g1_poisson_group_means(spark, d):
    train = _train(spark, d)
    fitted = fit(train, Spec("m", "poisson", COUNT, ("o_orderpriority",), {"alpha": 1e-9}, levels="drop_first"))
    return rounded(fitted.predict(train.select(KEY, "o_orderpriority")).groupBy("o_orderpriority").agg(
        F.avg("yhat").alias("yhat"), F.count("*").alias("n")), 4)


@query("g1_poisson_penalised")
def g1_poisson_penalised(spark, d):
    """Penalty 1.0 on all predictors; compared with an exact optimum in the tests."""
    train = _train(spark, d)
    return rounded(E.coefficient_table(fit(train, Spec("m", "poisson", COUNT, EVERYTHING)), spark))


@query("g2_ols_group_means", """
SELECT event_type, round(avg(value), 4) AS yhat, count(*) AS n FROM events GROUP BY 1""")
def g2_ols_group_means(spark, d):
    df = event_value(spark, d)
    fitted = fit(df, Spec("m", "ols", "value", ("event_type",)))
    return rounded(fitted.predict(df.select("event_id", "event_type")).groupBy("event_type").agg(
        F.avg("yhat").alias("yhat"), F.count("*").alias("n")), 4)


@query("g2_ols_line", """
SELECT 'l_quantity' AS feature, round(regr_slope(l_extendedprice, l_quantity) * stddev_pop(l_quantity), 3) AS coefficient FROM lineitem
UNION ALL SELECT '(intercept)', round(avg(l_extendedprice), 3) FROM lineitem""")
def g2_ols_line(spark, d):
    fitted = fit(line_value(spark, d), Spec("m", "ols", "l_extendedprice", ("l_quantity",)))
    return rounded(E.coefficient_table(fitted, spark).select("feature", "coefficient"), 3)


@query("g3_ridge_line", """
SELECT 'l_quantity' AS feature,
       round(count(*) * covar_pop(l_extendedprice, l_quantity) / stddev_pop(l_quantity) / (count(*) + 5000), 3) AS coefficient FROM lineitem
UNION ALL SELECT '(intercept)', round(avg(l_extendedprice), 3) FROM lineitem""")
def g3_ridge_line(spark, d):
    """A heavy penalty, so that the shrinkage shows."""
    fitted = fit(line_value(spark, d), Spec("m", "ridge", "l_extendedprice", ("l_quantity",), {"alpha": 5000.0}))
    return rounded(E.coefficient_table(fitted, spark).select("feature", "coefficient"), 3)


@query("g4_logistic_groups", with_tables(SIDES_SQL, """
, t AS (SELECT *, count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY hi)) AS w FROM sides WHERE split = 'train')
SELECT o_month, round(sum(w) FILTER (hi = 1) / sum(w), 4) AS p FROM t GROUP BY 1"""))
def g4_logistic_groups(spark, d):
    """Unpenalised with balanced weights: the weighted share of positives per group."""
    train = _train(spark, d)
    fitted = fit(train, Spec("m", "logistic", BINARY, ("o_month",), {"c": 1e9}))
    return rounded(fitted.predict(train.select(KEY, "o_month")).groupBy("o_month").agg(F.avg("p").alias("p")), 4)


@query("g4_logistic_wide")
def g4_logistic_wide(spark, d):
    """Penalised fit on 64 inputs; compared with an exact optimum in the tests."""
    df = emb_label(spark, d)
    return rounded(E.coefficient_table(fit(df, Spec("m", "logistic", "is_zero", tuple(f"e{i}" for i in range(64)))), spark), 4)


@query("g5_elastic_net_line", """
WITH s AS (SELECT covar_pop(ln(1 + l_extendedprice), l_quantity) / stddev_pop(l_quantity) AS c FROM lineitem)
SELECT 'l_quantity' AS feature, round(sign(c) * greatest(abs(c) - 0.0005, 0) / (1 + 0.0005), 4) AS coefficient FROM s""")
def g5_elastic_net_line(spark, d):
    """One standardised predictor: the soft threshold."""
    fitted = fit(line_value(spark, d), Spec(
        "m", "elastic_net", "log_price", ("l_quantity",), {"alpha": 0.001, "l1_ratio": 0.5}))
    return rounded(E.coefficient_table(fitted, spark).where("feature <> '(intercept)'").select("feature", "coefficient"), 4)


@query("g5_elastic_net_all_zero", """
SELECT c AS feature, 0.0::DOUBLE AS coefficient FROM (VALUES ('l_quantity'), ('l_discount'), ('l_tax')) AS v(c)
UNION ALL SELECT '(intercept)', round(avg(ln(1 + l_extendedprice)), 4) FROM lineitem""")
def g5_elastic_net_all_zero(spark, d):
    fitted = fit(line_value(spark, d), Spec(
        "m", "elastic_net", "log_price", ("l_quantity", "l_discount", "l_tax"), {"alpha": 100.0, "l1_ratio": 0.9}))
    return rounded(E.coefficient_table(fitted, spark).select("feature", "coefficient"), 4)


@query("g6_poisson_chosen_alpha")
def g6_poisson_chosen_alpha(spark, d):
    train = _train(spark, d)
    fitted = fit(train, Spec("m", "poisson", COUNT, EVERYTHING, {"alpha": 0.01}))
    return rounded(E.coefficient_table(fitted, spark))


@query("g7_boosted_trees")
def g7_boosted_trees(spark, d):
    sides = _sides(spark, d)
    fitted = fit(sides.where("split = 'train'"), Spec(
        "m", "gbt", COUNT, EVERYTHING, {"n_estimators": 10, "learning_rate": 0.1, "max_depth": 2}))
    return rounded(fitted.predict(sides.where("split = 'test'").select(KEY, COUNT, *EVERYTHING)).select(KEY, COUNT, "yhat"))


@query("g7_boosted_stumps", """
WITH s AS (SELECT (l_returnflag = 'A')::INT AS is_a, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1)
SELECT is_a, round(m, 4) AS yhat, count(*) AS n FROM lineitem JOIN s ON is_a = (l_returnflag = 'A')::INT GROUP BY ALL""")
def g7_boosted_stumps(spark, d):
    """Three stumps on one indicator, no subsampling: the first gives the group means and leaves nothing to the others."""
    df = line_value(spark, d).withColumn("is_a", (F.col("l_returnflag") == "A").cast("int"))
    fitted = fit(df, Spec("m", "gbt", "l_extendedprice", ("is_a",), {
        "n_estimators": 3, "max_depth": 1, "subsample": 1.0, "max_features": "all"}))
    return rounded(fitted.predict(df.select("is_a")).groupBy("is_a").agg(F.avg("yhat").alias("yhat"), F.count("*").alias("n")), 4)


@query("g8_random_forest")
def g8_random_forest(spark, d):
    sides = _sides(spark, d)
    fitted = fit(sides.where("split = 'train'"), Spec(
        "m", "forest", COUNT, EVERYTHING, {"n_estimators": 10, "max_depth": 5, "min_samples_leaf": 2, "max_features": 0.5}))
    return rounded(fitted.predict(sides.where("split = 'test'").select(KEY, COUNT, *EVERYTHING)).select(KEY, COUNT, "yhat"))


@query("g8_single_stump", """
WITH s AS (SELECT count(*) FILTER (l_returnflag = 'A') AS na, avg(l_extendedprice) AS m FROM lineitem)
SELECT (l_returnflag = 'A')::INT AS is_a, round(avg(l_extendedprice), 4) AS yhat, count(*) AS n FROM lineitem, s GROUP BY 1""")
def g8_single_stump(spark, d):
    """One tree of depth one on one indicator, no bootstrap: the two group means."""
    df = line_value(spark, d).withColumn("is_a", (F.col("l_returnflag") == "A").cast("int"))
    fitted = fit(df, Spec("m", "forest", "l_extendedprice", ("is_a",), {
        "n_estimators": 1, "max_depth": 1, "bootstrap": False, "max_features": "all"}))
    return rounded(fitted.predict(df.select("is_a")).groupBy("is_a").agg(F.avg("yhat").alias("yhat"), F.count("*").alias("n")), 4)


_MLP = {"hidden": [16], "learning_rate": 0.01, "alpha": 0.0001, "max_iter": 6}


@query("g9_mlp_regressor")
def g9_mlp_regressor(spark, d):
    sides = _sides(spark, d)
    spec = Spec("m", "mlp", COUNT, ("o_totalprice", "c_acctbal", "o_orderpriority", "o_month"), _MLP, key=KEY)
    fitted = fit(sides.where("split = 'train'"), spec)
    rows = sides.where("split = 'test'").select(KEY, COUNT, *spec.predictors)
    return rounded(fitted.predict(rows).select(KEY, COUNT, "yhat"))


@query("g18_mlp_training_log")
def g18_mlp_training_log(spark, d):
    spec = Spec("m", "mlp", "l_extendedprice_k", ("l_quantity", "l_discount", "l_tax"), _MLP, key="line_key")
    df = line_value(spark, d).withColumn("l_extendedprice_k", F.col("l_extendedprice") / 1000)
    fitted = fit(df, spec)
    return rounded(training_log(spark, fitted.log).withColumn("parameters", F.lit(fitted.model.parameters)))


@query("g10_polynomial_degree_two", """
WITH z AS (SELECT l_extendedprice AS y, (l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem) AS z FROM lineitem),
c AS (SELECT var_pop(z) AS s11, var_pop(z * z) AS s22, covar_pop(z, z * z) AS s12, covar_pop(y, z) AS t1, covar_pop(y, z * z) AS t2,
             avg(y) AS my, avg(z) AS mz, avg(z * z) AS mzz FROM z),
b AS (SELECT (t1 * s22 - t2 * s12) / (s11 * s22 - s12 * s12) AS b1, (t2 * s11 - t1 * s12) / (s11 * s22 - s12 * s12) AS b2, * FROM c)
SELECT 'l_quantity' AS feature, round(b1, 3) AS coefficient FROM b UNION ALL
SELECT 'l_quantity^2', round(b2, 3) FROM b UNION ALL
SELECT '(intercept)', round(my - b1 * mz - b2 * mzz, 3) FROM b""")
def g10_polynomial_degree_two(spark, d):
    fitted = fit(line_value(spark, d), Spec("m", "polynomial", "l_extendedprice", ("l_quantity",), {"degree": 2}))
    return rounded(E.coefficient_table(fitted, spark).select("feature", "coefficient"), 3)


@query("g10_polynomial_comparison")
def g10_polynomial_comparison(spark, d):
    spec = Spec("poly", "polynomial", "log_price", ("l_quantity", "l_discount", "l_tax"), key="line_key")
    df = with_split(line_value(spark, d), "line_key")
    results = compare_degrees(df, spec, [1, 2, 3], "line_key", k=3)
    out = results[0].metrics
    for r in results[1:]:
        out = out.unionByName(r.metrics)
    return rounded(out.where("metric IN ('mse', 'rmse', 'mae', 'r2')").drop("fold"))


def _inference(df, label, predictors, family, spark):
    data = df.withColumn("__y", F.col(label).cast("double"))
    e = fit_encoder(data, Recipe.of(data, predictors, levels="drop_first"))
    return E.inference_table(E.inference(e.transform(data).select("features", "__y"), e.names, family), spark)


@query("g11_inference_linear", """
WITH s AS (SELECT count(*) AS n, regr_slope(l_extendedprice, l_quantity) * stddev_pop(l_quantity) AS b, var_pop(l_extendedprice) * count(*) AS syy,
                  avg(l_extendedprice) AS a FROM lineitem),
r AS (SELECT *, sqrt((syy - b * b * n) / (n - 2) / n) AS se FROM s)
SELECT 'l_quantity' AS feature, round(b, 3) AS coefficient, round(se, 3) AS std_error, round(b / se, 4) AS statistic FROM r UNION ALL
SELECT '(intercept)', round(a, 3), round(se, 3), round(a / se, 4) FROM r""")
def g11_inference_linear(spark, d):
    """Slope on a standardised predictor with its error and t statistic."""
    t = _inference(line_value(spark, d), "l_extendedprice", ["l_quantity"], "linear", spark).drop("p_value")
    return t.select("feature", F.round("coefficient", 3).alias("coefficient"), F.round("std_error", 3).alias("std_error"),
                    F.round("statistic", 4).alias("statistic"))


_GROUPS_SQL = SIDES_SQL + """,
g AS (SELECT o_orderpriority AS v, avg(n_lines) AS m, sum(n_lines) AS s, sum(hi) AS pos, sum(1 - hi) AS neg FROM sides WHERE split = 'train' GROUP BY 1),
f AS (SELECT * FROM g ORDER BY v LIMIT 1)"""


@query("g11_inference_poisson", with_tables(_GROUPS_SQL, """
, c AS (SELECT 'o_orderpriority_' || g.v AS feature, ln(g.m / f.m) AS b, sqrt(1 / g.s + 1 / f.s) AS se FROM g, f WHERE g.v <> f.v
        UNION ALL SELECT '(intercept)', ln(m), sqrt(1 / s) FROM f)
SELECT feature, round(b, 4) AS coefficient, round(se, 4) AS std_error, round(b / se, 2) AS statistic FROM c"""))
def g11_inference_poisson(spark, d):
    """Log rate ratios against the first level."""
    t = _inference(_train(spark, d), COUNT, ["o_orderpriority"], "poisson", spark).drop("p_value")
    return rounded(t.withColumn("statistic", F.round("statistic", 2)), 4)


@query("g11_inference_logistic", with_tables(_GROUPS_SQL, """
, c AS (SELECT 'o_orderpriority_' || g.v AS feature, ln(g.pos / g.neg / (f.pos / f.neg)) AS b,
               sqrt(1 / g.pos + 1 / g.neg + 1 / f.pos + 1 / f.neg) AS se FROM g, f WHERE g.v <> f.v
        UNION ALL SELECT '(intercept)', ln(pos / neg), sqrt(1 / pos + 1 / neg) FROM f)
SELECT feature, round(b, 4) AS coefficient, round(se, 4) AS std_error, round(b / se, 2) AS statistic FROM c"""))
def g11_inference_logistic(spark, d):
    """Log odds ratios against the first level."""
    t = _inference(_train(spark, d), BINARY, ["o_orderpriority"], "logistic", spark).drop("p_value")
    return rounded(t.withColumn("statistic", F.round("statistic", 2)), 4)


@query("g11_inference_p_values")
def g11_inference_p_values(spark, d):
    return rounded(_inference(_train(spark, d), COUNT, ["o_totalprice", "c_acctbal", "o_orderpriority"], "poisson", spark))


_PATH_SQL = """
WITH s AS (SELECT covar_pop(ln(1 + l_extendedprice), l_quantity) / stddev_pop(l_quantity) AS c FROM lineitem),
g AS (SELECT l1_ratio, 0.001 * power(10000.0, i / 49.0) AS alpha
      FROM (VALUES (0.1::DOUBLE), (0.5), (0.9)) AS r(l1_ratio), range(50) AS t(i))"""
_RATIOS = [0.1, 0.5, 0.9]


@query("g12_coefficient_path", _PATH_SQL + """
SELECT l1_ratio, round(alpha, 6) AS alpha, 'l_quantity' AS feature,
       round(sign(c) * greatest(abs(c) - alpha * l1_ratio, 0) / (1 + alpha * (1 - l1_ratio)), 4) AS coefficient FROM s, g""")
def g12_coefficient_path(spark, d):
    spec = Spec("m", "elastic_net", "log_price", ("l_quantity",))
    return _round_path(E.largest_paths(E.coefficient_paths(line_value(spark, d), spec, E.alpha_grid(), _RATIOS)))


def _round_path(df):
    return df.select("l1_ratio", F.round("alpha", 6).alias("alpha"), "feature",
                     (F.round("coefficient", 4) + F.lit(0.0)).alias("coefficient"))


@query("g12_largest_paths")
def g12_largest_paths(spark, d):
    """Paths of the twenty largest of all encoded predictors; compared with a direct optimum in the tests."""
    paths = E.coefficient_paths(_train(spark, d), Spec("m", "elastic_net", LOG, EVERYTHING), E.alpha_grid(), _RATIOS)
    return _round_path(E.largest_paths(paths))


@query("g13_l1_norms", _PATH_SQL + """
SELECT l1_ratio, round(alpha, 6) AS alpha, round(greatest(abs(c) - alpha * l1_ratio, 0) / (1 + alpha * (1 - l1_ratio)), 4) AS l1_norm FROM s, g""")
def g13_l1_norms(spark, d):
    spec = Spec("m", "elastic_net", "log_price", ("l_quantity",))
    norms = E.l1_norms(E.coefficient_paths(line_value(spark, d), spec, E.alpha_grid(), _RATIOS))
    return norms.select("l1_ratio", F.round("alpha", 6).alias("alpha"), (F.round("l1_norm", 4) + F.lit(0.0)).alias("l1_norm"))


@query("g14_predict", with_tables(SIDES_SQL, """
, f AS (SELECT regr_slope(log_lines, o_totalprice) AS b, regr_intercept(log_lines, o_totalprice) AS a FROM sides WHERE split = 'train')
SELECT o_orderkey, round(a + b * o_totalprice, 5) AS yhat FROM sides, f WHERE split = 'test'"""))
def g14_predict(spark, d):
    sides = _sides(spark, d).select(KEY, "split", LOG, "o_totalprice")
    fitted = fit(sides.where("split = 'train'"), Spec("m", "ols", LOG, ("o_totalprice",), log_label=True))
    return rounded(fitted.predict(sides.where("split = 'test'")).select(KEY, "yhat"), 5)


@query("g15_label_at_cut", with_tables(SIDES_SQL, """
, m AS (SELECT o_orderpriority, avg(hi) AS p FROM sides WHERE split = 'train' GROUP BY 1)
SELECT o_orderpriority, round(p, 4) AS p, (p >= 0.4)::INT AS yhat, count(*) AS n FROM sides JOIN m USING (o_orderpriority)
WHERE split = 'test' GROUP BY ALL"""))
def g15_label_at_cut(spark, d):
    """Class 1 from probability 0.4 on (here without class weights)."""
    sides = _sides(spark, d).select(KEY, "split", BINARY, "o_orderpriority")
    fitted = fit(sides.where("split = 'train'"), Spec(
        "m", "logistic", BINARY, ("o_orderpriority",), {"c": 1e9, "balanced": False}))
    scored = fitted.predict(sides.where("split = 'test'"))
    return scored.groupBy("o_orderpriority", F.round("p", 4).alias("p"), "yhat").agg(F.count("*").alias("n"))


@query("g16_top_coefficients", """
WITH m AS (SELECT event_type, avg(value) AS m FROM events GROUP BY 1), o AS (SELECT avg(m) AS o FROM m)
SELECT 'event_type_' || event_type AS feature, round(m - o, 3) AS coefficient FROM m, o ORDER BY abs(m - o) DESC LIMIT 3""")
def g16_top_coefficients(spark, d):
    """All levels kept: the smallest least-squares coefficients are the centred group means."""
    fitted = fit(event_value(spark, d), Spec("m", "ols", "value", ("event_type",)))
    return rounded(E.top_coefficients(E.coefficient_table(fitted, spark), 3).select("feature", "coefficient"), 3)


@query("g17_feature_importances")
def g17_feature_importances(spark, d):
    fitted = fit(_train(spark, d), Spec("m", "forest", COUNT, EVERYTHING, {"n_estimators": 10, "max_depth": 4}))
    return rounded(E.top_importances(E.importance_table(fitted, spark)))


@query("g17_importance_shares", """
WITH g AS (SELECT (l_returnflag = 'A')::INT AS a, (l_returnflag = 'R')::INT AS r, l_extendedprice AS y FROM lineitem),
v AS (SELECT var_pop(y) AS whole,
  (SELECT sum(c * w) / sum(c) FROM (SELECT count(*) AS c, var_pop(y) AS w FROM g GROUP BY a)) AS by_a,
  (SELECT sum(c * w) / sum(c) FROM (SELECT count(*) AS c, var_pop(y) AS w FROM g GROUP BY r)) AS by_r FROM g)
SELECT 'is_a' AS feature, (by_a <= by_r)::INT::DOUBLE AS importance FROM v UNION ALL SELECT 'is_r', (by_a > by_r)::INT::DOUBLE FROM v""")
def g17_importance_shares(spark, d):
    """One stump over two indicators: all importance goes to the split that leaves less variance."""
    flag = lambda v: (F.col("l_returnflag") == v).cast("int")
    df = line_value(spark, d).withColumn("is_a", flag("A")).withColumn("is_r", flag("R"))
    fitted = fit(df, Spec("m", "forest", "l_extendedprice", ("is_a", "is_r"), {
        "n_estimators": 1, "max_depth": 1, "bootstrap": False, "max_features": "all"}))
    return rounded(E.importance_table(fitted, spark).select("feature", "importance"))


@query("g19_null_model", with_tables(SIDES_SQL, """
, m AS (SELECT avg(n_lines) AS mu FROM sides WHERE split = 'train'), t AS (SELECT n_lines AS y FROM sides WHERE split = 'test')
SELECT count(*) AS n, round(avg((y - mu) ^ 2), 6) AS mse, round(avg(abs(y - mu)), 6) AS mae,
       round(avg(2 * (CASE WHEN y > 0 THEN y * ln(y / mu) ELSE 0 END - y + mu)), 6) AS poisson_deviance FROM t, m"""))
def g19_null_model(spark, d):
    sides = _sides(spark, d).select("split", COUNT)
    mean = sides.where("split = 'train'").agg(F.avg(COUNT)).scalar()
    scored = sides.where("split = 'test'").select(F.col(COUNT).cast("double").alias("y"), mean.alias("yhat"))
    wanted = {k: M.COUNT[k] for k in ("mse", "mae", "poisson_deviance")}
    return rounded(M.evaluate(scored, wanted))


@query("g19_majority_class", with_tables(SIDES_SQL, """
, m AS (SELECT (avg(hi) > 0.5)::INT AS c FROM sides WHERE split = 'train')
SELECT count(*) AS n, c AS majority_class, round(avg((hi = c)::INT), 6) AS accuracy,
       CASE WHEN c = 1 THEN round(2.0 * sum(hi) / (count(*) + sum(hi)), 6) ELSE 0.0::DOUBLE END AS f1, 0.5::DOUBLE AS roc_auc
FROM sides, m WHERE split = 'test' GROUP BY c"""))
def g19_majority_class(spark, d):
    sides = _sides(spark, d).select("split", BINARY)
    return rounded(M.majority_baseline(sides.where("split = 'train'"), sides.where("split = 'test'"), BINARY))
