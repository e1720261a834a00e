"""Chart tables, reports and sinks."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tallymark.operators import diagnostics as D, metrics as M, profile as P
from tallymark.operators.estimators import Spec
from tallymark.plans.report import report_lines
from tallymark.plans.train import tidy
from tallymark.queries.profiling import _corr_sql, _HISTOGRAM
from tallymark.queries.registry import query, rounded, with_tables
from tallymark.queries.scoring import _DEV, _two_sides
from tallymark.session import staging_root
from tallymark.sources.fixtures import (
    CATEGORICAL, COUNT, KEY, LOG, NUMERIC, ORDER_FACT_SQL, SCORED_SQL, line_value, order_fact, scored_orders,
)
from tallymark.sources.sinks import write_metrics, write_report, write_table


@query("x1_residuals", with_tables(SCORED_SQL, "SELECT o_orderkey, round(y - yhat, 6) AS residual FROM scored"))
def x1_residuals(spark, d):
    return rounded(D.residuals(scored_orders(spark, d)).select(KEY, "residual"))


@query("x2_residual_band", with_tables(SCORED_SQL, """
, e AS (SELECT y - yhat AS r FROM scored), s AS (SELECT stddev_pop(r) AS sd, avg(r) AS m FROM e)
SELECT count(*) AS n, round(m, 6) AS mean_residual, round(-2 * sd, 6) AS lower, round(2 * sd, 6) AS upper,
       round(avg((abs(r) > 2 * sd)::INT), 6) AS outside_share FROM e, s GROUP BY m, sd"""))
def x2_residual_band(spark, d):
    band = D.residual_band(D.residuals(scored_orders(spark, d)))
    return rounded(band.groupBy("mean_residual", "lower", "upper").agg(
        F.count("*").alias("n"), F.avg("outside").alias("outside_share")))


@query("x3_residual_histogram", with_tables(SCORED_SQL + ", src AS (SELECT y - yhat AS v FROM scored)", _HISTOGRAM.format(bins=30)))
def x3_residual_histogram(spark, d):
    return rounded(D.residual_histogram(D.residuals(scored_orders(spark, d))))


@query("x4_qq_points")
def x4_qq_points(spark, d):
    return rounded(D.qq_points(D.residuals(scored_orders(spark, d)), "residual", KEY))


@query("x4_qq_ranks", with_tables(SCORED_SQL, """
SELECT round(y - yhat, 6) AS ordered, count(*) AS n, min(rk) AS first_rank, max(rk) AS last_rank FROM
  (SELECT *, row_number() OVER (ORDER BY round(y - yhat, 9), o_orderkey) AS rk FROM scored) GROUP BY round(y - yhat, 6)"""))
def x4_qq_ranks(spark, d):
    """Ranks of tied residuals form one block each."""
    r = scored_orders(spark, d).select(KEY, F.round(F.col("y") - F.col("yhat"), 9).alias("residual"))
    return D.qq_points(r, "residual", KEY).groupBy(F.round("ordered", 6).alias("ordered")).agg(
        F.count("*").alias("n"), F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"))


@query("x4_qq_line")
def x4_qq_line(spark, d):
    return rounded(D.qq_line(D.qq_points(D.residuals(scored_orders(spark, d)), "residual", KEY)), 4)


@query("x5_error_by_actual", with_tables(SCORED_SQL, """
, e AS (SELECT y AS actual, yhat - y AS error FROM scored),
b AS (SELECT actual, count(*) AS n, quantile_cont(error, 0.25) AS q25, quantile_cont(error, 0.5) AS median, quantile_cont(error, 0.75) AS q75 FROM e GROUP BY 1)
SELECT actual, n, round(q25, 6) AS q25, round(median, 6) AS median, round(q75, 6) AS q75,
       round(min(error) FILTER (error >= q25 - 1.5 * (q75 - q25)), 6) AS whisker_low,
       round(max(error) FILTER (error <= q75 + 1.5 * (q75 - q25)), 6) AS whisker_high
FROM b JOIN e USING (actual) GROUP BY ALL"""))
def x5_error_by_actual(spark, d):
    return rounded(D.error_by_actual(scored_orders(spark, d)))


@query("x6_actual_vs_predicted", with_tables(SCORED_SQL, """
SELECT count(*) AS n, round(avg(y), 6) AS mean_actual, round(avg(yhat), 6) AS mean_predicted, round(least(min(y), min(yhat)), 6) AS low,
       round(greatest(max(y), max(yhat)), 6) AS high FROM scored"""))
def x6_actual_vs_predicted(spark, d):
    return rounded(D.actual_vs_predicted(scored_orders(spark, d)))


def _side_metrics(spark, d, names):
    cv, test = _two_sides(spark, d)
    return tidy(cv, names, "by_month", "cv").unionByName(tidy(test, names, "by_month", "test"))


_BARS_SQL = SCORED_SQL + f""",
g AS (SELECT fold < 5 AS cv, avg({_DEV}) AS poisson_deviance, avg((y - yhat) ^ 2) AS mse,
             1 - avg({_DEV}) / avg({_DEV.replace('yhat', 'm')}) AS pseudo_r2
      FROM (SELECT *, avg(y) OVER (PARTITION BY fold < 5) AS m FROM scored) GROUP BY 1),
l AS (UNPIVOT g ON poisson_deviance, mse, pseudo_r2 INTO NAME metric VALUE v)"""


@query("x7_metric_bars", with_tables(_BARS_SQL, """
, p AS (SELECT metric, max(v) FILTER (cv) AS cv, max(v) FILTER (NOT cv) AS test FROM l GROUP BY 1)
SELECT 'by_month' AS model, metric, round(cv, 6) AS cv, round(test, 6) AS test,
       CASE WHEN cv > 0 THEN round((test - cv) / cv * 100, 4) END AS percent_change,
       coalesce((CASE WHEN cv > 0 THEN (test - cv) / cv * 100 ELSE 0 END > 10)::INT, 0) AS flag FROM p"""))
def x7_metric_bars(spark, d):
    bars = D.metric_bars(_side_metrics(spark, d, ["poisson_deviance", "pseudo_r2", "mse", "mae"]), "poisson")
    return rounded(bars.withColumn("percent_change", F.round("percent_change", 4)))


@query("x7_metric_bars_linear", with_tables(SCORED_SQL, """
, g AS (SELECT fold < 5 AS cv, avg((y - yhat) ^ 2) AS mse, avg(abs(y - yhat)) AS mae FROM scored GROUP BY 1),
l AS (UNPIVOT (SELECT cv, mse, mae, mse AS primary_metric FROM g) ON mse, mae, primary_metric INTO NAME metric VALUE v)
, p AS (SELECT metric, max(v) FILTER (cv) AS cv, max(v) FILTER (NOT cv) AS test FROM l GROUP BY 1)
SELECT 'by_month' AS model, metric, round(cv, 6) AS cv, round(test, 6) AS test,
       CASE WHEN cv > 0 THEN round((test - cv) / cv * 100, 4) END AS percent_change,
       coalesce((CASE WHEN cv > 0 THEN (test - cv) / cv * 100 ELSE 0 END > 10)::INT, 0) AS flag FROM p"""))
def x7_metric_bars_linear(spark, d):
    bars = D.metric_bars(_side_metrics(spark, d, ["mse", "mae", "pseudo_r2"]), "ridge")
    return rounded(bars.withColumn("percent_change", F.round("percent_change", 4)))


@query("x8_target_panel", with_tables(ORDER_FACT_SQL, """
, c AS (SELECT n_lines, count(*) AS n FROM order_fact GROUP BY 1 ORDER BY n DESC, n_lines LIMIT 1)
SELECT 'n_lines' AS "column", count(*) AS n, round(avg(o.n_lines), 6) AS mean, round(stddev_samp(o.n_lines), 6) AS std,
       round(var_samp(o.n_lines), 6) AS var, min(o.n_lines)::DOUBLE AS min, max(o.n_lines)::DOUBLE AS max,
       (max(o.n_lines) - min(o.n_lines))::DOUBLE AS range, round(skewness(o.n_lines), 6) AS skew, round(kurtosis(o.n_lines), 6) AS kurtosis,
       quantile_cont(o.n_lines, 0.25)::DOUBLE AS q25, median(o.n_lines)::DOUBLE AS median, quantile_cont(o.n_lines, 0.75)::DOUBLE AS q75,
       (quantile_cont(o.n_lines, 0.75) - quantile_cont(o.n_lines, 0.25))::DOUBLE AS iqr, any_value(c.n_lines)::INT AS mode FROM order_fact o, c"""))
def x8_target_panel(spark, d):
    return rounded(D.target_panel(order_fact(spark, d), COUNT))


@query("x9_original_and_log", with_tables(ORDER_FACT_SQL + ", b AS (SELECT n_lines::DOUBLE AS original, ln(1 + n_lines) AS log FROM order_fact)",
    " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count(*) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(median({c}), 6) AS median,
       round(skewness({c}), 6) AS skew FROM b""" for c in ("original", "log"))))
def x9_original_and_log(spark, d):
    return rounded(D.original_and_log(order_fact(spark, d), COUNT).select("column", "n", "mean", "std", "median", "skew"))


@query("x9_histograms", with_tables("src AS (SELECT l_extendedprice AS v FROM lineitem)", _HISTOGRAM.format(bins=50).replace(
    "coalesce(n, 0) AS n", "coalesce(n, 0) AS n, 'original' AS scale")) + " UNION ALL SELECT * FROM (" + with_tables(
    "src AS (SELECT ln(1 + l_extendedprice) AS v FROM lineitem)", _HISTOGRAM.format(bins=50).replace(
        "coalesce(n, 0) AS n", "coalesce(n, 0) AS n, 'log' AS scale")) + ")")
def x9_histograms(spark, d):
    return rounded(D.original_and_log_histograms(line_value(spark, d), "l_extendedprice"))


@query("x10_correlation_bars", with_tables(ORDER_FACT_SQL, _corr_sql(NUMERIC, [COUNT, LOG], "order_fact")))
def x10_correlation_bars(spark, d):
    return rounded(P.correlations(order_fact(spark, d), NUMERIC, [COUNT, LOG]))


_TREND_COLUMNS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@query("x10_scatter_trends", "WITH f AS (" + " UNION ALL ".join(f"""
SELECT '{c}' AS predictor, abs(corr(l_extendedprice, {c})) AS abs_r, regr_slope(l_extendedprice, {c}) AS b, regr_intercept(l_extendedprice, {c}) AS a,
       min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM lineitem""" for c in _TREND_COLUMNS) + """),
t AS (SELECT * FROM f ORDER BY abs_r DESC, predictor LIMIT 3)
SELECT predictor, round(abs_r, 6) AS abs_r, i::INT AS point, round(lo + i * (hi - lo) / 99, 6) AS x, round(a + b * (lo + i * (hi - lo) / 99), 4) AS y
FROM t, range(100) AS r(i)""")
def x10_scatter_trends(spark, d):
    t = D.scatter_with_trend(line_value(spark, d), _TREND_COLUMNS, "l_extendedprice")
    return rounded(t.withColumn("y", F.round("y", 4)))


@query("x11_predictor_comparison", with_tables(ORDER_FACT_SQL, """
, g AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS predictor, avg(n_lines) AS m FROM order_fact GROUP BY {c}" for c in CATEGORICAL) + """),
o AS (SELECT avg(n_lines) AS o FROM order_fact)
SELECT 'categorical' AS kind, predictor, round(max(abs(m - o)), 6) AS effect, round(avg(m), 6) AS mean_of_means FROM g, o GROUP BY predictor UNION ALL
""" + " UNION ALL ".join(f"SELECT 'numeric', '{c}', round(corr({c}, n_lines), 6), NULL FROM order_fact" for c in NUMERIC)))
def x11_predictor_comparison(spark, d):
    return rounded(D.predictor_comparison(order_fact(spark, d), NUMERIC, CATEGORICAL, COUNT))


_SPEC = Spec("by_month", "poisson", COUNT, ("o_orderpriority", "o_month"))
_NAMES = ["poisson_deviance", "pseudo_r2", "mse", "rmse", "mae", "r2"]


def _report(spark, d):
    cv, test = _two_sides(spark, d)
    metrics = tidy(cv, _NAMES, "by_month", "cv").unionByName(tidy(M.with_adjusted_r2(test, 2), [*_NAMES, "adj_r2"], "by_month", "test"))
    spread = M.ranges(scored_orders(spark, d).where("fold >= 5"))
    return report_lines(metrics.unionByName(tidy(spread, spread.columns, "by_month", "test")), _SPEC, "fixed")


_REPORT_SQL = SCORED_SQL + f""",
w AS (SELECT *, avg(y) OVER (PARTITION BY fold < 5) AS m FROM scored),
g AS (SELECT fold < 5 AS cv, avg({_DEV}) AS dev, 1 - avg({_DEV}) / avg({_DEV.replace('yhat', 'm')}) AS pr, avg((y - yhat) ^ 2) AS mse,
             avg(abs(y - yhat)) AS mae FROM w GROUP BY 1),
c AS (SELECT * FROM g WHERE cv), t AS (SELECT * FROM g WHERE NOT cv)"""


@query("x12_report_lines", with_tables(_REPORT_SQL, """
SELECT section, text FROM (
""" + " UNION ALL ".join(f"""
SELECT '{s}' AS section, printf('  %-20s%.4f', '{n}:', {e}) AS text FROM {t}"""
    for s, t in (("cross-validation (10 folds)", "c"), ("test set", "t"))
    for n, e in (("Poisson Deviance", "dev"), ("Pseudo-R2", "pr"), ("MSE", "mse"), ("RMSE", "sqrt(mse)"), ("MAE", "mae"))) + """
UNION ALL SELECT 'generalisation (test / cv)', printf('  %-20s%.4f', 'Poisson Deviance:', t.dev / c.dev) FROM c, t
UNION ALL SELECT 'generalisation (test / cv)', printf('  %-20s%.4f', 'MSE:', t.mse / c.mse) FROM c, t
UNION ALL SELECT 'generalisation (test / cv)', printf('  %-20s%.4f', 'MAE:', t.mae / c.mae) FROM c, t)"""))
def x12_report_lines(spark, d):
    """The measured lines of a text report."""
    shown = ["cross-validation (10 folds)", "test set", "generalisation (test / cv)"]
    return _report(spark, d).where(F.col("section").isin(shown)).select("section", "text")


@query("s2_text_report")
def s2_text_report(spark, d):
    """The whole report, written as text and read back."""
    path = os.path.join(staging_root(spark), f"report-{uuid.uuid4().hex}")
    write_report(_report(spark, d), path)
    return spark.read.text(path)


@query("s3_metrics_registry", with_tables(_REPORT_SQL, """
SELECT 'poisson' AS family, 'by_month' AS model, 'r1' AS run, CASE WHEN cv THEN 'cv' ELSE 'test' END AS split, metric, round(v, 6) AS value
FROM (UNPIVOT (SELECT cv, dev AS poisson_deviance, mse, mae FROM g) ON poisson_deviance, mse, mae INTO NAME metric VALUE v)"""))
def s3_metrics_registry(spark, d):
    """Tidy metrics appended to the registry and read back."""
    root = os.path.join(staging_root(spark), f"registry-{uuid.uuid4().hex}")
    write_metrics(_side_metrics(spark, d, ["poisson_deviance", "mse", "mae"]), root, "r1", "poisson")
    return rounded(spark.read.parquet(root).select("family", "model", "run", "split", "metric", "value"))


@query("s4_artifact_layout", with_tables(SCORED_SQL, """
SELECT 'poisson' AS folder, 'r1' AS run, count(*) AS n, round(sum(yhat), 4) AS total FROM scored UNION ALL
SELECT 'best', 'r1', count(*), round(sum(yhat), 4) FROM scored"""))
def s4_artifact_layout(spark, d):
    """Predictions written to the family folder and, as a best model, to the best folder."""
    root = os.path.join(staging_root(spark), f"artifacts-{uuid.uuid4().hex}")
    scored = scored_orders(spark, d).select(KEY, "y", "yhat")
    paths = {"poisson": write_table(scored, root, "poisson", "by_month", "r1"),
             "best": write_table(scored, root, "poisson", "by_month", "r1", best=True)}
    parts = [spark.read.option("basePath", os.path.dirname(p)).parquet(p).groupBy("run").agg(
        F.count("*").alias("n"), F.sum("yhat").alias("total")).withColumn("folder", F.lit(f)) for f, p in paths.items()]
    return rounded(parts[0].unionByName(parts[1]), 4)


@query("x13_degree_report")
def x13_degree_report(spark, d):
    """Report of a degree-two model with its encoded width and the adjusted R2 that uses it."""
    spec = Spec("poly_deg_2", "polynomial", COUNT, ("o_totalprice", "c_acctbal"), {"degree": 2})
    from tallymark.operators.estimators import fit
    from tallymark.operators.splits import with_split
    from tallymark.plans.train import score, test_metrics

    sides = with_split(order_fact(spark, d), KEY)
    fitted = fit(sides.where("split = 'train'"), spec)
    metrics = test_metrics(score(fitted, sides.where("split = 'test'"), KEY), spec, fitted.encoder.width)
    return report_lines(metrics, spec, "fixed", features=fitted.encoder.width)
