"""Metrics over the scored orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.functions.columns import auc_band
from tallymark.operators import metrics as M
from tallymark.queries.registry import query, rounded, with_tables
from tallymark.sources.fixtures import KEY, SCORED_SQL, SIDES_SQL, order_fact, scored_orders
from tallymark.operators.splits import with_split

_DEV = "2 * (CASE WHEN y > 0 THEN y * ln(y / greatest(yhat, 1e-9)) ELSE 0 END - y + greatest(yhat, 1e-9))"


@query("m1_mse_rmse", with_tables(SCORED_SQL, """
SELECT fold, count(*) AS n, round(avg((y - yhat) ^ 2), 6) AS mse, round(sqrt(avg((y - yhat) ^ 2)), 6) AS rmse FROM scored GROUP BY fold"""))
def m1_mse_rmse(spark, d):
    return rounded(M.evaluate(scored_orders(spark, d), {k: M.REGRESSION[k] for k in ("mse", "rmse")}, by=["fold"]))


@query("m2_mae", with_tables(SCORED_SQL, "SELECT fold, count(*) AS n, round(avg(abs(y - yhat)), 6) AS mae FROM scored GROUP BY fold"))
def m2_mae(spark, d):
    return rounded(M.evaluate(scored_orders(spark, d), {"mae": M.mae}, by=["fold"]))


@query("m3_r2", with_tables(SCORED_SQL, """
SELECT fold, count(*) AS n, round(1 - sum((y - yhat) ^ 2) / (var_pop(y) * count(*)), 6) AS r2 FROM scored GROUP BY fold"""))
def m3_r2(spark, d):
    return rounded(M.evaluate(scored_orders(spark, d), {"r2": M.r2}, by=["fold"]))


@query("m4_adjusted_r2", with_tables(SCORED_SQL, """
, r AS (SELECT fold, count(*) AS n, 1 - sum((y - yhat) ^ 2) / (var_pop(y) * count(*)) AS r2 FROM scored GROUP BY fold)
SELECT fold, n, round(r2, 6) AS r2, CASE WHEN n > 61 THEN round(1 - (1 - r2) * (n - 1) / (n - 60 - 1), 6) END AS adj_r2 FROM r"""))
def m4_adjusted_r2(spark, d):
    return rounded(M.with_adjusted_r2(M.evaluate(scored_orders(spark, d), {"r2": M.r2}, by=["fold"]), 60))


@query("m5_poisson_deviance", with_tables(SCORED_SQL, f"SELECT fold, count(*) AS n, round(avg({_DEV}), 6) AS deviance FROM scored GROUP BY fold"))
def m5_poisson_deviance(spark, d):
    return rounded(M.evaluate(scored_orders(spark, d), {"deviance": M.poisson_deviance}, by=["fold"]))


@query("m6_pseudo_r2", with_tables(SCORED_SQL, f"""
, w AS (SELECT *, avg(y) OVER (PARTITION BY fold) AS m FROM scored),
r AS (SELECT fold, avg({_DEV}) AS dev, avg({_DEV.replace('yhat', 'm')}) AS nul, avg({_DEV.replace('yhat', 'trunc(m)')}) AS nul_cut FROM w GROUP BY fold)
SELECT fold, round(1 - dev / nul, 6) AS pseudo_r2, round(greatest(0, least(1, 1 - dev / nul_cut)), 6) AS compat FROM r"""))
def m6_pseudo_r2(spark, d):
    """Against the mean, and against the whole-number mean with clamping."""
    return rounded(scored_orders(spark, d).groupBy("fold").agg(
        M.pseudo_r2("y", "yhat").alias("pseudo_r2"), M.pseudo_r2("y", "yhat", compat=True).alias("compat")))


def _labels(spark, d, cut=0.5):
    return scored_orders(spark, d).select(KEY, F.col("hi").alias("y"), (F.col("p") >= cut).cast("int").alias("yhat"), "p", "fold")


_LABELS_SQL = SCORED_SQL + ", lab AS (SELECT o_orderkey, hi AS y, (p >= 0.5)::INT AS yhat, p, fold FROM scored)"
_CELLS_SQL = _LABELS_SQL + """,
cells AS (SELECT count(*) FILTER (y = 1 AND yhat = 1) AS tp, count(*) FILTER (y = 0 AND yhat = 1) AS fp,
                 count(*) FILTER (y = 1 AND yhat = 0) AS fn, count(*) FILTER (y = 0 AND yhat = 0) AS tn, fold FROM lab GROUP BY fold)"""


@query("m7_classification", with_tables(_CELLS_SQL, """
SELECT fold, tp + fp + fn + tn AS n, tn, fp, fn, tp, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
       round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM cells"""))
def m7_classification(spark, d):
    return rounded(M.classification(_labels(spark, d), "y", "yhat", ["fold"]))


_AUC_SQL = """
, r AS (SELECT fold, y, p, rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2.0 AS rk FROM lab),
a AS (SELECT fold, (sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0)
             / (count(*) FILTER (y = 1)::DOUBLE * count(*) FILTER (y = 0)) AS roc_auc FROM r GROUP BY fold)"""


@query("m8_roc_auc", with_tables(_LABELS_SQL + _AUC_SQL, "SELECT fold, round(roc_auc, 6) AS roc_auc FROM a"))
def m8_roc_auc(spark, d):
    return rounded(M.roc_auc(_labels(spark, d), "y", "p", ["fold"]))


@query("m8_roc_auc_ties", with_tables(SCORED_SQL.replace("AS p, fold", "AS p_fine, fold") + """
, lab AS (SELECT 0 AS fold, hi AS y, round(p_fine, 1) AS p FROM scored)""" + _AUC_SQL, "SELECT round(roc_auc, 6) AS roc_auc FROM a"))
def m8_roc_auc_ties(spark, d):
    """Scores cut to one digit: large groups of ties."""
    return rounded(M.roc_auc(_labels(spark, d).withColumn("p", F.round("p", 1)), "y", "p"))


@query("m9_log_loss", with_tables(_LABELS_SQL, """
SELECT fold, round(avg(CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END), 6) AS log_loss FROM lab GROUP BY fold"""))
def m9_log_loss(spark, d):
    return rounded(_labels(spark, d).groupBy("fold").agg(M.log_loss("y", "p").alias("log_loss")))


@query("m10_confusion", with_tables(_LABELS_SQL, """
SELECT a::INT AS actual, b::INT AS predicted, count(y) AS n FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS g(a, b)
LEFT JOIN lab ON y = a AND yhat = b GROUP BY ALL"""))
def m10_confusion(spark, d):
    return M.confusion(_labels(spark, d), "y", "yhat")


@query("m11_classification_report", with_tables(_LABELS_SQL, """
, c AS (SELECT count(*) FILTER (y = 1 AND yhat = 1) AS tp, count(*) FILTER (y = 0 AND yhat = 1) AS fp,
               count(*) FILTER (y = 1 AND yhat = 0) AS fn, count(*) FILTER (y = 0 AND yhat = 0) AS tn FROM lab),
k AS (SELECT 'low' AS label, tn / (tn + fn) AS "precision", tn / (tn + fp) AS recall, 2 * tn / (2 * tn + fn + fp) AS f1, tn + fp AS support FROM c
      UNION ALL SELECT 'high', tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), tp + fn FROM c),
rows AS (SELECT * FROM k UNION ALL
  SELECT 'macro avg', avg("precision"), avg(recall), avg(f1), sum(support)::BIGINT FROM k UNION ALL
  SELECT 'weighted avg', sum("precision" * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM k UNION ALL
  SELECT 'accuracy', (tp + tn) / (tp + tn + fp + fn), (tp + tn) / (tp + tn + fp + fn), (tp + tn) / (tp + tn + fp + fn), tp + tn + fp + fn FROM c)
SELECT label, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rows"""))
def m11_classification_report(spark, d):
    return rounded(M.classification_report(_labels(spark, d), "y", "yhat", ("low", "high")))


_ROC_SQL = _LABELS_SQL + """,
s AS (SELECT p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM lab GROUP BY p),
roc AS (SELECT p AS threshold, sum(neg) OVER w / (sum(neg) OVER ()) AS fpr, sum(pos) OVER w / (sum(pos) OVER ()) AS tpr FROM s WINDOW w AS (ORDER BY p DESC))"""


@query("m12_roc_curve", with_tables(_ROC_SQL, "SELECT round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc"))
def m12_roc_curve(spark, d):
    return rounded(M.roc_curve(_labels(spark, d), "y", "p"))


@query("m13_auc_band", with_tables(_LABELS_SQL + _AUC_SQL, """
SELECT fold, CASE WHEN roc_auc >= 0.9 THEN 'excellent' WHEN roc_auc >= 0.8 THEN 'good' WHEN roc_auc >= 0.7 THEN 'fair' ELSE 'poor' END AS band FROM a"""))
def m13_auc_band(spark, d):
    return M.roc_auc(_labels(spark, d), "y", "p", ["fold"]).select("fold", auc_band("roc_auc").alias("band"))


@query("m14_baseline_improvement", with_tables(_CELLS_SQL.replace("GROUP BY fold)", "GROUP BY fold)") + """,
maj AS (SELECT (avg(hi) > 0.5)::INT AS c FROM sides WHERE split = 'train'),
t AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM cells),
m AS (SELECT (tp + tn) / (tp + tn + fp + fn) AS acc, CASE WHEN c = 1 THEN (tp + fn) ELSE (tn + fp) END / (tp + tn + fp + fn) AS base FROM t, maj)""", """
SELECT round(acc, 6) AS accuracy, round(base, 6) AS baseline_accuracy, round((acc - base) / base * 100, 6) AS accuracy_gain FROM m"""))
def m14_baseline_improvement(spark, d):
    """Accuracy against the majority class of the train side, in percent."""
    sides = with_split(order_fact(spark, d).select(KEY, "hi"), KEY)
    base = M.majority_baseline(sides.where("split = 'train'"), sides.where("split = 'test'"), "hi").select("accuracy").scalar()
    ours = M.classification(_labels(spark, d), "y", "yhat").select("accuracy", base.alias("baseline_accuracy"))
    return rounded(ours.withColumn("accuracy_gain", M.improvement(F.col("accuracy"), F.col("baseline_accuracy"))))


_PANEL_SQL = SCORED_SQL + ", pan AS (SELECT (y >= 4)::INT AS y, (yhat >= 4)::INT AS yhat, yhat / (max(yhat) OVER ()) AS p, 0 AS fold FROM scored), lab AS (SELECT * FROM pan)"


@query("m15_count_panel", with_tables(_PANEL_SQL + _AUC_SQL, """
, c AS (SELECT count(*) AS n, count(*) FILTER (y = 1 AND yhat = 1) AS tp, count(*) FILTER (y = 0 AND yhat = 1) AS fp,
               count(*) FILTER (y = 1 AND yhat = 0) AS fn, count(*) FILTER (y = 0 AND yhat = 0) AS tn FROM lab)
SELECT n, tn, fp, fn, tp, round((tp + tn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall,
       round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(roc_auc, 6) AS roc_auc FROM c, a"""))
def m15_count_panel(spark, d):
    """A count model judged as a classifier after cutting truth and prediction."""
    panel = M.count_panel(scored_orders(spark, d), "y", "yhat", 4)
    return rounded(M.classification(panel, "y_bin", "yhat_bin").withColumn(
        "roc_auc", M.roc_auc(panel, "y_bin", "p").scalar()))


@query("m15_count_panel_one_class", with_tables(SCORED_SQL, """
SELECT CASE WHEN count(DISTINCT y >= 3) = 2 AND count(DISTINCT yhat >= 3) = 2 THEN count(*) ELSE 0 END AS n FROM scored"""))
def m15_count_panel_one_class(spark, d):
    """At threshold 3 every prediction falls in one class, so the panel is empty."""
    return M.count_panel(scored_orders(spark, d), "y", "yhat", 3).agg(F.count("*").alias("n"))


@query("m16_original_scale", with_tables(SCORED_SQL, """
, b AS (SELECT exp(y_log) - 1 AS y, greatest(exp(yhat_log) - 1, 0) AS yhat FROM scored),
r AS (SELECT count(*) AS n, avg(yhat) AS pred_mean, min(yhat) AS pred_min, max(yhat) AS pred_max, avg((y - yhat) ^ 2) AS mse,
             avg(abs(y - yhat)) AS mae, 1 - avg((y - yhat) ^ 2) / var_pop(y) AS r2 FROM b)
SELECT n, round(pred_mean, 6) AS pred_mean, round(pred_min, 6) AS pred_min, round(pred_max, 6) AS pred_max, round(mse, 6) AS mse,
       round(sqrt(mse), 6) AS rmse, round(mae, 6) AS mae, round(r2, 6) AS r2,
       CASE WHEN n > 61 THEN round(1 - (1 - r2) * (n - 1) / (n - 60 - 1), 6) END AS adj_r2 FROM r"""))
def m16_original_scale(spark, d):
    return rounded(M.original_scale(scored_orders(spark, d), "y_log", "yhat_log", 60))


@query("m17_log_scale", with_tables(SCORED_SQL, """
, b AS (SELECT ln(1 + y) AS y, ln(1 + greatest(yhat, 0)) AS yhat FROM scored)
SELECT count(*) AS n, round(avg((y - yhat) ^ 2), 6) AS mse, round(sqrt(avg((y - yhat) ^ 2)), 6) AS rmse,
       round(avg(abs(y - yhat)), 6) AS mae, round(1 - avg((y - yhat) ^ 2) / var_pop(y), 6) AS r2 FROM b"""))
def m17_log_scale(spark, d):
    return rounded(M.log_scale(scored_orders(spark, d), "y", "yhat"))


_SPLIT_SQL = SCORED_SQL + f""",
v AS (SELECT avg((y - yhat) ^ 2) FILTER (fold < 5) AS mse0, avg((y - yhat) ^ 2) FILTER (fold >= 5) AS mse1,
             avg(abs(y - yhat)) FILTER (fold < 5) AS mae0, avg(abs(y - yhat)) FILTER (fold >= 5) AS mae1,
             avg({_DEV}) FILTER (fold < 5) AS dev0, avg({_DEV}) FILTER (fold >= 5) AS dev1,
             1 - avg((y - yhat) ^ 2) FILTER (fold >= 5) / var_pop(y) FILTER (fold >= 5) AS r2 FROM scored),
g AS (SELECT 'mse' AS metric, mse0 AS cv, mse1 AS test FROM v UNION ALL SELECT 'mae', mae0, mae1 FROM v UNION ALL SELECT 'poisson_deviance', dev0, dev1 FROM v)"""


def _two_sides(spark, d):
    df = scored_orders(spark, d)
    return M.evaluate(df.where("fold < 5"), M.COUNT), M.evaluate(df.where("fold >= 5"), M.COUNT)


@query("m18_generalisation", with_tables(_SPLIT_SQL, """
SELECT metric, round(cv, 6) AS cv, round(test, 6) AS test, round(test / cv, 6) AS ratio, round((test - cv) / cv * 100, 6) AS percent_change,
       ((test - cv) / cv * 100 > 10)::INT AS flag FROM g"""))
def m18_generalisation(spark, d):
    return rounded(M.generalisation(*_two_sides(spark, d), ["mse", "mae", "poisson_deviance"]))


@query("m19_warnings", with_tables(_SPLIT_SQL, """
SELECT round(r2, 6) AS r2, round(mse1 / mse0, 6) AS mse_ratio, round(mae1 / mae0, 6) AS mae_ratio, (r2 < 0.1)::INT AS low_r2,
       (mse1 / mse0 > 1.2 OR mae1 / mae0 > 1.2)::INT AS overfitting FROM v"""))
def m19_warnings(spark, d):
    cv, test = _two_sides(spark, d)
    before = cv.agg(F.struct(F.first("mse").alias("mse"), F.first("mae").alias("mae"))).scalar()
    return rounded(M.warnings(test.select("r2", (F.col("mse") / before["mse"]).alias("mse_ratio"),
                                          (F.col("mae") / before["mae"]).alias("mae_ratio"))))


@query("m20_mae_from_mse", with_tables(SCORED_SQL, """
SELECT fold, round(sqrt(2 * avg((y - yhat) ^ 2) / pi()), 6) AS approximate_mae, round(avg(abs(y - yhat)), 6) AS mae FROM scored GROUP BY fold"""))
def m20_mae_from_mse(spark, d):
    m = M.evaluate(scored_orders(spark, d), M.REGRESSION, by=["fold"])
    return rounded(m.select("fold", M.mae_from_mse("mse").alias("approximate_mae"), "mae"))


@query("m21_ranges", with_tables(SCORED_SQL, """
SELECT round(avg(y), 6) AS actual_mean, min(y) AS actual_min, max(y) AS actual_max, max(y) - min(y) AS actual_range,
       round(avg(yhat), 6) AS predicted_mean, round(min(yhat), 6) AS predicted_min, round(max(yhat), 6) AS predicted_max,
       round(max(yhat) - min(yhat), 6) AS predicted_range FROM scored"""))
def m21_ranges(spark, d):
    return rounded(M.ranges(scored_orders(spark, d)))
