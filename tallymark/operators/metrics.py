"""Metrics over a prediction table ``(y, yhat[, p])``: named aggregate expressions, one pass each.

Every function that takes ``by`` returns one row per group (for example per fold).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallymark.functions.columns import (
    MEAN_FLOOR, adjusted_r2, at_least, back_transform, col, floor_mean, log_target, safe_div,
)
from tallymark.operators.ordering import running_totals

P_FLOOR = 2.220446049250313e-16  # machine epsilon, the clip of a log loss


# --- regression and counts -------------------------------------------------

def _xlogx(y: Column) -> Column:
    return F.when(y > 0, y * F.ln(y)).otherwise(F.lit(0.0))


def mse(y, yhat) -> Column:
    return F.avg(F.pow(col(y) - col(yhat), 2))


def mae(y, yhat) -> Column:
    return F.avg(F.abs(col(y) - col(yhat)))


def r2(y, yhat) -> Column:
    """1 - SSE/SST; for a constant target 1 if exact, else 0."""
    y = col(y).cast("double")
    flat = F.min(y) == F.max(y)
    error = mse(y, yhat)
    return F.when(flat, F.when(error == 0, 1.0).otherwise(0.0)).otherwise(1 - error / F.var_pop(y))


def poisson_deviance(y, mu) -> Column:
    y, m = col(y).cast("double"), floor_mean(mu)
    return F.avg(2 * (_xlogx(y) - F.when(y > 0, y * F.ln(m)).otherwise(F.lit(0.0)) - y + m))


def null_deviance(y, compat: bool = False) -> Column:
    """Deviance of the mean, in the same pass; ``compat`` cuts the mean to a whole number."""
    y = col(y).cast("double")
    mean = F.avg(y)
    m = F.greatest(F.floor(mean).cast("double"), F.lit(MEAN_FLOOR)) if compat else F.greatest(mean, F.lit(MEAN_FLOOR))
    deviance = 2 * (F.avg(_xlogx(y)) - mean * F.ln(m) - mean + m)
    flat = (F.min(y) == F.max(y)) & (F.min(y) == m)
    return F.when(flat, 0.0).otherwise(deviance)


def pseudo_r2(y, mu, compat: bool = False) -> Column:
    """1 - deviance / null deviance (null if the latter is 0); ``compat`` also clamps to [0, 1]."""
    null = null_deviance(y, compat)
    value = F.when(null != 0, 1 - poisson_deviance(y, mu) / null)
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))) if compat else value


REGRESSION: dict = {"mse": mse, "rmse": lambda y, m: F.sqrt(mse(y, m)), "mae": mae, "r2": r2}
COUNT: dict = {**REGRESSION, "poisson_deviance": poisson_deviance, "pseudo_r2": pseudo_r2}


def evaluate(df: DataFrame, names: dict, y: str = "y", yhat: str = "yhat", by: list[str] = ()) -> DataFrame:
    """Apply a registry of metrics in one aggregate."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[fn(y, yhat).alias(name) for name, fn in names.items()])


def with_adjusted_r2(metrics: DataFrame, p: int) -> DataFrame:
    return metrics.withColumn("adj_r2", adjusted_r2("r2", "n", p))


def ranges(df: DataFrame, y: str = "y", yhat: str = "yhat", by: list[str] = ()) -> DataFrame:
    aggs = []
    for name, c in (("actual", y), ("predicted", yhat)):
        c = F.col(c).cast("double")
        aggs += [F.avg(c).alias(f"{name}_mean"), F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max"),
                 (F.max(c) - F.min(c)).alias(f"{name}_range")]
    return df.groupBy(*by).agg(*aggs)


def original_scale(df: DataFrame, y_log: str, yhat_log: str, p: int | None = None, by: list[str] = ()) -> DataFrame:
    """Metrics of a log model after undoing the log, predictions clipped at zero."""
    back = df.select(*by, back_transform(y_log, clip=False).alias("y"), back_transform(yhat_log).alias("yhat"))
    out = back.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("yhat").alias("pred_mean"), F.min("yhat").alias("pred_min"),
        F.max("yhat").alias("pred_max"), *[fn("y", "yhat").alias(k) for k, fn in REGRESSION.items()])
    return out if p is None else with_adjusted_r2(out, p)


def log_scale(df: DataFrame, y: str, yhat: str, by: list[str] = ()) -> DataFrame:
    logged = df.select(*by, log_target(y).alias("y"), log_target(F.greatest(F.col(yhat), F.lit(0.0))).alias("yhat"))
    return evaluate(logged, REGRESSION, by=by)


# --- classification --------------------------------------------------------

def _hits(y: Column, yhat: Column, a: int, b: int) -> Column:
    return F.sum(((y == a) & (yhat == b)).cast("long"))


def classification(df: DataFrame, y: str, yhat: str, by: list[str] = ()) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1; zero where undefined."""
    a, b = F.col(y), F.col(yhat)
    cells = df.groupBy(*by).agg(
        F.count("*").alias("n"), _hits(a, b, 0, 0).alias("tn"), _hits(a, b, 0, 1).alias("fp"),
        _hits(a, b, 1, 0).alias("fn"), _hits(a, b, 1, 1).alias("tp"))
    return with_rates(cells)


def with_rates(cells: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.withColumns({
        "accuracy": safe_div(tp + tn, tp + tn + fp + fn), "precision": safe_div(tp, tp + fp),
        "recall": safe_div(tp, tp + fn), "f1": safe_div(2 * tp, 2 * tp + fp + fn)})


def log_loss(y, p) -> Column:
    prob = F.least(F.greatest(col(p), F.lit(P_FLOOR)), F.lit(1 - P_FLOOR))
    return F.avg(F.when(col(y) == 1, -F.ln(prob)).otherwise(-F.ln(1 - prob)))


def confusion(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """All four cells, zero-filled, from one aggregate row."""
    a, b = F.col(y), F.col(yhat)
    cells = [F.struct(F.lit(i).alias("actual"), F.lit(j).alias("predicted"), F.coalesce(_hits(a, b, i, j), F.lit(0)).alias("n"))
             for i in (0, 1) for j in (0, 1)]
    return df.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("c")).select("c.*")


def classification_report(df: DataFrame, y: str, yhat: str, names: tuple[str, str] = ("0", "1")) -> DataFrame:
    """Precision, recall, F1 and support per class with macro and weighted averages and accuracy."""
    cells = classification(df, y, yhat)
    rows = []
    for label, tp, fp, fn in ((names[0], "tn", "fn", "fp"), (names[1], "tp", "fp", "fn")):
        tp, fp, fn = F.col(tp), F.col(fp), F.col(fn)
        rows.append(F.struct(
            F.lit(label).alias("label"), safe_div(tp, tp + fp).alias("precision"), safe_div(tp, tp + fn).alias("recall"),
            safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support")))
    one, two = F.col("one"), F.col("two")
    total = one["support"] + two["support"]
    measures = ("precision", "recall", "f1")
    macro = F.struct(F.lit("macro avg").alias("label"), *[((one[m] + two[m]) / 2).alias(m) for m in measures],
                     total.alias("support"))
    weighted = F.struct(
        F.lit("weighted avg").alias("label"),
        *[safe_div(one[m] * one["support"] + two[m] * two["support"], total).alias(m) for m in measures],
        total.alias("support"))
    accuracy = F.struct(F.lit("accuracy").alias("label"), *[F.col("accuracy").alias(m) for m in measures],
                        total.alias("support"))
    both = cells.select("accuracy", rows[0].alias("one"), rows[1].alias("two"))
    return both.select(F.explode(F.array("one", "two", accuracy, macro, weighted)).alias("r")).select("r.*")


def score_totals(df: DataFrame, y: str, p: str, by: list[str] = ()) -> DataFrame:
    """Positives and negatives at or above each distinct score, scores descending."""
    counts = df.groupBy(*by, F.col(p).alias("score")).agg(
        F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) == 0).cast("long")).alias("neg"))
    return running_totals(counts, [F.desc("score")], ["pos", "neg"], by)


def roc_auc(df: DataFrame, y: str, p: str, by: list[str] = ()) -> DataFrame:
    """Exact ROC-AUC with midrank ties (null when one class is missing)."""
    t = score_totals(df, y, p, by)
    area = F.sum(F.col("neg").cast("double") * (F.col("cum_pos") - F.col("pos") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return t.groupBy(*by).agg(F.when(pairs > 0, area / pairs).alias("roc_auc"))


def roc_curve(df: DataFrame, y: str, p: str) -> DataFrame:
    """One point per distinct score: threshold, false and true positive rate."""
    t = score_totals(df, y, p)
    whole = df.agg(F.struct(F.sum((F.col(y) == 1).cast("long")).alias("p"),
                            F.sum((F.col(y) == 0).cast("long")).alias("n"))).scalar()
    return t.select(F.col("score").alias("threshold"), (F.col("cum_neg") / whole["n"]).alias("fpr"),
                    (F.col("cum_pos") / whole["p"]).alias("tpr"))


def classification_full(df: DataFrame, y: str, yhat: str, p: str, by: list[str] = ()) -> DataFrame:
    """Label metrics, log loss and AUC side by side."""
    labels = classification(df, y, yhat, by)
    loss = df.groupBy(*by).agg(log_loss(y, p).alias("log_loss"))
    auc = roc_auc(df, y, p, by)
    if by:
        return labels.join(loss, list(by)).join(auc, list(by))
    return labels.withColumn("log_loss", loss.scalar()).withColumn("roc_auc", auc.scalar())


# --- baselines and comparisons ---------------------------------------------

def majority_baseline(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Scores on ``test`` of always predicting the majority class of ``train``; AUC of a constant score is 0.5."""
    share = train.agg(F.avg(F.col(label).cast("double"))).scalar()
    picked = test.select(F.col(label).alias("y"), (share > 0.5).cast("int").alias("yhat"))
    return classification(picked, "y", "yhat").select(
        "n", (F.when(F.col("tp") + F.col("fp") > 0, 1).otherwise(0)).alias("majority_class"), "accuracy", "f1",
        F.lit(0.5).alias("roc_auc"))


def improvement(model: Column, baseline: Column) -> Column:
    """Percent gain over the baseline, null ("N/A") if the baseline is zero."""
    return F.when(baseline != 0, (model - baseline) / baseline * 100)


def generalisation(cv: DataFrame, test: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per metric: CV value, test value, ratio and percent change. Both inputs hold one row."""
    stacked = cv.select(*metrics).unpivot([], metrics, "metric", "cv").join(
        test.select(*metrics).unpivot([], metrics, "metric", "test"), "metric")
    return stacked.withColumn("ratio", F.when(F.col("cv") != 0, F.col("test") / F.col("cv"))).withColumn(
        "percent_change", F.when(F.col("cv") > 0, (F.col("test") - F.col("cv")) / F.col("cv") * 100)
    ).withColumn("flag", (F.coalesce("percent_change", F.lit(0.0)) > 10).cast("int"))


def warnings(metrics: DataFrame) -> DataFrame:
    """Flags for a weak fit and for overfitting from columns ``r2, mse_ratio, mae_ratio``."""
    return metrics.withColumn("low_r2", (F.col("r2") < 0.1).cast("int")).withColumn(
        "overfitting", ((F.col("mse_ratio") > 1.2) | (F.col("mae_ratio") > 1.2)).cast("int"))


def mae_from_mse(mse_value: str | Column) -> Column:
    """Mean absolute error of normal errors with the given MSE: stands in for a missing CV MAE."""
    return F.sqrt(col(mse_value) * 2 / F.lit(3.141592653589793))


def count_panel(df: DataFrame, y: str, yhat: str, threshold: float = 3) -> DataFrame:
    """Truth and prediction of a count model cut at ``threshold``, with a pseudo-probability.

    Columns ``y_bin, yhat_bin, p``; empty when truth or prediction holds a single class.
    """
    info = df.agg(F.struct(
        F.max(yhat).alias("top"), F.min(at_least(y, threshold)).alias("y0"), F.max(at_least(y, threshold)).alias("y1"),
        F.min(at_least(yhat, threshold)).alias("p0"), F.max(at_least(yhat, threshold)).alias("p1"))).scalar()
    usable = (info["y0"] != info["y1"]) & (info["p0"] != info["p1"])
    p = F.when(info["top"] > 0, F.col(yhat) / info["top"]).otherwise(F.col(yhat))
    return df.where(usable).select(
        at_least(y, threshold).alias("y_bin"), at_least(yhat, threshold).alias("yhat_bin"), p.alias("p"))


# --- thresholds ------------------------------------------------------------

def threshold_table(df: DataFrame, y: str, p: str, lo: float = 0.1, hi: float = 0.9, steps: int = 81) -> DataFrame:
    """Confusion cells at every threshold of an even grid.

    A row adds to the highest threshold its score reaches, and a running sum over the grid
    gives the counts: the rows are read once instead of once per threshold. The place on the
    grid is computed and then corrected by one step against the exact thresholds.
    """
    step = (hi - lo) / (steps - 1)
    grid = F.array(*[F.lit(i * step + lo) for i in range(steps)])
    guess = F.least(F.greatest(F.floor((F.col(p) - lo) / step), F.lit(0)), F.lit(steps - 1)).cast("int")
    here, after = F.get(grid, guess), F.get(grid, guess + 1)
    reached = guess + F.when(F.col(p) < here, 0).when(F.col(p) >= after, 2).otherwise(1)
    counts = df.groupBy(reached.alias("reached")).agg(
        F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) == 0).cast("long")).alias("neg"))
    spots = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("reached"))
    full = spots.join(F.broadcast(counts), "reached", "left").na.fill(0, ["pos", "neg"])  # steps + 1 rows
    upper = Window.partitionBy(F.lit(1)).orderBy(F.desc("reached"))
    whole = Window.partitionBy(F.lit(1))
    cells = full.select(
        "reached", F.sum("pos").over(upper).alias("tp"), F.sum("neg").over(upper).alias("fp"),
        (F.sum("pos").over(whole) - F.sum("pos").over(upper)).alias("fn"),
        (F.sum("neg").over(whole) - F.sum("neg").over(upper)).alias("tn"))
    threshold = F.get(grid, F.col("reached") - 1)
    return with_rates(cells.where("reached > 0").withColumn("threshold", threshold)).withColumn(
        "balanced", F.col("f1")).drop("reached")


def best_threshold(df: DataFrame, y: str, p: str, metric: str = "f1") -> DataFrame:
    """Lowest threshold with the best score; 0.5 when no threshold scores above zero."""
    table = threshold_table(df, y, p).where(F.col(metric) > 0)
    best = table.agg(F.max(F.struct(F.col(metric).alias("s"), (-F.col("threshold")).alias("t"))).alias("b"))
    return best.select(F.lit(metric).alias("metric"), F.coalesce(-F.col("b.t"), F.lit(0.5)).alias("threshold"),
                       F.coalesce(F.col("b.s"), F.lit(0.0)).alias("score"))
