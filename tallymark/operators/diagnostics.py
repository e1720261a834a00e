"""Tables behind the diagnostic charts of a fitted model, from its predictions ``(key, y, yhat)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallymark.functions.columns import log_target, normal_quantile
from tallymark.operators import profile
from tallymark.operators.ordering import exact_quantiles, ranked
from tallymark.session import stage


def residuals(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    return df.withColumn("residual", F.col(y) - F.col(yhat))


def residual_band(df: DataFrame, width: float = 2.0) -> DataFrame:
    """Residuals with the +-2 sigma band around their mean and an outside flag."""
    stats = df.agg(F.struct(F.avg("residual").alias("m"), F.stddev_pop("residual").alias("s"))).scalar()
    half = width * stats["s"]
    return df.withColumn("lower", -half).withColumn("upper", half).withColumn("mean_residual", stats["m"]).withColumn(
        "outside", (F.abs("residual") > half).cast("int"))


def residual_histogram(df: DataFrame, bins: int = 30) -> DataFrame:
    return profile.histogram(df, "residual", bins)


def qq_points(df: DataFrame, value: str, key: str) -> DataFrame:
    """Each value against the normal quantile of its order-statistic median (Filliben)."""
    n = df.agg(F.count("*").cast("double").alias("n")).scalar()
    placed = ranked(df.select(key, value), [value, key], "rank").withColumn("__n", n)
    edge = F.pow(F.lit(0.5), 1 / F.col("__n"))
    median = (
        F.when(F.col("rank") == F.col("__n"), edge).when(F.col("rank") == 1, 1 - edge)
        .otherwise((F.col("rank") - 0.3175) / (F.col("__n") + 0.365))
    )
    return placed.select(key, F.col(value).alias("ordered"), "rank", normal_quantile(median).alias("theoretical"))


def qq_line(points: DataFrame) -> DataFrame:
    return points.agg(
        F.count("*").alias("n"), F.regr_slope("ordered", "theoretical").alias("slope"),
        F.regr_intercept("ordered", "theoretical").alias("intercept"), F.corr("ordered", "theoretical").alias("r"))


def error_by_actual(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Box-plot numbers of the error ``yhat - y`` per actual value."""
    errors = df.select(F.col(y).alias("actual"), (F.col(yhat) - F.col(y)).alias("error"))
    boxes = stage(exact_quantiles(errors, "error", [0.25, 0.5, 0.75], by=["actual"]).select(
        "actual", "n", F.col("q0").alias("q25"), F.col("q1").alias("median"), F.col("q2").alias("q75")))
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    # One staged row per actual value on the right: broadcast if small.
    inside = errors.join(boxes, "actual").where(
        (F.col("error") >= F.col("q25") - reach) & (F.col("error") <= F.col("q75") + reach))
    whiskers = inside.groupBy("actual").agg(F.min("error").alias("whisker_low"), F.max("error").alias("whisker_high"))
    return boxes.join(whiskers, "actual")


def actual_vs_predicted(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Mean lines and the bounds of the identity line."""
    return df.agg(F.count("*").alias("n"), F.avg(y).alias("mean_actual"), F.avg(yhat).alias("mean_predicted"),
                  F.least(F.min(y), F.min(yhat)).alias("low"), F.greatest(F.max(y), F.max(yhat)).alias("high"))


# The three metrics each family of models shows; the primary metric of linear models is the MSE.
METRIC_TRIPLES = {
    "poisson": ["poisson_deviance", "pseudo_r2", "mse"],
    "logistic": ["roc_auc", "accuracy", "f1"],
    "linear": ["mse", "mae", "primary_metric"],
    "other": ["r2", "mse", "mae"],
}
LINEAR = {"ols", "ridge", "elastic_net", "polynomial"}


def metric_bars(metrics: DataFrame, family: str) -> DataFrame:
    """CV and test value side by side for the family's three metrics.

    ``metrics`` is the tidy table ``(model, split, metric, value)``.
    """
    family = "linear" if family in LINEAR else family
    wanted = METRIC_TRIPLES.get(family, METRIC_TRIPLES["other"])
    if "primary_metric" in wanted:
        metrics = metrics.where(F.col("metric") != "primary_metric").unionByName(
            metrics.where(F.col("metric") == "mse").withColumn("metric", F.lit("primary_metric")))
    bars = metrics.where(F.col("metric").isin(wanted)).groupBy("model", "metric").pivot("split", ["cv", "test"]).agg(
        F.first("value"))
    change = F.when(F.col("cv") > 0, (F.col("test") - F.col("cv")) / F.col("cv") * 100)
    return bars.withColumn("percent_change", change).withColumn(
        "flag", (F.coalesce("percent_change", F.lit(0.0)) > 10).cast("int"))


def target_panel(df: DataFrame, target: str) -> DataFrame:
    """Summary of the target in one row: moments, quartiles, shape and mode."""
    return profile.summary(df, [target]).withColumn("mode", profile.mode(df, target).select(target).scalar())


def original_and_log(df: DataFrame, target: str) -> DataFrame:
    """Summary of a target before and after the log, one row each."""
    both = df.select(F.col(target).cast("double").alias("original"), log_target(target).alias("log"))
    return profile.summary(both, ["original", "log"])


def original_and_log_histograms(df: DataFrame, target: str, bins: int = 50) -> DataFrame:
    both = df.select(F.col(target).cast("double").alias("original"), log_target(target).alias("log"))
    return profile.histogram(both, "original", bins).withColumn("scale", F.lit("original")).unionByName(
        profile.histogram(both, "log", bins).withColumn("scale", F.lit("log")))


def predictor_comparison(df: DataFrame, numeric: list[str], categories: list[str], target: str) -> DataFrame:
    """Numeric predictors by r and categorical ones by the spread of level means, in one table."""
    num = profile.correlations(df, numeric, [target]).select(
        F.lit("numeric").alias("kind"), F.col("predictor"), F.col("r").alias("effect"), F.lit(None).cast("double").alias("mean_of_means"))
    cat = profile.category_effects(df, categories, target).select(
        F.lit("categorical").alias("kind"), F.col("column").alias("predictor"), F.col("max_difference").alias("effect"), "mean_of_means")
    return num.unionByName(cat)


def scatter_with_trend(df: DataFrame, predictors: list[str], target: str, k: int = 3, points: int = 100) -> DataFrame:
    """Trend lines of the ``k`` predictors most correlated with the target.

    The choice and all fits come from one aggregate row; no data is read twice.
    """
    y = F.col(target).cast("double")
    aggs = []
    for p in predictors:
        x = F.col(p).cast("double")
        aggs.append(F.struct(
            F.abs(F.corr(x, y)).alias("abs_r"), F.lit(p).alias("predictor"), F.regr_slope(y, x).alias("slope"),
            F.regr_intercept(y, x).alias("intercept"), F.min(x).alias("lo"), F.max(x).alias("hi")))
    fits = df.agg(F.array(*aggs).alias("fits")).select(F.explode("fits").alias("f")).select("f.*")
    top = fits.orderBy(F.desc("abs_r"), "predictor").limit(k)
    grid = top.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("lo") + F.col("point") * (F.col("hi") - F.col("lo")) / (points - 1)
    return grid.select("predictor", "abs_r", "point", x.alias("x"), (F.col("intercept") + F.col("slope") * x).alias("y"))
