"""Summaries, distributions and correlations of a table."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallymark.functions.columns import above, col
from tallymark.operators.ordering import exact_quantiles, quantile_bounds, running_totals
from tallymark.session import stage


def skewness(c: str | Column) -> Column:
    """Bias-corrected sample skewness (null below three values)."""
    n = F.count(col(c)).cast("double")
    return F.when(n > 2, F.skewness(col(c)) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(c: str | Column) -> Column:
    """Bias-corrected excess kurtosis (null below four values)."""
    n = F.count(col(c)).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(col(c)) + 6))


def moments(c: str | Column) -> list[Column]:
    c = col(c).cast("double")
    return [
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev(c).alias("std"), F.variance(c).alias("var"),
        F.min(c).alias("min"), F.max(c).alias("max"), (F.max(c) - F.min(c)).alias("range"),
    ]


def long_form(df: DataFrame, columns: list[str], names: str = "column", values: str = "value") -> DataFrame:
    """One row per row and column, for aggregating many columns in one pass."""
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, names, values)


QUARTILES = [0.25, 0.5, 0.75]


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Moments, quartiles and shape of every column, one row per column.

    Two passes: one for the moments and the bounds of the quartiles, one that orders the values between these.
    """
    long = long_form(df, columns)
    shape = stage(long.groupBy("column").agg(
        *moments("value"), skewness("value").alias("skew"), kurtosis("value").alias("kurtosis"),
        quantile_bounds("value", QUARTILES).alias("__e")))
    found = _quartiles(long, shape.select("column", "__e")).drop("n")
    return shape.drop("__e").join(found, "column", "left")


def quartiles(df: DataFrame, columns: list[str]) -> DataFrame:
    return _quartiles(long_form(df, columns))


def _quartiles(long: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    q = exact_quantiles(long, "value", QUARTILES, by=["column"], bounds=bounds)
    return q.select("column", "n", F.col("q0").alias("q25"), F.col("q1").alias("median"), F.col("q2").alias("q75"),
                    (F.col("q2") - F.col("q0")).alias("iqr"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(column)


def mode(df: DataFrame, column: str) -> DataFrame:
    """Most frequent value, the smallest one on ties."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(1)


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins between min and max, the last one closed; empty bins are listed."""
    edges = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"))).scalar()
    # A constant column gets a range of one around its value.
    lo = F.when(edges["lo"] == edges["hi"], edges["lo"] - 0.5).otherwise(edges["lo"])
    width = F.when(edges["lo"] == edges["hi"], F.lit(1.0)).otherwise(edges["hi"] - edges["lo"]) / bins
    spot = F.greatest(F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1)), F.lit(0)).cast("int")
    counted = df.where(F.col(column).isNotNull()).groupBy(spot.alias("bin")).agg(F.count("*").alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(F.broadcast(counted), "bin", "left").select(  # at most ``bins`` rows
        "bin", (lo + F.col("bin") * width).alias("left"), (lo + (F.col("bin") + 1) * width).alias("right"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def integer_histogram(df: DataFrame, column: str) -> DataFrame:
    """Unit-width bins over the whole numbers from min to max, empty ones included."""
    counted = df.groupBy(F.floor(column).alias("bin")).agg(F.count("*").alias("n"))
    ends = counted.agg(F.min("bin").alias("lo"), F.max("bin").alias("hi")).first()
    frame = df.sparkSession.range(0 if ends.lo is None else ends.lo, 0 if ends.lo is None else ends.hi + 1).select(F.col("id").alias("bin"))
    return frame.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def group_profile(df: DataFrame, categories: list[str], target: str) -> DataFrame:
    """Mean, sample deviation and count of the target per level of every category, in one pass."""
    long = df.select(F.col(target).cast("double").alias("__y"), *[F.col(c).cast("string").alias(c) for c in categories])
    return (
        long.unpivot(["__y"], categories, "column", "level").groupBy("column", "level")
        .agg(F.avg("__y").alias("mean"), F.stddev("__y").alias("std"), F.count("*").alias("n"))
        .orderBy("column", F.desc("mean"), "level")
    )


def category_effects(df: DataFrame, categories: list[str], target: str) -> DataFrame:
    """Per category: largest distance of a level mean from the overall mean, and the plain mean of level means."""
    levels = group_profile(df, categories, target)
    total = levels.groupBy("column").agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("overall"))
    return (
        levels.join(F.broadcast(total), "column")  # one row per category
        .groupBy("column")
        .agg(F.max(F.abs(F.col("mean") - F.col("overall"))).alias("max_difference"),
             F.avg("mean").alias("mean_of_means"), F.count("*").alias("levels"))
        .orderBy(F.desc("max_difference"), "column")
    )


def class_balance(df: DataFrame, label: str, by: list[str] = ()) -> DataFrame:
    """Count and share per class; ``majority`` marks the largest one (lowest label on ties)."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    everything = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))  # one row per class
    first = everything.orderBy(F.desc("n"), label)
    return counts.select(
        *by, label, "n", (F.col("n") / F.sum("n").over(everything)).alias("share"),
        (F.row_number().over(first) == 1).cast("int").alias("majority"),
    )


def ecdf(df: DataFrame, column: str) -> DataFrame:
    """Cumulative percent at each distinct value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    running = running_totals(counts, ["value"], ["n"])
    return running.select("value", "n", "cum_n").withColumn("percent", F.col("cum_n") / total * 100)


def correlations(df: DataFrame, predictors: list[str], targets: list[str]) -> DataFrame:
    """Pearson r of every predictor with every target, all in one aggregate."""
    pairs = [(p, t) for t in targets for p in predictors]
    return _corr_rows(df, pairs, "predictor", "target")


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson r of all pairs in long form; each pair is computed once."""
    half = _corr_rows(df, list(combinations_with_replacement(columns, 2)), "a", "b")
    mirrored = half.where(F.col("a") != F.col("b")).select(F.col("b").alias("a"), F.col("a").alias("b"), "r")
    return half.select("a", "b", "r").unionByName(mirrored)


def _corr_rows(df: DataFrame, pairs: list[tuple[str, str]], left: str, right: str) -> DataFrame:
    used = sorted({c for pair in pairs for c in pair})
    values = df.select(*[F.col(c).cast("double").alias(c) for c in used])
    row = values.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    entries = [F.struct(F.lit(a).alias(left), F.lit(b).alias(right), F.col(f"r{i}").alias("r"))
               for i, (a, b) in enumerate(pairs)]
    return (
        row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
        .withColumn("abs_r", F.abs("r")).orderBy(right, F.desc("abs_r"), left)
    )


def strongest(correlated: DataFrame, k: int) -> DataFrame:
    return correlated.orderBy(F.desc("abs_r"), "predictor").limit(k)


def strong_only(correlated: DataFrame, threshold: float = 0.3) -> DataFrame:
    return correlated.where(F.col("abs_r") > threshold)


def any_strong(correlated: DataFrame, threshold: float = 0.3) -> DataFrame:
    strong = F.sum(above("abs_r", threshold))
    return correlated.agg(strong.alias("strong"), (strong == 0).cast("int").alias("none_strong"))


def trend_line(df: DataFrame, x: str, y: str, points: int = 100) -> DataFrame:
    """Least-squares line of ``y`` on ``x`` at evenly spaced points between min and max of ``x``."""
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    fit = df.agg(F.regr_slope(ys, xs).alias("slope"), F.regr_intercept(ys, xs).alias("intercept"),
                 F.min(xs).alias("lo"), F.max(xs).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    return fit.select("slope", "intercept", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")).select(
        "point", (F.col("lo") + F.col("point") * step).alias("x"), "slope", "intercept",
    ).withColumn("y", F.col("intercept") + F.col("slope") * F.col("x"))


def split_shares(df: DataFrame, split: str = "split") -> DataFrame:
    counts = df.groupBy(split).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(F.lit(1))  # one row per side
    return counts.withColumn("share", F.col("n") / F.sum("n").over(whole))
