"""Exploratory analysis of a table: correlations, level means and the chart tables behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallymark.functions.columns import correlation_direction, correlation_strength, split_by_type
from tallymark.operators import diagnostics as D, profile as P


def explore(df: DataFrame, predictors: list[str], target: str, log_target: str) -> dict[str, DataFrame]:
    """Named result tables; each is one aggregate over the data and none is computed before it is used."""
    numeric, categories = split_by_type(df, predictors)
    correlated = P.correlations(df, numeric, [target, log_target])
    of_target = correlated.where(correlated.target == target)
    return {
        "correlations": correlated.withColumn("strength", correlation_strength("r")).withColumn(
            "direction", correlation_direction("r")),
        "strongest": P.strongest(of_target, 5),
        "any_strong": P.any_strong(of_target),
        "levels": P.group_profile(df, categories, target),
        "effects": P.category_effects(df, categories, target),
        "comparison": D.predictor_comparison(df, numeric, categories, target),
        "matrix": P.correlation_matrix(df, [*numeric, target]),
        "trends": D.scatter_with_trend(df, numeric, target),
        "target": D.original_and_log(df, target),
    }
