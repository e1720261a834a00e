"""Choosing predictors: redundant pairs and backward elimination by p-value."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import VectorSlicer
from pyspark.sql import DataFrame, functions as F

from tallymark.operators import gram
from tallymark.operators.encode import Recipe, fit_encoder
from tallymark.operators.estimators import p_values
from tallymark.session import cache_spread


def drop_redundant(predictors: list[str], pairs: list[tuple[str, str]]) -> list[str]:
    """Of each (specific, general) pair that is present, drop the specific column."""
    kept = list(predictors)
    for specific, general in pairs:
        if specific in kept and general in kept:
            kept.remove(specific)
    return kept


@dataclass
class Selection:
    selected: list[str]
    trace: list = field(default_factory=list)  # (step, feature, source, p_value, eliminated)
    outcome: str = "all significant"


def backward_selection(
    df: DataFrame, predictors: list[str], label: str, family: str = "logistic", significance: float = 0.1,
    redundant_pairs: list[tuple[str, str]] = (),
) -> Selection:
    """Drop the encoded column with the largest p-value until all are significant.

    A linear model takes one pass over the rows, after which columns leave its cross-products one by one
    (``gram.Elimination``). For the other families the rows are encoded and cached once and each step is a distributed
    fit on a slice of the vector. A source column stays while one of its encoded columns stays. If everything is
    eliminated the full predictor list is returned, redundant ones included; a singular fit
    stops the elimination and keeps the survivors.
    """
    clean = drop_redundant(predictors, list(redundant_pairs))
    columns = [F.col(f"`{c}`") for c in clean]
    base = cache_spread(df.select(F.col(label).cast("double").alias("__y"), *columns))
    encoded = None
    try:
        encoder = fit_encoder(base, Recipe.of(base, clean, levels="drop_first", unknown="error"))
        left, trace, step = list(range(encoder.width)), [], 0
        sources = lambda: sorted({encoder.sources[i] for i in left})
        fitted = None
        if family == "linear" and encoder.width <= gram.GRAM_COLUMNS:
            try:
                fitted = gram.Elimination(gram.cross_products(gram.encoded(base, encoder, "__y"), encoder, None).parts.sum(axis=0))
            except ValueError:
                return Selection(sources(), trace, "stopped: no p-values")
        else:
            encoded = encoder.transform(base).select("features", "__y").persist()
        while left:
            step += 1
            try:
                if fitted:
                    p = fitted.p_values()
                else:
                    sliced = VectorSlicer(inputCol="features", outputCol="slice", indices=left).transform(encoded)
                    p = dict(zip(left, p_values(sliced, [encoder.names[i] for i in left], family, "slice").values()))
            except ValueError:
                return Selection(sources(), trace, "stopped: no p-values")
            worst = max(left, key=lambda i: (p[i], -i))
            gone = bool(p[worst] > significance)
            trace.append((step, encoder.names[worst], encoder.sources[worst], float(p[worst]), gone))
            if not gone:
                return Selection(sources(), trace)
            left.remove(worst)
            if fitted:
                fitted.drop(worst)
        return Selection(list(predictors), trace, "all eliminated")
    finally:
        if encoded is not None:
            encoded.unpersist()
        base.unpersist()


def selection_table(spark, selection: Selection) -> DataFrame:
    return spark.createDataFrame(selection.trace, "step int, feature string, source string, p_value double, eliminated boolean")
