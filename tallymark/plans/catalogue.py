"""Named predictor sets for the order table, in the manner baseline -> one more -> groups -> everything."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tallymark.functions.columns import existing
from tallymark.operators.estimators import Spec
from tallymark.sources.fixtures import BINARY, CATEGORICAL, COUNT, KEY, LOG, NUMERIC


@dataclass(frozen=True)
class PredictorSet:
    name: str
    columns: tuple[str, ...]


BASE = ("o_orderpriority", "o_orderstatus", "o_year")
PREDICTOR_SETS = [
    PredictorSet("baseline", BASE),
    PredictorSet("price", (*BASE, "o_totalprice")),
    PredictorSet("customer", (*BASE, "c_acctbal", "c_mktsegment")),
    PredictorSet("place", (*BASE, "r_name", "n_name")),
    PredictorSet("season", (*BASE, "o_month")),
    PredictorSet("everything", (*NUMERIC, *CATEGORICAL)),
]
REDUNDANT_PAIRS = [("n_name", "r_name")]  # a nation determines its region

# family -> (label, suffix of the model name, log target)
FAMILIES = {"poisson": (COUNT, "", False), "ols": (LOG, "_log", True), "logistic": (BINARY, "_binary", False)}


def specs(family: str, sets: list[PredictorSet] = PREDICTOR_SETS, **params) -> list[Spec]:
    label, suffix, is_log = FAMILIES[family]
    return [Spec(s.name + suffix, family, label, s.columns, params, is_log, KEY) for s in sets]


def complete_rows(df: DataFrame, sets: list[PredictorSet]) -> DataFrame:
    """Rows usable for each set: no null among its columns. One pass for all sets."""
    counts = []
    for s in sets:
        full = F.lit(True)
        for c in existing(df, list(s.columns)):
            full = full & F.col(c).isNotNull()
        counts.append(F.struct(F.lit(s.name).alias("predictor_set"), F.lit(len(s.columns)).alias("predictors"),
                               F.coalesce(F.sum(full.cast("long")), F.lit(0)).alias("complete_rows")))
    return df.agg(F.array(*counts).alias("sets")).select(F.explode("sets").alias("s")).select("s.*")
