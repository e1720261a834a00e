"""The whole analysis of a table: selection, three model families over all predictor sets, best models, reports."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame

from tallymark.operators.estimators import needed_columns
from tallymark.operators.selection import Selection, backward_selection
from tallymark.operators.splits import with_split
from tallymark.plans.catalogue import FAMILIES, PREDICTOR_SETS, REDUNDANT_PAIRS, PredictorSet, specs
from tallymark.plans.report import report_lines
from tallymark.plans.train import Result, choose, side_by_side, train_and_score
from tallymark.session import cache_spread
from tallymark.sources.fixtures import BINARY, KEY

COMPARED = ["poisson_deviance", "pseudo_r2", "mse", "mae", "r2", "roc_auc", "accuracy", "f1"]


@dataclass
class Analysis:
    selection: Selection
    results: list[Result]
    best: dict[str, Result]
    comparison: DataFrame
    reports: dict[str, DataFrame]


def analyse(df: DataFrame, when: str, sets: list[PredictorSet] = PREDICTOR_SETS, k: int = 10) -> Analysis:
    """Train poisson, log-OLS and logistic models on every set and on a selected one."""
    sides = with_split(df, KEY)
    first = [s for family in FAMILIES for s in specs(family, sets)]
    base = cache_spread(needed_columns(sides, first, [KEY, "split"]))  # read by every model below
    try:
        chosen = backward_selection(
            base.where("split = 'train'"), list(sets[-1].columns), BINARY, "logistic", 0.1, REDUNDANT_PAIRS)
        all_sets = [*sets, PredictorSet("backward_selected", tuple(chosen.selected))]
        trained = {family: [train_and_score(base, s, KEY, k, cached=True) for s in specs(family, all_sets)]
                   for family in FAMILIES}
    finally:
        base.unpersist()
    results = [r for family in trained.values() for r in family]
    best = {family: choose(rs) for family, rs in trained.items()}
    reports = {r.spec.name: report_lines(r.metrics, r.spec, when, folds=k) for r in results}
    for winner in best.values():
        reports[f"{winner.spec.name}_best"] = report_lines(winner.metrics, winner.spec, when, best=True, folds=k)
    comparison = side_by_side(reduce(DataFrame.unionByName, [r.metrics for r in results]), COMPARED)
    return Analysis(chosen, results, best, comparison, reports)
