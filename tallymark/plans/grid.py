"""Grid search: encoders once per fold, all models of a fold scored in one pass over it."""

from __future__ import annotations

import json
from dataclasses import replace
from itertools import product

from pyspark.sql import DataFrame, Window, functions as F

from tallymark.operators import boosting, gram, metrics as M
from tallymark.operators.encode import Encoder, fit_encoder, fit_encoders
from tallymark.operators.ensembles import prefix_scores
from tallymark.operators.estimators import SEED, TINY_RIDGE, Spec, fit_rows, needed_columns, training_rows
from tallymark.operators.mlp import fit_mlps, network_scores
from tallymark.operators.splits import with_contiguous_folds, with_folds
from tallymark.session import cache_spread, stage
from tallymark.plans.train import PARALLEL_FITS, Result, run_parallel, train_all, train_degrees

# The published parameter grids. They are large; pass smaller ones for a quick search.
GRIDS = {
    "gbt": {"n_estimators": [300, 500, 800, 1200], "learning_rate": [0.01, 0.03, 0.05, 0.1], "max_depth": [1, 2, 3, 4]},
    "forest": {"n_estimators": [100, 200, 300, 500], "max_depth": [10, 20, 30, None], "min_samples_split": [2, 5, 10],
               "min_samples_leaf": [1, 2, 4], "max_features": ["sqrt", "log2", 0.5]},
    "mlp": {"hidden": [[50], [100], [100, 50], [100, 100], [200, 100], [200, 150], [100, 50, 25], [100, 75, 50],
                       [100, 50, 25, 10], [100, 75, 50, 25]],
            "learning_rate": [0.0001, 0.001, 0.01, 0.03], "alpha": [0, 0.0001, 0.001, 0.01, 0.1],
            "batch_size": [32, 64, 128, "auto"]},
    "elastic_net": {"alpha": [0.01, 0.1, 1.0, 10.0], "l1_ratio": [0.1, 0.3, 0.5, 0.7, 0.9]},
    "poisson": {"alpha": [0.01, 0.1, 1.0, 10.0]},
}

SCORES = ("grid_index int, params string, side string, fold int, n long, mse double, mae double, r2 double, "
          "poisson_deviance double")
FOLDS_TOGETHER = 10  # folds of boosted ensembles under way at once: a task grows the ensembles of one
SCORED_TOGETHER = 40  # prediction columns added in one pass


def expand(grid: dict[str, list]) -> list[dict]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def grid_search(
    df: DataFrame, spec: Spec, grid: dict[str, list], key: str, k: int = 10, contiguous: bool = True,
    with_train: bool = False, workers: int = PARALLEL_FITS,
) -> DataFrame:
    """Metrics of every grid point and fold: ``grid_index, params, side, fold, n, mse, mae, r2[, deviance]``.

    Squared-error models come from cross-products by fold: one pass for all points and folds, and one to score them.
    Boosted ensembles that differ in length alone are fitted once, at the largest, and scored at every length in
    one pass. Networks of all points are trained side by side, one job an epoch, and scored in one pass. Only
    metric rows (grid points x folds) reach the driver.
    """
    points = expand(grid)
    narrow = needed_columns(df, [spec], [key])  # before the folds, which stage what they number
    base = cache_spread(with_contiguous_folds(narrow, key, k) if contiguous else with_folds(narrow, key, k))
    try:
        if spec.family in gram.LINEAR:
            encoder = fit_encoder(base, spec.recipe(base), spec.label)
            if encoder.width <= gram.GRAM_COLUMNS:
                return df.sparkSession.createDataFrame(_linear_scores(base, spec, encoder, points, with_train), SCORES)
        encoders = fit_encoders(base, spec.recipe(base), "fold", spec.label)
        folds = sorted(f for f in encoders if f >= 0)
        together = 1
        if spec.family == "gbt" and folds:
            like = training_rows(base, spec, encoders[folds[0]])
            together = FOLDS_TOGETHER if boosting.supported(like, [{**spec.params, **q} for q in points]) else 1

        def one(i: int) -> list[tuple]:
            train = training_rows(base.where(F.col("fold") != i), spec, encoders[i]).persist()
            valid = encoders[i].transform(base.where(F.col("fold") == i)).select(
                "features", F.col(spec.label).cast("double").alias("y"))
            try:
                if spec.family == "gbt":
                    return _boosted_scores(train, valid, spec, encoders[i], points, i, with_train, workers)
                if spec.family == "mlp":
                    return _network_scores(train, valid, spec, encoders[i], points, i, with_train)
                models = run_parallel(
                    df.sparkSession, [lambda q=q: fit_rows(train, spec.with_params(**q), encoders[i]).model for q in points],
                    workers)
                found = _score(valid, models, points, "valid", i, spec)
                if with_train:
                    found += _score(_labelled(train), models, points, "train", i, spec)
                return found
            finally:
                train.unpersist()

        rows = sum(run_parallel(df.sparkSession, [lambda i=i: one(i) for i in folds], together), []) if folds else []
    finally:
        base.unpersist()
    return df.sparkSession.createDataFrame(rows, SCORES)


def _labelled(train: DataFrame) -> DataFrame:
    return train.select("features", F.col("__y").alias("y"))


def _network_scores(
    train: DataFrame, valid: DataFrame, spec: Spec, encoder: Encoder, points: list[dict], fold: int, with_train: bool,
) -> list[tuple]:
    models = [model for model, _ in fit_mlps(train, [{**spec.params, **q} for q in points], encoder.width)]
    sides = [("valid", valid), *([("train", _labelled(train))] if with_train else [])]
    return [(g, json.dumps(points[g]), side, fold, *values) for side, rows in sides
            for _, _, g, *values in network_scores(rows, models, fold, side, encoder.label_mean or 0.0, not spec.log_label)]


def _boosted_scores(
    train: DataFrame, valid: DataFrame, spec: Spec, encoder: Encoder, points: list[dict], fold: int, with_train: bool, workers: int,
) -> list[tuple]:
    """One ensemble for all points that differ in ``n_estimators`` alone; all are grown in the same jobs where they can be."""
    alike: dict[str, list[int]] = {}
    for g, q in enumerate(points):
        alike.setdefault(json.dumps({k: v for k, v in q.items() if k != "n_estimators"}), []).append(g)
    params = [{**spec.params, **q} for q in points]
    if boosting.supported(train, params):
        return _grown_scores(train, valid, spec, encoder, points, params, list(alike.values()), fold, with_train)

    def one(members: list[int]) -> list[tuple]:
        settings = [{**spec.params, **points[g]} for g in members]
        lengths = [q.get("n_estimators", 100) for q in settings]
        model = fit_rows(train, spec.with_params(**{**points[members[0]], "n_estimators": max(lengths)}), encoder).model
        sides = [("valid", valid), *([("train", _labelled(train))] if with_train else [])]
        return [(members[at], json.dumps(points[members[at]]), side, fold, *values) for side, rows in sides
                for _, _, at, *values in prefix_scores(rows, model, lengths, fold, side, encoder.label_mean or 0.0, not spec.log_label)]

    return sum(run_parallel(train.sparkSession, [lambda m=m: one(m) for m in alike.values()], workers), [])


def _grown_scores(train, valid, spec, encoder, points, params, groups: list[list[int]], fold: int, with_train: bool) -> list[tuple]:
    """Ensembles of all groups side by side, every point scored in one pass a side."""
    lengths = [[params[g].get("n_estimators", 100) for g in members] for members in groups]
    settings = [boosting.Setting(max(n), params[m[0]].get("learning_rate", 0.1), params[m[0]].get("max_depth", 3)) for m, n in zip(groups, lengths)]
    order = [g for members in groups for g in members]
    sides = [("valid", valid), *([("train", _labelled(train))] if with_train else [])]
    found = boosting.grown_scores(
        train, sides, settings, lengths, params[0], SEED, fold, encoder.label_mean or 0.0, not spec.log_label)
    return [(order[at], json.dumps(points[order[at]]), side, fold, *values) for side, _, at, *values in found]


def _linear_scores(base: DataFrame, spec: Spec, encoder: Encoder, points: list[dict], with_train: bool) -> list[tuple]:
    rows = gram.encoded(base, encoder, spec.label, "fold")
    settings = [{**spec.params, **q} for q in points]
    models = gram.solve(gram.cross_products(rows, encoder), spec.family, settings, TINY_RIDGE)
    found = gram.scores(rows, models, with_train, deviance=not spec.log_label)
    return [(g, json.dumps(points[g]), side, fold, *values) for side, fold, g, *values in found]


def _score(rows: DataFrame, models: list, points: list[dict], side: str, fold: int, spec: Spec) -> list[tuple]:
    out = []
    for start in range(0, len(models), SCORED_TOGETHER):
        chunk = list(range(start, min(start + SCORED_TOGETHER, len(models))))
        scored = rows
        for g in chunk:
            scored = models[g].transform(scored).withColumnRenamed("prediction", f"yhat{g}")
        aggs = [F.count("*").alias("n")]
        for g in chunk:
            y, yhat = "y", f"yhat{g}"
            dev = M.poisson_deviance(y, yhat) if not spec.log_label else F.lit(None).cast("double")
            aggs += [M.mse(y, yhat).alias(f"mse{g}"), M.mae(y, yhat).alias(f"mae{g}"), M.r2(y, yhat).alias(f"r2{g}"),
                     dev.alias(f"dev{g}")]
        r = scored.agg(*aggs).first()
        out += [(g, json.dumps(points[g]), side, fold, r["n"], r[f"mse{g}"], r[f"mae{g}"], r[f"r2{g}"], r[f"dev{g}"])
                for g in chunk]
    return out


def summarise(results: DataFrame, rank_by: str = "cv_mse") -> DataFrame:
    """One row per grid point: mean and spread over folds, and its rank (``cv_mse`` or ``cv_deviance``)."""
    per_fold = results.withColumn("rmse", F.sqrt("mse"))
    valid, train = F.col("side") == "valid", F.col("side") == "train"
    table = per_fold.groupBy("grid_index", "params").agg(
        F.avg(F.when(valid, F.col("mse"))).alias("cv_mse"), F.stddev_pop(F.when(valid, F.col("mse"))).alias("cv_mse_std"),
        F.avg(F.when(valid, F.col("mae"))).alias("cv_mae"), F.avg(F.when(valid, F.col("r2"))).alias("cv_r2"),
        F.avg(F.when(valid, F.col("poisson_deviance"))).alias("cv_deviance"),
        F.avg(F.when(train, F.col("mse"))).alias("train_mse"))
    ordered = Window.partitionBy(F.lit(1)).orderBy(rank_by, "grid_index")  # one row per grid point
    return table.withColumn("cv_rmse", F.sqrt("cv_mse")).withColumn("rank", F.row_number().over(ordered))


def top_points(summary: DataFrame, k: int) -> DataFrame:
    return summary.orderBy("rank").limit(k)


def tune_and_train(
    df: DataFrame, spec: Spec, grid: dict[str, list], key: str, k: int = 10, retrain: int = 1, contiguous: bool = True,
) -> tuple[DataFrame, list[Result]]:
    """Search on the train side, then train and score the best ``retrain`` grid points."""
    found = stage(grid_search(df.where("split = 'train'"), spec, grid, key, k, contiguous))
    summary = summarise(found, "cv_deviance" if spec.family == "poisson" else "cv_mse")
    best = [json.loads(r["params"]) for r in top_points(summary, retrain).collect()]  # ``retrain`` rows
    ranked = [replace(spec, name=f"{spec.name}_rank{i}", params={**spec.params, **q}) for i, q in enumerate(best, 1)]
    return summary, train_all(df, ranked, key, k)


def compare_degrees(df: DataFrame, spec: Spec, degrees: list[int], key: str, k: int = 10) -> list[Result]:
    """Polynomial regressions of rising degree on the same split."""
    return train_degrees(df, spec, degrees, key, k)
