"""Cross-validation, training and scoring of one model or a list of models.

The needed columns are cached once, every fold is fitted once (squared-error models all from one pass over the
rows, see ``operators.gram``), and all CV metrics come from one staged table of out-of-fold predictions.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallymark.operators import gram, metrics as M
from tallymark.operators.encode import Encoder, fit_encoder, fit_encoders
from tallymark.operators.estimators import TINY_RIDGE, Fitted, Spec, fit, fit_rows, fit_sums, needed_columns, training_rows
from tallymark.operators.splits import with_contiguous_folds, with_folds, with_split
from tallymark.session import cache_spread, stage

PARALLEL_FITS = 4  # concurrent Spark jobs; the cluster shares its executors among them


def run_parallel(spark: SparkSession, tasks: list, workers: int = PARALLEL_FITS) -> list:
    """Run driver-side closures that submit Spark jobs, results in order."""
    if workers <= 1 or len(tasks) == 1:
        return [t() for t in tasks]
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(workers) as pool:
        return [f.result() for f in [pool.submit(inherit(t)) for t in tasks]]


def out_of_fold(
    df: DataFrame, spec: Spec, key: str, k: int = 10, contiguous: bool = False, with_train: bool = False,
    cached: bool = False, workers: int = PARALLEL_FITS,
) -> DataFrame:
    """Staged predictions of every row by the model fitted without its fold.

    Columns ``key, fold, side, y, yhat[, p]``; ``side`` is ``valid``, and with ``with_train``
    also ``train`` (each row once per fold it was fitted in). ``cached`` says that ``df``
    comes from a cache, so that it is not cached again.
    """
    return _out_of_fold(df, spec, key, k, contiguous, with_train, cached, workers)[0]


def _out_of_fold(df, spec, key, k, contiguous, with_train, cached, workers=PARALLEL_FITS) -> tuple[DataFrame, Encoder]:
    """The predictions and the encoder of all rows, which the same pass yields."""
    narrow = needed_columns(df, [spec], [key])
    base = with_contiguous_folds(narrow, key, k) if contiguous else with_folds(narrow, key, k)
    keep = contiguous or not cached  # hashed folds are a plain projection of cached rows
    if keep:
        base = cache_spread(base)
    try:
        if spec.family in gram.LINEAR:
            encoder = fit_encoder(base, spec.recipe(narrow), spec.label)
            if encoder.width <= gram.GRAM_COLUMNS:
                rows = gram.encoded(base, encoder, spec.label, key, "fold")
                models = gram.solve(gram.cross_products(rows, encoder), spec.family, [spec.params], TINY_RIDGE)
                return stage(gram.predictions(rows, models, key, with_train)), encoder
        encoders = fit_encoders(base, spec.recipe(narrow), "fold", spec.label)
        folds = sorted(i for i in encoders if i >= 0)

        def one(i: int) -> Fitted:
            return fit_rows(training_rows(base.where(F.col("fold") != i), spec, encoders[i]), spec, encoders[i])

        models = run_parallel(df.sparkSession, [lambda i=i: one(i) for i in folds], workers)
        parts = []
        for i, model in zip(folds, models):
            wanted = [("valid", base.where(F.col("fold") == i))]
            if with_train:
                wanted.append(("train", base.where(F.col("fold") != i)))
            for side, rows in wanted:
                scored = model.predict(rows)
                parts.append(scored.select(
                    key, F.lit(i).alias("fold"), F.lit(side).alias("side"), F.col(spec.label).cast("double").alias("y"),
                    F.col("yhat").cast("double").alias("yhat"), *(["p"] if spec.family == "logistic" else [])))
        return stage(reduce(DataFrame.unionByName, parts)), encoders[-1]
    finally:
        if keep:
            base.unpersist()


def fold_metrics(oof: DataFrame, spec: Spec) -> DataFrame:
    """One row per fold (and side)."""
    by = ["side", "fold"]
    if spec.family == "logistic":
        # The usual CV label cuts the probability at one half, unlike the final model.
        halves = oof.withColumn("yhat", (F.col("p") >= 0.5).cast("int"))
        return M.classification_full(halves, "y", "yhat", "p", by)
    return M.evaluate(oof, M.COUNT if spec.family == "poisson" else M.REGRESSION, by=by)


def metric_names(spec: Spec) -> list[str]:
    if spec.family == "logistic":
        return ["accuracy", "precision", "recall", "f1", "roc_auc", "log_loss"]
    return list(M.COUNT if spec.family == "poisson" else M.REGRESSION)


def primary_metric(spec: Spec) -> tuple[str, bool]:
    """(metric, smaller is better) used to choose among models of a family."""
    return {"poisson": ("poisson_deviance", True), "logistic": ("roc_auc", False)}.get(spec.family, ("mse", True))


def tidy(wide: DataFrame, names: list[str], model: str, split: str, fold: str | None = None) -> DataFrame:
    """Long form ``(model, split, fold, metric, value)``."""
    ids = [F.lit(model).alias("model"), F.lit(split).alias("split"),
           (F.col(fold).cast("int") if fold else F.lit(None).cast("int")).alias("fold")]
    flat = wide.select(*ids, *[F.col(n).cast("double").alias(n) for n in names])
    return flat.unpivot(["model", "split", "fold"], names, "metric", "value")


def cv_metrics(oof: DataFrame, spec: Spec) -> DataFrame:
    """Tidy CV metrics: the mean over folds, plus pooled values where the model calls for them.

    A Poisson model's pseudo-R2 is pooled over all out-of-fold predictions; a log model also gets
    pooled metrics on the original scale.
    """
    names = metric_names(spec)
    per_fold = fold_metrics(oof, spec)
    means = per_fold.where("side = 'valid'").agg(*[F.avg(n).alias(n) for n in names])
    valid = oof.where("side = 'valid'")
    if spec.family == "poisson":
        means = means.withColumn("pseudo_r2", valid.agg(M.pseudo_r2("y", "yhat")).scalar())
    out = tidy(means, names, spec.name, "cv")
    if spec.log_label:
        back = M.original_scale(valid, "y", "yhat")
        shown = ["mse", "rmse", "mae"]
        renamed = back.select(*[F.col(n).alias(f"{n}_original") for n in shown])
        out = out.unionByName(tidy(renamed, [f"{n}_original" for n in shown], spec.name, "cv"))
    return out


def test_metrics(scored: DataFrame, spec: Spec, p: int | None = None) -> DataFrame:
    """Tidy hold-out metrics of predictions ``y, yhat[, p]``."""
    if spec.family == "logistic":
        return tidy(M.classification_full(scored, "y", "yhat", "p"), metric_names(spec), spec.name, "test")
    wide = M.with_adjusted_r2(M.evaluate(scored, M.COUNT if spec.family == "poisson" else M.REGRESSION),
                              p if p is not None else len(spec.predictors))
    out = tidy(wide, [*metric_names(spec), "adj_r2"], spec.name, "test")
    spread = M.ranges(scored)
    out = out.unionByName(tidy(spread, spread.columns, spec.name, "test"))
    if spec.log_label:
        back = M.original_scale(scored, "y", "yhat", len(spec.predictors))
        kept = [c for c in back.columns if c != "n"]
        renamed = back.select(*[F.col(c).alias(f"{c}_original") for c in kept])
        out = out.unionByName(tidy(renamed, [f"{c}_original" for c in kept], spec.name, "test"))
    return out


def baseline_metrics(train: DataFrame, test: DataFrame, spec: Spec) -> DataFrame:
    """Tidy hold-out metrics, split "baseline", of always predicting the majority class of the train side."""
    wide = M.majority_baseline(train, test, spec.label)
    return tidy(wide, ["majority_class", "accuracy", "f1", "roc_auc"], spec.name, "baseline")


@dataclass
class Result:
    """Everything one training run hands on; row data stays in Spark."""

    spec: Spec
    fitted: Fitted
    oof: DataFrame
    predictions: DataFrame
    metrics: DataFrame


def score(fitted: Fitted, test: DataFrame, key: str) -> DataFrame:
    """Predictions ``key, y, yhat[, p]``."""
    spec = fitted.spec
    rows = needed_columns(test, [spec], [key])
    return fitted.predict(rows).select(
        key, F.col(spec.label).cast("double").alias("y"), F.col("yhat").cast("double").alias("yhat"),
        *(["p"] if spec.family == "logistic" else []))


def train_and_score(
    df: DataFrame, spec: Spec, key: str, k: int = 10, contiguous: bool = False, with_train: bool = False,
    cached: bool = False,
) -> Result:
    """Cross-validate on the train side, fit on all of it, score the test side.

    ``df`` holds both sides; a missing ``split`` column is added. Its needed columns are
    cached once for all of this, unless ``cached`` says that ``df`` comes from a cache.
    """
    sides = df if "split" in df.columns else with_split(df, key)
    base = sides if cached else cache_spread(needed_columns(sides, [spec], [key, "split"]))
    try:
        train, test = base.where("split = 'train'"), base.where("split = 'test'")
        oof, encoder = _out_of_fold(train, spec, key, k, contiguous, with_train, cached=True)
        fitted = fit(train, spec, encoder, cached=True)
        predictions = stage(score(fitted, test, key))
        baseline = stage(baseline_metrics(train, test, spec)) if spec.family == "logistic" else None
    finally:
        if not cached:
            base.unpersist()
    metrics = cv_metrics(oof, spec).unionByName(test_metrics(predictions, spec))
    metrics = stage(metrics if baseline is None else metrics.unionByName(baseline))
    return Result(spec, fitted, oof, predictions, metrics)


def best_model(metrics: DataFrame, metric: str, smaller: bool = True) -> DataFrame:
    """Model with the best CV value; the first name in ``order`` (or name order) on ties."""
    cv = metrics.where((F.col("split") == "cv") & (F.col("metric") == metric) & F.col("value").isNotNull())
    place = F.col("order") if "order" in metrics.columns else F.col("model")
    return cv.orderBy(F.col("value").asc() if smaller else F.col("value").desc(), place).limit(1).select(
        "model", "metric", "value")


def train_all(df: DataFrame, specs: list[Spec], key: str, k: int = 10) -> list[Result]:
    """Train a list of models on one cached table of all their columns."""
    sides = df if "split" in df.columns else with_split(df, key)
    base = cache_spread(needed_columns(sides, specs, [key, "split"]))
    try:
        return [train_and_score(base, s, key, k, cached=True) for s in specs]
    finally:
        base.unpersist()


def train_degrees(df: DataFrame, spec: Spec, degrees: list[int], key: str, k: int = 10) -> list[Result]:
    """Polynomial regressions of several degrees: one pass for the cross-products of the highest, which hold all others',
    and one for the out-of-fold predictions of all. With too many terms for that they are trained one by one."""
    specs = [replace(spec, name=f"poly_deg_{d}", family="polynomial", params={"degree": d}) for d in degrees]
    sides = df if "split" in df.columns else with_split(df, key)
    base = cache_spread(needed_columns(sides, specs, [key, "split"]))
    try:
        train, test = base.where("split = 'train'"), base.where("split = 'test'")
        folded = with_folds(needed_columns(train, specs, [key]), key, k)
        encoders = [fit_encoder(folded, s.recipe(folded), s.label) for s in specs]
        top = max(encoders, key=lambda e: e.recipe.degree)
        if top.width > gram.GRAM_COLUMNS:
            return [train_and_score(base, s, key, k, cached=True) for s in specs]
        rows = gram.encoded(folded, top, spec.label, key, "fold")
        sums = gram.cross_products(rows, top)
        own = [sums.only(e) for e in encoders]
        models = gram.side_by_side([gram.solve(g, s.family, [s.params], TINY_RIDGE) for g, s in zip(own, specs)], own, top)
        guesses = stage(gram.predictions(rows, models, key))
        results = []
        for i, (s, g) in enumerate(zip(specs, own)):
            yhat = "yhat" if len(specs) == 1 else f"yhat{i}"
            oof = guesses.select(key, "fold", "side", "y", F.col(yhat).alias("yhat"))
            fitted = fit(train, s, g.encoder, cached=True) if g.encoder.recipe.categorical else fit_sums(g, s)
            predictions = stage(score(fitted, test, key))
            metrics = stage(cv_metrics(oof, s).unionByName(test_metrics(predictions, s)))
            results.append(Result(s, fitted, oof, predictions, metrics))
        return results
    finally:
        base.unpersist()


def choose(results: list[Result]) -> Result:
    """Best of one family by CV, the first on ties. It is already fitted on the whole train side."""
    table = reduce(DataFrame.unionByName, [
        r.metrics.withColumn("order", F.lit(i)) for i, r in enumerate(results)])
    winner = best_model(table, *primary_metric(results[0].spec)).first()["model"]
    return next(r for r in results if r.spec.name == winner)


def side_by_side(metrics: DataFrame, names: list[str]) -> DataFrame:
    """One row per model with a column per split and metric."""
    wanted = metrics.where(F.col("metric").isin(names) & F.col("fold").isNull())
    labelled = wanted.withColumn("cell", F.concat_ws("_", "split", "metric"))
    cells = [f"{s}_{n}" for s in ("cv", "test") for n in names]
    return labelled.groupBy("model").pivot("cell", cells).agg(F.first("value"))
