"""Model families on MLlib, with penalties stated on the scale of the plain objective.

``alpha`` is always the weight in (1/2n) * loss + alpha * penalty for the squared-error and
Poisson models; MLlib scales its own ``regParam`` differently, so it is translated here.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressor,
)
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallymark.operators import gram
from tallymark.operators.encode import Encoder, Recipe, fit_encoder
from tallymark.operators.mlp import fit_mlp
from tallymark.operators.splits import validation_slice
from tallymark.session import cache_spread

PROBABILITY_CUT = 0.4  # class 1 from this probability on
SEED = 42
# Keeps the normal equations of full one-hot sets solvable; picks the smallest coefficients.
TINY_RIDGE = 1e-9
NORMAL_EQUATIONS = 4096  # fixed value: columns up to which MLlib solves least squares in one step
TREE_ROWS = 250_000  # training rows of a tree model that a task holds; MLlib keeps them and their predictions as objects


@dataclass(frozen=True)
class Spec:
    """A model to train: family, target column, predictors and family parameters."""

    name: str
    family: str  # poisson | ols | ridge | elastic_net | logistic | gbt | forest | mlp | polynomial
    label: str
    predictors: tuple[str, ...]
    params: dict = field(default_factory=dict, hash=False)
    log_label: bool = False
    key: str | None = None  # row key; needed where training keeps rows aside
    levels: str | None = None  # "all" or "drop_first"; by default all, but for a network and a Poisson model without penalty

    def recipe(self, df: DataFrame) -> Recipe:
        options = {"levels": "all"}
        if self.family == "polynomial":
            options["degree"] = self.params.get("degree", 2)
        unpenalised = self.family == "poisson" and self.params.get("alpha", 1.0) == 0
        if self.levels:
            options["levels"] = self.levels
        elif self.family == "mlp" or unpenalised:
            # Without a penalty a full set of levels is singular; predictions are the same.
            options["levels"] = "drop_first"
        return Recipe.of(df, list(self.predictors), **options)

    def with_params(self, **params) -> "Spec":
        return replace(self, params={**self.params, **params})


@dataclass
class Fitted:
    spec: Spec
    encoder: Encoder
    model: object
    log: list = field(default_factory=list)

    def predict(self, df: DataFrame, cut: float = PROBABILITY_CUT) -> DataFrame:
        """Add ``yhat`` (and ``p`` for classifiers) to ``df``."""
        kept = [F.col(f"`{c}`") for c in df.columns]
        scored = self.model.transform(self.encoder.transform(df))
        if self.spec.family == "logistic":
            p = vector_to_array("probability")[1]
            return scored.select(*kept, p.alias("p")).withColumn("yhat", (F.col("p") >= cut).cast("int"))
        return scored.select(*kept, F.col("prediction").alias("yhat"))


def fit(df: DataFrame, spec: Spec, encoder: Encoder | None = None, cached: bool = False) -> Fitted:
    """Encode and fit on all rows of ``df``.

    Solvers read their input once per iteration, so the needed columns are cached for the
    time of the fit (spilling to disk), unless ``cached`` says that ``df`` comes from a cache.
    """
    base = df if cached else cache_spread(needed_columns(df, [spec]))
    try:
        encoder = encoder or fit_encoder(base, spec.recipe(base), spec.label)
        return fit_rows(training_rows(base, spec, encoder), spec, encoder)
    finally:
        if not cached:
            base.unpersist()


def fit_rows(rows: DataFrame, spec: Spec, encoder: Encoder) -> Fitted:
    """Fit on rows that are already encoded."""
    if spec.family == "mlp":
        return Fitted(spec, encoder, *fit_mlp(rows, spec.params, encoder.width))
    return Fitted(spec, encoder, make_estimator(spec, encoder).fit(rows))


def fit_sums(sums: gram.Gram, spec: Spec) -> Fitted:
    """Least squares from the cross-products of all rows, as a model like any other; the rows are not read again.

    For numeric columns: with full sets of levels the coefficients, though not the predictions, hang on rounding.
    """
    rows = sums.stand_in(SparkSession.active())
    return Fitted(spec, sums.encoder, make_estimator(spec, sums.encoder).fit(rows))


def needed_columns(df: DataFrame, specs: list[Spec], extra: list[str] = ()) -> DataFrame:
    names = dict.fromkeys([*extra, *(c for s in specs for c in (s.label, *s.predictors, *([s.key] if s.key else [])))])
    return df.select(*[F.col(f"`{c}`") for c in names])


def training_rows(df: DataFrame, spec: Spec, encoder: Encoder) -> DataFrame:
    """``features, __y`` and, for balanced classifiers, ``__w``."""
    data = df.withColumn("__y", F.col(spec.label).cast("double"))
    columns = ["features", "__y"]
    if spec.family == "logistic" and spec.params.get("balanced", True):
        # n / (2 * n_c) per class, from the label mean that the encoder's pass has found.
        share = min(max(encoder.label_mean, 1e-300), 1 - 1e-16)
        data = data.withColumn("__w", F.when(F.col("__y") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
        columns.append("__w")
    if spec.family == "mlp":
        if not spec.key:
            raise ValueError("a network keeps validation rows aside by key: set Spec.key")
        data = data.withColumn("__valid", validation_slice(spec.key)).withColumn("__place", F.xxhash64(spec.key))
        columns += ["__valid", "__place"]
    rows = encoder.transform(data).select(*columns)
    if spec.family in ("gbt", "forest"):
        parts = -(-int(encoder.n) // TREE_ROWS)
        if parts > 1 and rows.rdd.getNumPartitions() < parts:
            return rows.repartition(parts)
    return rows


def make_estimator(spec: Spec, encoder: Encoder):
    """MLlib estimator for a spec; row count and label moments come from the encoder's pass."""
    q, n = spec.params, encoder.n
    # MLlib divides its penalty by the label's deviation: that of the population in the
    # normal-equation solver, that of the sample in the iterative one for wider vectors.
    solver = "normal" if encoder.width <= NORMAL_EQUATIONS else "l-bfgs"
    spread = (encoder.label_std or 1.0) * (1.0 if solver == "normal" else (n / max(n - 1, 1)) ** 0.5)
    if spec.family == "poisson":
        return GeneralizedLinearRegression(
            family="poisson", link="log", labelCol="__y", maxIter=q.get("max_iter", 50), tol=1e-8,
            regParam=q.get("alpha", 1.0) / max(encoder.label_mean, 1e-12))
    if spec.family in ("ols", "polynomial"):
        return LinearRegression(
            labelCol="__y", standardization=False, solver=solver, regParam=q.get("ridge", TINY_RIDGE) * spread)
    if spec.family == "ridge":
        return LinearRegression(
            labelCol="__y", standardization=False, solver=solver, regParam=q.get("alpha", 1.0) / n * spread)
    if spec.family == "elastic_net":
        l1 = q.get("alpha", 0.001) * q.get("l1_ratio", 0.8)
        l2 = q.get("alpha", 0.001) * (1 - q.get("l1_ratio", 0.8)) * spread
        return LinearRegression(
            labelCol="__y", standardization=False, regParam=l1 + l2, elasticNetParam=l1 / (l1 + l2) if l1 + l2 else 0.0,
            tol=1e-10, maxIter=q.get("max_iter", 5000))
    if spec.family == "logistic":
        strength = q.get("c", 1.0)
        balanced = q.get("balanced", True)  # balanced weights sum to n, like unit weights
        return LogisticRegression(
            labelCol="__y", standardization=False, tol=1e-9, maxIter=q.get("max_iter", 5000),
            regParam=1 / (strength * n) if strength else 0.0, **({"weightCol": "__w"} if balanced else {}))
    if spec.family == "gbt":
        return GBTRegressor(
            labelCol="__y", maxIter=q.get("n_estimators", 100), stepSize=q.get("learning_rate", 0.1),
            maxDepth=q.get("max_depth", 3), subsamplingRate=q.get("subsample", 0.8),
            featureSubsetStrategy=q.get("max_features", "sqrt"), seed=SEED, maxBins=q.get("max_bins", 32))
    if spec.family == "forest":
        depth = q.get("max_depth")
        return RandomForestRegressor(
            labelCol="__y", numTrees=q.get("n_estimators", 100), maxDepth=min(depth, 30) if depth else 30,
            minInstancesPerNode=max(q.get("min_samples_leaf", 1), -(-q.get("min_samples_split", 2) // 2)),
            featureSubsetStrategy=str(q.get("max_features", "sqrt")), bootstrap=q.get("bootstrap", True), seed=SEED,
            maxBins=q.get("max_bins", 32))
    raise ValueError(f"unknown family {spec.family}")


# --- coefficients and importances ------------------------------------------

def coefficient_table(fitted: Fitted, spark) -> DataFrame:
    """Named coefficients, one row per encoded feature and one for the intercept."""
    last = spark.createDataFrame([("(intercept)", "(intercept)", float(fitted.model.intercept))], "feature string, source string, coefficient double")
    return _named(fitted.encoder, fitted.model.coefficients.toArray(), "coefficient", spark).unionByName(last)


def _named(encoder: Encoder, values, name: str, spark) -> DataFrame:
    """``(feature, source, name)`` of one value per slot; only the values pass the driver."""
    slots = spark.createDataFrame(pd.DataFrame({"slot": np.arange(len(values), dtype=np.int32), name: np.asarray(values, float)}))
    return encoder.names_table(spark).join(slots, "slot").select("feature", "source", name)


def top_coefficients(table: DataFrame, k: int = 20) -> DataFrame:
    return table.where("feature <> '(intercept)'").withColumn("size", F.abs("coefficient")).orderBy(
        F.desc("size"), "feature").limit(k)


def importance_table(fitted: Fitted, spark) -> DataFrame:
    return _named(fitted.encoder, fitted.model.featureImportances.toArray(), "importance", spark)


def top_importances(table: DataFrame, k: int = 20) -> DataFrame:
    return table.orderBy(F.desc("importance"), "feature").limit(k)


# --- inference -------------------------------------------------------------

def inference(encoded: DataFrame, names: list[str], family: str, vector: str = "features", label: str = "__y") -> list[tuple]:
    """Maximum-likelihood fit: ``(feature, coefficient, std_error, statistic, p_value)``, intercept last.

    Raises ``ValueError`` when the fit is singular and has no p-values.
    """
    try:
        if family == "linear":
            model = LinearRegression(featuresCol=vector, labelCol=label, solver="normal", regParam=0.0).fit(encoded)
        else:
            glm = {"logistic": ("binomial", "logit"), "poisson": ("poisson", "log")}[family]
            model = GeneralizedLinearRegression(
                featuresCol=vector, labelCol=label, family=glm[0], link=glm[1], maxIter=50, tol=1e-8).fit(encoded)
        s = model.summary
        columns = (s.coefficientStandardErrors, s.tValues, s.pValues)
    except (Py4JJavaError, PySparkException) as e:  # MLlib reports a singular system this way
        raise ValueError(f"no p-values: {str(e)[:200]}") from e
    rows = list(zip([*names, "(intercept)"], [*model.coefficients, model.intercept], *columns))
    if any(r[4] != r[4] for r in rows):
        raise ValueError("no p-values: undefined")
    return [(r[0], *map(float, r[1:])) for r in rows]


def p_values(encoded: DataFrame, names: list[str], family: str, vector: str = "features", label: str = "__y") -> dict:
    """P-value per feature, without the intercept."""
    return {r[0]: r[4] for r in inference(encoded, names, family, vector, label)[:-1]}


def inference_table(rows: list[tuple], spark) -> DataFrame:
    return spark.createDataFrame(
        rows, "feature string, coefficient double, std_error double, statistic double, p_value double")


# --- coefficient paths -----------------------------------------------------

def alpha_grid(count: int = 50, lo: float = 1e-3, hi: float = 10.0) -> list[float]:
    """Evenly spaced on the log scale."""
    return [lo * (hi / lo) ** (i / (count - 1)) for i in range(count)] if count > 1 else [lo]


def coefficient_paths(df: DataFrame, spec: Spec, alphas: list[float], l1_ratios: list[float]) -> DataFrame:
    """Coefficients of an elastic net for every alpha and ratio: ``(l1_ratio, alpha, feature, coefficient)``.

    All come from the cross-products of one pass over the rows. Beyond ``gram.GRAM_COLUMNS`` encoded columns the
    encoded rows are cached and every point is a distributed fit. Only coefficients reach the driver.
    """
    encoder = fit_encoder(df, spec.recipe(df), spec.label)
    points = [(ratio, alpha) for ratio in l1_ratios for alpha in alphas]
    if encoder.width <= gram.GRAM_COLUMNS:
        sums = gram.cross_products(gram.encoded(df, encoder, spec.label), encoder, None)
        models = gram.solve(sums, "elastic_net", [{"alpha": a, "l1_ratio": r} for r, a in points], TINY_RIDGE, whole=True)
        rows = [(*p, n, float(c)) for p, b in zip(points, models.standardised[0]) for n, c in zip(encoder.names, b)]
        return df.sparkSession.createDataFrame(rows, "l1_ratio double, alpha double, feature string, coefficient double")
    data = cache_spread(encoder.transform(df.withColumn("__y", F.col(spec.label).cast("double"))).select("features", "__y"))
    rows = []
    try:
        for ratio, alpha in points:
            model = make_estimator(replace(spec, family="elastic_net", params={"alpha": alpha, "l1_ratio": ratio}), encoder).fit(data)
            rows += [(ratio, alpha, n, float(c)) for n, c in zip(encoder.names, model.coefficients)]
    finally:
        data.unpersist()
    return df.sparkSession.createDataFrame(rows, "l1_ratio double, alpha double, feature string, coefficient double")


def largest_paths(paths: DataFrame, k: int = 20) -> DataFrame:
    """Paths of the ``k`` features with the largest coefficient at the last alpha."""
    last = paths.agg(F.max("alpha")).scalar()
    top = paths.where(F.col("alpha") == last).groupBy("feature").agg(F.max(F.abs("coefficient")).alias("size"))
    return paths.join(F.broadcast(top.orderBy(F.desc("size"), "feature").limit(k).select("feature")), "feature")


def l1_norms(paths: DataFrame) -> DataFrame:
    return paths.groupBy("l1_ratio", "alpha").agg(F.sum(F.abs("coefficient")).alias("l1_norm"))
