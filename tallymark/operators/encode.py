"""Feature encoding: scaling, one-hot levels, polynomial terms, assembled into one ML vector.

An encoder is fitted from two small aggregates (numeric moments and level lists), which are
grouped by fold when folds are given: one pass over the data then yields the encoder of
every training side, since moments and level counts add up across folds.
The result is an ordinary ``PipelineModel``, so it can be saved and used on streams. Where a column has more than
``LISTED_LEVELS`` levels, these stay in a staged dictionary instead (``WideEncoder``) and reach the rows by joins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, PolynomialExpansion, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from tallymark.functions.columns import split_by_type
from tallymark.operators.joins import looked_up
from tallymark.operators.ordering import ranked
from tallymark.session import stage

LISTED_LEVELS = 10_000  # levels of a column up to which the driver lists them, as an MLlib indexer must


@dataclass(frozen=True)
class Recipe:
    """What to encode and how.

    levels:   "all" keeps every level, "drop_first" leaves the first one out.
    unknown:  "zeros" or "error" for a level not seen while fitting.
    """

    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    levels: str = "all"
    unknown: str = "zeros"
    scale: bool = True
    degree: int = 1
    passthrough: tuple[str, ...] = ()

    @staticmethod
    def of(df: DataFrame, predictors: list[str], **options) -> "Recipe":
        numeric, categorical = split_by_type(df, predictors)
        return Recipe(tuple(numeric), tuple(categorical), **options)

    @property
    def columns(self) -> list[str]:
        return [*self.numeric, *self.categorical, *self.passthrough]


@dataclass
class Encoder:
    recipe: Recipe
    model: PipelineModel
    names: list[str]                      # one per vector slot
    sources: list[str]                    # source column of each slot
    n: int                                # rows fitted on
    label_mean: float | None = None
    label_std: float | None = None        # population deviation
    means: dict = field(default_factory=dict)
    scales: dict = field(default_factory=dict)
    levels: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)

    @property
    def width(self) -> int:
        return len(self.names)

    def names_table(self, spark: SparkSession) -> DataFrame:
        """``(slot, feature, source)`` of every vector slot."""
        return spark.createDataFrame(
            [(i, n, s) for i, (n, s) in enumerate(zip(self.names, self.sources))], "slot int, feature string, source string")


@dataclass
class WideEncoder:
    """An encoder whose levels stay in Spark; the driver holds the number of levels of each column."""

    recipe: Recipe
    dictionary: DataFrame                 # staged column, level, place (from 0, in order of the levels), n
    counts: dict[str, int]                # levels of each column
    n: int
    label_mean: float | None = None
    label_std: float | None = None
    means: dict = field(default_factory=dict)
    scales: dict = field(default_factory=dict)

    @property
    def first(self) -> int:
        return 1 if self.recipe.levels == "drop_first" else 0

    @property
    def offsets(self) -> dict[str, int]:
        """First vector slot of each categorical column."""
        out, at = {}, len(self.recipe.numeric)
        for c in self.recipe.categorical:
            out[c] = at
            at += max(0, self.counts.get(c, 0) - self.first)
        return out

    @property
    def width(self) -> int:
        levels = sum(max(0, self.counts.get(c, 0) - self.first) for c in self.recipe.categorical)
        return len(self.recipe.numeric) + levels + len(self.recipe.passthrough)

    @property
    def names(self) -> list[str]:
        raise ValueError("the names of a wide encoding stay in Spark: use names_table")

    sources = names

    def names_table(self, spark: SparkSession) -> DataFrame:
        """``(slot, feature, source)`` of every vector slot."""
        after = self.width - len(self.recipe.passthrough)
        plain = [(i, c, c) for i, c in enumerate(self.recipe.numeric)] + [(after + i, c, c) for i, c in enumerate(self.recipe.passthrough)]
        offset = F.create_map(*[F.lit(x) for pair in self.offsets.items() for x in pair])
        levels = self.dictionary.where(F.col("place") >= self.first).select(
            (offset[F.col("column")] + F.col("place") - self.first).cast("int").alias("slot"),
            F.concat_ws("_", "column", "level").alias("feature"), F.col("column").alias("source"))
        return spark.createDataFrame(plain, "slot int, feature string, source string").unionByName(levels)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``features``, sparse vectors put together from looked-up slots; a level that is not known is all zeros."""
        rows, places = df, {c: f"{c}__i" for c in self.recipe.categorical}
        for c, place in places.items():
            known = self.dictionary.where(F.col("column") == c).select(F.col("level").alias("__level"), F.col("place").alias(place), "n")
            rows = looked_up(rows.withColumn("__level", F.col(f"`{c}`").cast("string")), known, "__level").drop("__level")
            if self.recipe.unknown == "error":
                unseen = F.raise_error(F.lit(f"unseen level in {c}"))
                rows = rows.withColumn(place, F.when(F.col(place).isNull(), unseen.cast("long")).otherwise(F.col(place)))
        numbers = [(F.col(f"`{c}`").cast("double") - self.means[c]) / self.scales[c] for c in self.recipe.numeric]
        entries = [_entry(F.lit(i), z) for i, z in enumerate(numbers)]
        for c, place in places.items():
            slot = F.when(F.col(place) >= self.first, F.col(place) + (self.offsets[c] - self.first))
            entries.append(_entry(slot, F.lit(1.0)))
        after = self.width - len(self.recipe.passthrough)
        entries += [_entry(F.lit(after + i), F.col(f"`{c}`").cast("double")) for i, c in enumerate(self.recipe.passthrough)]
        filled = F.filter(F.array(*entries), lambda e: e["i"].isNotNull())
        whole = F.forall(filled, lambda e: e["v"].isNotNull())
        filled = F.when(whole, filled).otherwise(F.raise_error(F.lit("null in a numeric predictor")).cast("array<struct<i:int,v:double>>"))
        vector = F.to_json(F.struct(F.struct(
            F.lit(0).alias("type"), F.lit(self.width).alias("size"), F.transform(filled, lambda e: e["i"]).alias("indices"),
            F.transform(filled, lambda e: e["v"]).alias("values")).alias("v")))
        # A vector column is a struct to the JSON reader: this makes sparse vectors without leaving the JVM.
        parsed = F.from_json(vector, StructType([StructField("v", VectorUDT())]))["v"]
        return rows.withColumn("features", parsed).drop(*places.values())


def _entry(slot: Column, value: Column) -> Column:
    return F.struct(slot.cast("int").alias("i"), value.alias("v"))


@dataclass
class _Moments:
    n: float = 0.0
    mean: float = 0.0
    m2: float = 0.0

    def plus(self, n: float, mean: float | None, m2: float | None) -> "_Moments":
        if not n:
            return self
        total = self.n + n
        delta = mean - self.mean
        return _Moments(total, self.mean + delta * n / total, self.m2 + m2 + delta * delta * self.n * n / total)


def fit_encoder(df: DataFrame, recipe: Recipe, label: str | None = None) -> Encoder:
    return fit_encoders(df.withColumn("__fold", F.lit(0)), recipe, "__fold", label, whole_only=True)[-1]


def fit_encoders(
    df: DataFrame, recipe: Recipe, fold: str, label: str | None = None, whole_only: bool = False
) -> dict[int, Encoder]:
    """Encoders of every training side (key = the fold left out) and of all rows (key -1)."""
    measured = [*recipe.numeric, *([label] if label else [])]
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(measured):
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"mean{i}"), (F.var_pop(x) * F.count(x)).alias(f"m2{i}"), F.count(x).alias(f"n{i}")]
    per_fold = df.groupBy(fold).agg(*aggs).collect()  # one row per fold
    table, counts = _level_table(df, recipe.categorical, fold)
    wide = max(counts.values(), default=0) > LISTED_LEVELS
    levels = {} if wide else _levels(table, recipe.categorical)
    dictionary = _dictionary(table) if wide else None
    out = {}
    folds = sorted(r[fold] for r in per_fold)
    for left_out in ([] if whole_only else folds) + [-1]:
        rows = [r for r in per_fold if r[fold] != left_out]
        stats = []
        for i, _ in enumerate(measured):
            m = _Moments()
            for r in rows:
                m = m.plus(r[f"n{i}"], r[f"mean{i}"], r[f"m2{i}"])  # nulls count for nothing
            stats.append(m)
        seen = {
            c: sorted(v for v, where in found.items() if where - {left_out}) for c, found in levels.items()
        }
        y = stats[-1] if label else None
        n = int(sum(r["n"] for r in rows))
        if wide:
            out[left_out] = _build_wide(
                recipe, dictionary, counts, n, dict(zip(recipe.numeric, stats)), y.mean if y else None, (y.m2 / max(y.n, 1)) ** 0.5 if y else None)
            continue
        out[left_out] = _build(
            df.drop(fold) if whole_only else df, recipe, n, dict(zip(recipe.numeric, stats)), seen,
            y.mean if y else None, (y.m2 / max(y.n, 1)) ** 0.5 if y else None)
    return out


def _level_table(df: DataFrame, categorical: tuple[str, ...], fold: str) -> tuple[DataFrame | None, dict[str, int]]:
    """Staged ``(column, level, folds, n)``, and the number of levels of each column."""
    if not categorical:
        return None, {}
    long = df.select(fold, *[F.col(c).cast("string").alias(c) for c in categorical]).unpivot(
        [fold], list(categorical), "column", "level")
    table = stage(long.where(F.col("level").isNotNull()).groupBy("column", "level").agg(
        F.collect_set(fold).alias("folds"), F.count("*").alias("n")))
    return table, {r["column"]: r["count"] for r in table.groupBy("column").count().collect()}  # a row per column


def _levels(table: DataFrame | None, categorical: tuple[str, ...]) -> dict[str, dict[str, set]]:
    """Level -> folds it occurs in, per column; at most ``LISTED_LEVELS`` of each."""
    found: dict[str, dict[str, set]] = {c: {} for c in categorical}
    for r in table.toLocalIterator() if table is not None else ():
        found[r["column"]][r["level"]] = set(r["folds"])
    return found


def _dictionary(table: DataFrame) -> DataFrame:
    """Staged ``(column, level, place, n)``, places from 0 in order of the levels of a column."""
    placed = ranked(table.select("column", "level", "n"), ["column", "level"], "place")
    first = stage(placed.groupBy("column").agg(F.min("place").alias("first")))
    return stage(placed.join(F.broadcast(first), "column").select("column", "level", (F.col("place") - F.col("first")).alias("place"), "n"))  # a row per column


def _build_wide(recipe: Recipe, dictionary: DataFrame, counts: dict, n: int, stats: dict, label_mean, label_std) -> WideEncoder:
    if recipe.degree > 1:
        raise ValueError("polynomial terms take listed levels only")
    means, scales = _scaling(recipe, stats)
    return WideEncoder(recipe, dictionary, counts, n, label_mean, label_std, means, scales)


def _scaling(recipe: Recipe, stats: dict) -> tuple[dict, dict]:
    means, scales = {}, {}
    for c, m in stats.items():
        deviation = (m.m2 / m.n) ** 0.5 if m.n else 0.0
        # A constant column is only centred; rounding noise counts as constant.
        scales[c] = deviation if deviation > 1e-12 * max(1.0, abs(m.mean)) else 1.0
        means[c] = m.mean
        if not recipe.scale:
            means[c], scales[c] = 0.0, 1.0
    return means, scales


def _build(df, recipe: Recipe, n: int, stats: dict, levels: dict, label_mean, label_std) -> Encoder:
    means, scales = _scaling(recipe, stats)
    kept = {c: (v[1:] if recipe.levels == "drop_first" else v) for c, v in levels.items()}
    kept = {c: v for c, v in kept.items() if v}

    stages, names, sources, parts = [], [], [], []
    scaled = [f"{c}__z" for c in recipe.numeric]
    if scaled:
        exprs = ", ".join(
            f"(CAST(`{c}` AS DOUBLE) - {means[c]!r}D) / {scales[c]!r}D AS `{z}`" for c, z in zip(recipe.numeric, scaled))
        stages.append(SQLTransformer(statement=f"SELECT *, {exprs} FROM __THIS__"))
        if recipe.degree > 1:
            stages += [VectorAssembler(inputCols=scaled, outputCol="numeric__v"),
                       PolynomialExpansion(degree=recipe.degree, inputCol="numeric__v", outputCol="numeric__p")]
            parts.append("numeric__p")
            for powers in monomials(len(scaled), recipe.degree):
                term = " ".join(recipe.numeric[i] + (f"^{e}" if e > 1 else "") for i, e in sorted(powers.items()))
                names.append(term)
                sources.append(term)
        else:
            parts += scaled
            names += recipe.numeric
            sources += recipe.numeric
    if kept:
        columns = [c for c in recipe.categorical if c in kept]
        # The slot after the listed levels takes everything else and is then left out of the
        # vector: an unseen (or dropped first) level is all zeros.
        if recipe.unknown == "error":
            stages.append(SQLTransformer(statement=_check_levels(levels)))
        # One stage per column: a stage for all would pad the shorter level lists.
        stages += [StringIndexerModel.from_labels(kept[c], inputCol=c, outputCol=f"{c}__i", handleInvalid="keep")
                   for c in columns]
        parts += [f"{c}__o" for c in columns]
        for c in columns:
            names += [f"{c}_{v}" for v in kept[c]]
            sources += [c] * len(kept[c])
    parts += recipe.passthrough
    names += recipe.passthrough
    sources += recipe.passthrough

    if kept:
        # The indexer's output schema already lists the levels, so this fit reads no data.
        staged = PipelineModel(stages).transform(df)
        stages.append(OneHotEncoder(
            inputCols=[f"{c}__i" for c in columns], outputCols=[f"{c}__o" for c in columns], dropLast=True).fit(staged))
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return Encoder(recipe, PipelineModel(stages), names, sources, n, label_mean, label_std, means, scales, levels)


def _check_levels(levels: dict) -> str:
    """SQL that fails on a row with an unseen level."""
    checks = []
    for c, seen in levels.items():
        listed = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in seen)
        checks.append(f"assert_true(`{c}` IN ({listed}), 'unseen level in {c}') IS NULL")
    return f"SELECT * FROM __THIS__ WHERE {' AND '.join(checks)}"


def monomials(width: int, degree: int) -> list[dict[int, int]]:
    """Exponents of every term MLlib's expansion yields, in its order."""

    def walk(last: int, left: int):
        if left == 0 or last < 0:
            yield {}
            return
        for e in range(left + 1):
            for rest in walk(last - 1, left - e):
                yield {**rest, last: e} if e else rest

    return [m for m in walk(width - 1, degree) if m]


def features_to_rows(encoded: DataFrame, encoder: Encoder, keys: list[str]) -> DataFrame:
    """Encoded vectors in long form ``(keys.., feature, value)``, for inspection."""
    from pyspark.ml.functions import vector_to_array

    names = F.array(*[F.lit(n) for n in encoder.names])
    return encoded.select(*keys, F.explode(F.arrays_zip(
        names.alias("feature"), vector_to_array("features").alias("value"))).alias("f")).select(
        *keys, F.col("f.feature").alias("feature"), F.col("f.value").alias("value"))


def width_table(encoder: Encoder, df: DataFrame) -> DataFrame:
    """Number of encoded features next to the number of rows."""
    return df.agg(F.count("*").alias("n")).withColumn("features", F.lit(encoder.width))


def balanced_weights(df: DataFrame, label: str, weight: str = "weight") -> DataFrame:
    """Class weights ``n / (k * n_c)``: every class gets the same total weight."""
    counts = df.groupBy(label).agg(F.count("*").alias("__c"))
    totals = counts.agg(F.struct(F.sum("__c").alias("n"), F.count("*").alias("k"))).scalar()
    weights = counts.select(label, (totals["n"] / (totals["k"] * F.col("__c"))).alias(weight))
    return df.join(stage(weights.where(F.col(label).isNotNull())), label)  # one staged row per class: broadcast if small
