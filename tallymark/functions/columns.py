"""Column expressions shared by the operators. Everything here stays on the JVM side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

MEAN_FLOOR = 1e-9  # smallest Poisson mean used in a deviance


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- target variants -------------------------------------------------------

def log_target(c: str | Column) -> Column:
    return F.log1p(col(c).cast("double"))


def back_transform(c: str | Column, clip: bool = True) -> Column:
    """Undo ``log_target``; negative results are clipped to zero unless ``clip`` is off."""
    raw = F.expm1(col(c))
    return F.greatest(raw, F.lit(0.0)) if clip else raw


def above(c: str | Column, threshold: float) -> Column:
    return (col(c) > F.lit(threshold)).cast("int")


def at_least(c: str | Column, threshold: float) -> Column:
    return (col(c) >= F.lit(threshold)).cast("int")


def floor_mean(c: str | Column, floor: float = MEAN_FLOOR) -> Column:
    return F.greatest(col(c).cast("double"), F.lit(floor))


def count_target(c: str | Column) -> Column:
    """Whole-number target: the fraction is cut off."""
    return col(c).cast("int")


# --- seeded hashing --------------------------------------------------------

def hash32(salt: str, *key: str | Column) -> Column:
    """First 32 bits of md5 over ``salt:key[:key..]`` as a non-negative long.

    Depends on the key alone, so a split or fold survives any repartitioning,
    retry or change of file order.
    """
    text = F.concat_ws(":", F.lit(salt), *[col(k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash_unit(salt: str, *key: str | Column) -> Column:
    return hash32(salt, *key) / F.lit(4294967296.0)


# --- labels and small arithmetic ------------------------------------------

def correlation_strength(r: str | Column) -> Column:
    size = F.abs(col(r))
    return F.when(size > 0.3, "strong").when(size > 0.1, "moderate").otherwise("weak")


def correlation_direction(r: str | Column) -> Column:
    return F.when(col(r) > 0, "positive").otherwise("negative")


def auc_band(auc: str | Column) -> Column:
    a = col(auc)
    return F.when(a >= 0.9, "excellent").when(a >= 0.8, "good").when(a >= 0.7, "fair").otherwise("poor")


def percent_change(test: str | Column, cv: str | Column) -> Column:
    """Relative change of the test value against the CV value in percent (null if CV <= 0)."""
    return F.when(col(cv) > 0, (col(test) - col(cv)) / col(cv) * 100)


def adjusted_r2(r2: str | Column, n: str | Column, p: str | Column | int) -> Column:
    p = F.lit(p) if isinstance(p, int) else col(p)
    left = col(n) - p - 1
    return F.when(left > 0, 1 - (1 - col(r2)) * (col(n) - 1) / left)


def safe_div(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(otherwise))


# --- inverse normal --------------------------------------------------------

# The published coefficients of Wichura's algorithm AS 241 (PPND16).
_CENTRE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
     13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867,
     5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
)
_NEAR_TAIL = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258,
     3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459,
     0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0),
)
_FAR_TAIL = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093,
     0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4,
     0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0),
)


def _ratio(x: Column, coefficients) -> Column:
    top, bottom = (reduce(lambda acc, c: acc * x + F.lit(c), cs[1:], F.lit(cs[0])) for cs in coefficients)
    return top / bottom


def normal_quantile(p: str | Column) -> Column:
    """Standard normal quantile for 0 < p < 1, accurate to about 1e-15."""
    p = col(p)
    q = p - 0.5
    centre = q * _ratio(F.lit(0.180625) - q * q, _CENTRE)
    r = F.sqrt(-F.ln(F.least(p, 1 - p)))
    tail = F.when(r <= 5, _ratio(r - 1.6, _NEAR_TAIL)).otherwise(_ratio(r - 5.0, _FAR_TAIL))
    return F.when(F.abs(q) <= 0.425, centre).otherwise(F.signum(q) * tail)


# --- schema helpers --------------------------------------------------------

def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def split_by_type(df: DataFrame, columns: list[str] | None = None) -> tuple[list[str], list[str]]:
    """(numeric, categorical) names among ``columns``, in their order."""
    kinds = {f.name: is_numeric(f.dataType) for f in df.schema.fields}
    wanted = list(kinds) if columns is None else [c for c in columns if c in kinds]
    return [c for c in wanted if kinds[c]], [c for c in wanted if not kinds[c]]


def existing(df: DataFrame, columns: list[str]) -> list[str]:
    have = set(df.columns)
    return [c for c in columns if c in have]
