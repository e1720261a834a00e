"""Global order without a single-task window: ranks, running totals, exact quantiles.

``Window.orderBy`` with no partition would pull every row into one task. Here the rows
are range-partitioned and sorted, each partition gets an id and a total, and the totals
(one row per partition) are turned into offsets that are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallymark.session import stage

_PART, _POS = "__part", "__pos"
_POS_BITS = 33  # monotonically_increasing_id keeps the row's place within its partition here


def _range_partitioned(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """Staged copy of ``df`` with partition number and place within it, in ``order``."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    row_id = F.monotonically_increasing_id()
    return stage(
        ordered.withColumn("__id", row_id)
        .withColumn(_PART, F.shiftright("__id", _POS_BITS).cast("int"))
        .withColumn(_POS, F.col("__id").bitwiseAND((1 << _POS_BITS) - 1))
        .drop("__id")
    )


def _offsets(parts: DataFrame, sums: list[str]) -> DataFrame:
    """Totals of all earlier partitions. One row per partition, so one task is enough."""
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(_PART).agg(*[F.sum(s).alias(f"__tot_{s}") for s in sums])
    return totals.select(
        _PART, *[F.coalesce(F.sum(f"__tot_{s}").over(before), F.lit(0)).alias(f"__off_{s}") for s in sums]
    )


def ranked(df: DataFrame, order: list[str | Column], rank: str = "rank") -> DataFrame:
    """Add the 1-based place of each row in the global ``order``. One range shuffle.

    ``order`` should end in a unique key: rows with equal values then spread over
    several range partitions instead of piling up in one.
    """
    parts = _range_partitioned(df, order)
    counts = _offsets(parts.withColumn("__one", F.lit(1)), ["__one"])
    return (
        parts.join(F.broadcast(counts), _PART)  # one row per partition
        .withColumn(rank, F.col("__off___one") + F.col(_POS) + 1)
        .drop(_PART, _POS, "__off___one")
    )


def running_totals(
    df: DataFrame, order: list[str | Column], sums: list[str], by: list[str] = (), prefix: str = "cum_",
    totals: str | None = None,
) -> DataFrame:
    """Add inclusive running totals of ``sums`` in ``order``, restarting for each ``by`` group.

    Meant for tables that are already aggregated to one row per ordering value. A group
    may span many partitions: the totals run over the whole table and each group's start
    is then subtracted. With ``totals`` each group's sum is added under that prefix.
    """
    by = list(by)
    parts = _range_partitioned(df, [*by, *order])
    offsets = _offsets(parts, sums)
    within = Window.partitionBy(_PART).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    running = parts.join(F.broadcast(offsets), _PART).select(  # one row per partition
        *df.columns, *[(F.col(f"__off_{s}") + F.sum(s).over(within)).alias(f"{prefix}{s}") for s in sums]
    )
    if not by and totals is None:
        return running
    groups = running.groupBy(*by).agg(*[
        e for s in sums for e in (
            F.min(F.col(f"{prefix}{s}") - F.col(s)).alias(f"__start_{s}"), F.sum(s).alias(f"__all_{s}"))])
    kept = [F.col(c) for c in df.columns]
    if by:
        # Staged, so that its size is known: few groups are broadcast and nothing is shuffled by group.
        joined = running.join(stage(groups), by)
        start, whole = (lambda s: F.col(f"__start_{s}")), (lambda s: F.col(f"__all_{s}"))
    else:
        everything = groups.select(F.struct(*[F.col(f"__all_{s}") for s in sums])).scalar()
        joined, start, whole = running, (lambda s: F.lit(0)), (lambda s: everything[f"__all_{s}"])
    return joined.select(
        *kept, *[(F.col(f"{prefix}{s}") - start(s)).alias(f"{prefix}{s}") for s in sums],
        *([whole(s).alias(f"{totals}{s}") for s in sums] if totals is not None else []))


ACCURACY = 10_000  # relative rank error 1/ACCURACY of the approximate bounds


def quantile_bounds(value: str | Column, probs: list[float]) -> Column:
    """Aggregate of a mergeable sketch: values that lie below and above each wanted place, for ``exact_quantiles``."""
    margin = 3.0 / ACCURACY
    ends = [max(0.0, p - margin) for p in probs] + [min(1.0, p + margin) for p in probs]
    return F.percentile_approx(value, ends, ACCURACY)


def exact_quantiles(
    df: DataFrame, value: str, probs: list[float], by: list[str] = (), bounds: DataFrame | None = None
) -> DataFrame:
    """Linear-interpolation quantiles per group, exact, as columns ``by.., n, q0, q1, ..``.

    A first pass finds approximate bounds around each wanted place, unless ``bounds`` brings them from a pass made for
    other aggregates too (staged ``by.., __e``, see ``quantile_bounds``). The second pass orders only the values within the bounds; all others are merely
    counted, which the map side does. Values are counted before they are shuffled, so copies
    cost nothing, and running counts are distributed: no group is held by one task.
    Should a bound ever miss its place, the whole group is ordered after all.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"))
    if bounds is None:
        bounds = stage(rows.groupBy(*by).agg(quantile_bounds("__v", probs).alias("__e")))
    if by:
        bounded = rows.join(bounds, by)  # one staged row per group: broadcast if small
    else:
        bounded = rows.withColumn("__e", bounds.select("__e").scalar())
    lows = [F.col("__e")[i] for i in range(len(probs))]
    highs = [F.col("__e")[len(probs) + i] for i in range(len(probs))]
    inside = F.lit(False)
    for lo, hi in zip(lows, highs):
        inside = inside | F.col("__v").between(lo, hi)
    # A value outside all bounds is counted at the nearest upper bound below it (null: below all).
    under = F.greatest(*[F.when(hi < F.col("__v"), hi) for hi in highs], F.lit(None).cast("double"))
    marked = bounded.select(*by, F.when(inside, F.col("__v")).otherwise(under).alias("__v"), inside.cast("int").alias("__in"))
    found = stage(_quantiles(marked, probs, by))
    missed = F.lit(False)
    for i in range(len(probs)):
        missed = missed | F.col(f"q{i}").isNull()
    if found.where(missed).isEmpty():
        return found
    return _quantiles(rows.withColumn("__in", F.lit(1)), probs, by)


def _quantiles(rows: DataFrame, probs: list[float], by: list[str]) -> DataFrame:
    """Quantiles of ``__v``; rows with ``__in = 0`` only shift the places of those above them."""
    counts = rows.groupBy(*by, "__v").agg(F.count("*").alias("__c"), F.sum("__in").alias("__real"))
    running = running_totals(counts, [F.col("__v").asc_nulls_first()], ["__c"], by, totals="all_").withColumnRenamed(
        "all___c", "__n")
    start = F.col("cum___c") - F.col("__c")
    aggs = []
    for i, p in enumerate(probs):
        place = (F.col("__n") - 1) * F.lit(float(p))
        for name, at in ((f"__lo{i}", F.floor(place)), (f"__hi{i}", F.ceil(place))):
            hit = (start <= at) & (at < start + F.col("__real"))
            aggs.append(F.max(F.when(hit, F.col("__v"))).alias(name))
    found = running.groupBy(*by).agg(F.max("__n").alias("__n"), *aggs)
    out = []
    for i, p in enumerate(probs):
        place = (F.col("__n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        out.append((lo + (hi - lo) * (place - F.floor(place))).alias(f"q{i}"))
    return found.select(*by, F.col("__n").alias("n"), *out)
