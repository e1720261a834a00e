"""Summaries, distributions and correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.operators import profile
from tallymark.operators.splits import with_split
from tallymark.queries.registry import query, rounded, with_tables
from tallymark.sources.fixtures import (
    CATEGORICAL, COUNT, KEY, LOG, NUMERIC, ORDER_FACT_SQL, SIDES_SQL, event_value, line_value, order_fact,
)

_LINE_COLUMNS = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


def _per_column(columns, select, source):
    return " UNION ALL ".join(select.format(c=c, source=source) for c in columns)


@query("e1_summary", with_tables(ORDER_FACT_SQL, _per_column([COUNT, "o_totalprice"], """
SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
       round(var_samp({c}), 0) AS var, round(min({c}), 4)::DOUBLE AS min, round(max({c}), 4)::DOUBLE AS max,
       round(max({c}) - min({c}), 4)::DOUBLE AS range, round(median({c}), 4)::DOUBLE AS median FROM {source}""", "order_fact")))
def e1_summary(spark, d):
    s = profile.summary(order_fact(spark, d), [COUNT, "o_totalprice"])
    wanted = rounded(s.drop("var"), 4).select("column", "n", "mean", "std", "min", "max", "range", "median")
    # A variance near 2e10: eleven digits are compared, more would be rounding noise.
    return wanted.join(rounded(s.select("column", "var"), 0), "column")


@query("e2_quartiles", _per_column(_LINE_COLUMNS, """
SELECT '{c}' AS "column", count(*) AS n, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS median,
       round(quantile_cont({c}, 0.75), 6) AS q75,
       round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS iqr FROM {source}""", "lineitem"))
def e2_quartiles(spark, d):
    return rounded(profile.quartiles(line_value(spark, d), _LINE_COLUMNS))


@query("e3_mode", with_tables(ORDER_FACT_SQL, """
SELECT n_lines, count(*) AS n FROM order_fact GROUP BY 1 ORDER BY n DESC, n_lines LIMIT 1"""))
def e3_mode(spark, d):
    return profile.mode(order_fact(spark, d), COUNT)


@query("e4_skewness", """
SELECT l_returnflag, round(skewness(l_extendedprice), 6) AS skew, round(skewness(l_quantity), 6) AS skew_quantity
FROM lineitem GROUP BY 1""")
def e4_skewness(spark, d):
    return rounded(line_value(spark, d).groupBy("l_returnflag").agg(
        profile.skewness("l_extendedprice").alias("skew"), profile.skewness("l_quantity").alias("skew_quantity")))


@query("e5_kurtosis", """
SELECT l_returnflag, round(kurtosis(l_extendedprice), 6) AS kurt, round(kurtosis(l_quantity), 6) AS kurt_quantity
FROM lineitem GROUP BY 1""")
def e5_kurtosis(spark, d):
    return rounded(line_value(spark, d).groupBy("l_returnflag").agg(
        profile.kurtosis("l_extendedprice").alias("kurt"), profile.kurtosis("l_quantity").alias("kurt_quantity")))


@query("e6_value_counts", with_tables(ORDER_FACT_SQL, "SELECT n_lines, count(*) AS n FROM order_fact GROUP BY 1 ORDER BY 1"))
def e6_value_counts(spark, d):
    return profile.value_counts(order_fact(spark, d), COUNT)


_HISTOGRAM = """
, e AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / {bins} AS w FROM src),
b AS (SELECT greatest(least(floor((v - lo) / w), {bins} - 1), 0)::INT AS bin, count(*) AS n FROM src, e GROUP BY 1)
SELECT i::INT AS bin, round(lo + i * w, 6) AS left, round(lo + (i + 1) * w, 6) AS right, coalesce(n, 0) AS n
FROM range({bins}) AS r(i) CROSS JOIN e LEFT JOIN b ON b.bin = i"""


@query("e7_histogram", with_tables("src AS (SELECT l_extendedprice AS v FROM lineitem)", _HISTOGRAM.format(bins=50)))
def e7_histogram(spark, d):
    return rounded(profile.histogram(line_value(spark, d), "l_extendedprice", 50))


@query("e8_integer_histogram", with_tables(ORDER_FACT_SQL, """
, c AS (SELECT n_lines AS bin, count(*) AS n FROM order_fact GROUP BY 1),
r AS (SELECT unnest(range(min(bin), max(bin) + 1)) AS bin FROM c)
SELECT r.bin::BIGINT AS bin, coalesce(n, 0) AS n FROM r LEFT JOIN c ON r.bin = c.bin"""))
def e8_integer_histogram(spark, d):
    return profile.integer_histogram(order_fact(spark, d), COUNT)


@query("e9_group_profile", with_tables(ORDER_FACT_SQL, _per_column(CATEGORICAL, """
SELECT '{c}' AS "column", {c} AS level, round(avg(n_lines), 6) AS mean, round(stddev_samp(n_lines), 6) AS std, count(*) AS n
FROM {source} GROUP BY {c}""", "order_fact")))
def e9_group_profile(spark, d):
    return rounded(profile.group_profile(order_fact(spark, d), CATEGORICAL, COUNT))


@query("e9_event_profile", _per_column(["event_type", "hour"], """
SELECT '{c}' AS "column", {c} AS level, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(*) AS n
FROM {source} GROUP BY {c}""", "(SELECT event_type, strftime(ts, '%H') AS hour, value FROM events)"))
def e9_event_profile(spark, d):
    return rounded(profile.group_profile(event_value(spark, d), ["event_type", "hour"], "value"))


@query("e10_category_effects", with_tables(ORDER_FACT_SQL, """
, g AS (""" + _per_column(CATEGORICAL, "SELECT '{c}' AS \"column\", avg(n_lines) AS mean FROM {source} GROUP BY {c}", "order_fact") + """),
o AS (SELECT avg(n_lines) AS overall FROM order_fact)
SELECT "column", round(max(abs(mean - overall)), 6) AS max_difference, round(avg(mean), 6) AS mean_of_means, count(*) AS levels
FROM g, o GROUP BY "column" """))
def e10_category_effects(spark, d):
    return rounded(profile.category_effects(order_fact(spark, d), CATEGORICAL, COUNT))


@query("e11_class_balance", with_tables(ORDER_FACT_SQL, """
, c AS (SELECT hi, count(*) AS n FROM order_fact GROUP BY 1)
SELECT hi, n, round(n / sum(n) OVER (), 6) AS share, (row_number() OVER (ORDER BY n DESC, hi) = 1)::INT AS majority FROM c"""))
def e11_class_balance(spark, d):
    return rounded(profile.class_balance(order_fact(spark, d), "hi"))


@query("e12_ecdf", with_tables(ORDER_FACT_SQL, """
, c AS (SELECT n_lines AS value, count(*) AS n FROM order_fact GROUP BY 1)
SELECT value, n, (sum(n) OVER (ORDER BY value))::BIGINT AS cum_n,
       round(sum(n) OVER (ORDER BY value) / sum(n) OVER () * 100, 6) AS percent FROM c"""))
def e12_ecdf(spark, d):
    return rounded(profile.ecdf(order_fact(spark, d), COUNT))


@query("e12_ecdf_prices", """
WITH c AS (SELECT l_extendedprice AS value, count(*) AS n FROM lineitem GROUP BY 1)
SELECT value, n, (sum(n) OVER (ORDER BY value))::BIGINT AS cum_n,
       round(sum(n) OVER (ORDER BY value) / sum(n) OVER () * 100, 6) AS percent FROM c""")
def e12_ecdf_prices(spark, d):
    """Tens of thousands of distinct values: the running total is distributed."""
    return profile.ecdf(line_value(spark, d), "l_extendedprice").withColumn("percent", F.round("percent", 6))


def _corr_sql(predictors, targets, source):
    return " UNION ALL ".join(
        f"SELECT '{p}' AS predictor, '{t}' AS target, round(corr({p}, {t}), 6) AS r, round(abs(corr({p}, {t})), 6) AS abs_r FROM {source}"
        for t in targets for p in predictors)


@query("e13_correlations", with_tables(ORDER_FACT_SQL, _corr_sql(NUMERIC, [COUNT], "order_fact")))
def e13_correlations(spark, d):
    return rounded(profile.correlations(order_fact(spark, d), NUMERIC, [COUNT]))


@query("e13_line_correlations", _corr_sql(["l_quantity", "l_discount", "l_tax", "l_linenumber"], ["l_extendedprice"], "lineitem"))
def e13_line_correlations(spark, d):
    return rounded(profile.correlations(line_value(spark, d), ["l_quantity", "l_discount", "l_tax", "l_linenumber"], ["l_extendedprice"]))


@query("e14_log_correlations", with_tables(ORDER_FACT_SQL, _corr_sql(NUMERIC, [COUNT, LOG], "order_fact")))
def e14_log_correlations(spark, d):
    """Both targets from one aggregate."""
    return rounded(profile.correlations(order_fact(spark, d), NUMERIC, [COUNT, LOG]))


_PRICE_PREDICTORS = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
_LINE_CORR = "src AS (SELECT *, ln(1 + l_extendedprice) AS log_price FROM lineitem), c AS (" + _corr_sql(
    _PRICE_PREDICTORS, ["log_price"], "src") + ")"


def _line_corr(spark, d):
    return profile.correlations(line_value(spark, d), _PRICE_PREDICTORS, ["log_price"])


@query("e15_strongest", with_tables(_LINE_CORR, "SELECT * FROM c ORDER BY abs_r DESC, predictor LIMIT 3"))
def e15_strongest(spark, d):
    return rounded(profile.strongest(_line_corr(spark, d), 3))


@query("e15_strong_only", with_tables(_LINE_CORR, "SELECT * FROM c WHERE abs_r > 0.3"))
def e15_strong_only(spark, d):
    return rounded(profile.strong_only(_line_corr(spark, d)))


@query("e15_any_strong", with_tables(_LINE_CORR, """
SELECT count(*) FILTER (abs_r > 0.3) AS strong, (count(*) FILTER (abs_r > 0.3) = 0)::INT AS none_strong FROM c"""))
def e15_any_strong(spark, d):
    return profile.any_strong(_line_corr(spark, d))


_MATRIX = ["l_quantity", "l_discount", "l_extendedprice", "l_tax"]


@query("e16_correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in _MATRIX for b in _MATRIX))
def e16_correlation_matrix(spark, d):
    return rounded(profile.correlation_matrix(line_value(spark, d), _MATRIX))


@query("e17_trend_line", """
WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept,
                  min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)
SELECT i::INT AS point, round(lo + i * (hi - lo) / 99, 6) AS x, round(slope, 6) AS slope, round(intercept, 4) AS intercept,
       round(intercept + slope * (lo + i * (hi - lo) / 99), 4) AS y FROM f, range(100) AS r(i)""")
def e17_trend_line(spark, d):
    t = profile.trend_line(line_value(spark, d), "l_quantity", "l_extendedprice")
    return t.select("point", *[F.round(c, p).alias(c) for c, p in (("x", 6), ("slope", 6), ("intercept", 4), ("y", 4))])


@query("e18_split_shares", with_tables(SIDES_SQL, """
SELECT split, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM sides GROUP BY split"""))
def e18_split_shares(spark, d):
    return rounded(profile.split_shares(with_split(order_fact(spark, d), KEY)))
