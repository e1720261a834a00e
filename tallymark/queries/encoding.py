"""Encoders: every query returns encoded values or widths computed from the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.operators.encode import Recipe, balanced_weights, features_to_rows, fit_encoder, width_table
from tallymark.operators.splits import with_split
from tallymark.queries.registry import query, rounded, with_tables
from tallymark.sources.fixtures import KEY, ORDER_FACT_SQL, SIDES_SQL, doc_label, order_fact

_NUM = ["o_totalprice", "c_acctbal"]


def _sides(spark, d, *columns):
    return with_split(order_fact(spark, d), KEY).select(KEY, "split", *columns)


def _z(c):
    return f"({c} - avg_{c}) / sd_{c}"


_STATS_SQL = SIDES_SQL + """,
st AS (SELECT avg(o_totalprice) AS avg_o_totalprice, stddev_pop(o_totalprice) AS sd_o_totalprice,
              avg(c_acctbal) AS avg_c_acctbal, stddev_pop(c_acctbal) AS sd_c_acctbal FROM sides WHERE split = 'train')"""


@query("f1_standardise", with_tables(_STATS_SQL, f"""
SELECT o_orderkey, round({_z('o_totalprice')}, 6) AS o_totalprice, round({_z('c_acctbal')}, 6) AS c_acctbal,
       0.0::DOUBLE AS constant FROM sides, st"""))
def f1_standardise(spark, d):
    """Train-side mean and population deviation applied to all rows; a constant column is only centred."""
    df = _sides(spark, d, *_NUM).withColumn("constant", F.lit(7.0))
    train = df.where("split = 'train'")
    e = fit_encoder(train, Recipe((*_NUM, "constant")))
    out = e.transform(df).select(KEY, *[F.col(f"{c}__z").alias(c) for c in (*_NUM, "constant")])
    return rounded(out)


@query("f1_standardise_nulls", with_tables(ORDER_FACT_SQL, """
, s AS (SELECT avg(avg_qty) AS mq, stddev_pop(avg_qty) AS sq, avg(o_totalprice) AS mp, stddev_pop(o_totalprice) AS sp FROM order_fact)
SELECT o_orderkey, round((avg_qty - mq) / sq, 6) AS avg_qty, round((o_totalprice - mp) / sp, 6) AS o_totalprice FROM order_fact, s"""))
def f1_standardise_nulls(spark, d):
    """A column with nulls: they count for neither mean nor deviation, and stay null."""
    df = order_fact(spark, d).select(KEY, "avg_qty", "o_totalprice")
    e = fit_encoder(df, Recipe(("avg_qty", "o_totalprice")))
    return rounded(e.transform(df).select(KEY, *[F.col(f"{c}__z").alias(c) for c in ("avg_qty", "o_totalprice")]))


def _indicator_rows(spark, d, **options):
    df = _sides(spark, d, "o_orderpriority", "o_orderstatus")
    e = fit_encoder(df.where("split = 'train'"), Recipe(categorical=("o_orderpriority", "o_orderstatus"), **options))
    return features_to_rows(e.transform(df), e, [KEY]).groupBy("feature").agg(
        F.sum("value").cast("long").alias("ones"), F.count("*").alias("n"),
        F.sum(F.when(F.col("value") == 1, F.col(KEY))).alias("key_sum"))


def _indicator_sql(drop_first):
    part = """
SELECT '{c}_' || v AS feature, count(*) FILTER ({c} = v) AS ones, count(*) AS n,
       (sum(o_orderkey) FILTER ({c} = v))::BIGINT AS key_sum
FROM (SELECT {c} AS v FROM sides WHERE split = 'train' GROUP BY 1 ORDER BY 1 OFFSET {o}), sides GROUP BY v"""
    return " UNION ALL ".join(f"SELECT * FROM ({part.format(c=c, o=int(drop_first))})" for c in ("o_orderpriority", "o_orderstatus"))


@query("f2_one_hot_all_levels", with_tables(SIDES_SQL, _indicator_sql(False)))
def f2_one_hot_all_levels(spark, d):
    return _indicator_rows(spark, d)


@query("f2_unknown_levels", with_tables(SIDES_SQL, """
SELECT o_orderkey, o_month, (o_month <= '06')::INT AS known, (o_month <= '06')::INT::DOUBLE AS indicator_sum FROM sides"""))
def f2_unknown_levels(spark, d):
    """Fitted on the first six months only: later months encode to all zeros."""
    df = _sides(spark, d, "o_month")
    e = fit_encoder(df.where("o_month <= '06'"), Recipe(categorical=("o_month",)))
    return features_to_rows(e.transform(df), e, [KEY, "o_month"]).groupBy(KEY, "o_month").agg(
        (F.col("o_month") <= "06").cast("int").alias("known"), F.sum("value").alias("indicator_sum"))


@query("f3_one_hot_drop_first", with_tables(SIDES_SQL, _indicator_sql(True)))
def f3_one_hot_drop_first(spark, d):
    return _indicator_rows(spark, d, levels="drop_first", unknown="error")


@query("f4_drop_first_unknown_zero", with_tables(SIDES_SQL, """
SELECT o_orderkey, o_month, (o_month > '01' AND o_month <= '06')::INT::DOUBLE AS indicator_sum FROM sides"""))
def f4_drop_first_unknown_zero(spark, d):
    df = _sides(spark, d, "o_month")
    e = fit_encoder(df.where("o_month <= '06'"), Recipe(categorical=("o_month",), levels="drop_first"))
    return features_to_rows(e.transform(df), e, [KEY, "o_month"]).groupBy(KEY, "o_month").agg(
        F.sum("value").alias("indicator_sum"))


@query("f5_polynomial_terms", with_tables(_STATS_SQL, f"""
, z AS (SELECT o_orderkey, {_z('o_totalprice')} AS a, {_z('c_acctbal')} AS b FROM sides, st)
SELECT o_orderkey, 'o_totalprice' AS feature, round(a, 6) AS value FROM z UNION ALL
SELECT o_orderkey, 'o_totalprice^2', round(a * a, 6) FROM z UNION ALL
SELECT o_orderkey, 'c_acctbal', round(b, 6) FROM z UNION ALL
SELECT o_orderkey, 'o_totalprice c_acctbal', round(a * b, 6) FROM z UNION ALL
SELECT o_orderkey, 'c_acctbal^2', round(b * b, 6) FROM z"""))
def f5_polynomial_terms(spark, d):
    df = _sides(spark, d, *_NUM)
    e = fit_encoder(df.where("split = 'train'"), Recipe(tuple(_NUM), degree=2))
    return rounded(features_to_rows(e.transform(df), e, [KEY]))


@query("f6_combined_vector", with_tables(_STATS_SQL, f"""
, z AS (SELECT *, {_z('o_totalprice')} AS a FROM sides, st)
SELECT 'o_totalprice' AS feature, round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS sd, count(*) AS n FROM z UNION ALL
SELECT 'o_orderstatus_' || v, round(avg((o_orderstatus = v)::INT), 6), round(stddev_pop((o_orderstatus = v)::INT), 6), count(*)
FROM (SELECT o_orderstatus AS v FROM sides WHERE split = 'train' GROUP BY 1), z GROUP BY v UNION ALL
SELECT 'o_year', round(avg(o_year), 6), round(stddev_pop(o_year), 6), count(*) FROM z"""))
def f6_combined_vector(spark, d):
    """Scaled numbers, one-hot levels and a passed-through column in one vector."""
    df = _sides(spark, d, "o_totalprice", "o_orderstatus", F.col("o_year").cast("double").alias("o_year"))
    e = fit_encoder(df.where("split = 'train'"), Recipe(("o_totalprice",), ("o_orderstatus",), passthrough=("o_year",)))
    return rounded(features_to_rows(e.transform(df), e, [KEY]).groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count("*").alias("n")))


@query("f7_feature_names", with_tables(SIDES_SQL, """
, t AS (SELECT * FROM sides WHERE split = 'train')
SELECT 0::INT AS slot, 'o_totalprice' AS feature, 'o_totalprice' AS source, count(*) AS n FROM t UNION ALL
SELECT 1, 'c_acctbal', 'c_acctbal', count(*) FROM t UNION ALL
SELECT (1 + row_number() OVER (ORDER BY c_mktsegment))::INT, 'c_mktsegment_' || c_mktsegment, 'c_mktsegment', count(*)
FROM t GROUP BY c_mktsegment"""))
def f7_feature_names(spark, d):
    """Names and source columns of the vector slots, with the rows that fill each."""
    df = _sides(spark, d, *_NUM, "c_mktsegment").where("split = 'train'")
    e = fit_encoder(df, Recipe.of(df, [*_NUM, "c_mktsegment"]))
    names = F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(n).alias("feature"), F.lit(s).alias("source"))
                      for i, (n, s) in enumerate(zip(e.names, e.sources))])
    used = features_to_rows(e.transform(df), e, [KEY]).groupBy("feature").agg(
        F.count("*").alias("rows"), F.sum((F.col("value") != 0).cast("long")).alias("filled"))
    slots = df.agg(names.alias("s")).select(F.explode("s").alias("s")).select("s.*")
    numeric = F.col("source").isin(_NUM)
    return slots.join(used, "feature").select("slot", "feature", "source", F.when(numeric, F.col("rows")).otherwise(F.col("filled")).alias("n"))


@query("f8_encoded_width", with_tables(SIDES_SQL, """
SELECT count(*) AS n, (2 + 1 + 2 + count(DISTINCT r_name) + count(DISTINCT o_month))::INT AS features
FROM sides WHERE split = 'train'"""))
def f8_encoded_width(spark, d):
    df = _sides(spark, d, *_NUM, "r_name", "o_month").where("split = 'train'")
    e = fit_encoder(df, Recipe.of(df, [*_NUM, "r_name", "o_month"], degree=2))
    return width_table(e, df)


@query("f10_balanced_weights", """
WITH l AS (SELECT doc_id, toxic FROM labels JOIN documents USING (doc_id)),
c AS (SELECT toxic, count(*) AS c FROM l GROUP BY 1), t AS (SELECT sum(c) AS n, count(*) AS k FROM c)
SELECT doc_id, toxic, round(n / (k * c), 6) AS weight FROM l JOIN c USING (toxic), t""")
def f10_balanced_weights(spark, d):
    return rounded(balanced_weights(doc_label(spark, d).select("doc_id", "toxic"), "toxic").select("doc_id", "toxic", "weight"))
