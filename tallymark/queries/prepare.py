"""Sources, sinks, predicates, splits and resampling."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F, types as T

from tallymark.functions.columns import (
    above, at_least, back_transform, correlation_direction, correlation_strength, count_target, existing, floor_mean,
    log_target, percent_change, split_by_type,
)
from tallymark.operators import profile

from tallymark.operators.selection import drop_redundant
from tallymark.operators.smote import smote
from tallymark.operators.splits import undersample, validation_slice, with_contiguous_folds, with_folds, with_split
from tallymark.plans.catalogue import PREDICTOR_SETS, REDUNDANT_PAIRS, complete_rows
from tallymark.queries.registry import query, rounded, with_tables
from tallymark.session import staging_root
from tallymark.sources.fixtures import (
    COUNT, KEY, ORDER_FACT_SQL, SCORED_SQL, doc_label, emb_label, hash_sql, line_value, order_fact,
    scored_orders,
)
from tallymark.sources.tables import drop_incomplete, read_csv, table


@query("s1_csv_scan", """
SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS c_mktsegment,
       CASE WHEN c_acctbal >= 0 THEN round(c_acctbal, 2) END AS c_acctbal FROM customer""")
def s1_csv_scan(spark, d):
    """Customers written as CSV with missing-value tokens in two columns, then scanned."""
    path = os.path.join(staging_root(spark), f"csv-{uuid.uuid4().hex}")
    c = table(spark, d, "customer")
    c.select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "NA").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
             F.when(F.col("c_acctbal") < 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal")
             ).write.csv(path, header=True)
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_mktsegment", T.StringType()),
                           T.StructField("c_acctbal", T.DoubleType())])
    return rounded(read_csv(spark, path, schema), 2)


@query("s1_csv_mixed_headers", """
SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS c_mktsegment, round(c_acctbal, 2) AS c_acctbal FROM customer""")
def s1_csv_mixed_headers(spark, d):
    """Customers in two sets of files that order their columns differently."""
    path = os.path.join(staging_root(spark), f"csv-{uuid.uuid4().hex}")
    c = table(spark, d, "customer").select(
        "c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "NA").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), "c_acctbal")
    for odd, names in enumerate((["c_custkey", "c_mktsegment", "c_acctbal"], ["c_acctbal", "c_custkey", "c_mktsegment"])):
        c.where(F.col("c_custkey") % 2 == odd).select(*names).write.csv(f"{path}/set={odd}", header=True)
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_mktsegment", T.StringType()),
                           T.StructField("c_acctbal", T.DoubleType())])
    return rounded(read_csv(spark, f"{path}/*/*.csv", schema), 2)


@query("s1_csv_inferred", """
SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS c_mktsegment,
       CASE WHEN c_acctbal >= 0 THEN round(c_acctbal, 2) END AS c_acctbal FROM customer""")
def s1_csv_inferred(spark, d):
    """The same scan with inferred types."""
    path = os.path.join(staging_root(spark), f"csv-{uuid.uuid4().hex}")
    c = table(spark, d, "customer")
    c.select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "NULL").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
             F.when(F.col("c_acctbal") < 0, "nan").otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal")
             ).write.csv(path, header=True)
    return rounded(read_csv(spark, path), 2)


@query("p1_drop_incomplete", with_tables(ORDER_FACT_SQL, """
SELECT o_orderkey, n_lines, round(avg_qty, 6) AS avg_qty, round(avg_disc, 6) AS avg_disc
FROM order_fact WHERE avg_qty IS NOT NULL AND avg_disc IS NOT NULL"""))
def p1_drop_incomplete(spark, d):
    return rounded(drop_incomplete(order_fact(spark, d).select(KEY, COUNT, "avg_qty", "avg_disc")))


@query("p2_log_target", with_tables(ORDER_FACT_SQL, """
SELECT count(*) AS n, min(n_lines) AS count_min, max(n_lines) AS count_max,
       round(min(ln(1 + n_lines)), 6) AS log_min, round(max(ln(1 + n_lines)), 6) AS log_max,
       round(avg(ln(1 + n_lines)), 6) AS log_mean FROM order_fact"""))
def p2_log_target(spark, d):
    x = log_target(COUNT)
    return rounded(order_fact(spark, d).agg(
        F.count("*").alias("n"), F.min(COUNT).alias("count_min"), F.max(COUNT).alias("count_max"),
        F.min(x).alias("log_min"), F.max(x).alias("log_max"), F.avg(x).alias("log_mean")))


@query("p3_back_transform", with_tables(SCORED_SQL, """
SELECT o_orderkey, round(greatest(exp(yhat_log) - 1, 0), 6) AS yhat,
       round(greatest(exp(yhat_log - 2) - 1, 0), 6) AS low_clipped, round(exp(yhat_log - 2) - 1, 6) AS low_raw
FROM scored"""))
def p3_back_transform(spark, d):
    low = F.col("yhat_log") - 2
    return rounded(scored_orders(spark, d).select(
        KEY, back_transform("yhat_log").alias("yhat"), back_transform(low).alias("low_clipped"),
        back_transform(low, clip=False).alias("low_raw")))


@query("p4_binary_target", with_tables(ORDER_FACT_SQL, "SELECT o_orderkey, n_lines, (n_lines > 4)::INT AS hi FROM order_fact"))
def p4_binary_target(spark, d):
    return order_fact(spark, d).select(KEY, COUNT, above(COUNT, 4).alias("hi"))


@query("p5_binarise_at_threshold", with_tables(SCORED_SQL, """
SELECT (y >= 3)::INT AS y_bin, (yhat >= 3)::INT AS yhat_bin, count(*) AS n FROM scored GROUP BY ALL"""))
def p5_binarise_at_threshold(spark, d):
    return scored_orders(spark, d).groupBy(at_least("y", 3).alias("y_bin"), at_least("yhat", 3).alias("yhat_bin")).agg(
        F.count("*").alias("n"))


@query("p6_project_predictors", with_tables(ORDER_FACT_SQL, """
SELECT o_orderkey, o_totalprice, c_acctbal, o_orderpriority, n_lines FROM order_fact"""))
def p6_project_predictors(spark, d):
    return order_fact(spark, d).select(KEY, "o_totalprice", "c_acctbal", "o_orderpriority", COUNT)


_KINDS = [(c, "numeric") for c in ("l_discount", "l_extendedprice", "l_linenumber", "l_orderkey", "l_quantity", "l_tax")] + [
    (c, "categorical") for c in ("l_linestatus", "l_returnflag")]


@query("p7_column_kinds", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{k}' AS kind, count({c}) AS n FROM lineitem" for c, k in _KINDS))
def p7_column_kinds(spark, d):
    """Kind of every modelling column of the line items, with its number of values."""
    df = line_value(spark, d).drop("line_key", "log_price")
    numeric, _ = split_by_type(df)
    cells = [F.struct(F.lit(c).alias("column"), F.lit("numeric" if c in numeric else "categorical").alias("kind"),
                      F.count(c).alias("n")) for c in df.columns]
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


@query("p8_existing_columns", with_tables(ORDER_FACT_SQL, """
SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS o_totalprice FROM order_fact GROUP BY 1"""))
def p8_existing_columns(spark, d):
    df = order_fact(spark, d)
    present = existing(df, ["not_there", "o_totalprice", "o_orderpriority", "missing_too"])
    return rounded(df.select(*present).groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.avg("o_totalprice").alias("o_totalprice")), 4)


@query("p9_count_target", "SELECT event_id, trunc(value)::INT AS y FROM events")
def p9_count_target(spark, d):
    return table(spark, d, "events").select("event_id", count_target("value").alias("y"))


@query("p10_floor_mean", with_tables(SCORED_SQL, """
SELECT o_orderkey, round(greatest(yhat - 4, 1e-9), 9) AS mu FROM scored"""))
def p10_floor_mean(spark, d):
    return rounded(scored_orders(spark, d).select(KEY, floor_mean(F.col("yhat") - 4).alias("mu")), 9)


@query("p11_redundant_pairs", with_tables(ORDER_FACT_SQL, """
SELECT o_orderpriority, r_name, count(*) AS n, round(avg(n_lines), 6) AS mean_lines FROM order_fact GROUP BY ALL"""))
def p11_redundant_pairs(spark, d):
    """The nation determines the region, so only the region stays as a predictor."""
    kept = drop_redundant(["o_orderpriority", "n_name", "r_name"], REDUNDANT_PAIRS)
    return rounded(order_fact(spark, d).groupBy(*kept).agg(F.count("*").alias("n"), F.avg(COUNT).alias("mean_lines")))


@query("p12_correlation_labels", """
WITH c AS (
  SELECT 'l_quantity' AS predictor, corr(l_extendedprice, l_quantity) AS r FROM lineitem UNION ALL
  SELECT 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem UNION ALL
  SELECT 'l_tax', corr(l_extendedprice, l_tax) FROM lineitem UNION ALL
  SELECT 'l_linenumber', corr(l_extendedprice, l_linenumber) FROM lineitem)
SELECT predictor, round(r, 6) AS r,
       CASE WHEN abs(r) > 0.3 THEN 'strong' WHEN abs(r) > 0.1 THEN 'moderate' ELSE 'weak' END AS strength,
       CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM c""")
def p12_correlation_labels(spark, d):
    c = profile.correlations(line_value(spark, d), ["l_quantity", "l_discount", "l_tax", "l_linenumber"], ["l_extendedprice"])
    return rounded(c.select("predictor", "r", correlation_strength("r").alias("strength"),
                            correlation_direction("r").alias("direction")))


@query("p13_pseudo_probability", with_tables(SCORED_SQL, """
, t AS (SELECT max(yhat) AS top FROM scored)
SELECT o_orderkey, CASE WHEN top > 0 THEN round(yhat / top, 6) ELSE round(yhat, 6) END AS p FROM scored, t"""))
def p13_pseudo_probability(spark, d):
    df = scored_orders(spark, d)
    top = df.agg(F.max("yhat")).scalar()
    return rounded(df.select(KEY, F.when(top > 0, F.col("yhat") / top).otherwise(F.col("yhat")).alias("p")))


_HALVES_SQL = SCORED_SQL + """,
errors AS (
  SELECT 'mse' AS metric, avg((y - yhat) ^ 2) FILTER (fold < 5) AS cv, avg((y - yhat) ^ 2) FILTER (fold >= 5) AS test FROM scored
  UNION ALL
  SELECT 'mae', avg(abs(y - yhat)) FILTER (fold < 5), avg(abs(y - yhat)) FILTER (fold >= 5) FROM scored)"""


@query("p14_percent_change", with_tables(_HALVES_SQL, """
SELECT metric, round((test - cv) / cv * 100, 6) AS percent_change, ((test - cv) / cv * 100 > 10)::INT AS flag FROM errors"""))
def p14_percent_change(spark, d):
    df = scored_orders(spark, d)
    side = F.when(F.col("fold") < 5, "cv").otherwise("test")
    long = df.select(side.alias("side"), F.pow(F.col("y") - F.col("yhat"), 2).alias("mse"),
                     F.abs(F.col("y") - F.col("yhat")).alias("mae")).unpivot(["side"], ["mse", "mae"], "metric", "v")
    wide = long.groupBy("metric").pivot("side", ["cv", "test"]).agg(F.avg("v"))
    return rounded(wide.select("metric", percent_change("test", "cv").alias("percent_change"))
                   .withColumn("flag", (F.col("percent_change") > 10).cast("int")))


@query("p16_predictor_sets", with_tables(ORDER_FACT_SQL, " UNION ALL ".join(
    f"SELECT '{s.name}' AS predictor_set, {len(s.columns)} AS predictors, "
    f"count(*) FILTER ({' AND '.join(c + ' IS NOT NULL' for c in s.columns)}) AS complete_rows FROM order_fact"
    for s in PREDICTOR_SETS)))
def p16_predictor_sets(spark, d):
    return complete_rows(order_fact(spark, d), PREDICTOR_SETS)


# --- splits and resampling -------------------------------------------------

@query("d1_holdout_split", f"""
SELECT o_orderkey, CASE WHEN {hash_sql('42', 'o_orderkey')} % 100 < 20 THEN 'test' ELSE 'train' END AS split FROM orders""")
def d1_holdout_split(spark, d):
    return with_split(table(spark, d, "orders").select(KEY), KEY)


@query("d2_hashed_folds", f"SELECT o_orderkey, ({hash_sql('fold:42', 'o_orderkey')} % 10)::INT AS fold FROM orders")
def d2_hashed_folds(spark, d):
    return with_folds(table(spark, d, "orders").select(KEY), KEY, 10)


@query("d3_contiguous_folds", """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, (CASE WHEN pos < (n % 7) * (n // 7 + 1) THEN pos // (n // 7 + 1)
       ELSE n % 7 + (pos - (n % 7) * (n // 7 + 1)) // (n // 7) END)::INT AS fold FROM r""")
def d3_contiguous_folds(spark, d):
    return with_contiguous_folds(table(spark, d, "orders").select(KEY), KEY, 7)


@query("d4_validation_slice", f"""
SELECT o_orderkey, ({hash_sql('valid:42', 'o_orderkey')} % 100 < 10)::INT AS kept_aside FROM orders""")
def d4_validation_slice(spark, d):
    return table(spark, d, "orders").select(KEY, validation_slice(KEY).cast("int").alias("kept_aside"))


@query("d5_undersample", f"""
WITH l AS (SELECT doc_id, toxic, {hash_sql('under:42', 'doc_id')} AS h FROM labels JOIN documents USING (doc_id)),
     m AS (SELECT min(c) AS smallest FROM (SELECT count(*) AS c FROM l GROUP BY toxic)),
     r AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY h, doc_id) AS rn FROM l)
SELECT doc_id, toxic FROM r, m WHERE rn <= smallest""")
def d5_undersample(spark, d):
    return undersample(doc_label(spark, d).select("doc_id", "toxic"), "doc_id", "toxic")


@query("d5_undersample_orders", with_tables(ORDER_FACT_SQL, f"""
, l AS (SELECT o_orderkey, hi, {hash_sql('under:42', 'o_orderkey')} AS h FROM order_fact),
     m AS (SELECT min(c) AS smallest FROM (SELECT count(*) AS c FROM l GROUP BY hi)),
     r AS (SELECT *, row_number() OVER (PARTITION BY hi ORDER BY h, o_orderkey) AS rn FROM l)
SELECT o_orderkey, hi FROM r, m WHERE rn <= smallest"""))
def d5_undersample_orders(spark, d):
    return undersample(order_fact(spark, d).select(KEY, "hi"), KEY, "hi")




_SMOTE_SQL = f"""
WITH l AS (SELECT doc_id::VARCHAR AS doc_id, toxic, n_chars::DOUBLE AS n_chars, (lang = 'en')::INT::DOUBLE AS is_en
           FROM labels JOIN documents USING (doc_id)),
c AS (SELECT toxic, count(*) AS n, max(count(*)) OVER () - count(*) AS need FROM l GROUP BY 1),
m AS (SELECT l.*, need, n, md5(n_chars || ',' || is_en) AS pid,
             row_number() OVER (PARTITION BY toxic ORDER BY {hash_sql('smote:42', 'doc_id')}, doc_id) AS place FROM l JOIN c USING (toxic) WHERE need > 0),
pts AS (SELECT toxic, pid, any_value(n_chars) AS n_chars, any_value(is_en) AS is_en, count(*) AS copies FROM m GROUP BY 1, 2),
near AS (SELECT a.toxic, a.pid, b.pid AS nn, b.copies AS weight, b.n_chars, b.is_en,
                row_number() OVER (PARTITION BY a.toxic, a.pid ORDER BY sqrt((a.n_chars - b.n_chars) ^ 2 + (a.is_en - b.is_en) ^ 2), b.pid) AS place
         FROM pts a JOIN pts b ON a.toxic = b.toxic AND a.pid <> b.pid),
slots AS (SELECT *, sum(weight) OVER (PARTITION BY toxic, pid ORDER BY place) AS upto FROM (
            SELECT toxic, pid, pid AS nn, copies - 1 AS weight, n_chars, is_en, 0 AS place FROM pts WHERE copies > 1 UNION ALL
            SELECT toxic, pid, nn, weight, n_chars, is_en, place FROM near WHERE place <= 5)),
tot AS (SELECT toxic, pid, least(5, sum(weight)) AS total FROM slots GROUP BY 1, 2),
asked AS (SELECT m.*, unnest(range(1, (need // n + (place <= need % n)::INT + 1)::BIGINT)) AS copy FROM m),
picked AS (SELECT asked.*, {hash_sql('smote-pick:42', "doc_id || ':' || copy")} % total AS pick,
                  {hash_sql('smote-step:42', "doc_id || ':' || copy")} / 4294967296.0 AS step FROM asked JOIN tot USING (toxic, pid))
SELECT doc_id, toxic, n_chars, is_en, NULL AS base, NULL AS neighbour, NULL::DOUBLE AS step FROM l UNION ALL
SELECT p.doc_id || '#' || copy, p.toxic, round(p.n_chars + step * (s.n_chars - p.n_chars), 6), round(p.is_en + step * (s.is_en - p.is_en), 6),
       p.pid, s.nn, round(step, 6) FROM picked p JOIN slots s ON s.toxic = p.toxic AND s.pid = p.pid AND s.upto - s.weight <= pick AND pick < s.upto"""


@query("d6_smote", _SMOTE_SQL)
def d6_smote(spark, d):
    """Toxic documents grown to the size of the others, in length and language columns."""
    docs = doc_label(spark, d).withColumn("is_en", (F.col("lang") == "en").cast("double"))
    return rounded(smote(docs, "doc_id", "toxic", ["n_chars", "is_en"]))


@query("d6_smote_class_sizes", """
WITH l AS (SELECT (label = 0)::INT AS is_zero FROM embeddings), c AS (SELECT is_zero, count(*) AS n FROM l GROUP BY 1)
SELECT is_zero, (SELECT max(n) FROM c)::BIGINT AS n, n AS original, (SELECT max(n) FROM c) - n AS synthetic FROM c""")
def d6_smote_class_sizes(spark, d):
    """64 inputs: sizes after growing."""
    grown = smote(emb_label(spark, d), "vec_id", "is_zero", [f"e{i}" for i in range(64)])
    made = F.col("step").isNotNull()
    return grown.groupBy("is_zero").agg(F.count("*").alias("n"), F.sum((~made).cast("long")).alias("original"),
                                        F.sum(made.cast("long")).alias("synthetic"))
