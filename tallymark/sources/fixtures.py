"""Modelling tables derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallymark.functions.columns import above, hash32, log_target
from tallymark.operators.splits import holdout_side
from tallymark.session import stage
from tallymark.sources.tables import table

KEY, COUNT, BINARY, LOG = "o_orderkey", "n_lines", "hi", "log_lines"
NUMERIC = ["o_totalprice", "c_acctbal", "o_year"]
CATEGORICAL = ["o_orderpriority", "o_orderstatus", "c_mktsegment", "r_name", "n_name", "o_month"]


def order_fact(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order: line count and its variants, order and customer attributes.

    Line items are aggregated before the join, so both sides hold one row per order.
    No join is hinted: Catalyst broadcasts by file size, and a customer with very many
    orders is split by the adaptive skew join.
    """
    per_order = (
        table(spark, folder, "lineitem").groupBy("l_orderkey")
        .agg(F.count("*").cast("int").alias("lines"), F.avg("l_quantity").alias("avg_qty"),
             F.avg("l_discount").alias("avg_disc"))
    )
    places = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    lines = F.coalesce("lines", F.lit(0))
    return (
        orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            "o_orderkey", lines.alias(COUNT), above(lines, 4).alias(BINARY), log_target(lines).alias(LOG),
            "o_orderpriority", "o_orderstatus", "c_mktsegment", "r_name", "n_name",
            F.date_format("o_orderdate", "MM").alias("o_month"), F.year("o_orderdate").alias("o_year"),
            "o_totalprice", "c_acctbal", "avg_qty", "avg_disc",
        )
    )


ORDER_FACT_SQL = """
order_fact AS (
  SELECT o_orderkey, coalesce(lines, 0)::INT AS n_lines, (coalesce(lines, 0) > 4)::INT AS hi,
         ln(1 + coalesce(lines, 0)) AS log_lines,
         o_orderpriority, o_orderstatus, c_mktsegment, r_name, n_name,
         strftime(o_orderdate, '%m') AS o_month, year(o_orderdate)::INT AS o_year,
         o_totalprice, c_acctbal, avg_qty, avg_disc
  FROM orders
  LEFT JOIN (SELECT l_orderkey, count(*) AS lines, avg(l_quantity) AS avg_qty, avg(l_discount) AS avg_disc
             FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
)"""


def line_value(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line item: price against quantity, discount and tax."""
    return table(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line_key"),
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice",
        log_target("l_extendedprice").alias("log_price"), "l_returnflag", "l_linestatus",
    )


def event_value(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id", "event_type", F.date_format("ts", "HH").alias("hour"), "value"
    )


def doc_label(spark: SparkSession, folder: str) -> DataFrame:
    """One row per labelled document; both labels are imbalanced."""
    return table(spark, folder, "labels").join(
        table(spark, folder, "documents").select("doc_id", "n_chars", "lang", "source"), "doc_id"
    )


def emb_label(spark: SparkSession, folder: str) -> DataFrame:
    """One row per vector: all its entries as numeric columns and ``label = 0`` as the binary target."""
    vectors = table(spark, folder, "embeddings")
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    return vectors.select(
        "vec_id", (F.col("label") == 0).cast("int").alias("is_zero"),
        *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(width)],
    )


def scored_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Test-side orders with predictions of two closed-form models fitted on the train side.

    ``yhat``: mean line count of the order's priority and month (a one-hot regression);
    ``p``: a logistic curve over the standardised order price (many distinct scores).
    """
    sides = order_fact(spark, folder).withColumn("split", holdout_side(KEY))
    train = sides.where("split = 'train'")
    # Staged, so that its size is known: 60 rows are broadcast and the orders are not shuffled by month.
    means = stage(train.groupBy("o_orderpriority", "o_month").agg(
        F.avg(COUNT).alias("yhat"), F.avg(LOG).alias("yhat_log")))
    price = train.agg(F.struct(F.avg("o_totalprice").alias("m"), F.stddev_pop("o_totalprice").alias("s"))).scalar()
    noisy = (F.col("o_totalprice") - price["m"]) / price["s"] + (F.col(COUNT) - 4) / 4.0
    p = 1 / (1 + F.exp(-noisy * (0.5 + (hash32("mix", KEY) % 1000) / 2000.0)))
    return (
        sides.where("split = 'test'").join(means, ["o_orderpriority", "o_month"])
        .select(KEY, F.col(COUNT).cast("double").alias("y"), F.col(LOG).alias("y_log"), BINARY,
                "o_orderpriority", "o_month", "yhat", "yhat_log", p.alias("p"),
                (hash32("fold:42", KEY) % 10).cast("int").alias("fold"))
    )


HASH32 = "('0x' || substr(md5('{salt}:' || {key}), 1, 8))::UBIGINT::BIGINT"


def hash_sql(salt: str, key: str) -> str:
    return HASH32.format(salt=salt, key=key)


SIDES_SQL = ORDER_FACT_SQL + f""",
sides AS (
  SELECT *, CASE WHEN {hash_sql('42', 'o_orderkey')} % 100 < 20 THEN 'test' ELSE 'train' END AS split,
         ({hash_sql('fold:42', 'o_orderkey')} % 10)::INT AS fold
  FROM order_fact
)"""

SCORED_SQL = SIDES_SQL + f""",
group_means AS (
  SELECT o_orderpriority, o_month, avg(n_lines) AS yhat, avg(log_lines) AS yhat_log
  FROM sides WHERE split = 'train' GROUP BY ALL
),
price AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM sides WHERE split = 'train'),
scored AS (
  SELECT o_orderkey, n_lines::DOUBLE AS y, log_lines AS y_log, hi, o_orderpriority, o_month, yhat, yhat_log,
         1 / (1 + exp(-((o_totalprice - m) / s + (n_lines - 4) / 4.0)
                      * (0.5 + ({hash_sql('mix', 'o_orderkey')} % 1000) / 2000.0))) AS p, fold
  FROM sides JOIN group_means USING (o_orderpriority, o_month) CROSS JOIN price WHERE split = 'test'
)"""
