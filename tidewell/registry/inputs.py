"""Inputs derived from the given tables, each beside the SQL that derives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.model import CDC_OP, CDC_SEQ, CDC_TS
from tidewell.session import read_table

SPLIT_DATE = "1998-01-01"
OVERLAP_DATE = "1997-07-01"


def op_of_event() -> Column:
    kind = F.col("event_type")
    return F.when(kind == "error", "delete").when(kind == "signup", "insert").otherwise("update")


SQL_OP = "CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'insert' ELSE 'update' END"


def customer_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a change of the customer whose key is its user."""
    return read_table(spark, sf, "events").select(
        F.col("user_id").alias("c_custkey"),
        F.col("event_type").alias("c_mktsegment"),
        F.col("value").alias("c_acctbal"),
        op_of_event().alias(CDC_OP),
        F.col("ts").alias(CDC_TS),
        F.col("event_id").alias(CDC_SEQ),
    )


SQL_CHANGES = f"""
changes AS (
  SELECT user_id AS c_custkey, event_type AS c_mktsegment, value AS c_acctbal,
         {SQL_OP} AS _cdc_op, ts AS _cdc_ts, event_id AS _cdc_seq
  FROM events),
latest AS (
  SELECT * FROM changes
  QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY _cdc_ts DESC, _cdc_seq DESC) = 1)
"""


def customer_target(spark: SparkSession, sf: str) -> DataFrame:
    """Customers in good standing: the others are new to the target when they change."""
    return read_table(spark, sf, "customer").filter(F.col("c_acctbal") >= 0).select(
        "c_custkey", "c_mktsegment", "c_acctbal"
    )


SQL_TARGET = """
target AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_acctbal >= 0)
"""


def order_target(spark: SparkSession, sf: str) -> DataFrame:
    orders = read_table(spark, sf, "orders")
    return orders.filter(F.col("o_orderdate") < F.lit(SPLIT_DATE).cast("timestamp_ntz"))


def order_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Later orders and the last half year of the target again, repriced."""
    orders = read_table(spark, sf, "orders")
    later = orders.filter(F.col("o_orderdate") >= F.lit(OVERLAP_DATE).cast("timestamp_ntz"))
    return later.withColumn("o_totalprice", F.col("o_totalprice") * 1.1)


SQL_ORDERS = f"""
target AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '{SPLIT_DATE}'),
batch AS (
  SELECT * REPLACE (o_totalprice * CAST(1.1 AS DOUBLE) AS o_totalprice)
  FROM orders WHERE o_orderdate >= TIMESTAMP '{OVERLAP_DATE}')
"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as one load run: five pipelines write, one job per twelve users."""
    kind, value = F.col("event_type"), F.col("value")
    return read_table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        (F.col("user_id") % 12).alias("job_id"),
        F.concat(F.lit("table_"), (F.col("user_id") % 5).cast("string")).alias("table_name"),
        F.when(kind == "error", "error").otherwise("success").alias("status"),
        F.floor(value).cast("bigint").alias("rows"),
        F.when(kind == "error", F.concat(F.lit("failed at "), F.col("event_id").cast("string"))).alias("error"),
        F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("started_at"),
        F.when(kind == "view", 0.0).otherwise(F.floor(value) / 4).alias("duration_s"),
    )


SQL_RUNS = """
runs AS (
  SELECT event_id AS id, user_id % 12 AS job_id, 'table_' || (user_id % 5) AS table_name,
         CASE event_type WHEN 'error' THEN 'error' ELSE 'success' END AS status,
         CAST(floor(value) AS BIGINT) AS rows,
         CASE WHEN event_type = 'error' THEN 'failed at ' || event_id END AS error,
         CAST(date_trunc('hour', ts) AS TIMESTAMP) AS started_at,
         CASE event_type WHEN 'view' THEN 0.0 ELSE floor(value) / 4 END AS duration_s
  FROM events)
"""


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs named after nations; those past the twelfth have never run."""
    return read_table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name")
    )


SQL_JOBS = "jobs AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation)"


def people(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data made from customers, with absent and malformed values among it."""
    key = F.col("c_custkey")
    digits = lambda n: F.lpad(key.cast("string"), n, "0")
    kind = key % 11
    octet = lambda n: (F.floor(key / n) % 256).cast("string")
    customer = read_table(spark, sf, "customer")
    return customer.select(
        key.alias("id"),
        F.when(kind == 0, None)
        .when(kind == 1, "")
        .when(kind == 2, F.concat(F.lit("nobody"), key.cast("string")))
        .when(kind == 3, F.concat(F.lit("@"), F.col("c_mktsegment")))
        .when(kind == 4, F.concat(F.lit("a@b"), key.cast("string"), F.lit("@c.org")))
        .otherwise(F.concat(F.lower("c_name"), F.lit("@ex"), F.col("c_nationkey").cast("string"), F.lit(".com")))
        .alias("email"),
        F.when(kind == 0, None)
        .when(kind == 1, "12-3")
        .otherwise(F.concat(F.lit("+1 ("), F.substring(digits(10), 1, 3), F.lit(") "),
                            F.substring(digits(10), 4, 3), F.lit("-"), F.substring(digits(10), 7, 4)))
        .alias("phone"),
        F.when(kind == 2, None).when(kind == 3, "n/a").otherwise(digits(9)).alias("ssn"),
        F.when(kind == 4, None).when(kind == 5, "****").otherwise(F.concat(F.lit("4000 "), digits(12))).alias("card"),
        F.when(kind == 6, None)
        .when(kind == 7, "10.0.1")
        .when(kind == 8, "1.2.3.4.")
        .otherwise(F.concat_ws(".", F.lit("10"), octet(65536), octet(256), octet(1)))
        .alias("ip"),
        F.when(kind == 9, None)
        .when(kind == 10, "   ")
        .when(kind == 8, F.concat(F.lit("  "), F.lower("c_name"), F.lit("\t")))
        .otherwise(F.lower("c_name"))
        .alias("name"),
        F.col("c_acctbal").alias("balance"),
    )


SQL_PEOPLE = """
people AS (
  SELECT c_custkey AS id,
    CASE c_custkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'nobody' || c_custkey
      WHEN 3 THEN '@' || c_mktsegment WHEN 4 THEN 'a@b' || c_custkey || '@c.org'
      ELSE lower(c_name) || '@ex' || c_nationkey || '.com' END AS email,
    CASE c_custkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '12-3'
      ELSE '+1 (' || substr(d10, 1, 3) || ') ' || substr(d10, 4, 3) || '-' || substr(d10, 7, 4) END AS phone,
    CASE c_custkey % 11 WHEN 2 THEN NULL WHEN 3 THEN 'n/a'
      ELSE lpad(CAST(c_custkey AS VARCHAR), 9, '0') END AS ssn,
    CASE c_custkey % 11 WHEN 4 THEN NULL WHEN 5 THEN '****'
      ELSE '4000 ' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') END AS card,
    CASE c_custkey % 11 WHEN 6 THEN NULL WHEN 7 THEN '10.0.1' WHEN 8 THEN '1.2.3.4.'
      ELSE '10.' || ((c_custkey // 65536) % 256) || '.' || ((c_custkey // 256) % 256) || '.'
           || (c_custkey % 256) END AS ip,
    CASE c_custkey % 11 WHEN 9 THEN NULL WHEN 10 THEN '   ' WHEN 8 THEN '  ' || lower(c_name) || chr(9)
      ELSE lower(c_name) END AS name,
    c_acctbal AS balance
  FROM (SELECT *, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS d10 FROM customer))
"""
