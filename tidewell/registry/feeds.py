"""Checked queries: even splits, version feeds as jobs, handoff from snapshot to log, expiring deletes."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.model import CDC_OP, CDC_SEQ, CDC_TS
from tidewell.operators.merge import MergeRules
from tidewell.plans.config import run_configured
from tidewell.plans.state import StateStore
from tidewell.plans.tables import Target
from tidewell.registry.base import query
from tidewell.session import fresh_dir, read_table
from tidewell.sources.splits import split_bounds as even_bounds
from tidewell.sources.splits import split_predicates
from tidewell.streaming.handoff import as_snapshot
from tidewell.streaming.handoff import snapshot_handoff as handoff


def _tag() -> str:
    return uuid.uuid4().hex[:12]


@query("SELECT count(*) AS n_rows, true AS each_in_one_split, true AS even FROM lineitem")
def split_bounds(spark, sf):
    """Sixteen splits of the line items: every row is in exactly one, none has twice its share."""
    items = read_table(spark, sf, "lineitem").select("l_orderkey")
    conditions = split_predicates("l_orderkey", even_bounds(items, "l_orderkey", 16))
    hits = [F.expr(f"CASE WHEN {c} THEN 1 ELSE 0 END") for c in conditions]
    counts = items.select(reduce(lambda a, b: a + b, hits).alias("hits"), *(h.alias(f"s{i}") for i, h in enumerate(hits)))
    largest = F.greatest(*(F.sum(f"s{i}") for i in range(len(hits))))
    return counts.agg(
        F.count("*").alias("n_rows"),
        ((F.min("hits") == 1) & (F.max("hits") == 1)).alias("each_in_one_split"),
        (largest <= 2 * F.count("*") / F.lit(len(hits))).alias("even"),
    )


@query(
    """WITH last AS (
      SELECT user_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n
      FROM events WHERE event_type <> 'view')
    SELECT user_id, value, event_type FROM last WHERE n = 1 AND event_type <> 'error'"""
)
def job_version_feed(spark, sf):
    """A job over a change feed: a first run, one that finds the rest, and one that finds nothing new."""
    root, tag, name = fresh_dir(spark, "feed"), _tag(), f"feed_{_tag()}"
    kind = F.col("event_type")
    change = F.when(kind == "error", "delete").when(kind == "view", "update_preimage").otherwise("update_postimage")
    feed = read_table(spark, sf, "events").select(
        "user_id", "value", "event_type", change.alias("_change_type"), F.col("event_id").alias("_commit_version"), F.timestamp_seconds("event_id").alias("_commit_timestamp")
    )
    table = {"path": f"{root}/feed", "primary_key": ["user_id"], "change_feed": True}
    job = {"id": name, "source_type": "format", "connection": {"format": "parquet"}, "tables": ["feed"], "tables_config": {"feed": table}, "target_table": name}
    state = StateStore(spark, root, f"state_{tag}")
    first = F.col("_commit_version") % 2 == 0
    middle = feed.agg(F.expr("CAST(max(_commit_version) / 2 AS BIGINT)")).first()[0]
    for part in (feed.filter(F.col("_commit_version") <= middle), feed.filter(F.col("_commit_version") > middle), None):
        if part is not None:
            # In two files each, whose versions interleave.
            for half in (first, ~first):
                part.filter(half).write.mode("append").parquet(f"{root}/feed")
        ((result,),) = run_configured(spark, {"jobs": [job]}, root, state).values()
        if result.error or (part is None and result.rows):
            raise RuntimeError(result.error or "a version was read twice")
    return Target(spark, name, root).read().select("user_id", "value", "event_type")


@query(
    """SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS o_totalprice
    FROM orders WHERE o_orderkey % 20 <> 0"""
)
def snapshot_handoff(spark, sf):
    """Orders read in four ranges while a fourth of them change and some go; the ranges are read last one first."""
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    position = F.lpad(F.hex((F.col("o_orderkey") * 37) % 1000), 8, "0")
    changed, gone = F.col("o_orderkey") % 4 == 0, F.col("o_orderkey") % 20 == 0
    log = orders.filter(changed).select(
        "o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.when(gone, "delete").otherwise("update").alias(CDC_OP), position.alias("lsn")
    )
    at = lambda n: F.lpad(F.hex(F.lit(n)), 8, "0")
    ranges: list[DataFrame] = []
    for i, low in enumerate((750, 500, 250, 0)):
        # A range shows what had happened when it was read, some way after its position.
        happened = changed & (position <= at(low + 120))
        rows = orders.filter(F.col("o_orderkey") % 7 % 4 == i).filter(~(happened & gone))
        shown = F.when(happened, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
        ranges.append(as_snapshot(rows.withColumn("o_totalprice", shown), at(low), "lsn"))
    events = handoff(reduce(DataFrame.unionByName, ranges), log, ["o_orderkey"], "lsn")
    return events.filter(F.col(CDC_OP) != "delete").select("o_orderkey", "o_totalprice")


@query(
    """WITH late AS (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN 'moved' ELSE c_mktsegment END AS c_mktsegment, 0 AS tombstones
    FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM late)"""
)
def merge_tombstone_expiry(spark, sf):
    """Deletes guard against late rows for an hour of event time, then go; later late rows are refused."""
    target = Target(spark, f"expiring_{_tag()}", fresh_dir(spark, "expiring"), ("c_custkey",), hash_partitions=4)
    rules = MergeRules(("c_custkey",), guard_late=True, keep_tombstones=True, retention_s=3600)
    customers = read_table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    minute = lambda n: (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=F.lit(n)))

    def put(rows, op, at, segment=None):
        rows = rows if segment is None else rows.withColumn("c_mktsegment", F.lit(segment))
        target.merge(rows.withColumns({CDC_OP: F.lit(op), CDC_TS: minute(at), CDC_SEQ: F.lit(at)}), rules)

    third = lambda n: customers.filter(F.col("c_custkey") % 3 == n)
    put(customers, "insert", 0)
    put(third(0), "delete", 10)
    # Late by event time: the tombstones stand against it.
    put(third(0), "insert", 5, "late")
    put(third(1), "update", 90, "moved")
    # The watermark is at minute 30 by now: tombstones of minute 10 go with the next rewrite, late rows stay out.
    put(third(0), "insert", 20, "too late")
    rows = target.read()
    left = rows.filter(F.col(CDC_OP) == "delete").count()
    return rows.filter(F.col(CDC_OP) != "delete").select("c_custkey", "c_mktsegment", F.lit(left).alias("tombstones"))
