"""Table formats by their own readers: snapshots, change feeds, soft deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.model import CDC_OP, CDC_SEQ, CDC_TS, drop_prefix

# Change types of a change data feed, and what each one does.
CDF_OPERATIONS = {"insert": "insert", "update_postimage": "update", "delete": "delete"}
PREIMAGE = "update_preimage"
CDF_COLUMNS = ("_change_type", "_commit_version", "_commit_timestamp")

# Columns that the format adds to rows.
COMMIT_TIME = "_hoodie_commit_time"
IS_DELETED = "_hoodie_is_deleted"


def hudi_table(spark: SparkSession, path: str) -> DataFrame:
    """Current rows as the format's own reader gives them: archived and replacing commits included."""
    return live_rows(spark.read.format("hudi").load(path))


def delta_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    reader = spark.read.format("delta")
    return (reader if version is None else reader.option("versionAsOf", version)).load(path)


def current_version(spark: SparkSession, path: str) -> int:
    return spark.sql(f"DESCRIBE HISTORY delta.`{path}`").agg(F.max("version")).first()[0]


def delta_changes(spark: SparkSession, path: str, last_version: int | None, current: int) -> DataFrame | None:
    """Change feed after ``last_version``; None when there is no newer version."""
    if last_version is not None and last_version >= current:
        return None
    if last_version is None:
        return delta_snapshot(spark, path, current)
    return (
        spark.read.format("delta")
        .option("readChangeFeed", "true")
        .option("startingVersion", last_version + 1)
        .option("endingVersion", current)
        .load(path)
    )


def cdf_to_events(feed: DataFrame, seq: Column | None = None) -> DataFrame:
    """Change events of a change data feed: pre-images dropped, feed columns removed."""
    kinds = F.create_map(*[F.lit(x) for pair in CDF_OPERATIONS.items() for x in pair])
    events = (
        feed.filter(F.col("_change_type") != PREIMAGE)
        .withColumn(CDC_OP, F.element_at(kinds, F.col("_change_type")))
        .withColumn(CDC_TS, F.col("_commit_timestamp"))
        .withColumn(CDC_SEQ, seq if seq is not None else F.col("_commit_version"))
    )
    return drop_prefix(events, "_change_").drop("_commit_version", "_commit_timestamp")


def live_rows(rows: DataFrame) -> DataFrame:
    """Rows that are not soft-deleted."""
    if IS_DELETED not in rows.columns:
        return rows
    return rows.filter(~F.coalesce(F.col(IS_DELETED), F.lit(False)))
