"""Ranks over all rows of a table, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.components import stored


def ranked(df: DataFrame, group: str, order: list[Column], label: str) -> DataFrame:
    """The rows with ``rank``, from 0 within their group in the given order, and ``group_n``, the group's rows.

    ``group`` has no nulls. Rows are dealt out by ranges of (group, order), so a group of any size is
    spread over tasks; what goes through a window is one row for each group and range. Rows that the order
    holds equal get ranks next to each other. The rows are written once below the shared folder.
    """
    placed = df.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    placed = stored(placed.withColumn("__at", F.monotonically_increasing_id()), label)
    part = F.shiftright("__at", 33)
    runs = placed.groupBy(F.col(group).alias("__group"), part.alias("__part")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    own = Window.partitionBy("__group")
    before = F.coalesce(F.sum("__n").over(own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("__group", "__part", "__first", before.alias("__before"), F.sum("__n").over(own).alias("group_n"))
    found = placed.join(runs, (placed[group] == runs["__group"]) & (part == runs["__part"]))
    rank = (F.col("__at") - F.col("__first") + F.col("__before")).alias("rank")
    return found.select(*df.columns, rank, "group_n")
