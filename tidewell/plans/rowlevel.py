"""Row-level changes for catalogs that support them.

Where a table format can merge in place, only the files that hold changed rows are rewritten,
so this is the way to merge into very large targets. Plain Parquet tables cannot, and are
merged by ``Target``.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.model import CDC_OP, CDC_SEQ, CDC_TS
from tidewell.operators.merge import MergeRules, latest_changes

# Providers whose tables take MERGE, UPDATE and DELETE.
ROW_LEVEL_PROVIDERS = ("iceberg", "delta", "hudi")


def supports_row_level(spark: SparkSession, table: str) -> bool:
    """Whether the table exists and its provider merges in place."""
    if not spark.catalog.tableExists(table):
        return False
    row = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter(F.col("col_name") == "Provider").first()
    return row is not None and row["data_type"].lower() in ROW_LEVEL_PROVIDERS


def merge_into(changes: DataFrame, table: str, rules: MergeRules) -> None:
    """``MERGE INTO`` with the rules of ``apply_changes``."""
    target = changes.sparkSession.table(table)
    latest = latest_changes(changes, rules).alias("s")
    old = lambda c: F.col(f"{table}.{c}")
    new = lambda c: F.col(f"s.{c}")
    order = [c for c in (CDC_TS, CDC_SEQ) if c in target.columns and c in changes.columns]
    newer: Column = F.lit(True)
    if rules.guard_late and order:
        newer = F.struct(*[new(c) for c in order]) >= F.struct(*[old(c) for c in order])
    deleted = new(CDC_OP) == "delete"
    shared = [c for c in target.columns if c in changes.columns and c != rules.unchanged]

    def value(name: str) -> Column:
        if not rules.unchanged or name in rules.keys:
            return new(name)
        kept = F.coalesce(F.array_contains(new(rules.unchanged), name), F.lit(False))
        return F.when(kept, old(name)).otherwise(new(name))

    merge = latest.mergeInto(table, reduce(and_, [old(k) == new(k) for k in rules.keys]))
    if not rules.keep_tombstones:
        merge = merge.whenMatched(newer & deleted).delete()
    merge = merge.whenMatched(newer).update({c: value(c) for c in shared})
    arrives = F.lit(True) if rules.keep_tombstones else ~deleted
    merge.whenNotMatched(arrives).insert({c: new(c) for c in shared}).merge()
