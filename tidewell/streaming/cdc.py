"""Change streams: native change codes, resume positions, routing, apply."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.model import CDC_OP, map_expr
from tidewell.operators.merge import MergeRules
from tidewell.plans.tables import Target

# Change codes of each engine. A code without an operation is no event: 3 is the
# before-image of an update, whose after-image follows as 4.
OP_CODES: dict[str, dict[str, str]] = {
    "sqlserver": {"1": "delete", "2": "insert", "4": "update"},
    "mongodb": {"insert": "insert", "update": "update", "replace": "update", "delete": "delete"},
    "mysql": {"write": "insert", "update": "update", "delete": "delete"},
    "postgres": {"I": "insert", "U": "update", "D": "delete"},
}
SNAPSHOT_POSITION = "snap:"


def normalize_ops(changes: DataFrame, engine: str, code: str) -> DataFrame:
    """Add ``_cdc_op`` for an engine's own change code; codes that are no event are dropped."""
    op = F.try_element_at(map_expr(OP_CODES[engine]), F.col(code).cast("string"))
    return changes.withColumn(CDC_OP, op).filter(F.col(CDC_OP).isNotNull())


def route_images(changes: DataFrame, row: str, op: str = CDC_OP) -> DataFrame:
    """Put a log row where its operation has it: before for a delete, after otherwise."""
    deleted = F.col(op) == "delete"
    return changes.withColumns(
        {"before": F.when(deleted, F.col(row)), "after": F.when(~deleted, F.col(row))}
    )


def lsn_range(changes: DataFrame, lsn: str, lo: str | None, hi: str | None = None) -> DataFrame:
    """Changes with ``lo < lsn <= hi``. Positions are fixed-width hex, so text order is log
    order; a snapshot position or none means from the start."""
    if lo is not None and not lo.startswith(SNAPSHOT_POSITION):
        changes = changes.filter(F.col(lsn) > lo)
    return changes if hi is None else changes.filter(F.col(lsn) <= hi)


def matches_table(source_table: Column, configured: str, tables: Sequence[str]) -> Column:
    """A change belongs to the table of its full name. Where no table has that name, it
    belongs to those that differ from it only by a leading schema."""
    suffix = source_table.endswith(f".{configured}") | F.endswith(
        F.lit(configured), F.concat(F.lit("."), source_table)
    )
    return (source_table == configured) | (~source_table.isin(*tables) & suffix)


def split_by_table(changes: DataFrame, tables: Sequence[str], source_table: str = "source_table") -> dict[str, DataFrame]:
    """One frame per configured table. The list comes from the job, never from the data."""
    return {t: changes.filter(matches_table(F.col(source_table), t, tables)) for t in tables}


def only_tables(changes: DataFrame, tables: Sequence[str], source_table: str = "source_table") -> DataFrame:
    """Changes of any configured table, read once for all of them."""
    return changes.filter(reduce(or_, [matches_table(F.col(source_table), t, tables) for t in tables]))


def route_append(batch: DataFrame, targets: Mapping[str, Target], batch_id: str, source_table: str = "source_table") -> None:
    """Append the rows of a batch to the logs of their tables, in one pass over the batch.

    Rows are written once, partitioned by table, and each table takes its part as a partition. A table whose stored
    types differ, or which has a layout of its own, is appended to by itself from the rows written.
    """
    names = list(targets)
    spark, root = targets[names[0]].spark, targets[names[0]].root.rstrip("/")
    belongs = [F.when(matches_table(F.col(source_table), t, names), F.lit(i)) for i, t in enumerate(names)]
    folder = f"{root}/routed/{uuid.uuid4().hex}"
    routed = batch.select("*", F.explode(F.array_compact(F.array(*belongs))).alias("__table"))
    routed.write.partitionBy("__table").parquet(folder)
    for i, name in enumerate(names):
        own = f"{folder}/__table={i}"
        if not targets[name].adopt(own, batch.schema, batch_id):
            rows = spark.read.schema(routed.schema).parquet(folder)
            targets[name].append(rows.where(F.col("__table") == i).drop("__table"), batch_id)


def apply_stream(
    changes: DataFrame,
    targets: Mapping[str, Target],
    rules: Mapping[str, MergeRules] | MergeRules,
    checkpoint: str,
    mode: str = "merge",
    name: str = "cdc",
    source_table: str | None = None,
    trigger: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Write a change stream to its tables, batch by batch.

    ``merge`` keeps the tables current; a replayed batch changes nothing, because rows are
    applied by key and event order. ``append`` keeps the log; each batch is a partition by the stream's
    ``name`` and the batch's number, so a replay takes its own place again.
    """

    if not source_table and len(targets) > 1:
        raise ValueError("several targets need source_table, which says where a row belongs")

    def merge(batch: DataFrame) -> None:
        if not source_table:
            for table, target in targets.items():
                target.merge(batch, rules if isinstance(rules, MergeRules) else rules[table])
            return
        # Kept while its tables are written one after the other.
        kept = only_tables(batch, list(targets), source_table).persist()
        try:
            for table, rows in split_by_table(kept, list(targets), source_table).items():
                targets[table].merge(rows, rules if isinstance(rules, MergeRules) else rules[table])
        finally:
            kept.unpersist()

    def write(batch: DataFrame, batch_id: int) -> None:
        if mode == "merge":
            merge(batch)
        elif source_table:
            route_append(batch, targets, f"{name}-{batch_id}", source_table)
        else:
            for target in targets.values():
                target.append(batch, f"{name}-{batch_id}")

    return (
        changes.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
