"""State tables: watermarks, schemas, loaded files, runs.

They are small keyed tables. A watermark is stored as JSON text with its cursor type, and
only after the rows it stands for are committed.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators.merge import merge_upsert
from tidewell.plans.tables import Target

WATERMARKS = "source_name string, source_table string, offset string, cursor_type string, updated_at timestamp"
SCHEMAS = "source_name string, source_table string, schema_json string, updated_at timestamp"
LEDGER = "path string, file_url string, target_table string, modification_time timestamp, loaded_at timestamp"
COPIED = "batch string, target_table string, rows bigint, loaded_at timestamp"
RUNS = (
    "id string, job_id string, table_name string, status string, rows bigint, error string, "
    "started_at timestamp, finished_at timestamp, duration_s double"
)
JOBS = (
    "id string, name string, config_json string, enabled boolean, created_at timestamp, updated_at timestamp"
)


def state_upsert(state: DataFrame, changes: DataFrame, keys: Sequence[str], created: str | None = None) -> DataFrame:
    """Insert or replace by key. A replaced row keeps the ``created`` stamp it had."""
    if created:
        old = state.select(*keys, F.col(created).alias("__created"))
        changes = changes.join(old, list(keys), "left").withColumn(
            created, F.coalesce("__created", created)
        ).drop("__created")
    return merge_upsert(state, changes.select(*state.columns), keys)


def reset_watermark(watermarks: DataFrame, source: str, table: str | None = None) -> DataFrame:
    """Watermarks without those of a source, or of one of its tables."""
    hit = F.col("source_name") == source
    if table is not None:
        hit = hit & (F.col("source_table") == table)
    return watermarks.filter(~hit)


def encode_offset(value: Any) -> str:
    if isinstance(value, (datetime, date)):
        value = value.isoformat()
    elif isinstance(value, Decimal):
        value = str(value)
    return json.dumps(value)


# Tables loaded at the same time write their state one after the other.
_WRITING = threading.RLock()


@dataclass(frozen=True)
class StateStore:
    """State tables of one installation, under one name prefix and folder.

    One driver at a time may write under a prefix.
    """

    spark: SparkSession
    root: str
    prefix: str = "tidewell"

    def table(self, name: str, ddl: str, batches: bool = False) -> Target:
        target = Target(self.spark, f"{self.prefix}_{name}", self.root)
        with _WRITING:
            target.ensure(T._parse_datatype_string(ddl), meta=False, batches=batches)
        return target

    def watermarks(self) -> DataFrame:
        return self.table("watermarks", WATERMARKS).read()

    def get_offset(self, source: str, table: str) -> Any:
        row = (
            self.watermarks()
            .filter((F.col("source_name") == source) & (F.col("source_table") == table))
            .select("offset")
            .first()
        )
        return json.loads(row["offset"]) if row else None

    def load_id(self, source: str, table: str) -> str:
        """Id of the load that comes next: the same until a watermark is set, so also after a load that died."""
        hit = (F.col("source_name") == source) & (F.col("source_table") == table)
        row = self.watermarks().filter(hit).select(F.unix_micros("updated_at").alias("us")).first()
        return uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([source, table, row and row["us"]])).hex

    def _upsert(self, name: str, ddl: str, row: tuple, keys: Sequence[str]) -> None:
        target = self.table(name, ddl)
        change = self.spark.createDataFrame([row], ddl.replace(", updated_at timestamp", ""))
        change = change.withColumn("updated_at", F.current_timestamp())
        with _WRITING:
            target.replace(state_upsert(target.read(), change, keys).coalesce(1))

    def set_offset(self, source: str, table: str, value: Any, cursor_type: str) -> None:
        row = (source, table, encode_offset(value), cursor_type)
        self._upsert("watermarks", WATERMARKS, row, ("source_name", "source_table"))

    def reset_offset(self, source: str, table: str | None = None) -> None:
        target = self.table("watermarks", WATERMARKS)
        with _WRITING:
            target.replace(reset_watermark(target.read(), source, table).coalesce(1))

    def get_schema(self, source: str, table: str) -> T.StructType | None:
        row = (
            self.table("schemas", SCHEMAS).read()
            .filter((F.col("source_name") == source) & (F.col("source_table") == table))
            .select("schema_json")
            .first()
        )
        return T.StructType.fromJson(json.loads(row["schema_json"])) if row else None

    def set_schema(self, source: str, table: str, schema: T.StructType) -> None:
        self._upsert("schemas", SCHEMAS, (source, table, schema.json()), ("source_name", "source_table"))

    def note_schema(self, source: str, table: str, schema: T.StructType) -> bool:
        """Remember the schema a table was last read with; true when it is not the one before."""
        changed = self.get_schema(source, table) != schema
        if changed:
            self.set_schema(source, table, schema)
        return changed

    def put_job(self, job_id: str, name: str, config: dict, enabled: bool = True) -> None:
        """Insert or replace a job; the time it was created stays."""
        target = self.table("jobs", JOBS)
        row = (job_id, name, json.dumps(config), enabled)
        change = self.spark.createDataFrame([row], "id string, name string, config_json string, enabled boolean")
        now = F.current_timestamp()
        change = change.withColumns({"created_at": now, "updated_at": now})
        with _WRITING:
            target.replace(state_upsert(target.read(), change, ["id"], created="created_at").coalesce(1))

    def jobs(self) -> DataFrame:
        return self.table("jobs", JOBS).read()

    def ledger(self) -> Target:
        """Files by the copy that takes them, noted before their rows are loaded."""
        return self.table("ledger", LEDGER, batches=True)

    def copied(self) -> Target:
        """Copies that are done."""
        return self.table("copied", COPIED, batches=True)

    def runs(self) -> DataFrame:
        return self.table("runs", RUNS).read()

    def add_run(self, row: tuple) -> None:
        target = self.table("runs", RUNS)
        with _WRITING:
            target.append(self.spark.createDataFrame([row], RUNS).coalesce(1))
