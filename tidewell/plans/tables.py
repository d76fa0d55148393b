"""Targets: catalog tables that are replaced, appended to and merged.

A table is an external Parquet table. A rewrite goes to a folder of its own and becomes
current by ``ALTER TABLE ... SET LOCATION``, so readers see the old rows or the new ones and
a lost executor costs only its tasks. The catalog knows the partitions of a partitioned table
one by one: a merge or a replacement gives each partition it rewrote its new location, so readers see
every partition before or after, and a rewrite that died in between is repeated. A keyed target may be
bucketed by its key: then a merge shuffles the changes but not the target.

Two partition columns are hidden from readers. ``hash_partitions`` deals a keyed target out by the hash of its
key, so that a merge rewrites the parts its changes fall into, with no column of the user's to partition by. And
an append with a batch id is a partition of its own: it becomes visible by one change of the catalog, and
the same batch appended again takes the place of its first copy.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime
from functools import reduce
from operator import and_, or_
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.model import CDC_TS, primary_keys
from tidewell.operators.merge import MergeRules, apply_latest, latest_changes, split_null_keys, without_expired, without_late
from tidewell.operators.schema import added_columns, conform, with_meta_schema
from tidewell.plans.rowlevel import merge_into, supports_row_level


# Hidden partition columns: the hash part of the key, and the batch that appended the row.
PART = "_key_part"
BATCH = "_batch"
WATERMARK = "tidewell.watermark"
BATCH_ID = re.compile(r"[A-Za-z0-9_.-]+")


@dataclass(frozen=True)
class Target:
    """One table of the lakehouse: its name, its folder and its layout."""

    spark: SparkSession
    name: str
    root: str
    keys: tuple[str, ...] = ()
    buckets: int = 0
    partition_by: tuple[str, ...] = ()
    sort_by: tuple[str, ...] = ()
    hash_partitions: int = 0

    def __post_init__(self) -> None:
        if bool(self.buckets) + bool(self.partition_by) + bool(self.hash_partitions) > 1:
            raise ValueError(f"{self.name}: a target is either bucketed or partitioned, by columns or by the hash of its key")

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def read(self) -> DataFrame:
        return self.stored().drop(PART, BATCH)

    def stored(self) -> DataFrame:
        """The table with its hidden columns."""
        return self.spark.table(self.name)

    def keyed(self, keys: Sequence[str] = ()) -> Target:
        """This target with the given key, if it has none of its own."""
        return self if self.keys or not keys else replace(self, keys=tuple(keys))

    def _parts(self) -> list[str]:
        return [*self.partition_by, *([PART] if self.hash_partitions and self.keys else [])]

    def _dealt(self, df: DataFrame) -> DataFrame:
        """Rows with the hash part of their key, which is of the stored type by then."""
        if PART not in self._parts():
            return df
        return df.withColumn(PART, F.pmod(F.xxhash64(*self.keys), F.lit(self.hash_partitions)).cast("int"))

    def _new_folder(self) -> str:
        return f"{self.root.rstrip('/')}/{self.name.replace('.', '/')}/v-{uuid.uuid4().hex}"

    def _writer(self, df: DataFrame) -> DataFrameWriter:
        parts = [*self._parts(), *([BATCH] if BATCH in df.columns else [])]
        writer = self._ordered(df, parts).write.format("parquet")
        if parts:
            writer = writer.partitionBy(*parts)
        if self.buckets and self.keys:
            writer = writer.bucketBy(self.buckets, *self.keys).sortBy(*self.keys)
        return writer

    def _ordered(self, df: DataFrame, parts: Sequence[str]) -> DataFrame:
        """Sorted rows, or rows in partitions of even size: neither leaves a large one to one task."""
        if self.sort_by:
            return clustered(df, [*parts, *self.sort_by] if PART in parts or BATCH in parts else self.sort_by)
        return df.hint("rebalance", *parts) if PART in parts else df

    def _laid_out(self, df: DataFrame) -> DataFrame:
        """One task per bucket, so that every bucket is one file."""
        return df.repartition(self.buckets, *self.keys) if self.buckets and self.keys else df

    def ensure(self, schema: T.StructType, meta: bool = True, batches: bool = False) -> None:
        """Create the table, with the metadata columns, if it is not there; ``batches`` makes each append a partition."""
        if self.exists():
            return
        full = with_meta_schema(schema) if meta else schema
        empty = self._dealt(self.spark.createDataFrame([], T.StructType([T.StructField(f.name, f.dataType) for f in full])))
        if batches:
            empty = empty.withColumn(BATCH, F.lit(""))
        self._writer(empty).option("path", self._new_folder()).saveAsTable(self.name)

    def evolve(self, schema: T.StructType) -> list[str]:
        """Add the columns the stored table lacks."""
        added = added_columns(self.read().schema, schema)
        if added:
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in added)
            self.spark.sql(f"ALTER TABLE {self.name} ADD COLUMNS ({columns})")
        return [f.name for f in added]

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def replace(self, df: DataFrame) -> None:
        """Make these rows the whole table, also when there are none."""
        self._swap(self._laid_out(self._dealt(df)))

    def _swap(self, df: DataFrame) -> None:
        """Write a new version and point the table at it."""
        folder, staged = self._new_folder(), f"{self.name}_{uuid.uuid4().hex[:12]}"
        self._writer(df).option("path", folder).saveAsTable(staged)
        same_columns = self.exists() and self._stored_columns(self.name) == self._stored_columns(staged)
        if same_columns:
            if parts := self._parts():
                self._publish(folder, df.schema, parts, self.stored())
            else:
                self.spark.sql(f"ALTER TABLE {self.name} SET LOCATION '{folder}'")
            self.spark.sql(f"DROP TABLE {staged}")
        else:
            self.drop()
            schema, _, name = self.name.rpartition(".")
            self.spark.sql(f"ALTER TABLE {staged} RENAME TO {f'{schema}.{name}' if schema else name}")
        self.spark.catalog.refreshTable(self.name)

    def _stored_columns(self, name: str) -> list[tuple[str, str]]:
        return [(f.name, f.dataType.simpleString()) for f in self.spark.table(name).schema.fields]

    def _fit(self, df: DataFrame, not_stored: str | None = None) -> DataFrame:
        """Rows in the types of the stored columns, which are never changed.

        Columns the table lacks are added to it. A value that does not cast is kept as text in
        ``_rescued``, a column that comes into being with the first such batch.
        """
        stored = {f.name: f for f in self.read().schema.fields}
        wanted = T.StructType([stored.get(f.name, f) for f in df.schema.fields])
        retyped = any(wanted[f.name].dataType != f.dataType for f in df.schema.fields)
        fitted = conform(df, wanted, rescue=True) if retyped else df
        self.evolve(T.StructType([f for f in fitted.schema.fields if f.name != not_stored]))
        return fitted

    def append(self, df: DataFrame, batch: str | None = None) -> None:
        """Add rows; columns new to the table are added to it first.

        Rows of a ``batch`` are there once, however often the batch is appended: they are written to a folder
        that becomes, or replaces, the partition of that id. A table that was made without batches, and
        an append without an id, cannot tell a repeat.
        """
        if batch is not None and not BATCH_ID.fullmatch(batch):
            raise ValueError(f"no batch id: {batch}")
        self.ensure(df.schema, meta=False, batches=batch is not None)
        rows = self._dealt(conform(self._fit(df), self.read().schema, rescue=False))
        if BATCH in self.stored().columns:
            self._put(rows, batch or uuid.uuid4().hex)
        else:
            clustered(rows, self.sort_by).write.insertInto(self.name)
        # A stream's batch has a session of its own; this one must list the new files too.
        self.spark.catalog.refreshTable(self.name)

    def _put(self, rows: DataFrame, batch: str) -> None:
        parts = [*self._parts(), BATCH]
        rows = rows.withColumn(BATCH, F.lit(batch))
        folder = self._new_folder()
        self._ordered(rows, parts).write.partitionBy(*parts).parquet(folder)
        self._publish(folder, rows.schema, parts, self.stored().where(F.col(BATCH) == batch))

    def adopt(self, folder: str, schema: T.StructType, batch: str) -> bool:
        """Take a folder of Parquet files as an appended batch; False, and nothing done, where their types do not fit.

        A folder that is not there is a batch without rows.
        """
        self.ensure(schema, meta=False, batches=True)
        mine = {f.name: f.dataType for f in self.read().schema.fields}
        fits = all(mine.get(f.name, f.dataType) == f.dataType for f in schema.fields)
        if not fits or self._parts() or self.sort_by or BATCH not in self.stored().columns:
            return False
        self.evolve(schema)
        fs, path = self._hadoop_path(folder)
        self._relocate([BATCH], [(batch,)], {(batch,): folder} if fs.exists(path) else {})
        self.spark.catalog.refreshTable(self.name)
        return True

    def _publish(self, folder: str, schema: T.StructType, parts: list[str], replaced: DataFrame) -> None:
        """Make the partitions in a folder current, in place of those that ``replaced`` has.

        Partition values and their folders are the only rows collected.
        """
        rows = self.spark.read.schema(schema).parquet(folder)
        place = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("__place")
        places = {tuple(r[c] for c in parts): unquote(r["__place"]) for r in rows.select(*parts, place).distinct().collect()}
        old = {tuple(r) for r in replaced.select(*parts).distinct().collect()}
        self._relocate(parts, sorted(old | set(places), key=repr), places)

    def quarantine(self) -> Target:
        """Where rows without a full key go: no merge can place them."""
        return Target(self.spark, f"{self.name}_quarantine", self.root)

    def merge(self, changes: DataFrame, rules: MergeRules | None = None) -> int:
        """Apply change events by key; returns how many rows went to the quarantine.

        The batch, one event per key, is written down first. So the source is read once and
        cannot differ between the uses of the batch, its size is known when Spark chooses the
        join, and tasks that are lost are repeated from files. Only files or partitions with
        changes are rewritten where the table's format, or a partitioning that follows from the
        key, allows.
        """
        rules = rules or MergeRules(self.keys or tuple(primary_keys(changes.schema)))
        if not rules.keys:
            raise ValueError(f"{self.name} has no key to merge by")
        if self.exists() and BATCH in self.stored().columns:
            raise ValueError(f"{self.name} holds appended batches; rows of several cannot be merged")
        if self.hash_partitions:
            return self.keyed(rules.keys).merge_partitions(changes, rules)
        if self.partition_by and set(self.partition_by) <= set(rules.keys):
            return self.merge_partitions(changes, rules)
        batch, lost = self._stage_changes(changes, rules)
        try:
            # The batch takes the layout of the target, whose rows then stay where they are.
            latest = self._laid_out(self.spark.read.parquet(batch))
            latest, _ = split_null_keys(latest, list(rules.keys))
            if supports_row_level(self.spark, self.name):
                # What these two rules say is done by now.
                merge_into(latest, self.name, replace(rules, before=None, order_by=()))
                return lost
            stored = self.stored()
            merged, watermark = self._merged(stored, latest, rules)
            self._swap(conform(merged, stored.schema, rescue=False))
            self._set_watermark(watermark)
        finally:
            self._delete(batch)
        return lost

    def _merged(self, stored: DataFrame, latest: DataFrame, rules: MergeRules) -> tuple[DataFrame, int | None]:
        """The rows after the batch, and the watermark in microseconds where the rules have one."""
        if rules.retention_s is None:
            return apply_latest(stored, latest, rules), None
        old = self.watermark()
        if old is not None:
            latest = without_late(latest, stored, rules.keys, F.timestamp_micros(F.lit(old)))
        newest = latest.agg(F.max(F.unix_micros(F.col(CDC_TS).cast("timestamp")))).first()[0]
        reached = [x for x in (old, newest and newest - rules.retention_s * 1_000_000) if x is not None]
        merged = apply_latest(stored, latest, rules)
        if not reached:
            return merged, None
        return without_expired(merged, F.timestamp_micros(F.lit(max(reached)))), max(reached)

    def watermark(self) -> int | None:
        """Event time, in microseconds, behind which tombstones are not kept; a property of the table."""
        found = self.spark.sql(f"SHOW TBLPROPERTIES {self.name}").filter(F.col("key") == WATERMARK).first()
        return int(found["value"]) if found else None

    def _set_watermark(self, value: int | None) -> None:
        if value is not None:
            self.spark.sql(f"ALTER TABLE {self.name} SET TBLPROPERTIES ('{WATERMARK}' = '{value}')")

    def _stage_changes(self, changes: DataFrame, rules: MergeRules) -> tuple[str, int]:
        """Write the deciding events down, the table made ready for them; keyless rows go aside.

        Partitions know no empty text: it is null there, and so is a key that holds it.
        """
        texts = [c for c in self.partition_by if c in changes.columns and changes.schema[c].dataType == T.StringType()]
        changes = changes.withColumns({c: F.when(F.col(c) != "", F.col(c)) for c in texts})
        self.ensure(changes.drop(*rules.not_stored).schema, meta=False)
        folder = self._stage(self._dealt(self._fit(latest_changes(changes, rules, keep_null_keys=True), rules.unchanged)))
        keyless = split_null_keys(self.spark.read.parquet(folder), list(rules.keys))[1].drop(PART)
        lost = keyless.count()
        if lost:
            self.quarantine().append(keyless)
        return folder, lost

    def _stage(self, df: DataFrame) -> str:
        folder = f"{self.root.rstrip('/')}/{self.name.replace('.', '/')}/batch-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return folder

    def _hadoop_path(self, folder):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _delete(self, folder) -> None:
        fs, path = self._hadoop_path(folder)
        fs.delete(path, True)

    def expire_versions(self, older_than: datetime) -> int:
        """Delete the folders of replaced versions; returns how many.

        Give a time that lies before the start of any query still reading them.
        """
        version = F.regexp_extract(F.col("_metadata.file_path"), r"/(v-[0-9a-f]{32})/", 1)
        current = {self.location().rstrip("/").rsplit("/", 1)[-1]}
        if self._parts() or BATCH in self.stored().columns:
            current |= {r[0] for r in self.stored().select(version).distinct().toLocalIterator()}
        fs, folder = self._hadoop_path(f"{self.root.rstrip('/')}/{self.name.replace('.', '/')}")
        gone = [
            s.getPath()
            for s in fs.listStatus(folder)
            if s.getPath().getName().startswith("v-")
            and s.getPath().getName() not in current
            and s.getModificationTime() < older_than.timestamp() * 1000
        ]
        return sum(bool(fs.delete(path, True)) for path in gone)

    def merge_partitions(self, changes: DataFrame, rules: MergeRules) -> int:
        """Merge that rewrites only the partitions the changes touch.

        Right only where the partition columns follow from the key, so that a row cannot
        move between partitions. Partition values of one batch are the only rows collected.
        """
        parts = self._parts()
        if not parts:
            raise ValueError(f"{self.name} is not partitioned")
        if self.hash_partitions and set(self.keys) != set(rules.keys):
            raise ValueError(f"{self.name} is partitioned by {self.keys}, not by {rules.keys}")
        staged, lost = self._stage_changes(changes, rules)
        try:
            latest, _ = split_null_keys(self.spark.read.parquet(staged), list(rules.keys))
            stored = self.stored()
            touched = [row.asDict() for row in latest.select(*parts).distinct().collect()]
            affected = stored.filter(_any_of(touched))
            merged, watermark = self._merged(affected, latest, rules)
            merged = conform(merged, stored.schema, rescue=False)
            folder = self._new_folder()
            # Sorted, or else in partitions of even size: neither leaves a large one to one task.
            ordered = clustered(merged, [*parts, *self.sort_by]) if self.sort_by else merged.hint("rebalance", *parts)
            ordered.write.partitionBy(*parts).parquet(folder)
            if touched:
                self._publish(folder, merged.schema, parts, latest)
            self._set_watermark(watermark)
        finally:
            self._delete(staged)
        self.spark.catalog.refreshTable(self.name)
        return lost

    def _relocate(self, parts: list[str], touched: list[tuple], places: dict[tuple, str]) -> None:
        """Make the new folders those of their partitions; a partition without one goes."""
        for values in touched:
            spec = ", ".join(f"`{c}` = {_literal(v)}" for c, v in zip(parts, values))
            place = places.get(values)
            if place is None:
                self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION ({spec})")
                continue
            self.spark.sql(f"ALTER TABLE {self.name} ADD IF NOT EXISTS PARTITION ({spec}) LOCATION {_literal(place)}")
            self.spark.sql(f"ALTER TABLE {self.name} PARTITION ({spec}) SET LOCATION {_literal(place)}")

    def location(self) -> str:
        described = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}")
        return described.filter(F.col("col_name") == "Location").first()["data_type"]


def _literal(value: object) -> str:
    """A partition value or folder as SQL; text is cast to the type of the partition column."""
    if value is None:
        return "null"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any_of(values: list[dict]) -> Column:
    """Filter on partition values; literals prune the partitions when the scan is planned."""
    rows = [
        reduce(and_, [F.col(c).eqNullSafe(F.lit(v)) for c, v in row.items()]) for row in values
    ]
    return reduce(or_, rows, F.lit(False))


def clustered(df: DataFrame, sort_by: Sequence[str]) -> DataFrame:
    """Rows range-partitioned and sorted, nulls last; unknown columns are skipped."""
    known = [c for c in sort_by if c in df.columns]
    if not known:
        return df
    order = [F.col(c).asc_nulls_last() for c in known]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)
