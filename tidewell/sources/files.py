"""File scans: format detection, listings, incremental reads by modification time.

Listings are DataFrames over file metadata; file contents are never part of them.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, fields
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators.incremental import EPOCH
from tidewell.operators.schema import union_by_name

# File endings and the format each one means.
FORMAT_BY_ENDING: dict[str, str] = {
    ".parquet": "parquet",
    ".pq": "parquet",
    ".avro": "avro",
    ".ndjson": "ndjson",
    ".jsonl": "ndjson",
    ".json": "json",
    ".orc": "orc",
}
# The endings blob containers look at; there anything unknown is JSON.
BLOB_FORMAT_BY_ENDING: dict[str, str] = {".parquet": "parquet", ".avro": "avro", ".csv": "csv"}

COPY_FORMATS = ("parquet", "json", "csv", "avro", "orc")

SOURCE_FILE = "_source_file"
SOURCE_MTIME = "last_modified"


def _endings(blob: bool) -> tuple[dict[str, str], str]:
    return (BLOB_FORMAT_BY_ENDING, "json") if blob else (FORMAT_BY_ENDING, "csv")


def detect_format(path: Column | str, blob: bool = False) -> Column:
    """Format named by the ending of a path column."""
    lowered = F.lower(F.col(path) if isinstance(path, str) else path)
    table, fallback = _endings(blob)
    expr = F.lit(fallback)
    for ending, fmt in table.items():
        expr = F.when(lowered.endswith(ending), fmt).otherwise(expr)
    return expr


def resolve_prefix(base: str, table: str) -> str:
    """Folder of a table: below the base, or the base itself for ``*`` or no name."""
    below = "" if table == "*" else (table or "").strip("/")
    return posixpath.join(base, below).rstrip("/")


# Settings that a connection may give for all of its tables.
SHARED_SETTINGS = ("file_format", "csv_delimiter", "csv_has_header")


@dataclass(frozen=True)
class FileOptions:
    """Reader options of one table: connection defaults overlaid by its own settings.

    ``csv_multiline`` allows line breaks inside quotes, for which a file must be read by one
    task; false, a line is a record and Spark splits large files. It never depends on sizes. ``csv_empty_text`` reads an empty
    field as empty text instead of null. ``schema`` (DDL) spares the pass that infers one.
    """

    file_format: str | None = None
    csv_delimiter: str = ","
    csv_has_header: bool = True
    csv_multiline: bool = True
    csv_empty_text: bool = False
    json_document: bool = False
    schema: str | None = None
    max_files: int | None = None
    extra: Mapping[str, str] = field(default_factory=dict)

    @staticmethod
    def from_config(connection: Mapping[str, Any], table: Mapping[str, Any]) -> FileOptions:
        values = {}
        for option in fields(FileOptions):
            places = (table, connection) if option.name in SHARED_SETTINGS else (table,)
            given = [x[option.name] for x in places if x.get(option.name) is not None]
            if given and option.name not in ("max_files", "extra"):
                values[option.name] = str(given[0]).lower() == "true" if option.type == "bool" else given[0]
        cap = table.get("max_files_per_run")
        return FileOptions(**values, max_files=int(cap) if cap else None)


def read_files(
    spark: SparkSession,
    paths: str | Sequence[str],
    fmt: str,
    options: FileOptions = FileOptions(),
    schema: T.StructType | str | None = None,
    recursive: bool = True,
    **reader_options: Any,
) -> DataFrame:
    """One format from one or many paths.

    JSON is read by lines: a line may hold one object or a whole array, so single-line
    documents and NDJSON share a scan that Spark can split. A document spread over lines
    needs ``json_document``, and then one task reads a whole file.
    """
    schema = schema or options.schema
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    for key, value in {**options.extra, **reader_options}.items():
        reader = reader.option(key, value)
    if schema is not None:
        reader = reader.schema(schema)
    where = [paths] if isinstance(paths, str) else list(paths)
    if fmt == "parquet":
        return (reader if schema is not None else reader.option("mergeSchema", "true")).parquet(*where)
    if fmt == "orc":
        return reader.orc(*where)
    if fmt == "avro":
        return reader.format("avro").load(where)
    if fmt in ("json", "ndjson", "jsonl"):
        # A line that is no JSON fails the load; by default Spark would read it as nulls.
        reader = reader.option("mode", reader_options.get("mode", "FAILFAST"))
        if fmt == "json" and options.json_document:
            reader = reader.option("multiLine", "true")
        return reader.json(where)
    if fmt != "csv":
        raise ValueError(f"unsupported file format: {fmt}")
    # Values stay text; typing them is the job of conform(). A quote is escaped by doubling it.
    reader = reader.options(
        sep=options.csv_delimiter,
        header=str(options.csv_has_header).lower(),
        multiLine=str(options.csv_multiline).lower(),
        escape='"',
    )
    rows = reader.csv(where)
    if not options.csv_has_header and schema is None:
        rows = rows.toDF(*[f"col_{i}" for i in range(len(rows.columns))])
    return rows.fillna("") if options.csv_empty_text else rows


def list_files(
    spark: SparkSession,
    path: str | Sequence[str],
    newer_than: datetime | str | None = None,
    not_after: datetime | str | None = None,
    max_files: int | None = None,
    files: Sequence[str] | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """Files below a path as rows of ``path, modificationTime, length``, and ``file_url``, the path as scans name it.

    ``newer_than`` is exclusive. The cap keeps the oldest files, and all of the time of the last
    kept one, however many: the next run goes on after that time and misses none. A list of names wins over a pattern, which is
    matched against the part of a name below ``path``.
    """
    where = [path] if isinstance(path, str) else list(path)
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(where)
        .select("path", "modificationTime", "length", F.col("_metadata.file_path").alias("file_url"))
    )
    if newer_than is not None:
        found = found.filter(F.col("modificationTime") > _instant(newer_than))
    if not_after is not None:
        found = found.filter(F.col("modificationTime") <= _instant(not_after))
    below = F.col("path")
    for root in where:
        below = F.substring_index(below, root.split("://", 1)[-1].rstrip("/") + "/", -1)
    if files:
        found = found.filter(below.isin(*files))
    elif pattern:
        found = found.filter(below.rlike(pattern))
    if max_files is None:
        return found
    oldest = found.select("modificationTime").orderBy("modificationTime").limit(max_files)
    last = oldest.agg(F.unix_micros(F.max("modificationTime"))).first()[0]
    kept = found if last is None else found.filter(F.col("modificationTime") <= F.timestamp_micros(F.lit(last)))
    return kept.orderBy("modificationTime", "path")


def _instant(value: datetime | str) -> Column:
    if isinstance(value, str):
        value = datetime.fromisoformat(value.replace("Z", "+00:00"))
    if value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp")


def with_source_file(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            SOURCE_FILE: F.col("_metadata.file_path"),
            SOURCE_MTIME: F.col("_metadata.file_modification_time"),
        }
    )


def incremental_files(
    df: DataFrame, newer_than: datetime | str | None = None, not_after: datetime | str | None = None
) -> DataFrame:
    """Rows of whole files modified in ``(newer_than, not_after]``.

    The predicate is on file metadata, so Spark drops the other files before opening them.
    """
    mtime = F.col("_metadata.file_modification_time")
    if newer_than is not None:
        df = df.filter(mtime > _instant(newer_than))
    if not_after is not None:
        df = df.filter(mtime <= _instant(not_after))
    return with_source_file(df)


def file_high_watermark(listing: DataFrame) -> DataFrame:
    return listing.agg(F.max("modificationTime").alias("high_watermark"))


def read_detected(
    spark: SparkSession,
    listing: DataFrame,
    options: FileOptions = FileOptions(),
    blob: bool = False,
) -> tuple[DataFrame | None, datetime]:
    """Rows of the files of a listing, each read in the format its name means, and the newest
    modification time among them. No files give no rows, and so no frame.

    Only names and times reach the driver, where any reader needs the names to plan its scan.
    """
    fmt = F.lit(options.file_format) if options.file_format else detect_format("path", blob)
    chosen = listing.select(fmt.alias("fmt"), "path", F.unix_micros("modificationTime").alias("us"))
    by_format: dict[str, list[str]] = {}
    newest = 0
    for row in chosen.toLocalIterator():
        by_format.setdefault(row["fmt"], []).append(row["path"])
        newest = max(newest, row["us"])
    if not by_format:
        return None, EPOCH
    rows = union_by_name(
        [
            with_source_file(read_files(spark, paths, f, options, recursive=False))
            for f, paths in sorted(by_format.items())
        ]
    )
    return rows, EPOCH + timedelta(microseconds=newest)


def new_files(listing: DataFrame, ledger: DataFrame, path: str = "path") -> DataFrame:
    """Files the ledger of loaded files does not know yet."""
    return listing.join(ledger.select(path), path, "left_anti")


def merged_schema(spark: SparkSession, paths: Iterable[str]) -> T.StructType:
    """Union schema of Parquet files, from their footers."""
    return spark.read.option("mergeSchema", "true").parquet(*paths).schema
