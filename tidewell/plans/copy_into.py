"""Bulk ingest of files into a table, each file once."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.model import add_cdc_meta
from tidewell.operators.merge import MergeRules
from tidewell.plans.load import observed
from tidewell.plans.state import StateStore
from tidewell.plans.tables import BATCH, Target
from tidewell.sources.files import COPY_FORMATS, FileOptions, list_files, new_files, read_files


# So many kinds of file names, by their endings, are told apart when Spark lists a location.
MOST_ENDINGS = 50


def reader_settings(format_options: Mapping[str, str] | None) -> tuple[FileOptions, dict[str, str]]:
    """Reader options for ``FIELD_DELIMITER``, ``TRIM_SPACE`` and the like."""
    given = {k.upper(): v for k, v in (format_options or {}).items()}
    options = FileOptions(
        csv_delimiter=given.get("FIELD_DELIMITER", ","),
        csv_has_header=str(given.get("EXTRACT_HEADER", "true")).lower() == "true",
    )
    trim = str(given.get("TRIM_SPACE", "false")).lower()
    return options, {"ignoreLeadingWhiteSpace": trim, "ignoreTrailingWhiteSpace": trim}


def copy_into(
    spark: SparkSession,
    target: Target,
    location: str,
    state: StateStore,
    file_format: str = "parquet",
    format_options: Mapping[str, str] | None = None,
    files: Sequence[str] | None = None,
    pattern: str | None = None,
    schema: T.StructType | str | None = None,
) -> int:
    """Append the files not loaded before, each once; returns the number of rows loaded.

    The files of a copy are noted in the ledger under its id, then loaded under that id, then the copy is noted as
    done. One that died in between is repeated with the same files and the same id before new files are looked
    for: an append takes the place of its first try, and a keyed target merges to the same rows. The list
    of files is a table at every step and never passes through the driver.
    """
    if file_format.lower() not in COPY_FORMATS:
        raise ValueError(f"unsupported file format: {file_format}")
    options, extra = reader_settings(format_options)
    mine = F.col("target_table") == target.name
    noted = state.ledger().stored().filter(mine)
    done = state.copied().read().filter(mine).select(F.col("batch").alias(BATCH))
    total = 0
    for row in noted.select(BATCH).distinct().join(done, BATCH, "left_anti").collect():
        total += _copy(spark, target, location, state, row[BATCH], file_format, options, extra, schema)
    found = list_files(spark, location, files=files, pattern=pattern)
    fresh = new_files(found, noted).select(
        "path",
        "file_url",
        F.lit(target.name).alias("target_table"),
        F.col("modificationTime").alias("modification_time"),
        F.current_timestamp().alias("loaded_at"),
    )
    copy = uuid.uuid4().hex
    state.ledger().append(fresh, copy)
    return total + _copy(spark, target, location, state, copy, file_format, options, extra, schema)


def _copy(
    spark: SparkSession,
    target: Target,
    location: str,
    state: StateStore,
    copy: str,
    file_format: str,
    options: FileOptions,
    extra: dict[str, str],
    schema: T.StructType | str | None,
) -> int:
    """Load the files noted under a copy."""
    chosen = state.ledger().stored().filter(F.col(BATCH) == copy)
    # Whole seconds around the files' times, exclusive: Spark leaves other files out when it lists the location.
    moment = lambda time, by: F.date_format(F.timestamp_seconds(F.floor(F.unix_micros(time) / 1_000_000) + by), "yyyy-MM-dd'T'HH:mm:ss")
    first, last = chosen.agg(moment(F.min("modification_time"), -1), moment(F.max("modification_time"), 2)).first()
    if first is None:
        return 0
    ending = F.regexp_extract("path", r"(\.[^./]+)?$", 0)
    endings = [r[0] for r in chosen.select(ending).distinct().limit(MOST_ENDINGS + 1).collect()]
    within = {"modifiedAfter": first, "modifiedBefore": last}
    if all(endings) and len(endings) <= MOST_ENDINGS:
        within["pathGlobFilter"] = f"*{{{','.join(endings)}}}"
    rows = read_files(spark, location, file_format.lower(), options, schema, **extra, **within)
    names = rows.columns
    url = F.col("_metadata.file_path")
    placed = rows.select("*", url.alias("__file"), F.col("_metadata.file_modification_time").alias("__modified"))
    placed = placed.join(chosen.select(F.col("file_url").alias("__file")), "__file", "left_semi")
    rows, metrics = observed(placed.select(*names, "__modified", "__file"))
    if target.keys:
        # Of rows with the same key, the one of the later file is kept.
        rules = MergeRules(target.keys, order_by=("__modified", "__file"))
        target.merge(add_cdc_meta(rows, source=target.name), rules)
    else:
        target.append(rows.drop("__modified", "__file"), copy)
    loaded = metrics.get["rows"]
    note = spark.createDataFrame([(copy, target.name, loaded)], "batch string, target_table string, rows bigint")
    state.copied().append(note.withColumn("loaded_at", F.current_timestamp()), copy)
    return loaded
