"""Continuous file ingest."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidewell.sources.files import with_source_file

# Fixed value: days for which a notice is known.
DEDUPE_LOOKBACK_DAYS = 14
ANY_AGE = "36500d"


def file_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    fmt: str = "parquet",
    max_files: int = 1000,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """New files as a stream, whatever their age.

    The checkpoint is the ledger of loaded files. Spark leaves out files older than ``maxFileAge``,
    so that is set beyond any file; the ledger then keeps every path.
    """
    reader = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files)
        .option("maxFileAge", ANY_AGE)
    )
    for key, value in (options or {}).items():
        reader = reader.option(key, value)
    return with_source_file(reader.format(fmt).load(path))


def dedupe_notifications(
    notices: DataFrame, path: str = "path", sent_at: str = "sent_at", lookback_days: int = DEDUPE_LOOKBACK_DAYS
) -> DataFrame:
    """Arrival notices of a queue, each file once within the lookback."""
    return notices.withWatermark(sent_at, f"{lookback_days} days").dropDuplicatesWithinWatermark([path])


def ingest(stream: DataFrame, folder: str, checkpoint: str, trigger: Mapping[str, object] | None = None) -> StreamingQuery:
    """Append the stream to a Parquet folder whose sink log makes every batch count once."""
    return (
        stream.withColumn("_ingested_at", F.current_timestamp())
        .writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
