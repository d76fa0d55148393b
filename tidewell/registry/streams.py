"""Checked queries: streams run to completion over whole given tables."""

import uuid

from pyspark.sql import functions as F

from tidewell.model import CDC_OP, CDC_SEQ, CDC_TS
from tidewell.operators.merge import MergeRules
from tidewell.plans.tables import Target
from tidewell.registry.analytics import COOLDOWN
from tidewell.registry.base import ORACLES, query
from tidewell.registry.inputs import SQL_CHANGES, SQL_OP, op_of_event
from tidewell.session import fresh_dir, parallelism, read_table
from tidewell.streaming.cdc import apply_stream
from tidewell.streaming.cooldown import cooldown_batches
from tidewell.streaming.pipe import file_stream, ingest


def _event_files(spark, sf):
    """The events table as files, read in two batches: folder, schema, files per batch."""
    folder, files = fresh_dir(spark, "events"), parallelism(spark, 4)
    events = read_table(spark, sf, "events")
    events.repartition(files, "event_id").write.parquet(folder)
    return folder, events.schema, files // 2


def _finish(started):
    started.awaitTermination()
    if started.exception():
        raise started.exception()


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def stream_file_ingest(spark, sf):
    folder, schema, batch = _event_files(spark, sf)
    out, checkpoint = fresh_dir(spark, "ingested"), fresh_dir(spark, "checkpoint")
    for _ in range(2):
        # The second run finds every file known and adds nothing.
        _finish(ingest(file_stream(spark, folder, schema, max_files=batch), out, checkpoint))
    return spark.read.parquet(out).drop("_source_file", "last_modified", "_ingested_at")


def _changes(stream):
    return stream.select(
        F.col("user_id").alias("c_custkey"),
        F.col("event_type").alias("c_mktsegment"),
        F.col("value").alias("c_acctbal"),
        op_of_event().alias(CDC_OP),
        F.col("ts").alias(CDC_TS),
        F.col("event_id").alias(CDC_SEQ),
    )


@query(f"WITH {SQL_CHANGES} SELECT * FROM latest WHERE _cdc_op <> 'delete'")
def stream_cdc_apply(spark, sf):
    """Files in any order: tombstones and the late guard make the end state the same."""
    folder, schema, batch = _event_files(spark, sf)
    target = Target(spark, f"streamed_{uuid.uuid4().hex[:12]}", fresh_dir(spark, "streamed"), ("c_custkey",), hash_partitions=4)
    rules = MergeRules(("c_custkey",), guard_late=True, keep_tombstones=True)
    changes = _changes(file_stream(spark, folder, schema, max_files=batch))
    _finish(apply_stream(changes, {"customer": target}, rules, fresh_dir(spark, "checkpoint")))
    return target.read().filter(F.col(CDC_OP) != "delete")


@query(
    f"""SELECT user_id, value, event_id, {SQL_OP} AS _cdc_op, 'public.click' AS routed FROM events WHERE event_type = 'click'
    UNION ALL SELECT user_id, value, event_id, {SQL_OP}, 'error' FROM events WHERE event_type = 'error'"""
)
def stream_route_append(spark, sf):
    """One stream into the logs of two tables."""
    folder, schema, batch = _event_files(spark, sf)
    root, tag = fresh_dir(spark, "routed"), uuid.uuid4().hex[:12]
    targets = {t: Target(spark, f"{t.replace('.', '_')}_{tag}", root) for t in ("public.click", "error")}
    changes = file_stream(spark, folder, schema, max_files=batch).select(
        "user_id", "value", "event_id", op_of_event().alias(CDC_OP), F.col("event_type").alias("source_table")
    )
    checkpoint = fresh_dir(spark, "checkpoint")
    _finish(apply_stream(changes, targets, {}, checkpoint, "append", f"route_{tag}", "source_table"))
    frames = [t.read().withColumn("routed", F.lit(n)).drop("source_table") for n, t in targets.items()]
    return frames[0].unionByName(frames[1])


@query(ORACLES["alert_cooldown"])
def stream_alert_cooldown(spark, sf):
    """The streaming form gives what the batch form gives."""
    folder, schema, _ = _event_files(spark, sf)
    raised = spark.readStream.schema(schema).parquet(folder).select(
        F.col("event_type").alias("alert_key"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t")
    )
    fired = Target(spark, f"fired_{uuid.uuid4().hex[:12]}", fresh_dir(spark, "fired"))
    _finish(cooldown_batches(raised, fired, ["alert_key"], "t", COOLDOWN, fresh_dir(spark, "checkpoint")))
    return fired.read()
