"""Checked queries: loads that die on the way and are repeated, and merges that rewrite parts of a table."""

import uuid
from contextlib import suppress

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidewell.model import CDC_OP, add_cdc_meta
from tidewell.operators.merge import MergeRules
from tidewell.plans.copy_into import copy_into
from tidewell.plans.state import StateStore
from tidewell.plans.tables import Target
from tidewell.registry.base import query
from tidewell.registry.inputs import SQL_ORDERS, SQL_OP, op_of_event, order_batch, order_target
from tidewell.session import fresh_dir, parallelism, read_table
from tidewell.streaming.cdc import apply_stream


class Crash(RuntimeError):
    """What a driver's end looks like to the code around it."""


class DiesBeforeCommit(Target):
    """Rows are written, the catalog never hears of them."""

    def _publish(self, *_):
        raise Crash


class DiesAfterAppend(Target):
    """The batch is there, who asked for it never hears of it."""

    def append(self, df, batch=None):
        super().append(df, batch)
        raise Crash


class DiesBeforeNote(StateStore):
    """The copy is there, the note of it is not."""

    def copied(self):
        noted = super().copied()
        return DiesBeforeCommit(noted.spark, noted.name, noted.root)


def _tag() -> str:
    return uuid.uuid4().hex[:12]


@query("SELECT event_id, user_id, value FROM events")
def append_replayed(spark, sf):
    """Two batches; one dies before it is visible, one is repeated after it is."""
    name, root = f"replayed_{_tag()}", fresh_dir(spark, "replayed")
    events = read_table(spark, sf, "events").select("event_id", "user_id", "value")
    even = F.col("event_id") % 2 == 0
    with suppress(Crash):
        DiesBeforeCommit(spark, name, root).append(events.filter(even), "load-0")
    target = Target(spark, name, root)
    for batch, rows in (("load-0", events.filter(even)), ("load-1", events.filter(~even)), ("load-1", events.filter(~even))):
        target.append(rows, batch)
    return target.read()


@query("SELECT * FROM orders")
def copy_into_after_crash(spark, sf):
    """A copy dies between its rows and its note, more files come, the next copy takes each file once."""
    folder, tag = fresh_dir(spark, "landing"), _tag()
    target = Target(spark, f"copied_{tag}", fresh_dir(spark, "copied"))
    orders = read_table(spark, sf, "orders")
    for part in range(2):
        orders.filter(F.col("o_orderkey") % 2 == part).write.mode("append").parquet(folder)
        state = DiesBeforeNote if part == 0 else StateStore
        with suppress(Crash):
            copy_into(spark, target, folder, state(spark, folder + "-state", f"state_{tag}"), pattern=r"\.parquet$")
    return target.read()


@query(f"SELECT user_id, value, event_id, {SQL_OP} AS _cdc_op FROM events")
def stream_append_replayed(spark, sf):
    """A stream dies after a batch is visible and before its checkpoint says so; the restart repeats the batch."""
    folder, checkpoint, files = fresh_dir(spark, "events"), fresh_dir(spark, "checkpoint"), parallelism(spark, 4)
    events = read_table(spark, sf, "events")
    events.repartition(files, "event_id").write.parquet(folder)
    name, root, tag = f"log_{_tag()}", fresh_dir(spark, "log"), _tag()
    for kind in (DiesAfterAppend, Target):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files // 2).parquet(folder)
        changes = stream.select("user_id", "value", "event_id", op_of_event().alias(CDC_OP))
        with suppress(StreamingQueryException):
            apply_stream(changes, {"log": kind(spark, name, root)}, {}, checkpoint, "append", f"log_{tag}").awaitTermination()
    return Target(spark, name, root).read()


@query(
    f"""WITH {SQL_ORDERS}
    SELECT * FROM target WHERE o_orderkey NOT IN (SELECT o_orderkey FROM batch) UNION ALL SELECT * FROM batch"""
)
def merge_hash_partitions(spark, sf):
    """A merge into a table dealt out by the hash of its key; the batch's parts are rewritten."""
    target = Target(spark, f"hashed_{_tag()}", fresh_dir(spark, "hashed"), ("o_orderkey",), hash_partitions=16)
    stamp = lambda df: add_cdc_meta(df, "shop", ts=F.col("o_orderdate"))
    target.replace(stamp(order_target(spark, sf)))
    target.merge(stamp(order_batch(spark, sf)), MergeRules(("o_orderkey",)))
    return target.read().select(*order_target(spark, sf).columns)
