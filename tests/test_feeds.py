"""Splits, version feeds, handoff and expiring deletes on small tables."""

import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewell.model import CDC_OP, CDC_TS
from tidewell.operators.merge import MergeRules
from tidewell.plans.load import LoadJob, run_job
from tidewell.plans.state import StateStore
from tidewell.plans.tables import Target
from tidewell.sources import splits
from tidewell.sources.readers import ConfiguredSource
from tidewell.streaming.handoff import as_snapshot, snapshot_handoff

T0 = datetime(2024, 1, 1)
CONNECTION = {"host": "h", "port": 5432, "database": "d", "user": "u", "password": "p"}


def test_splits_of_a_crowded_column_are_even(spark):
    df = spark.range(10_000).select(F.pow(F.col("id"), 3).cast("long").alias("x"))
    conditions = splits.split_predicates("x", splits.split_bounds(df, "x", 8))
    counts = [df.where(c).count() for c in conditions]
    assert len(counts) == 8 and sum(counts) == 10_000 and max(counts) <= 2 * min(counts)
    hot = df.select(F.when(F.col("x") % 2 == 0, 7).otherwise(F.col("x")).alias("x")).union(spark.range(3).select(F.lit(None).cast("long")))
    conditions = splits.split_predicates("x", splits.split_bounds(hot, "x", 8))
    assert sum(hot.where(c).count() for c in conditions) == 10_003 and len(conditions) < 8


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz", "decimal(18,2)", "double"])
def test_splits_by_other_types(spark, kind):
    value = F.col("id").cast(kind) if kind[:2] in ("de", "do") else F.timestamp_seconds(F.col("id") * 86_400).cast(kind)
    df = spark.range(1000).select(value.alias("x"))
    conditions = splits.split_predicates("x", splits.split_bounds(df, "x", 4))
    counts = [df.where(c).count() for c in conditions]
    assert len(counts) == 4 and sum(counts) == 1000 and max(counts) <= 300


def test_splits_of_nothing_and_of_text(spark):
    empty = spark.range(0)
    assert splits.split_predicates("id", splits.split_bounds(empty, "id", 4)) == ["1 = 1"]
    assert splits.split_bounds(spark.range(5), "id", 1) == []
    with pytest.raises(ValueError):
        splits.split_bounds(spark.createDataFrame([("a",)], "x string"), "x", 2)


def test_splits_become_predicates_of_the_reader():
    predicates = splits.split_predicates('"id"', [10, 20])
    got = splits.jdbc_arguments("postgres", CONNECTION, "public.t", predicates, {"fetch_size": 7})
    assert got["table"] == '"public"."t"' and got["url"].startswith("jdbc:postgresql://h:5432/d")
    assert got["predicates"] == ['"id" < 10 OR "id" IS NULL', '"id" >= 10 AND "id" < 20', '"id" >= 20']
    assert got["properties"]["fetchsize"] == "7" and not {"dbtable", "url", "partitionColumn"} & set(got["properties"])
    assert splits.jdbc_arguments("postgres", CONNECTION, "t", [], {"query": "SELECT 1"})["table"] == "(SELECT 1) q"


def test_version_feed_reads_each_version_once(spark, tmp_path):
    name = f"v_{uuid.uuid4().hex[:8]}"
    state = StateStore(spark, str(tmp_path / "state"), f"s_{name}")
    table = {"path": str(tmp_path / "feed"), "primary_key": ["k"], "change_feed": True}
    config = {"id": name, "source_type": "format", "connection": {"format": "parquet"}, "tables": ["t"], "tables_config": {"t": table}, "target_table": name}
    ddl = "k int, v string, _change_type string, _commit_version long, _commit_timestamp timestamp"

    def run(*rows):
        if rows:
            spark.createDataFrame([(*r, T0) for r in rows], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
        (r,) = run_job(spark, LoadJob.from_config(config), ConfiguredSource(spark, config), str(tmp_path), state)
        assert r.error is None
        return r.rows, {x.k: x.v for x in Target(spark, name, str(tmp_path)).read().collect()}

    assert run((1, "a", "insert", 1), (2, "b", "insert", 1)) == (2, {1: "a", 2: "b"})
    assert run() == (0, {1: "a", 2: "b"})
    assert run((1, "a", "update_preimage", 2), (1, "A", "update_postimage", 2), (2, "b", "delete", 3)) == (2, {1: "A"})
    assert state.get_offset(name, "t") == 3
    # A version that was read is never read again.
    assert run((1, "old", "update_postimage", 2)) == (0, {1: "A"})


@pytest.mark.parametrize("seed", range(3))
def test_handoff_ends_in_the_table_as_it_is(spark, seed):
    """A table changes at every position while ranges of it are read, in any order."""
    rng = random.Random(seed)
    now, log, shown = {k: f"start{k}" for k in range(40)}, [], []
    reads = {rng.randrange(5, 95): r for r in range(4)}
    low = {r: at - rng.randrange(5) for at, r in reads.items()}
    for at in range(100):
        k = rng.randrange(50)
        if rng.random() < 0.3 and k in now:
            log.append((k, None, "delete", f"{at:04d}"))
            del now[k]
        else:
            log.append((k, f"v{at}", "update" if k in now else "insert", f"{at:04d}"))
            now[k] = f"v{at}"
        if at in reads:
            r = reads[at]
            shown += [(key, v, f"{low[r]:04d}") for key, v in now.items() if key % len(reads) == list(reads.values()).index(r)]
    rows = spark.createDataFrame(shown, "k int, v string, low string")
    snapshot = as_snapshot(rows, F.col("low"), "lsn").drop("low")
    events = snapshot_handoff(snapshot, spark.createDataFrame(log, f"k int, v string, {CDC_OP} string, lsn string"), ["k"], "lsn")
    # Keys that never changed and were not there to be read differ in nothing.
    assert {r.k: r.v for r in events.where(f"{CDC_OP} <> 'delete'").collect()} == now


def test_tombstones_guard_then_go(spark, tmp_path):
    t = Target(spark, f"x_{uuid.uuid4().hex[:8]}", str(tmp_path), ("k",))
    rules = MergeRules(("k",), guard_late=True, keep_tombstones=True, retention_s=60)

    def put(k, v, op, second):
        t.merge(spark.createDataFrame([(k, v, op, T0 + timedelta(seconds=second))], f"k int, v string, {CDC_OP} string, {CDC_TS} timestamp"), rules)
        return {r.k: (r.v if r[CDC_OP] != "delete" else None) for r in t.read().collect()}

    assert put(1, "a", "insert", 0) == {1: "a"}
    assert put(1, "", "delete", 10) == {1: None}
    assert put(1, "late", "insert", 5) == {1: None}
    assert put(2, "b", "insert", 69) == {1: None, 2: "b"}
    assert put(2, "c", "update", 100) == {2: "c"}
    # Older than the watermark and without a row to compare with: refused. With one, that row decides.
    assert put(1, "too late", "insert", 20) == {2: "c"}
    assert put(2, "older", "update", 30) == {2: "c"}
    assert put(1, "again", "insert", 50) == {1: "again", 2: "c"}
    with pytest.raises(ValueError):
        MergeRules(("k",), retention_s=5)
