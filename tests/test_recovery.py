"""Repeats of loads that died, and what a merge leaves where it was."""

import uuid
from contextlib import suppress

import pytest
from pyspark.sql import functions as F

from tidewell.operators.merge import MergeRules
from tidewell.plans.copy_into import copy_into
from tidewell.plans.load import FrameSource, LoadJob, run_job
from tidewell.plans.state import StateStore
from tidewell.plans.tables import BATCH, PART, Target
from tidewell.registry.recovery import Crash, DiesBeforeCommit, DiesBeforeNote
from tidewell.streaming.cdc import route_append


@pytest.fixture
def name():
    return f"r_{uuid.uuid4().hex[:10]}"


@pytest.fixture
def state(spark, tmp_path, name):
    return StateStore(spark, str(tmp_path / "state"), f"s_{name}")


def files_of(target):
    return {r[0]: r[1] for r in target.stored().select(F.col("_metadata.file_path"), PART).distinct().collect()}


def test_batch_appended_again_takes_its_place(spark, tmp_path, name):
    t = Target(spark, name, str(tmp_path))
    t.append(spark.range(5), "a")
    t.append(spark.range(5, 9).withColumn("more", F.lit("x")), "b")
    with suppress(Crash):
        DiesBeforeCommit(spark, name, str(tmp_path)).append(spark.range(100, 200), "c")
    assert t.read().count() == 9 and t.read().columns == ["id", "more"]
    t.append(spark.range(3), "a")
    assert sorted(r.id for r in t.read().collect()) == [0, 1, 2, 5, 6, 7, 8]
    t.append(spark.range(0), "b")
    assert t.read().count() == 3
    t.append(spark.range(1))
    assert t.read().count() == 4 and BATCH not in t.read().columns
    with pytest.raises(ValueError):
        t.append(spark.range(1), "a/b")
    with pytest.raises(ValueError):
        t.merge(spark.range(1), MergeRules(("id",)))


def test_appended_batches_of_a_partitioned_table(spark, tmp_path, name):
    t = Target(spark, name, str(tmp_path), partition_by=("p",))
    rows = lambda *r: spark.createDataFrame(r, "v int, p string")
    t.append(rows((1, "x"), (2, "y")), "a")
    t.append(rows((3, "x")), "b")
    t.append(rows((1, "x"), (5, "z")), "a")
    assert sorted(tuple(r) for r in t.read().select("v", "p").collect()) == [(1, "x"), (3, "x"), (5, "z")]


def test_load_that_died_before_its_watermark_is_repeated_in_place(spark, tmp_path, name, state):
    job = LoadJob.from_config({"id": name, "source_type": "postgres", "tables": ["a"], "options": {"snapshot_cursor_column": "c"}, "target_table": name})
    load = lambda rows, s: run_job(spark, job, FrameSource({"a": spark.createDataFrame(rows, "v string, c int")}), str(tmp_path), s)[0]

    class Dies(StateStore):
        def set_offset(self, *_):
            raise Crash

    dying = Dies(spark, state.root, state.prefix)
    assert load([("a", 1)], dying).status == "error"
    assert load([("a", 1), ("b", 2)], state).rows == 2
    assert load([("a", 1), ("b", 2), ("c", 3)], dying).status == "error"
    assert load([("a", 1), ("b", 2), ("c", 3), ("d", 4)], state).rows == 2
    assert sorted(r.v for r in spark.table(name).collect()) == ["a", "b", "c", "d"]


def test_copy_that_died_is_repeated_with_its_own_files(spark, tmp_path, name, state):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a 1.csv").write_text("k,v\n1,a\n")
    (folder / "notes.bin").write_bytes(b"\x00\xff" * 50)
    t = Target(spark, name, str(tmp_path / "out"))
    dying = DiesBeforeNote(spark, state.root, state.prefix)
    with suppress(Crash):
        copy_into(spark, t, str(folder), dying, "csv", pattern=r"\.csv$")
    assert t.read().count() == 1
    (folder / "b.csv").write_text("k,v\n2,b\n3,c\n")
    assert copy_into(spark, t, str(folder), state, "csv", pattern=r"\.csv$") == 3
    assert copy_into(spark, t, str(folder), state, "csv", pattern=r"\.csv$") == 0
    assert sorted(r.k for r in t.read().collect()) == ["1", "2", "3"]
    assert state.copied().read().count() == 2


def test_copy_of_many_files(spark, tmp_path, name, state, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(2000):
        (folder / f"{i}.json").write_text(f'{{"k": {i}}}\n')
    monkeypatch.setattr("pyspark.sql.DataFrame.toLocalIterator", lambda *_: pytest.fail("a list went to the driver"))
    assert copy_into(spark, Target(spark, name, str(tmp_path / "out")), str(folder), state, "json", schema="k int") == 2000


def test_merge_by_hash_leaves_other_parts_where_they_are(spark, tmp_path, name):
    t = Target(spark, name, str(tmp_path), ("k",), hash_partitions=8)
    rows = lambda n, v, op="insert": spark.range(n).select(F.col("id").cast("int").alias("k"), F.lit(v).alias("v"), F.lit(op).alias("_cdc_op"), F.lit(1).alias("_cdc_seq"))
    t.merge(rows(200, "old"))
    before = files_of(t)
    assert set(before.values()) == set(range(8)) and PART not in t.read().columns
    # A key of another integer type falls into the same part.
    t.merge(rows(200, "new").where("k = 7").withColumn("k", F.col("k").cast("long")))
    after = files_of(t)
    moved = {before[f] for f in before if f not in after}
    assert len(moved) == 1 and {after[f] for f in after if f not in before} == moved
    t.merge(rows(200, "", "delete").where("k = 9").unionByName(rows(1, "none").withColumn("k", F.lit(None).cast("int"))))
    got = {r.k: r.v for r in t.read().collect()}
    assert len(got) == 199 and got[7] == "new" and got[8] == "old" and t.quarantine().read().count() == 1
    t.replace(rows(3, "whole"))
    assert t.read().count() == 3 and t.name in [x.name for x in spark.catalog.listTables()]
    with pytest.raises(ValueError):
        t.merge(rows(1, "x"), MergeRules(("v",)))
    with pytest.raises(ValueError):
        Target(spark, name, "", ("k",), buckets=2, hash_partitions=2)


def test_hash_partitions_come_from_the_configuration(spark, tmp_path, name, state):
    config = {"id": name, "source_type": "postgres", "load_mode": "full", "tables": ["a"], "target_table": name}
    job = LoadJob.from_config({**config, "tables_config": {"a": {"primary_key": ["k"], "hash_partitions": 4}}})
    for v in ("x", "y"):
        (r,) = run_job(spark, job, FrameSource({"a": spark.createDataFrame([(1, v), (2, v)], "k int, v string")}), str(tmp_path), state)
        assert r.error is None
    t = Target(spark, name, str(tmp_path))
    assert sorted((r.k, r.v) for r in t.read().collect()) == [(1, "y"), (2, "y")] and PART in t.stored().columns


def test_routing_writes_a_batch_once(spark, tmp_path, name):
    rows = spark.createDataFrame([(1, "p.a"), (2, "b"), (3, "x.b"), (4, "none")], "v int, source_table string")
    targets = {t: Target(spark, f"{name}_{t.replace('.', '_')}", str(tmp_path)) for t in ("p.a", "b", "odd")}
    # A table with another type is appended to by itself.
    targets["odd"].append(spark.createDataFrame([("0", "odd")], "v string, source_table string"), "first")
    rows = rows.unionByName(spark.createDataFrame([(9, "odd")], rows.schema))
    for _ in range(2):
        route_append(rows, targets, "batch-0")
    got = {t: sorted(str(r.v) for r in target.read().collect()) for t, target in targets.items()}
    assert got == {"p.a": ["1"], "b": ["2", "3"], "odd": ["0", "9"]}
