import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.model import add_cdc_meta
from tidewell.operators.merge import MergeRules, apply_latest
from tidewell.plans.copy_into import copy_into, reader_settings
from tidewell.plans.load import FrameSource, LoadJob, run_job
from tidewell.plans.rowlevel import merge_into, supports_row_level
from tidewell.plans.state import StateStore, state_upsert
from tidewell.plans.tables import Target, clustered
from tidewell.sources.readers import ConfiguredSource


@pytest.fixture
def name():
    return f"t_{uuid.uuid4().hex[:10]}"


@pytest.fixture
def state(spark, tmp_path, name):
    return StateStore(spark, str(tmp_path / "state"), f"s_{name}")


def frame(spark, *rows, ddl="k int, v string"):
    return spark.createDataFrame(list(rows), ddl)


def stamped(df, second=0):
    return add_cdc_meta(df, "src", op="update", ts=F.lit(f"2024-01-01 00:00:{second:02d}").cast("timestamp"))


def state_of(df):
    return {r["k"]: r["v"] for r in df.collect()}


def test_ensure_is_idempotent_and_adds_meta(spark, tmp_path, name):
    t = Target(spark, name, str(tmp_path))
    t.ensure(T._parse_datatype_string("a int"))
    t.ensure(T._parse_datatype_string("b int"))
    assert t.read().columns == ["a", "_cdc_op", "_cdc_source", "_cdc_ts", "_cdc_ingest_ts"]
    t.drop()
    t.drop()
    assert not t.exists()


def test_replace_with_nothing_empties(spark, tmp_path, name):
    t = Target(spark, name, str(tmp_path))
    t.replace(frame(spark, (1, "a")))
    t.replace(frame(spark, (1, "a")).limit(0))
    assert t.exists() and t.read().count() == 0


def test_replace_may_read_itself_and_change_columns(spark, tmp_path, name):
    t = Target(spark, name, str(tmp_path))
    t.replace(frame(spark, (1, "a")))
    t.replace(t.read().withColumn("w", F.lit(5)))
    assert t.read().columns == ["k", "v", "w"] and t.read().first()["w"] == 5


def test_append_evolves(spark, tmp_path, name):
    t = Target(spark, name, str(tmp_path))
    t.append(frame(spark, (1, "a")))
    t.append(frame(spark, (2, 7), ddl="k int, n int"))
    assert {r["k"]: (r["v"], r["n"]) for r in t.read().collect()} == {1: ("a", None), 2: (None, 7)}


def test_merge_creates_updates_and_evolves(spark, tmp_path, name):
    t = Target(spark, name, str(tmp_path), keys=("k",))
    t.merge(stamped(frame(spark, (1, "a"), (2, "b"))))
    t.merge(stamped(frame(spark, (2, "B", 1), (3, "c", 2), ddl="k int, v string, n int"), 5))
    assert state_of(t.read()) == {1: "a", 2: "B", 3: "c"}
    assert "n" in t.read().columns
    left = [p.name for p in (tmp_path / name).iterdir() if p.name.startswith("batch-")]
    assert left == []


def test_drifting_batches(spark, tmp_path, name):
    """A batch that adds a column, drops one and changes the type of a third."""
    t = Target(spark, name, str(tmp_path), keys=("k",))
    t.merge(stamped(frame(spark, (1, 10, "x"), (2, 20, "y"), ddl="k int, n int, gone string")))
    t.merge(stamped(frame(spark, (2, "21", 1.5), (3, "many", 2.5), ddl="k int, n string, added double"), 5))
    rows = {r["k"]: (r["n"], r["gone"], r["added"], r["_rescued"]) for r in t.read().collect()}
    assert rows == {1: (10, "x", None, None), 2: (21, "y", 1.5, None), 3: (None, None, 2.5, '{"n":"many"}')}
    t.merge(stamped(frame(spark, (3, 30), ddl="k int, n int"), 9))
    row = t.read().filter("k = 3").first()
    assert (row["n"], row["added"], row["_rescued"]) == (30, 2.5, None)


def test_rows_without_key_go_to_the_quarantine(spark, tmp_path, name):
    t = Target(spark, name, str(tmp_path), keys=("k",))
    assert t.merge(stamped(frame(spark, (1, "a"), (None, "lost"), (None, "lost too")))) == 2
    assert state_of(t.read()) == {1: "a"}
    assert sorted(r["v"] for r in t.quarantine().read().collect()) == ["lost", "lost too"]
    assert t.merge(stamped(frame(spark, (1, "b")), 5)) == 0


def test_unchanged_columns_are_not_stored(spark, tmp_path, name):
    t = Target(spark, name, str(tmp_path), keys=("k",))
    rules = MergeRules(("k",), unchanged="same")
    t.merge(stamped(frame(spark, (1, "a", []), ddl="k int, v string, same array<string>")), rules)
    t.merge(stamped(frame(spark, (1, None, ["v"]), ddl="k int, v string, same array<string>"), 5), rules)
    assert "same" not in t.read().columns and state_of(t.read()) == {1: "a"}


def test_moved_keys(spark, tmp_path, name):
    t = Target(spark, name, str(tmp_path), keys=("k",))
    rules = MergeRules(("k",), before="before")
    ddl = "k int, v string, before struct<k:int>"
    t.merge(stamped(frame(spark, (1, "a", None), (2, "b", (2,)), ddl=ddl)), rules)
    t.merge(stamped(frame(spark, (9, "moved", (1,)), ddl=ddl), 5), rules)
    assert "before" not in t.read().columns and state_of(t.read()) == {2: "b", 9: "moved"}


def test_merge_without_key_raises(spark, tmp_path, name):
    with pytest.raises(ValueError, match="no key"):
        Target(spark, name, str(tmp_path)).merge(stamped(frame(spark, (1, "a"))))


def test_bucketed_merge_shuffles_only_the_batch(spark, tmp_path, name):
    t = Target(spark, name, str(tmp_path), keys=("k",), buckets=4)
    t.replace(stamped(spark.range(1000).selectExpr("cast(id as int) k", "'a' v")))
    t.merge(stamped(spark.range(500, 1500).selectExpr("cast(id as int) k", "'b' v"), 5))
    assert t.read().count() == 1500 and t.read().filter("v = 'b'").count() == 1000
    folder = t.location().replace("file:", "")
    files = list(__import__("pathlib").Path(folder).glob("*.parquet"))
    assert len(files) <= 8
    described = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    assert described["Num Buckets"] == "4"


@pytest.mark.parametrize("guard,exchanges", [(False, 2), (True, 3)])
def test_bucketed_target_is_not_shuffled(spark, tmp_path, name, plan, guard, exchanges):
    t = Target(spark, name, str(tmp_path), keys=("k",), buckets=4)
    t.replace(stamped(spark.range(1000).selectExpr("cast(id as int) k", "'a' v")))
    stamped(spark.range(10).selectExpr("cast(id as int) k", "'b' v")).write.parquet(str(tmp_path / "batch"))
    batch = t._laid_out(spark.read.parquet(str(tmp_path / "batch")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = apply_latest(t.read(), batch, MergeRules(("k",), guard_late=guard))
        lines = plan(merged).splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Every exchange is one of the batch: below it, the next scan is not that of the table.
    shuffles = [i for i, line in enumerate(lines) if "Exchange" in line]
    scans = [next(line for line in lines[i:] if "FileScan" in line) for i in shuffles]
    assert len(shuffles) >= exchanges and not [s for s in scans if name in s]
    assert sum(name in line and "Bucketed: true" in line for line in lines) >= 1


def test_partition_merge_leaves_other_partitions_alone(spark, tmp_path, name):
    ddl = "k int, v string, p int"
    t = Target(spark, name, str(tmp_path), keys=("k",), partition_by=("p",))
    t.replace(stamped(frame(spark, (1, "a", 1), (2, "b", 2), (3, "c", None), ddl=ddl)))
    folder = __import__("pathlib").Path(t.location().replace("file:", ""))
    before = {f.name for f in (folder / "p=1").glob("*.parquet")}
    t.merge_partitions(stamped(frame(spark, (2, "B", 2), (4, "d", 9), (3, "C", None), ddl=ddl), 5), MergeRules(("k",)))
    assert state_of(t.read()) == {1: "a", 2: "B", 3: "C", 4: "d"}
    assert {f.name for f in (folder / "p=1").glob("*.parquet")} == before


def test_partition_merge_may_empty_a_partition(spark, tmp_path, name):
    ddl = "k int, v string, p string"
    t = Target(spark, name, str(tmp_path), keys=("k",), partition_by=("p",))
    t.replace(stamped(frame(spark, (1, "a", "x y"), (2, "b", "x y"), (3, "c", "z"), ddl=ddl)))
    gone = stamped(frame(spark, (1, None, "x y"), (2, None, "x y"), ddl=ddl), 5).withColumn("_cdc_op", F.lit("delete"))
    t.merge_partitions(gone, MergeRules(("k",)))
    assert state_of(t.read()) == {3: "c"}
    t.merge_partitions(stamped(frame(spark, (4, "d", "x y"), ddl=ddl), 9), MergeRules(("k",)))
    assert state_of(t.read()) == {3: "c", 4: "d"}


def test_partition_merge_that_dies_leaves_whole_partitions(spark, tmp_path, name, monkeypatch):
    ddl = "k int, v string, p string"
    t = Target(spark, name, str(tmp_path), keys=("k", "p"), partition_by=("p",))
    t.replace(stamped(frame(spark, (1, "a", "it's"), (2, "b", "x%y"), ddl=ddl)))
    change = stamped(frame(spark, (1, "A", "it's"), (2, "B", "x%y"), (3, "C", "a/b"), ddl=ddl), 5)
    with monkeypatch.context() as broken:
        broken.setattr(Target, "_relocate", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            t.merge(change)
    assert state_of(t.read()) == {1: "a", 2: "b"}
    for _ in range(2):
        t.merge(change)
        assert state_of(t.read()) == {1: "A", 2: "B", 3: "C"}
    # The first version, the one that died and the first of the two repeats; reads go on.
    assert t.expire_versions(datetime.now() - timedelta(days=1)) == 0
    t.expire_versions(datetime.now() + timedelta(seconds=5))
    assert state_of(t.read()) == {1: "A", 2: "B", 3: "C"}
    assert len([p for p in (tmp_path / name).iterdir() if p.name.startswith("v-")]) == 2


def test_partitions_hold_empty_text_as_null(spark, tmp_path, name):
    ddl = "k int, v string, p string"
    t = Target(spark, name, str(tmp_path), keys=("k",), partition_by=("p",))
    t.replace(stamped(frame(spark, (1, "a", None), (2, "b", "x"), ddl=ddl)))
    t.merge_partitions(stamped(frame(spark, (3, "c", ""), ddl=ddl), 5), MergeRules(("k",)))
    assert state_of(t.read()) == {1: "a", 2: "b", 3: "c"}
    t = Target(spark, name, str(tmp_path), keys=("k", "p"), partition_by=("p",))
    assert t.merge(stamped(frame(spark, (9, "lost", ""), ddl=ddl), 5)) == 1


def test_merge_by_a_key_with_the_partition_rewrites_touched_partitions(spark, tmp_path, name):
    ddl = "k int, v string, p int"
    t = Target(spark, name, str(tmp_path), keys=("k", "p"), partition_by=("p",), sort_by=("v",))
    t.replace(stamped(frame(spark, (1, "a", 1), (2, "b", 2), ddl=ddl)))
    kept = set(t.read().filter("p = 1").inputFiles())
    t.merge(stamped(frame(spark, (2, "B", 2), (1, "c", 3), ddl=ddl), 5))
    assert sorted((r["k"], r["p"], r["v"]) for r in t.read().collect()) == [(1, 1, "a"), (1, 3, "c"), (2, 2, "B")]
    assert set(t.read().filter("p = 1").inputFiles()) == kept
    t.append(stamped(frame(spark, (5, "e", 2), ddl=ddl)))
    assert t.read().filter("p = 2").count() == 2


def test_buckets_and_partitions_exclude_each_other(spark, tmp_path, name):
    with pytest.raises(ValueError, match="either bucketed or partitioned"):
        Target(spark, name, str(tmp_path), keys=("k",), buckets=4, partition_by=("p",))


def test_partitioned_tables_are_replaced_and_merged_whole(spark, tmp_path, name):
    ddl = "k int, v string, p int"
    t = Target(spark, name, str(tmp_path), keys=("k",), partition_by=("p",))
    t.replace(stamped(frame(spark, (1, "a", 1), (2, "b", 2), ddl=ddl)))
    t.replace(stamped(frame(spark, (1, "A", 1), (3, "c", 3), ddl=ddl)))
    assert state_of(t.read()) == {1: "A", 3: "c"}
    t.merge(stamped(frame(spark, (3, "C", 3), (1, "moved", 4), ddl=ddl), 5))
    assert {r["k"]: (r["v"], r["p"]) for r in t.read().collect()} == {1: ("moved", 4), 3: ("C", 3)}
    assert t.read().filter("p = 1").count() == 0


def test_old_versions_expire(spark, tmp_path, name):
    t = Target(spark, name, str(tmp_path))
    for i in range(3):
        t.replace(frame(spark, (i, "a")))
    assert t.expire_versions(datetime.now() - timedelta(days=1)) == 0
    assert t.expire_versions(datetime.now() + timedelta(seconds=5)) == 2
    assert state_of(t.read()) == {2: "a"}


def test_clustered_order(spark):
    df = frame(spark, *[(i % 7 if i % 5 else None, str(i)) for i in range(50)])
    parts = clustered(df, ["k", "missing"]).rdd.glom().collect()
    flat = [r["k"] for p in parts for r in p]
    known = [k for k in flat if k is not None]
    assert known == sorted(known) and flat[-10:] == [None] * 10
    assert clustered(df, ["missing"]) is df


def test_parquet_tables_have_no_row_level_merge(spark, tmp_path, name):
    t = Target(spark, name, str(tmp_path), keys=("k",))
    t.replace(stamped(frame(spark, (1, "a"))))
    assert not supports_row_level(spark, name) and not supports_row_level(spark, "no_such_table")
    with pytest.raises(PySparkException, match="UNSUPPORTED_FEATURE.TABLE_OPERATION"):
        merge_into(stamped(frame(spark, (1, "b"))), name, MergeRules(("k",), guard_late=True))


# --- state


def test_offsets_round_trip_typed(state):
    assert state.get_offset("s", "t") is None
    for value, kind in ((5, "integer"), ("2024-01-01T00:00:00+00:00", "timestamp"), ("x", "string")):
        state.set_offset("s", "t", value, kind)
        assert state.get_offset("s", "t") == value
    state.set_offset("s", "u", 1, "integer")
    state.reset_offset("s", "t")
    assert state.get_offset("s", "t") is None and state.get_offset("s", "u") == 1
    state.reset_offset("s")
    assert state.watermarks().count() == 0


def test_schemas_round_trip(spark, state):
    schema = T.StructType([T.StructField("a", T.IntegerType(), False, {"primary_key": True})])
    state.set_schema("s", "t", schema)
    assert state.get_schema("s", "t") == schema and state.get_schema("s", "u") is None


def test_jobs_keep_their_creation_time(state):
    state.put_job("j", "first", {"a": 1})
    created = state.jobs().first()["created_at"]
    state.put_job("j", "second", {"a": 2}, enabled=False)
    row = state.jobs().collect()
    assert len(row) == 1 and (row[0]["name"], row[0]["enabled"], row[0]["created_at"]) == ("second", False, created)
    assert row[0]["updated_at"] > created


def test_upsert_keeps_created(spark):
    ddl = "id int, v string, created int"
    out = state_upsert(frame(spark, (1, "a", 10), ddl=ddl), frame(spark, (1, "b", 20), (2, "c", 20), ddl=ddl), ["id"], "created")
    assert sorted(tuple(r) for r in out.collect()) == [(1, "b", 10), (2, "c", 20)]


# --- jobs


def job(name, **config):
    return LoadJob.from_config({"id": f"j_{name}", "source_type": "postgres", "tables": ["a"], "target_table": name, **config})


def test_incremental_job(spark, tmp_path, name, state):
    j = job(name, masking={"fields": {"v": "mask"}}, options={"snapshot_cursor_column": "c"})
    ddl = "k int, v string, c int"
    run = lambda *rows: run_job(spark, j, FrameSource({"a": frame(spark, *rows, ddl=ddl)}), str(tmp_path), state, {"a": ("k",)})[0]
    first = run((1, "x", 5), (2, "y", None), (3, "z", 7))
    assert (first.status, first.rows) == ("success", 3) and state.get_offset(j.id, "a") == 7
    second = run((1, "x", 5), (3, "z2", 7), (4, "w", 8), (1, "x9", 9))
    assert second.rows == 2 and state.get_offset(j.id, "a") == 9
    third = run((1, "x", 5))
    assert third.rows == 0 and state.get_offset(j.id, "a") == 9
    assert state_of(spark.table(name)) == {1: "***", 2: "***", 3: "***", 4: "***"}
    assert state.runs().filter("status = 'success'").count() == 3


def test_watermark_never_moves_back(spark, tmp_path, name, state):
    j = job(name, options={"snapshot_cursor_column": "c"})
    for rows in ([(1, "x", 9)], [(1, "x", 5)]):
        run_job(spark, j, FrameSource({"a": frame(spark, *rows, ddl="k int, v string, c int")}), str(tmp_path), state, {"a": ("k",)})
    assert state.get_offset(j.id, "a") == 9


def test_replacing_job_with_an_empty_source(spark, tmp_path, name, state):
    for rows, mode in (([(1, "a")], "ctas"), ([], "full_replace")):
        run_job(spark, job(name, load_mode=mode), FrameSource({"a": frame(spark, *rows)}), str(tmp_path), state)
    assert spark.table(name).count() == 0


def test_full_job_keeps_rows_the_source_lost(spark, tmp_path, name, state):
    for rows in ([(1, "a"), (2, "b")], [(2, "B")]):
        run_job(spark, job(name, load_mode="full"), FrameSource({"a": frame(spark, *rows)}), str(tmp_path), state, {"a": ("k",)})
    assert state_of(spark.table(name)) == {1: "a", 2: "B"}
    assert state.get_offset(f"j_{name}", "a") == "full:done"


@pytest.mark.parametrize("parallel", [1, 3])
def test_one_failing_table_does_not_stop_the_rest(spark, tmp_path, name, state, parallel):
    j = job(name, tables=["a", "missing", "b"], load_mode="ctas")
    good = frame(spark, (1, "a"))
    results = run_job(spark, j, FrameSource({"a": good, "b": good}), str(tmp_path), state, parallel=parallel)
    assert [r.status for r in results] == ["success", "error", "success"]
    assert state.runs().filter("status = 'error'").first()["table_name"] == "missing"
    assert spark.table(f"{name}_b").count() == 1


def test_unknown_source_type_is_a_failed_run(spark, tmp_path, name, state):
    source = ConfiguredSource(spark, {"source_type": "ftp"})
    results = run_job(spark, job(name), source, str(tmp_path), state)
    assert results[0].status == "error" and "unknown source type" in results[0].error


def test_file_job_advances_by_modification_time(spark, tmp_path, name, state):
    import os

    folder = tmp_path / "in" / "a"
    folder.mkdir(parents=True)

    def put(file, text, mtime):
        (folder / file).write_text(text)
        os.utime(folder / file, (mtime, mtime))

    config = {"id": f"j_{name}", "source_type": "s3", "tables": ["a"], "target_table": name,
              "connection": {"path": str(tmp_path / "in")}, "tables_config": {"a": {"max_files_per_run": 1}}}
    j = LoadJob.from_config(config)
    put("1.csv", "k,v\n1,a\n", 1_700_000_000)
    put("2.csv", "k,v\n2,b\n", 1_700_000_100)
    put("3.csv", "k,v\n1,A\n", 1_700_000_200)
    for expected in (1, 1, 1):
        result = run_job(spark, j, ConfiguredSource(spark, config), str(tmp_path / "out"), state, {"a": ("k",)})[0]
        assert (result.status, result.rows) == ("success", expected), result.error
    assert state_of(spark.table(name)) == {"1": "A", "2": "b"}


def test_bad_load_mode():
    with pytest.raises(ValueError, match="unknown load mode"):
        LoadJob.from_config({"id": "x", "source_type": "s3", "load_mode": "sideways"})


# --- copy into


def test_copy_each_file_once_with_options(spark, tmp_path, name, state):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.csv").write_text("k|v\n1| a \n")
    t = Target(spark, name, str(tmp_path / "out"))
    options = {"FIELD_DELIMITER": "|", "TRIM_SPACE": "true"}
    load = lambda **k: copy_into(spark, t, str(folder), state, "csv", options, **k)
    assert load() == 1 and load() == 0
    (folder / "2.csv").write_text("k|v\n2|b\n3|c\n")
    (folder / "skip.txt").write_text("k|v\n9|z\n")
    assert load(pattern=r"\.csv$") == 2
    assert load(files=["skip.txt"]) == 1
    assert state_of(t.read()) == {"1": "a", "2": "b", "3": "c", "9": "z"}
    assert state.ledger().read().count() == 3


def test_keyed_copy_keeps_the_row_of_the_later_file(spark, tmp_path, name, state):
    import os

    folder = tmp_path / "in"
    folder.mkdir()
    for i, (file, text) in enumerate((("b.csv", "k,v\n1,old\n2,b\n"), ("a.csv", "k,v\n1,new\n"))):
        (folder / file).write_text(text)
        os.utime(folder / file, (1_700_000_000 + i, 1_700_000_000 + i))
    t = Target(spark, name, str(tmp_path / "out"), keys=("k",))
    assert copy_into(spark, t, str(folder), state, "csv") == 3
    assert state_of(t.read()) == {"1": "new", "2": "b"}
    assert not [c for c in t.read().columns if c.startswith("__")]


def test_layout_and_write_mode_come_from_the_configuration(spark, tmp_path, name, state):
    table = {"partition_by": ["p"], "sort_by": ["v"], "write_mode": "append", "primary_key": ["k"]}
    j = job(name, load_mode="full", tables_config={"a": table})
    for _ in range(2):
        run_job(spark, j, FrameSource({"a": frame(spark, (1, "x", 7), ddl="k int, v string, p int")}), str(tmp_path), state)
    assert spark.table(name).count() == 2 and "p" in [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
    bad = job(name, tables_config={"a": {"write_mode": "sideways"}})
    (result,) = run_job(spark, bad, FrameSource({"a": frame(spark, (1, "x"))}), str(tmp_path), state)
    assert "unknown write mode" in result.error


def test_later_cursor_wins_within_a_load(spark, tmp_path, name, state):
    rows = [(1, "late", 9), (1, "early", 3), (1, "middle", 5)]
    j = job(name, options={"snapshot_cursor_column": "c"})
    run_job(spark, j, FrameSource({"a": frame(spark, *rows, ddl="k int, v string, c int")}), str(tmp_path), state, {"a": ("k",)})
    assert state_of(spark.table(name)) == {1: "late"}


def test_ledger_is_per_target(spark, tmp_path, name, state, sf):
    for suffix in ("x", "y"):
        t = Target(spark, f"{name}_{suffix}", str(tmp_path))
        assert copy_into(spark, t, f"{sf}/nation.parquet", state) == 25


def test_copy_formats():
    with pytest.raises(ValueError):
        copy_into(None, None, "", None, file_format="xml")
    assert reader_settings({"field_delimiter": ";"})[0].csv_delimiter == ";"
