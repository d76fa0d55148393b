import random
import uuid
from contextlib import suppress
from datetime import datetime, timedelta

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidewell.operators.merge import MergeRules, apply_changes
from tidewell.plans.tables import Target
from tidewell.registry.recovery import DiesAfterAppend
from tidewell.streaming import cdc
from tidewell.streaming.cooldown import cooldown_batches
from tidewell.streaming.pipe import dedupe_notifications, file_stream, ingest

T0 = datetime(2024, 1, 1)
DDL = "k int, v string, _cdc_op string, _cdc_ts timestamp, _cdc_seq int"


def done(q):
    q.awaitTermination()
    assert q.exception() is None


def test_codes_and_images(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (9, "e")], "code int, v string")
    out = cdc.normalize_ops(df, "sqlserver", "code")
    assert [(r["v"], r["_cdc_op"]) for r in out.collect()] == [("a", "delete"), ("b", "insert"), ("d", "update")]
    routed = cdc.route_images(out, "v").collect()
    assert [(r["before"], r["after"]) for r in routed] == [("a", None), (None, "b"), (None, "d")]
    for engine, code, op in (("mongodb", "replace", "update"), ("mysql", "write", "insert"), ("postgres", "D", "delete")):
        row = cdc.normalize_ops(spark.createDataFrame([(code,)], "c string"), engine, "c").first()
        assert row["_cdc_op"] == op


def test_positions(spark):
    df = spark.createDataFrame([("00A",), ("00F",), ("010",)], "lsn string")
    assert cdc.lsn_range(df, "lsn", "00A", "010").count() == 2
    assert cdc.lsn_range(df, "lsn", "snap:done").count() == 3
    assert cdc.lsn_range(df, "lsn", None, "00A").count() == 1


def test_routing_prefers_the_full_name(spark):
    df = spark.createDataFrame([("public.a",), ("a",), ("other.a",), ("b",)], "source_table string")
    routed = {t: sorted(r[0] for r in f.collect()) for t, f in cdc.split_by_table(df, ["public.a", "a"]).items()}
    assert routed == {"public.a": ["public.a"], "a": ["a", "other.a"]}
    assert cdc.only_tables(df, ["public.a"]).count() == 2


def test_stream_equals_batch_and_replay_changes_nothing(spark, tmp_path):
    rng = random.Random(3)
    rows = [
        (rng.randrange(8), f"v{i}", rng.choice(["insert", "update", "delete"]), T0 + timedelta(seconds=rng.randrange(20)), i)
        for i in range(80)
    ]
    for n in range(4):
        spark.createDataFrame(rows[n * 20:(n + 1) * 20], DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    target = Target(spark, f"t_{uuid.uuid4().hex[:8]}", str(tmp_path / "out"), ("k",))
    rules = MergeRules(("k",), guard_late=True, keep_tombstones=True)
    for checkpoint in ("c1", "c2"):
        stream = file_stream(spark, str(tmp_path / "in"), DDL, max_files=1).drop("_source_file", "last_modified")
        done(cdc.apply_stream(stream, {"t": target}, rules, str(tmp_path / checkpoint)))
        live = target.read().filter("_cdc_op <> 'delete'")
        batch = spark.createDataFrame(rows, DDL)
        expected = apply_changes(batch.limit(0), batch, MergeRules(("k",)))
        got = sorted((r["k"], r["v"]) for r in live.collect())
        assert got == sorted((r["k"], r["v"]) for r in expected.collect())


def test_append_mode_repeats_a_batch_in_its_place(spark, tmp_path):
    tag = uuid.uuid4().hex[:8]
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").coalesce(1).write.parquet(str(tmp_path / "in"))
    target = Target(spark, f"log_{tag}", str(tmp_path / "out"))
    for checkpoint in ("c1", "c2"):
        # A second checkpoint replays batch 0, as a crash before the checkpoint commit would.
        stream = spark.readStream.schema("k int, v string").parquet(str(tmp_path / "in"))
        done(cdc.apply_stream(stream, {"t": target}, {}, str(tmp_path / checkpoint), "append", tag))
    assert target.read().count() == 2


def test_file_ingest_takes_each_file_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(3):
        spark.range(n * 10, n * 10 + 10).coalesce(1).write.mode("append").parquet(src)
        done(ingest(file_stream(spark, src, "id bigint", max_files=1), out, str(tmp_path / "c")))
    ids = sorted(r["id"] for r in spark.read.parquet(out).collect())
    assert ids == list(range(30))


def test_notices_are_deduplicated_within_the_lookback(spark, tmp_path):
    rows = [("a", T0), ("a", T0 + timedelta(days=3)), ("b", T0), ("a", T0 + timedelta(minutes=1))]
    spark.createDataFrame(rows, "path string, sent_at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, sent_at timestamp").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    q = dedupe_notifications(stream).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "c")
    ).trigger(availableNow=True).start()
    done(q)
    assert sorted(r["path"] for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_cooldown_by_batches_carries_on_and_survives_a_replay(spark, tmp_path):
    src = str(tmp_path / "in")
    name, root = f"fired_{uuid.uuid4().hex[:8]}", str(tmp_path / "out")
    fired = Target(spark, name, root)
    start = lambda checkpoint, target: cooldown_batches(
        spark.readStream.schema("k string, t bigint").parquet(src), target, ["k"], "t", 300, str(tmp_path / checkpoint)
    )
    for times in ([0, 100, 300, 300], [599, 600, 700], [900, 100]):
        rows = [("a", t) for t in times] + [("b", times[0])]
        spark.createDataFrame(rows, "k string, t bigint").coalesce(1).write.mode("append").parquet(src)
        # The batch is written, the stream dies before its checkpoint says so, and the restart repeats it.
        with suppress(StreamingQueryException):
            start("c", DiesAfterAppend(spark, name, root)).awaitTermination()
        q = start("c", fired)
        done(q)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 2
    got = lambda: sorted((r["k"], r["t"]) for r in fired.read().collect())
    expected = [("a", 0), ("a", 300), ("a", 600), ("a", 900), ("b", 0), ("b", 599), ("b", 900)]
    assert got() == expected
    # A stream that begins goes on from the table.
    done(start("other", fired))
    assert got() == expected
