import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewell.operators import alerts as A
from tidewell.operators import runs as R

T0 = datetime(2024, 1, 1)
RUNS = (
    "id int, job_id int, table_name string, status string, rows bigint, error string, "
    "started_at timestamp_ntz, duration_s double"
)


def runs(spark, *rows):
    return spark.createDataFrame(
        [(i, j, "t", s, n, f"e{i}" if s == "error" else None, T0 + timedelta(minutes=i), d) for i, (j, s, n, d) in enumerate(rows)],
        RUNS,
    )


def jobs(spark, n):
    return spark.createDataFrame([(i, f"job{i}") for i in range(n)], "id int, name string")


def health(spark, *rows, n=1):
    return R.health_by_job(jobs(spark, n), runs(spark, *rows)).orderBy("id").collect()


def test_statuses(spark):
    ok, bad = (0, "success", 1, 1.0), (0, "error", 0, 1.0)
    assert health(spark)[0]["health"] == "never_run"
    assert health(spark, ok, bad)[0]["health"] == "failing"
    assert health(spark, bad, *[ok] * 9)[0]["health"] == "healthy"
    assert health(spark, bad, *[ok] * 8)[0]["health"] == "degraded"


def test_only_the_latest_twenty_count(spark):
    row = health(spark, *[(0, "error", 100, 9.0)] * 5, *[(0, "success", 1, 2.0)] * 20)[0]
    assert (row["total_runs"], row["total_rows"], row["success_rate"], row["recent_errors"]) == (20, 20, 1.0, [])


def test_durations_of_zero_are_ignored_and_ties_round_to_even(spark):
    row = health(spark, (0, "success", None, 0.0), (0, "success", 5, None), (0, "success", 1, 0.25))[0]
    assert (row["avg_duration_s"], row["total_rows"]) == (0.2, 6)
    one_of_eight = health(spark, *[(0, "error", 0, 1.0)] * 7, (0, "success", 0, 1.0))[0]
    assert one_of_eight["success_rate"] == 0.12
    five_of_eight = health(spark, *[(0, "error", 0, 1.0)] * 3, *[(0, "success", 0, 1.0)] * 5)[0]
    assert five_of_eight["success_rate"] == 0.62


def test_recent_errors_newest_first(spark):
    row = health(spark, *[(0, "error", 0, 1.0)] * 5)[0]
    assert row["recent_errors"] == ["e4", "e3", "e2"]


def test_totals(spark):
    frame = R.health_by_job(jobs(spark, 3), runs(spark, (0, "success", 1, 1.0), (1, "error", 1, 1.0)))
    assert R.health_totals(frame).first().asDict() == dict(total_jobs=3, healthy=1, degraded=0, failing=1, never_run=1)


def test_groups_by_second(spark):
    rows = [
        (1, 0, "a", "success", 1, None, T0, 1.0), (2, 0, "b", "running", 2, None, T0 + timedelta(milliseconds=9), 1.0),
        (3, 0, "a", "success", 4, None, T0 + timedelta(seconds=5), 1.0), (4, 0, "b", "error", 0, "x", T0 + timedelta(seconds=5), 1.0),
        (5, 0, "b", "error", 0, "y", T0 + timedelta(seconds=5), 1.0), (6, 0, "a", "success", None, None, T0 + timedelta(seconds=9), 1.0),
    ]
    groups = R.run_groups(spark.createDataFrame(rows, RUNS))
    out = [(r["status"], r["rows"], r["tables"], r["error"]) for r in groups.orderBy("started_at").collect()]
    assert out == [("running", 3, 2, None), ("error", 4, 3, "y"), ("success", 0, 1, None)]
    assert R.run_success_pct(groups).first()["success_pct"] == 33


def test_last_run_and_switch(spark):
    settings = spark.createDataFrame([(0, False)], "id int, enabled boolean")
    out = R.jobs_last_run(jobs(spark, 2), settings, runs(spark, (0, "error", 0, 1.0), (0, "success", 0, 1.0)))
    rows = {r["id"]: (r["enabled"], r["last_status"]) for r in out.collect()}
    assert rows == {0: (False, "success"), 1: (True, None)}


def test_list_runs(spark):
    frame = runs(spark, *[(i % 2, "success", 1, 1.0) for i in range(30)])
    assert [r["id"] for r in R.list_runs(frame, 1, 3).collect()] == [29, 27, 25]
    assert R.list_runs(frame, limit=20).count() == 20


def test_hot_job_is_cut_before_the_shuffle(spark, plan):
    assert "WindowGroupLimit" in plan(R.health_by_job(jobs(spark, 1), runs(spark, (0, "success", 1, 1.0))))


def test_rules(spark):
    status = spark.createDataFrame(
        [("s", "edge", 60.0, 4, "running", None), ("s", "lag", 60.1, 0, "running", None),
         ("s", "errs", None, 5, "running", None), ("s", "all", 99.0, 9, "error", "boom"), ("s", "dead", None, None, "error", None)],
        "source string, table string, lag_seconds double, error_count int, state string, error string",
    )
    out = {(r["table"], r["alert_type"]): r["message"] for r in A.alert_rules(status).collect()}
    assert out == {
        ("lag", "lag"): "Lag 60.1s exceeds threshold 60s",
        ("errs", "errors"): "Error count 5 reached threshold 5",
        ("all", "lag"): "Lag 99.0s exceeds threshold 60s",
        ("all", "errors"): "Error count 9 reached threshold 5",
        ("all", "worker_error"): "Worker entered error state: boom",
        ("dead", "worker_error"): "Worker entered error state: unknown",
    }


def fold(times, cooldown):
    fired, last = [], None
    for t in sorted(times):
        if last is None or t - last >= cooldown:
            fired.append(t)
            last = t
    return fired


def cooled(spark, by_key, cooldown):
    frame = spark.createDataFrame([(k, t) for k, ts in by_key.items() for t in ts], "k string, t bigint")
    out = {}
    for r in A.alert_cooldown(frame, ["k"], "t", cooldown).collect():
        out.setdefault(r["k"], []).append(r["t"])
    return {k: sorted(v) for k, v in out.items()}


def test_refire_exactly_at_cooldown(spark):
    assert cooled(spark, {"a": [0, 100, 300, 599, 600]}, 300) == {"a": [0, 300, 600]}


@pytest.mark.parametrize("seed", range(3))
def test_random_alerts_agree_with_a_fold(spark, seed):
    rng = random.Random(seed)
    spread = [40, 400, 4000][seed]
    by_key = {k: [rng.randrange(-50, spread) for _ in range(rng.randrange(1, 80))] for k in "abcd"}
    assert cooled(spark, by_key, 10) == {k: fold(v, 10) for k, v in by_key.items()}


def test_hot_key_with_a_long_chain(spark):
    by_key = {"hot": list(range(0, 900, 3)), "cold": [5]}
    assert cooled(spark, by_key, 10) == {k: fold(v, 10) for k, v in by_key.items()}


def test_cooldown_with_null_and_composite_keys_and_blocks(spark):
    rows = [(k, j, t) for k in ("x", None) for j in (1, None) for t in range(-200, 500, 7)] + [("x", 1, None)]
    frame = spark.createDataFrame(rows, "k string, j int, t bigint")
    got = {}
    for r in A.alert_cooldown(frame, ["k", "j"], "t", 10, cells=3).collect():
        got.setdefault((r.k, r.j), []).append(r.t)
    want = fold([t for _, _, t in rows[:100]], 10)
    assert {k: sorted(v) for k, v in got.items()} == dict.fromkeys([(k, j) for k in ("x", None) for j in (1, None)], want)


def test_cooldown_shuffles_three_times_and_keeps_nothing(spark, plan):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"))
        text = plan(A.alert_cooldown(frame, ["k"], "t", 10))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = {line.split("Exchange ")[1].split(" ENSURE")[0].split("#")[0] for line in text.splitlines() if "Exchange hashpartitioning" in line}
    assert 0 < len(exchanges) <= 3 and "Checkpoint" not in text and "CartesianProduct" not in text
