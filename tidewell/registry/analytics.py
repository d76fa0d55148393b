"""Checked queries: run history and alerts."""

from pyspark.sql import functions as F

from tidewell.operators import alerts as A
from tidewell.operators import runs as R
from tidewell.registry.base import query
from tidewell.registry.inputs import SQL_JOBS, SQL_RUNS, jobs, runs
from tidewell.session import read_table

SQL_LATEST = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY started_at DESC, id DESC) AS rn FROM runs)
"""

SQL_HEALTH = """
recent AS (SELECT * FROM ranked WHERE rn <= 20),
stats AS (
  SELECT job_id, count(*) AS total_runs, avg(CASE status WHEN 'success' THEN 1 ELSE 0 END) AS rate,
    CAST(sum(coalesce(rows, 0)) AS BIGINT) AS total_rows,
    round_even(avg(nullif(duration_s, 0)), 1) AS avg_duration_s,
    max(CASE WHEN rn = 1 THEN status END) AS last_status,
    max(started_at) AS last_started_at
  FROM recent GROUP BY job_id),
errors AS (
  SELECT job_id, string_agg(error, '; ' ORDER BY rn) AS recent_errors
  FROM (SELECT * FROM recent WHERE status = 'error'
        QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY rn) <= 3)
  GROUP BY job_id),
health AS (
  SELECT j.id, j.name,
    CASE WHEN s.job_id IS NULL THEN 'never_run' WHEN last_status = 'error' THEN 'failing'
         WHEN rate >= 0.9 THEN 'healthy' ELSE 'degraded' END AS health,
    round_even(rate, 2) AS success_rate, coalesce(total_runs, 0) AS total_runs,
    coalesce(total_rows, 0) AS total_rows, avg_duration_s, last_status, last_started_at,
    coalesce(recent_errors, '') AS recent_errors
  FROM jobs j LEFT JOIN stats s ON j.id = s.job_id LEFT JOIN errors e ON j.id = e.job_id)
"""


def _health(spark, sf):
    return R.health_by_job(jobs(spark, sf), runs(spark, sf))


@query(f"WITH {SQL_RUNS}, {SQL_JOBS}, {SQL_LATEST}, {SQL_HEALTH} SELECT * FROM health")
def health_by_job(spark, sf):
    return _health(spark, sf).withColumn("recent_errors", F.array_join("recent_errors", "; "))


@query(
    f"""WITH {SQL_RUNS}, {SQL_JOBS}, {SQL_LATEST}, {SQL_HEALTH}
    SELECT count(*) AS total_jobs, count(*) FILTER (health = 'healthy') AS healthy,
      count(*) FILTER (health = 'degraded') AS degraded, count(*) FILTER (health = 'failing') AS failing,
      count(*) FILTER (health = 'never_run') AS never_run FROM health"""
)
def health_totals(spark, sf):
    return R.health_totals(_health(spark, sf))


@query(
    f"""WITH {SQL_RUNS}, {SQL_JOBS}, {SQL_LATEST}
    SELECT j.id, j.name, coalesce(count(r.id), 0) AS total_runs,
      round_even(avg(CASE r.status WHEN 'success' THEN 1 WHEN 'error' THEN 0 END), 2) AS success_rate,
      max(CASE WHEN rn = 1 THEN r.id END) AS last_run_id,
      max(CASE WHEN rn = 1 THEN r.status END) AS last_status,
      max(CASE WHEN rn = 1 THEN r.started_at END) AS last_started_at,
      max(CASE WHEN rn = 1 THEN r.rows END) AS last_rows
    FROM jobs j LEFT JOIN (SELECT * FROM ranked WHERE rn <= 10) r ON j.id = r.job_id
    GROUP BY j.id, j.name"""
)
def pipeline_overview(spark, sf):
    return R.pipeline_overview(jobs(spark, sf), runs(spark, sf))


SQL_GROUPS = """
groups AS (
  SELECT job_id, date_trunc('second', started_at) AS sec, max(started_at) AS started_at,
    CASE WHEN bool_and(status = 'success') THEN 'success' WHEN bool_or(status = 'error') THEN 'error'
         ELSE arg_min(status, rn) END AS status,
    CAST(sum(coalesce(rows, 0)) AS BIGINT) AS rows, count(*) AS tables,
    arg_min(error, rn) FILTER (error IS NOT NULL) AS error, min(rn) AS newest
  FROM ranked WHERE rn <= 20 GROUP BY ALL),
shown AS (
  SELECT * FROM groups QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY newest) <= 8)
"""


@query(
    f"""WITH {SQL_RUNS}, {SQL_LATEST}, {SQL_GROUPS}
    SELECT job_id, started_at, status, rows, tables, error FROM shown"""
)
def run_groups(spark, sf):
    return R.run_groups(runs(spark, sf))


@query(
    f"""WITH {SQL_RUNS}, {SQL_LATEST}, {SQL_GROUPS}
    SELECT job_id, CAST(floor(100 * avg(CASE status WHEN 'success' THEN 1 ELSE 0 END) + 0.5) AS INTEGER)
      AS success_pct FROM shown GROUP BY job_id"""
)
def run_success_pct(spark, sf):
    return R.run_success_pct(R.run_groups(runs(spark, sf)))


@query(
    f"""WITH {SQL_RUNS} SELECT * FROM runs
    QUALIFY row_number() OVER (PARTITION BY job_id, table_name ORDER BY started_at DESC, id DESC) = 1"""
)
def latest_run_per_table(spark, sf):
    return R.latest_run_per_table(runs(spark, sf))


@query(f"WITH {SQL_RUNS}, {SQL_LATEST} SELECT * EXCLUDE (rn) FROM ranked WHERE rn <= 10")
def latest_n_per_job(spark, sf):
    return R.latest_runs(runs(spark, sf), 10)


@query(f"WITH {SQL_RUNS} SELECT * FROM runs ORDER BY started_at DESC, id DESC LIMIT 200")
def list_runs(spark, sf):
    return R.list_runs(runs(spark, sf))


@query(
    f"""WITH {SQL_RUNS}, {SQL_JOBS}, {SQL_LATEST}
    SELECT j.id, j.name, coalesce(s.enabled, true) AS enabled, r.id AS last_run_id,
      r.status AS last_status, r.started_at AS last_started_at
    FROM jobs j
    LEFT JOIN (SELECT s_nationkey AS id, bool_or(s_acctbal > 9000) AS enabled
               FROM supplier GROUP BY s_nationkey) s ON s.id = j.id
    LEFT JOIN ranked r ON r.job_id = j.id AND r.rn = 1"""
)
def jobs_last_run(spark, sf):
    stored = read_table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("id")).agg(
        F.bool_or(F.col("s_acctbal") > 9000).alias("enabled")
    )
    return R.jobs_last_run(jobs(spark, sf), stored, runs(spark, sf)).select(
        "id", "name", "enabled", "last_run_id", "last_status", "last_started_at"
    )


@query(
    f"""WITH {SQL_RUNS}, {SQL_JOBS}, {SQL_LATEST}, {SQL_HEALTH},
    schedule AS (SELECT c_nationkey AS id, max(o_orderdate) AS next_run, min(o_orderdate) AS prev_run
      FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' GROUP BY c_nationkey)
    SELECT j.id, j.name, next_run, prev_run, h.health, h.success_rate,
      coalesce(h.total_runs, 0) AS total_runs, h.avg_duration_s
    FROM jobs j LEFT JOIN schedule s ON s.id = j.id
    LEFT JOIN (SELECT * FROM health WHERE health <> 'never_run') h ON h.id = j.id"""
)
def context_enrich(spark, sf):
    planned = (
        read_table(spark, sf, "orders")
        .filter(F.col("o_orderstatus") == "P")
        .join(read_table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").cast("bigint").alias("id"))
        .agg(F.max("o_orderdate").alias("next_run"), F.min("o_orderdate").alias("prev_run"))
    )
    known = _health(spark, sf).filter(F.col("health") != "never_run")
    return R.context_enrich(jobs(spark, sf), planned, known)


SQL_STATUS = """
status AS (
  SELECT event_type AS source, 'user_' || user_id AS "table",
    date_diff('second', date_trunc('second', max(ts)), (SELECT date_trunc('second', max(ts)) FROM events)) AS lag_seconds,
    count(*) FILTER (value > 80) AS error_count,
    CASE WHEN max(value) > 99 THEN 'error' ELSE 'running' END AS state,
    CASE WHEN max(value) > 99 AND user_id % 2 = 0 THEN 'user ' || user_id END AS error
  FROM events GROUP BY event_type, user_id)
"""


def worker_status(spark, sf):
    """State of one worker per event type and user."""
    events = read_table(spark, sf, "events")
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    newest = events.agg(F.max(seconds).alias("newest")).scalar()
    broken = F.max("value") > 99
    per_worker = events.groupBy("event_type", "user_id").agg(
        F.max(seconds).alias("seen"),
        F.count(F.when(F.col("value") > 80, 1)).alias("error_count"),
        F.when(broken, "error").otherwise("running").alias("state"),
    )
    return per_worker.select(
        F.col("event_type").alias("source"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("table"),
        (newest - F.col("seen")).alias("lag_seconds"),
        "error_count",
        "state",
        F.when(
            (F.col("state") == "error") & (F.col("user_id") % 2 == 0),
            F.concat(F.lit("user "), F.col("user_id").cast("string")),
        ).alias("error"),
    )


@query(
    f"""WITH {SQL_STATUS}
    SELECT source, "table", 'lag:' || source || '/' || "table" AS alert_key, 'lag' AS alert_type,
      'Lag ' || lag_seconds || '.0s exceeds threshold 86400s' AS message
    FROM status WHERE lag_seconds > 86400
    UNION ALL
    SELECT source, "table", 'errors:' || source || '/' || "table", 'errors',
      'Error count ' || error_count || ' reached threshold 5' FROM status WHERE error_count >= 5
    UNION ALL
    SELECT source, "table", 'state:' || source || '/' || "table", 'worker_error',
      'Worker entered error state: ' || coalesce(error, 'unknown') FROM status WHERE state = 'error'"""
)
def alert_rules(spark, sf):
    return A.alert_rules(worker_status(spark, sf), lag_threshold=86_400.0)


COOLDOWN = 6 * 3600


@query(
    f"""WITH RECURSIVE raised AS (
      SELECT DISTINCT event_type AS alert_key, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS t FROM events),
    fired AS (
      SELECT alert_key, min(t) AS t FROM raised GROUP BY alert_key
      UNION ALL
      SELECT f.alert_key, (SELECT min(r.t) FROM raised r WHERE r.alert_key = f.alert_key AND r.t >= f.t + {COOLDOWN})
      FROM fired f WHERE f.t IS NOT NULL)
    SELECT alert_key, t FROM fired WHERE t IS NOT NULL"""
)
def alert_cooldown(spark, sf):
    raised = read_table(spark, sf, "events").select(
        F.col("event_type").alias("alert_key"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t")
    )
    return A.alert_cooldown(raised, ["alert_key"], "t", COOLDOWN)
