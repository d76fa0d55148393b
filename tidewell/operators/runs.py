"""Run-history analytics: health, overviews, run groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.dedup import latest_n

# How many runs each report looks at, and when a job counts as healthy.
HEALTH_RUNS = 20
OVERVIEW_RUNS = 10
GROUP_RUNS = 20
GROUPS_SHOWN = 8
ERRORS_SHOWN = 3
HEALTHY_RATE = 0.9

RUN_ORDER = ("started_at", "id")


def _newest() -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in RUN_ORDER]


def _when() -> Column:
    return F.struct(*[F.col(c) for c in RUN_ORDER])


def latest_runs(runs: DataFrame, n: int, by: str = "job_id") -> DataFrame:
    return latest_n(runs, [by], _newest(), n)


def list_runs(runs: DataFrame, job_id: object | None = None, limit: int = 200) -> DataFrame:
    """Newest runs, of one job or of all."""
    chosen = runs if job_id is None else runs.filter(F.col("job_id") == job_id)
    return chosen.orderBy(*_newest()).limit(limit)


def _success() -> Column:
    return (F.col("status") == "success").cast("int")


def health_by_job(jobs: DataFrame, runs: DataFrame, n: int = HEALTH_RUNS) -> DataFrame:
    """Status of every job over its latest ``n`` runs; at most ``n`` rows per job are grouped."""
    errors = F.collect_list(F.when(F.col("status") == "error", F.struct(*RUN_ORDER, "error")))
    newest_errors = F.slice(F.reverse(F.array_sort(errors)), 1, ERRORS_SHOWN)
    per_job = latest_runs(runs, n).groupBy("job_id").agg(
        F.count("*").alias("total_runs"),
        F.avg(_success()).alias("rate"),
        F.sum(F.coalesce("rows", F.lit(0))).alias("total_rows"),
        F.bround(F.avg(F.nullif("duration_s", F.lit(0.0))), 1).alias("avg_duration_s"),
        F.max_by("status", _when()).alias("last_status"),
        F.max("started_at").alias("last_started_at"),
        F.transform(newest_errors, lambda e: e["error"]).alias("recent_errors"),
    )
    health = (
        F.when(F.col("total_runs").isNull(), "never_run")
        .when(F.col("last_status") == "error", "failing")
        .when(F.col("rate") >= HEALTHY_RATE, "healthy")
        .otherwise("degraded")
    )
    return jobs.join(per_job, jobs["id"] == per_job["job_id"], "left").select(
        *jobs.columns,
        health.alias("health"),
        F.bround("rate", 2).alias("success_rate"),
        F.coalesce("total_runs", F.lit(0)).alias("total_runs"),
        F.coalesce("total_rows", F.lit(0)).alias("total_rows"),
        "avg_duration_s",
        "last_status",
        "last_started_at",
        F.coalesce("recent_errors", F.array().cast("array<string>")).alias("recent_errors"),
    )


def health_totals(health: DataFrame) -> DataFrame:
    counts = [
        F.count(F.when(F.col("health") == s, 1)).alias(s)
        for s in ("healthy", "degraded", "failing", "never_run")
    ]
    return health.agg(F.count("*").alias("total_jobs"), *counts)


def pipeline_overview(jobs: DataFrame, runs: DataFrame, n: int = OVERVIEW_RUNS) -> DataFrame:
    per_job = latest_runs(runs, n).groupBy("job_id").agg(
        F.count("*").alias("total_runs"),
        F.bround(F.avg(_success()), 2).alias("success_rate"),
        F.max_by(F.struct("id", "status", "started_at", "rows"), _when()).alias("last_run"),
    )
    return jobs.join(per_job, jobs["id"] == per_job["job_id"], "left").select(
        *[jobs[c] for c in jobs.columns],
        F.coalesce("total_runs", F.lit(0)).alias("total_runs"),
        "success_rate",
        F.col("last_run.id").alias("last_run_id"),
        F.col("last_run.status").alias("last_status"),
        F.col("last_run.started_at").alias("last_started_at"),
        F.col("last_run.rows").alias("last_rows"),
    )


def run_groups(runs: DataFrame, n: int = GROUP_RUNS, shown: int = GROUPS_SHOWN) -> DataFrame:
    """Latest runs of each job grouped by start second, newest groups first."""
    has_error = F.nullif("error", F.lit("")).isNotNull()
    groups = (
        latest_runs(runs, n)
        .withColumn("started_second", F.date_trunc("SECOND", "started_at"))
        .groupBy("job_id", "started_second")
        .agg(
            F.max(_when()).alias("newest"),
            F.when(F.bool_and(F.col("status") == "success"), "success")
            .when(F.bool_or(F.col("status") == "error"), "error")
            .otherwise(F.max_by("status", _when()))
            .alias("status"),
            F.sum(F.coalesce("rows", F.lit(0))).alias("rows"),
            F.count("*").alias("tables"),
            F.max_by(F.when(has_error, F.col("error")), F.when(has_error, _when())).alias("error"),
        )
    )
    kept = latest_n(groups, ["job_id"], [F.col("newest").desc()], shown)
    return kept.select(
        "job_id", F.col("newest.started_at").alias("started_at"), "status", "rows", "tables", "error"
    )


def run_success_pct(groups: DataFrame) -> DataFrame:
    """Share of all-success groups per job, in whole percent, halves up."""
    return groups.groupBy("job_id").agg(
        F.floor(F.avg(_success()) * 100 + 0.5).cast("int").alias("success_pct")
    )


def latest_run_per_table(runs: DataFrame) -> DataFrame:
    named = runs.filter(F.nullif("table_name", F.lit("")).isNotNull())
    return latest_n(named, ["job_id", "table_name"], _newest(), 1)


def jobs_last_run(jobs: DataFrame, settings: DataFrame, runs: DataFrame) -> DataFrame:
    """Configured jobs with their stored switch (on by default) and their last run."""
    last = latest_runs(runs, 1).select(
        F.col("job_id"),
        F.col("id").alias("last_run_id"),
        F.col("status").alias("last_status"),
        F.col("started_at").alias("last_started_at"),
    )
    switch = settings.select(F.col("id").alias("setting_id"), F.col("enabled").alias("stored_enabled"))
    return (
        jobs.join(switch, F.col("id") == F.col("setting_id"), "left")
        .join(last, F.col("id") == F.col("job_id"), "left")
        .withColumn("enabled", F.coalesce("stored_enabled", F.lit(True)))
        .drop("setting_id", "stored_enabled", "job_id")
    )


def context_enrich(jobs: DataFrame, schedule: DataFrame, health: DataFrame) -> DataFrame:
    """Jobs with their schedule and health; a job without runs has 0 of them."""
    times = schedule.select("id", "next_run", "prev_run")
    status = health.select("id", "health", "success_rate", "total_runs", "avg_duration_s")
    return (
        jobs.join(times, "id", "left")
        .join(status, "id", "left")
        .withColumn("total_runs", F.coalesce("total_runs", F.lit(0)))
    )
