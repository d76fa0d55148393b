"""Jobs as configuration: a list of load jobs and copy jobs."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import SparkSession

from tidewell.plans.copy_into import copy_into
from tidewell.plans.load import LoadJob, LoadResult, run_job
from tidewell.plans.state import StateStore
from tidewell.plans.tables import Target
from tidewell.sources.readers import ConfiguredSource


def parse_config(text: str) -> dict[str, Any]:
    """A configuration in JSON, or in YAML where a YAML reader is installed."""
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as exc:
            raise ValueError("the configuration is no JSON, and no YAML reader is installed") from exc
        return yaml.safe_load(text)


def run_copy_job(spark: SparkSession, config: Mapping[str, Any], root: str, state: StateStore) -> list[LoadResult]:
    """One copy job, recorded as a run like any other load."""
    started = datetime.now(timezone.utc)
    rows, status, error = 0, "success", None
    location, name = config["source_location"], config["target_table"]
    try:
        rows = copy_into(
            spark,
            Target(spark, name, root, tuple(config.get("primary_key", ()))),
            location,
            state,
            config.get("file_format", "parquet"),
            config.get("format_options"),
            config.get("files"),
            config.get("pattern"),
        )
    except Exception as exc:  # noqa: BLE001 - recorded as a failed run
        status, error = "error", str(exc)
    done = LoadResult(location, status, rows, error, started, datetime.now(timezone.utc))
    state.add_run(
        (uuid.uuid4().hex, config["id"], location, status, rows, error, started, done.finished_at, done.duration_s)
    )
    return [done]


def run_configured(
    spark: SparkSession, config: Mapping[str, Any], root: str, state: StateStore
) -> dict[str, list[LoadResult]]:
    """Run the jobs of a configuration one after the other.

    Keys of a table are its ``primary_key`` in ``tables_config``; ``options.buckets`` and
    ``options.parallel`` set the layout of new targets and how many tables load at a time.
    """
    results = {}
    for job_config in config.get("jobs", ()):
        if job_config["source_type"] == "copy_into":
            results[job_config["id"]] = run_copy_job(spark, job_config, root, state)
            continue
        job = LoadJob.from_config(job_config)
        keys = {t: tuple(c["primary_key"]) for t, c in job.tables_config.items() if c.get("primary_key")}
        results[job.id] = run_job(
            spark, job, ConfiguredSource(spark, job_config), root, state, keys,
            int(job.options.get("buckets", 0)), int(job.options.get("parallel", 1)),
        )
    return results
