"""Load jobs: read, mask, stamp, write, then move the watermark."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any, Protocol

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.masking import apply_masking
from tidewell.model import CDC_INGEST_TS, CDC_SOURCE, add_cdc_meta, primary_keys, target_name
from tidewell.operators.incremental import advances, choose_cursor, high_watermark_value, incremental_range
from tidewell.operators.merge import MergeRules
from tidewell.plans.state import StateStore
from tidewell.plans.tables import Target
from tidewell.sources.dialects import SOURCE_TYPES, default_cursor, refetched
from tidewell.sources.readers import LANDED
from tidewell.sources.table_formats import PREIMAGE, cdf_to_events
from tidewell.sources.windows import DAY_SETTINGS, SEARCH_SETTINGS, report_days, search, searches

# Load modes; the last two replace the target.
REPLACING = ("ctas", "full_replace")
LOAD_MODES = ("incremental", "full", *REPLACING)
FULL_DONE = "full:done"
# Watermarks of landed pages are kept beside those of the rows.
PAGES = "#pages"
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
WRITE_MODES = ("merge", "append")


class Source(Protocol):
    """What a load reads from."""

    def read(self, table: str, newer_than: Any = None) -> DataFrame | None: ...

    def keys(self, table: str) -> tuple[str, ...]: ...

    def high_watermark(self, table: str, cursor: str, rows: DataFrame, cursor_type: str = "") -> Any: ...


@dataclass(frozen=True)
class FrameSource:
    """Tables given as DataFrames."""

    frames: Mapping[str, DataFrame]

    def read(self, table: str, newer_than: Any = None) -> DataFrame:
        return self.frames[table]

    def keys(self, table: str) -> tuple[str, ...]:
        return ()

    def high_watermark(self, table: str, cursor: str, rows: DataFrame, cursor_type: str = "") -> Any:
        return high_watermark_value(rows, cursor, cursor_type)


@dataclass(frozen=True)
class LoadJob:
    id: str
    source_type: str
    tables: tuple[str, ...]
    name: str = ""
    load_mode: str = "incremental"
    connection: Mapping[str, Any] = field(default_factory=dict)
    tables_config: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    options: Mapping[str, Any] = field(default_factory=dict)
    masking: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    target_table: str | None = None

    @staticmethod
    def from_config(config: Mapping[str, Any]) -> LoadJob:
        mode = config.get("load_mode", "incremental")
        if mode not in LOAD_MODES:
            raise ValueError(f"unknown load mode: {mode}")
        return LoadJob(
            id=config["id"],
            name=config.get("name", config["id"]),
            source_type=config["source_type"],
            tables=tuple(config.get("tables", ())),
            load_mode=mode,
            connection=config.get("connection", {}),
            tables_config=config.get("tables_config", {}),
            options=config.get("options", {}),
            masking=config.get("masking", {}),
            target_table=config.get("target_table"),
        )

    def target_for(self, table: str) -> str:
        """The configured target; several tables of one job get one target each."""
        if not self.target_table:
            return target_name(table, lakehouse=True)
        if len(self.tables) <= 1:
            return self.target_table
        return f"{self.target_table}_{target_name(table, lakehouse=True)}"

    def setting(self, table: str, name: str, default: Any = None) -> Any:
        """What the table's configuration says, else the job's options."""
        return self.tables_config.get(table, {}).get(name, self.options.get(name, default))

    def layout(self, table: str) -> dict[str, Any]:
        listed = {name: tuple(self.setting(table, name) or ()) for name in ("partition_by", "sort_by")}
        return {**listed, "hash_partitions": int(self.setting(table, "hash_partitions") or 0)}

    def write_mode(self, table: str) -> str:
        mode = self.setting(table, "write_mode", "merge")
        if mode not in WRITE_MODES:
            raise ValueError(f"unknown write mode: {mode}")
        return mode

    def cursor_for(self, table: str, df: DataFrame) -> tuple[str, str]:
        """Cursor column and type."""
        config = self.tables_config.get(table, {})
        source = SOURCE_TYPES[self.source_type]
        keys = config.get("primary_key") or primary_keys(df.schema)
        configured = self.options.get("snapshot_cursor_column") or config.get("cursor_column")
        name = choose_cursor(df.columns, keys, configured, default_cursor(self.source_type, table, config))
        return name, config.get("cursor_type") or _cursor_type(df, name) or source.cursor_type


def _cursor_type(df: DataFrame, column: str) -> str | None:
    kind = df.schema[column].dataType.typeName()
    if kind.startswith("timestamp"):
        return "timestamp"
    if kind in ("date", "string"):
        return kind
    if kind in ("byte", "short", "integer", "long"):
        return "integer"
    return "number" if kind.startswith(("decimal", "double", "float")) else None


@dataclass(frozen=True)
class LoadResult:
    table: str
    status: str
    rows: int
    error: str | None
    started_at: datetime
    finished_at: datetime

    @property
    def duration_s(self) -> float:
        return (self.finished_at - self.started_at).total_seconds()


def observed(df: DataFrame) -> tuple[DataFrame, Observation]:
    """Count rows on their way to the target instead of scanning them again."""
    metrics = Observation()
    return df.observe(metrics, F.count(F.lit(1)).alias("rows")), metrics


def _events(job: LoadJob, table: str, rows: DataFrame) -> DataFrame:
    return add_cdc_meta(apply_masking(rows, table, job.masking), source=job.id)


def lists_by_time(job: LoadJob, table: str) -> bool:
    """Whether the watermark is a file's time; a cursor in the data says nothing about files."""
    configured = job.options.get("snapshot_cursor_column") or job.tables_config.get(table, {}).get("cursor_column")
    default = SOURCE_TYPES[job.source_type].default_cursor
    return SOURCE_TYPES[job.source_type].kind in ("files", "blobs") and configured in (None, "", default)


def load_feed(job: LoadJob, table: str, source: Source, target: Target, state: StateStore) -> int:
    """Apply the versions of a change feed that came since the last load; its watermark is the version.

    Deletes are applied, so the table needs a key. A load that died before its watermark was set is repeated.
    """
    last = state.get_offset(job.id, table)
    feed, current = source.changes(table, last)
    if feed is None:
        return 0
    keys = target.keys or tuple(job.tables_config.get(table, {}).get("primary_key", ()))
    if not keys:
        raise ValueError("a change feed needs a primary key")
    feed, metrics = observed(apply_masking(feed, table, job.masking).filter(F.col("_change_type") != PREIMAGE) if "_change_type" in feed.columns else feed)
    if "_change_type" in feed.columns:
        events = cdf_to_events(feed).withColumns({CDC_SOURCE: F.lit(job.id), CDC_INGEST_TS: F.current_timestamp()})
    else:
        events = add_cdc_meta(apply_masking(feed, table, job.masking), source=job.id, seq=F.lit(current).cast("long"))
    target.merge(events, MergeRules(keys))
    state.set_offset(job.id, table, current, "integer")
    return metrics.get["rows"]


def load_table(job: LoadJob, table: str, source: Source, target: Target, state: StateStore) -> int:
    """Load one table; returns the number of rows written."""
    if job.setting(table, "change_feed"):
        return load_feed(job, table, source, target, state)
    lo = state.get_offset(job.id, table) if job.load_mode == "incremental" else None
    lo = None if lo == FULL_DONE else lo
    settings = {**getattr(source, "config", {}).get("connection", {}), **job.tables_config.get(table, {})}
    by_file_time = lists_by_time(job, table)
    if settings.get("max_files_per_run") and (job.load_mode != "incremental" or not by_file_time):
        raise ValueError("max_files_per_run needs an incremental load by file time; it would leave files out")
    newest = None
    if job.load_mode == "incremental" and prunes_pages(job, table):
        newest = source.newest_page(table)
        before = state.get_offset(job.id, table + PAGES) if lo is not None else None
        if newest is None:
            return 0
        rows = source.read(table, pages=(datetime.fromisoformat(before) if before else EPOCH, newest))
    else:
        rows = source.read(table, newer_than=lo if by_file_time else None)
    if rows is None:
        if job.load_mode in REPLACING and target.exists():
            target.replace(target.read().limit(0))
        return 0
    state.note_schema(job.id, table, rows.drop(LANDED).schema)
    keys = target.keys or tuple(job.tables_config.get(table, {}).get("primary_key", ()))
    keys = keys or tuple(primary_keys(rows.schema)) or source.keys(table)
    settings = {**job.options, **settings}
    rows = report_days(job.source_type, table, rows, settings, lo)
    target = target.keyed(keys) if target.hash_partitions else target
    merging = job.write_mode(table) == "merge"
    landed = (LANDED,) if LANDED in rows.columns else ()
    if job.load_mode != "incremental":
        events, metrics = observed(_events(job, table, rows))
        if job.load_mode == "full":
            _write(target, events, keys if merging else (), state.load_id(job.id, table), order_by=landed)
        else:
            target.replace(events.drop(LANDED))
        state.set_offset(job.id, table, FULL_DONE, "string")
        return metrics.get["rows"]

    cursor, cursor_type = job.cursor_for(table, rows)
    rows = search(rows, cursor, settings, lo) if searches(job.source_type, settings) else rows
    keys = keys if merging else ()
    whole = bool(keys) and refetched(job.source_type, table)
    hi = source.high_watermark(table, cursor, rows, cursor_type)
    lookback = job.tables_config.get(table, {}).get("lookback")
    again = searches(job.source_type, settings)
    if (lookback or again) and not keys:
        raise ValueError("a lookback or a search rereads rows, so the table needs a primary key")
    if not whole and not again and lo is not None and not advances(lo, hi, cursor_type):
        if not lookback:
            if newest is not None:
                state.set_offset(job.id, table + PAGES, newest.isoformat(), "timestamp")
            return 0
        hi = lo
    selected = rows if whole or again else incremental_range(rows, cursor, lo, hi, cursor_type, lookback)
    events, metrics = observed(_events(job, table, selected))
    _write(target, events, keys, state.load_id(job.id, table), order_by=(*landed, cursor) if whole else (cursor, *landed))
    if hi is not None:
        state.set_offset(job.id, table, hi, cursor_type)
    if newest is not None:
        state.set_offset(job.id, table + PAGES, newest.isoformat(), "timestamp")
    return metrics.get["rows"]


def prunes_pages(job: LoadJob, table: str) -> bool:
    """Whether a load opens only the pages landed since the last one, that of the last one's time included.

    Not where a part of the rows of old pages may still be to load.
    """
    if not job.setting(table, "new_pages_only"):
        return False
    settings = {**job.options, **job.connection, **job.tables_config.get(table, {})}
    partial = [s for s in (*DAY_SETTINGS, *SEARCH_SETTINGS, "customer_id", "where_clause") if settings.get(s)]
    if partial or table == "audience_counts" or SOURCE_TYPES[job.source_type].kind != "payload":
        raise ValueError(f"new_pages_only would leave rows out: {', '.join(partial) or table}")
    return True


def _write(target: Target, rows: DataFrame, keys: tuple[str, ...], load_id: str, order_by: tuple[str, ...] = ()) -> None:
    """Merge by key, or append where there is none. All rows of a load carry one time, so of
    two with the same key the one with the later cursor is kept. A load that died before its watermark
    was set has the same id when it is repeated, and its rows give way to the repeat's."""
    if keys:
        target.merge(rows, MergeRules(keys, order_by=order_by))
    else:
        target.append(rows.drop(LANDED), load_id)


def run_job(
    spark: SparkSession,
    job: LoadJob,
    source: Source,
    root: str,
    state: StateStore,
    keys: Mapping[str, tuple[str, ...]] | None = None,
    buckets: int = 0,
    parallel: int = 1,
) -> list[LoadResult]:
    """Load every table of a job. A table that fails does not stop the others.

    ``parallel`` tables are loaded at a time; set ``spark.scheduler.mode=FAIR`` for them to
    share the cluster evenly.
    """

    def load(table: str) -> LoadResult:
        started = datetime.now(timezone.utc)
        rows, status, error = 0, "success", None
        try:
            target = Target(spark, job.target_for(table), root, (keys or {}).get(table, ()), buckets, **job.layout(table))
            rows = load_table(job, table, source, target, state)
        except Exception as exc:  # noqa: BLE001 - recorded as a failed run
            status, error = "error", str(exc)
        done = LoadResult(table, status, rows, error, started, datetime.now(timezone.utc))
        state.add_run(
            (uuid.uuid4().hex, job.id, table, status, rows, error, started, done.finished_at, done.duration_s)
        )
        return done

    with ThreadPoolExecutor(max(1, parallel)) as pool:
        return list(pool.map(load, job.tables))
