"""Alert rules and cooldown suppression."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Thresholds, and the seconds in which an alert does not repeat.
LAG_THRESHOLD_S = 60.0
ERROR_THRESHOLD = 5
COOLDOWN_S = 300

# Cooldowns in a block of a key's times.
BLOCK_CELLS = 16
NEVER = -(1 << 62)


def alert_rules(
    status: DataFrame, lag_threshold: float = LAG_THRESHOLD_S, error_threshold: int = ERROR_THRESHOLD
) -> DataFrame:
    """One row per rule a worker breaks: lag above, errors at or above, error state."""
    place = F.concat_ws("/", "source", "table")

    def alert(fires, prefix, kind, message):
        row = F.struct(
            F.concat(F.lit(prefix + ":"), place).alias("alert_key"),
            F.lit(kind).alias("alert_type"),
            message.alias("message"),
        )
        return F.when(fires, row)

    alerts = F.array_compact(
        F.array(
            alert(
                F.col("lag_seconds") > lag_threshold,
                "lag",
                "lag",
                F.format_string(
                    "Lag %.1fs exceeds threshold %.0fs", F.col("lag_seconds").cast("double"), F.lit(float(lag_threshold))
                ),
            ),
            alert(
                F.coalesce("error_count", F.lit(0)) >= error_threshold,
                "errors",
                "errors",
                F.format_string(
                    "Error count %d reached threshold %d", F.col("error_count"), F.lit(error_threshold)
                ),
            ),
            alert(
                F.col("state") == "error",
                "state",
                "worker_error",
                F.concat(F.lit("Worker entered error state: "), F.coalesce("error", F.lit("unknown"))),
            ),
        )
    )
    return status.select("source", "table", F.explode(alerts).alias("a")).select("source", "table", "a.*")


def alert_cooldown(alerts: DataFrame, keys: Sequence[str], ts: str, cooldown: int, cells: int = BLOCK_CELLS) -> DataFrame:
    """Times at which an alert fires when it then stays silent for ``cooldown``.

    ``ts`` is a whole number (seconds, microseconds) and ``cooldown`` has its unit. Suppression
    is a chain along each key: a time fires, and so does the first time at least ``cooldown``
    later. To keep a hot key out of a single task, its times are cut into blocks of ``cells`` cooldowns:

    * a block is a map from when the next alert may fire to the last time that fires in the block. Only times in
      its first cooldown, or the one after those, can be the first to fire there, so the map is short;
    * the maps of a key are applied one after the other, which says when the next alert may fire at
      the start of each block. About one in ``cells`` of a key's times comes to this task, read as a stream;
    * each block then follows its chain by itself.

    Rows are shuffled to blocks, with repeated times gone before, maps to keys, and starts to blocks.
    """
    k = list(keys)
    key = F.struct(*k) if k else F.struct(F.lit(0))
    time = F.col(ts).cast("bigint")
    span = cells * cooldown
    times = alerts.select(*k, time.alias("__t")).where("__t IS NOT NULL")
    block = F.floor(F.col("__t") / F.lit(span)).cast("bigint")
    blocks = times.groupBy(key.alias("__key"), block.alias("__block")).agg(F.sort_array(F.collect_set("__t")).alias("__times"))
    maps = blocks.mapInArrow(_block_maps(cooldown, span), _schema(blocks, "__key", "__block", "__firsts array<bigint>, __lasts array<bigint>"))
    ordered = maps.repartition("__key").sortWithinPartitions("__key", "__block")
    starts = ordered.mapInArrow(_block_starts(cooldown), _schema(blocks, "__key", "__block", "__from bigint"))
    joined = blocks.join(starts, ["__key", "__block"]).select("__key", "__times", "__from")
    fired = joined.mapInArrow(_followed(cooldown), _schema(blocks, "__key", "__fired array<bigint>"))
    each = fired.select("__key", F.explode("__fired").alias("__t"))
    return each.select(*[F.col("__key")[c].alias(c) for c in k], F.col("__t").cast("bigint").alias(ts))


def _schema(df: DataFrame, *columns: str) -> T.StructType:
    """Types of the named columns, then of those given with a type."""
    fields = []
    for c in columns:
        fields += [df.schema[c]] if c in df.columns else T._parse_datatype_string(c).fields
    return T.StructType(fields)


def _lists(column: pa.Array) -> list[np.ndarray]:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.split(values, np.cumsum(column.value_lengths().to_numpy())[:-1])


def _block_maps(cooldown: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            firsts, lasts = [], []
            for number, times in zip(batch.column("__block").to_pylist(), _lists(batch.column("__times"))):
                # From each time to the last of its chain: a time's successor until there is none, by doubling.
                last = np.searchsorted(times, times + cooldown)
                last = np.where(last < len(times), last, np.arange(len(times)))
                while (last[last] != last).any():
                    last = last[last]
                n = int(np.searchsorted(times, number * span + cooldown)) + 1
                ends = times[last[:n]]
                # Of first times that lead to the same end the latest stands for all.
                own = np.flatnonzero(np.r_[ends[1:] != ends[:-1], True])
                firsts.append(times[:n][own])
                lasts.append(ends[own])
            columns = [pa.array(x, pa.list_(pa.int64())) for x in (firsts, lasts)]
            yield pa.RecordBatch.from_arrays([batch.column("__key"), batch.column("__block"), *columns], names=["__key", "__block", "__firsts", "__lasts"])

    return run


def _block_starts(cooldown: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, start = None, NEVER
        for batch in batches:
            out = []
            if not batch.num_rows:
                continue
            for own, firsts, lasts in zip(batch.column("__key").to_pylist(), _lists(batch.column("__firsts")), _lists(batch.column("__lasts"))):
                if own != key:
                    key, start = own, NEVER
                out.append(start)
                at = int(np.searchsorted(firsts, start))
                if at < len(firsts):
                    start = int(lasts[at]) + cooldown
            yield pa.RecordBatch.from_arrays([batch.column("__key"), batch.column("__block"), pa.array(out, pa.int64())], names=["__key", "__block", "__from"])

    return run


def _followed(cooldown: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for times, start in zip(_lists(batch.column("__times")), batch.column("__from").to_pylist()):
                fired, at = [], int(np.searchsorted(times, start))
                while at < len(times):
                    fired.append(int(times[at]))
                    at = int(np.searchsorted(times, fired[-1] + cooldown))
                out.append(fired)
            yield pa.RecordBatch.from_arrays([batch.column("__key"), pa.array(out, pa.list_(pa.int64()))], names=["__key", "__fired"])

    return run
