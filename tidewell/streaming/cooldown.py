"""Alert suppression over a stream: the state of a key is the last time it fired."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidewell.plans.tables import BATCH, Target

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastFired(StatefulProcessor):
    """Times of a key that fire. One number a key is kept, for ``ttl_ms`` after it was written if that is given."""

    def __init__(self, keys: Sequence[str], ts: str, cooldown: int, ttl_ms: int | None):
        self.keys, self.ts, self.cooldown, self.ttl_ms = list(keys), ts, cooldown, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "fired bigint", self.ttl_ms)

    def handleInitialState(self, key: Any, initial: pd.DataFrame, timers: Any) -> None:
        self.last.update((int(initial[self.ts].max()),))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        times = np.zeros(0, np.int64)
        for part in rows:
            times = np.union1d(times, part[self.ts].dropna().to_numpy(np.int64))
        fired = []
        at = int(np.searchsorted(times, self.last.get()[0] + self.cooldown)) if self.last.exists() else 0
        while at < len(times):
            fired.append(int(times[at]))
            at = int(np.searchsorted(times, fired[-1] + self.cooldown))
        if not fired:
            return
        self.last.update((fired[-1],))
        out = {name: pd.Series([value] * len(fired), dtype=object) for name, value in zip(self.keys, key)}
        yield pd.DataFrame({**out, self.ts: np.array(fired, np.int64)})

    def close(self) -> None:
        pass


def cooldown_batches(
    alerts: DataFrame,
    fired: Target,
    keys: Sequence[str],
    ts: str,
    cooldown: int,
    checkpoint: str,
    trigger: Mapping[str, object] | None = None,
    ttl_ms: int | None = None,
) -> StreamingQuery:
    """Append the alerts that fire to a table, batch by batch.

    When each key last fired is kept in the stream's own keyed state, so no batch reads what fired before; only
    a stream that begins takes its first state from the table. Batches are appended by their number under the
    stream's checkpoint, so one that is replayed after it was written takes its own place again.
    """
    k, spark = list(keys), fired.spark
    thin = alerts.select(*k, F.col(ts).cast("bigint").alias(ts))
    fired.ensure(thin.schema, meta=False, batches=True)
    stream = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex
    # A first batch that is replayed must not find its own rows.
    before = fired.stored().where(F.col(BATCH) != f"{stream}-0") if BATCH in fired.stored().columns else fired.read()
    heads = before.groupBy(*k).agg(F.max(ts).alias(ts)).where(F.col(ts).isNotNull())
    schema = T.StructType([*(thin.schema[c] for c in k), T.StructField(ts, T.LongType())])
    chains = thin.groupBy(*k).transformWithStateInPandas(
        LastFired(k, ts, cooldown, ttl_ms), schema, "Append", "ProcessingTime" if ttl_ms else "None", heads.groupBy(*k)
    )
    set_before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return (
            chains.writeStream.foreachBatch(lambda batch, number: fired.append(batch, f"{stream}-{number}"))
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
    finally:
        spark.conf.set(PROVIDER, set_before) if set_before else spark.conf.unset(PROVIDER)
