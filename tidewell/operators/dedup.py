"""Keyed deduplication and latest-n selection.

``row_number() <= n`` lets Catalyst place a partial group limit before the shuffle, so
a map task sends at most n rows per key however many rows that key has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.model import CDC_OP, CDC_SEQ, CDC_TS

_RANK = "__rank"


def event_order(df: DataFrame) -> list[Column]:
    """Newest first; ``ts`` alone ties, so the sequence decides when there is one."""
    return [F.col(c).desc_nulls_last() for c in (CDC_TS, CDC_SEQ) if c in df.columns]


def latest_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_RANK, F.row_number().over(window)).filter(F.col(_RANK) <= n).drop(_RANK)


def dedup_last_by_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None
) -> DataFrame:
    """The last event of every key. ``order`` is newest first and must be total."""
    return latest_n(df, keys, order or event_order(df), 1)


def current_state(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Live rows of an append-only event log."""
    return dedup_last_by_key(log, keys).filter(F.col(CDC_OP) != "delete")
