"""Bounded incremental reads.

One run reads ``lo < cursor <= hi``. ``hi`` is the maximum cursor, taken before the read
and persisted after the commit, so rows tied on the cursor are never split over two runs
and no chunk loop is needed. The bound is a typed literal, which the scan can push down.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cursor types a job may name, and the Spark type they compare as.
CURSOR_TYPES: dict[str, str] = {
    "timestamp": "timestamp",
    "date": "date",
    "integer": "bigint",
    "bigint": "bigint",
    "millis": "bigint",
    "seconds": "bigint",
    "number": "decimal(38,9)",
    "iso": "string",
    "string": "string",
    "timeuuid": "string",
}


EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


class WatermarkError(ValueError):
    """A stored watermark that does not parse; reading everything again would hide it."""


def _parse_instant(value: Any) -> datetime:
    if isinstance(value, datetime):
        return value
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    return datetime.fromisoformat(str(value).replace("Z", "+00:00"))


def parse_watermark(value: Any, cursor_type: str) -> Any:
    """Python value for a stored watermark; raises where it does not fit its type."""
    if cursor_type not in CURSOR_TYPES:
        raise WatermarkError(f"unknown cursor type: {cursor_type}")
    try:
        if cursor_type == "timestamp":
            return _parse_instant(value)
        if cursor_type == "date":
            return _parse_instant(value).date()
        if cursor_type in ("integer", "bigint", "millis", "seconds"):
            number = Decimal(str(value))
            if number != number.to_integral_value():
                raise WatermarkError(f"not a whole number: {value!r}")
            return int(number)
        if cursor_type == "number":
            return Decimal(str(value))
    except (ValueError, InvalidOperation) as exc:
        raise WatermarkError(f"{value!r} is no {cursor_type} watermark") from exc
    return str(value)


def watermark_literal(value: Any, cursor_type: str, data_type: T.DataType | None = None) -> Column:
    """Literal of the type of the cursor column itself, so that no cast stops pushdown."""
    parsed = parse_watermark(value, cursor_type)
    if isinstance(parsed, datetime):
        if isinstance(data_type, T.TimestampNTZType):
            if parsed.tzinfo is not None:
                parsed = parsed.astimezone(timezone.utc).replace(tzinfo=None)
            return F.lit(parsed.isoformat(sep=" ")).cast("timestamp_ntz")
        if parsed.tzinfo is None:
            parsed = parsed.replace(tzinfo=timezone.utc)
        return F.lit(parsed.isoformat(sep=" ")).cast("timestamp")
    if isinstance(parsed, date):
        return F.lit(parsed.isoformat()).cast("date")
    return F.lit(parsed)


def timeuuid_order(col: Column | str) -> Column:
    """Text that sorts version-1 UUIDs by their embedded time."""
    col = F.col(col) if isinstance(col, str) else col
    return F.concat(F.substring(col, 16, 3), F.substring(col, 10, 4), F.substring(col, 1, 8))


def _timeuuid_text(value: Any) -> str:
    text = str(value)
    return text[15:18] + text[9:13] + text[0:8]


def cursor_value(df: DataFrame, cursor: str, cursor_type: str) -> Column:
    """The expression compared with a watermark of the given type."""
    data_type = df.schema[cursor].dataType
    col = F.col(cursor)
    if cursor_type == "timeuuid":
        return timeuuid_order(col)
    if isinstance(data_type, T.StringType) and cursor_type in ("string", "iso"):
        return F.coalesce(col, F.lit(""))
    return col


def _bound(df: DataFrame, cursor: str, value: Any, cursor_type: str) -> Column:
    if cursor_type == "timeuuid":
        return F.lit(_timeuuid_text(value))
    return watermark_literal(value, cursor_type, df.schema[cursor].dataType)


def _above(df: DataFrame, cursor: str, lo: Any, cursor_type: str) -> Column:
    """Nothing is below empty text, so beyond a bound a null is out either way: the bare column is pushed down."""
    col = cursor_value(df, cursor, cursor_type) if cursor_type == "timeuuid" else F.col(cursor)
    return col > _bound(df, cursor, lo, cursor_type)


def cursor_after(df: DataFrame, cursor: str, lo: Any, cursor_type: str) -> DataFrame:
    """Rows strictly after the watermark."""
    return df.filter(_above(df, cursor, lo, cursor_type))


def _back_off(lo: Any, cursor_type: str, lookback: Any) -> Any:
    value = parse_watermark(lo, cursor_type)
    return value - (timedelta(seconds=lookback) if isinstance(value, (datetime, date)) else lookback)


def incremental_range(
    df: DataFrame,
    cursor: str,
    lo: Any = None,
    hi: Any = None,
    cursor_type: str = "timestamp",
    lookback: Any = None,
) -> DataFrame:
    """Rows with ``lo < cursor <= hi``.

    Without ``lo`` this is the first run: rows with a null cursor are included once.
    ``lookback`` (seconds, or units of a numeric cursor) rereads an overlap for late rows.
    """
    col = cursor_value(df, cursor, cursor_type)
    if lo is not None and lookback:
        lo = _back_off(lo, cursor_type, lookback)
    if lo is None:
        if hi is None:
            return df
        return df.filter(F.col(cursor).isNull() | (col <= _bound(df, cursor, hi, cursor_type)))
    df_lo = df.filter(_above(df, cursor, lo, cursor_type))
    if hi is None:
        return df_lo
    top = col if cursor_type == "timeuuid" else F.col(cursor)
    return df_lo.filter(top <= _bound(df, cursor, hi, cursor_type))


def high_watermark(df: DataFrame, cursor: str, cursor_type: str = "") -> DataFrame:
    """One row: the maximum cursor."""
    if cursor_type == "timeuuid":
        return df.agg(F.max_by(cursor, timeuuid_order(cursor)).alias("high_watermark"))
    return df.agg(F.max(cursor).alias("high_watermark"))


def high_watermark_value(df: DataFrame, cursor: str, cursor_type: str = "") -> Any:
    """The scalar itself; the only value that reaches the driver.

    An instant comes back as an aware UTC datetime, whatever the zone of the driver.
    """
    top = high_watermark(df, cursor, cursor_type)
    if not isinstance(df.schema[cursor].dataType, T.TimestampType):
        return top.first()[0]
    micros = top.select(F.unix_micros("high_watermark")).first()[0]
    return None if micros is None else EPOCH + timedelta(microseconds=micros)


def advances(lo: Any, hi: Any, cursor_type: str) -> bool:
    """Whether a new watermark lies past the stored one."""
    if hi is None:
        return False
    if cursor_type == "timeuuid":
        return _timeuuid_text(hi) > _timeuuid_text(lo)
    return parse_watermark(hi, cursor_type) > parse_watermark(lo, cursor_type)


def choose_cursor(
    columns: Sequence[str],
    keys: Sequence[str] = (),
    configured: str | None = None,
    source_default: str | None = None,
) -> str:
    """Configured column, source default, first key column, first column, in that order."""
    if configured:
        return configured
    if source_default and source_default in columns:
        return source_default
    return keys[0] if keys else columns[0]


def topk_cursor(df: DataFrame, cursor: str, n: int, *ties: str) -> DataFrame:
    return df.orderBy(F.col(cursor).asc(), *[F.col(t).asc() for t in ties]).limit(n)


def page_offset(df: DataFrame, cursor: str, offset: int, n: int, *ties: str) -> DataFrame:
    """One page. ``ties`` must make the order total, or pages overlap."""
    return df.orderBy(F.col(cursor).asc(), *[F.col(t).asc() for t in ties]).offset(offset).limit(n)


def date_window(
    today: date, start_after: Any = None, config: Mapping[str, Any] | None = None
) -> tuple[date, date]:
    """First and last day to load. ``start > end`` means nothing is left to load."""
    config = config or {}
    if start_after:
        try:
            return date.fromisoformat(str(start_after)) + timedelta(days=1), today
        except ValueError:
            return today - timedelta(days=30), today
    if config.get("start_date"):
        return date.fromisoformat(str(config["start_date"])), today
    return today - timedelta(days=int(config.get("date_range_days", 30))), today


def filter_date_window(df: DataFrame, column: str, window: tuple[date, date]) -> DataFrame:
    """Rows of the window; ``column`` holds dates or ISO text."""
    start, end = window
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return df.filter(F.col(column).between(start.isoformat(), end.isoformat()))
    if isinstance(kind, T.DateType):
        return df.filter(F.col(column).between(F.lit(start), F.lit(end)))
    upper = end + timedelta(days=1)
    return df.filter(
        (F.col(column) >= watermark_literal(start.isoformat(), "timestamp", kind))
        & (F.col(column) < watermark_literal(upper.isoformat(), "timestamp", kind))
    )


def time_window_limit(
    df: DataFrame,
    column: str,
    earliest: Any,
    latest: Any = None,
    max_count: int | None = None,
    order: Sequence[Column] = (),
) -> DataFrame:
    """Search window, inclusive at its lower edge; ``max_count`` is the search's own limit."""
    kind = df.schema[column].dataType
    out = df.filter(F.col(column) >= watermark_literal(earliest, "timestamp", kind))
    if latest is not None:
        out = out.filter(F.col(column) < watermark_literal(latest, "timestamp", kind))
    if max_count is None:
        return out
    return out.orderBy(F.col(column).desc(), *order).limit(max_count)
