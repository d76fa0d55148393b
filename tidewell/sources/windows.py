"""What part of an API source a job asks for: days of ad reports, a search over log events."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime, timezone
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.incremental import date_window, filter_date_window, time_window_limit
from tidewell.sources.dialects import SOURCE_TYPES

DAY_SETTINGS = ("start_date", "date_range_days")
SEARCH_SETTINGS = ("earliest", "latest", "max_count")
# A search reaches back this far where nothing says otherwise.
EPOCH = "1970-01-01T00:00:00"


def report_days(source_type: str, table: str, rows: DataFrame, settings: Mapping[str, Any], last: Any = None) -> DataFrame:
    """Rows of an ad report within the days that its settings ask for; other tables, and reports without settings, whole.

    After ``last``, the day loaded before, the days that follow it count; ``today`` may be set.
    """
    if SOURCE_TYPES[source_type].cursor_by_table.get(table) != "date" or not any(settings.get(s) for s in DAY_SETTINGS):
        return rows
    today = settings.get("today")
    today = date.fromisoformat(str(today)) if today else datetime.now(timezone.utc).date()
    return filter_date_window(rows, "date", date_window(today, last, settings))


def searches(source_type: str, settings: Mapping[str, Any]) -> bool:
    return source_type == "splunk" and any(settings.get(s) for s in SEARCH_SETTINGS)


def search(rows: DataFrame, column: str, settings: Mapping[str, Any], last: Any = None) -> DataFrame:
    """Events from ``last`` on, that time included, else from ``earliest``, and before ``latest``.

    ``max_count`` keeps the earliest events, and all of the time of the last kept one: the next search goes on
    from that time and misses none.
    """
    found = time_window_limit(rows, column, last or settings.get("earliest") or EPOCH, settings.get("latest"))
    if not settings.get("max_count"):
        return found
    top = found.select(column).orderBy(column).limit(int(settings["max_count"])).agg(F.max(column).alias("t"))
    return found.filter(F.col(column) <= top.scalar())
