"""From a snapshot to the log: tables read while they change.

A snapshot is taken in ranges of the key, each between two positions of the log. What a range's rows
hold is at least as new as the position before the read, and the log tells what happened after it; so a
snapshot row counts as an event at that position, and whatever the log has for its key later wins. Changes
that fell between the two positions may be in the row already: applying them again ends in the same
row, as a log event carries the whole row. Ranges may be read in any order, and at the same time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.model import CDC_OP
from tidewell.operators.dedup import dedup_last_by_key

SNAPSHOT = "snapshot"


def as_snapshot(rows: DataFrame, position: Column, lsn: str) -> DataFrame:
    """Rows of one range as events at the log position before it was read."""
    return rows.withColumns({CDC_OP: F.lit(SNAPSHOT), lsn: position})


def snapshot_handoff(snapshot: DataFrame, log: DataFrame, keys: Sequence[str], lsn: str) -> DataFrame:
    """The deciding event of each key from snapshot events and log events in one order.

    The log may begin anywhere at or before the first range's position: events that a range already holds are older
    than its rows. At one position the log's event is the later one. The result goes on to a merge,
    and the log is followed from its own last position.
    """
    events = snapshot.unionByName(log, allowMissingColumns=True)
    order = [F.col(lsn).desc_nulls_last(), (F.col(CDC_OP) == SNAPSHOT).asc()]
    return dedup_last_by_key(events, keys, order)
