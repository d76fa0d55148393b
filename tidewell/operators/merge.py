"""Applying inserts, updates and deletes to a keyed table.

The target always streams past the changes: an anti join for a plain upsert or delete, a left
join for rules that need the old row (late guard, unchanged columns). Catalyst broadcasts the
changes when their measured size allows and otherwise sorts and merges. Keys are unique on both
sides by then, so no join can be skewed; and the output keeps the partitioning of the target,
so that a target bucketed by its key is neither shuffled for the join nor for the write.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.model import CDC_OP, CDC_SEQ, CDC_TS, META_COLUMNS, RESCUED, payload_columns
from tidewell.operators.dedup import dedup_last_by_key, event_order


def _all(columns: Sequence[Column]) -> Column:
    return reduce(and_, columns)


def _has_null(keys: Sequence[str]) -> Column:
    return reduce(or_, [F.col(k).isNull() for k in keys])


def split_null_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that can match, and the quarantine: SQL equality never matches a null key."""
    return df.filter(~_has_null(keys)), df.filter(_has_null(keys))


def merge_delete(target: DataFrame, deleted: DataFrame, keys: Sequence[str]) -> DataFrame:
    return target.join(deleted.select(*keys), list(keys), "left_anti").select(*target.columns)


def carried_columns(target: DataFrame, changes: DataFrame) -> list[str]:
    """Payload columns the batch does not have: a changed row keeps its stored value in them."""
    return [c for c in payload_columns(target.columns) if c not in changes.columns and c != RESCUED]


def merge_upsert(target: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Changed rows replace their old versions; columns new to the target are added."""
    if carried_columns(target, changes):
        return _apply_with_old_rows(target, changes, MergeRules(tuple(keys), keep_tombstones=True))
    return merge_delete(target, changes, keys).unionByName(changes, allowMissingColumns=True)


def merge_images(
    target: DataFrame, before_keys: DataFrame, changes: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Upsert that also removes the rows known by their before-image key."""
    superseded = before_keys.select(*keys).unionByName(changes.select(*keys))
    return merge_delete(target, superseded, keys).unionByName(changes, allowMissingColumns=True)


def expand_key_changes(events: DataFrame, keys: Sequence[str], before: str = "before") -> DataFrame:
    """Turn an update that moved a key into a delete of the old key and an insert.

    ``before`` is a struct holding at least the key columns. Both halves keep the order of
    the event; the delete carries the payload of the event only to fill its columns.
    """
    moved = (F.col(CDC_OP) == "update") & F.col(before).isNotNull() & ~_all(
        [F.col(f"{before}.{k}").eqNullSafe(F.col(k)) for k in keys]
    )
    struct_of = lambda op, source: F.struct(
        *[
            (F.col(f"{source}.{c}") if source and c in keys else op if c == CDC_OP else F.col(c)).alias(c)
            for c in events.columns
        ]
    )
    halves = F.when(
        moved, F.array(struct_of(F.lit("delete"), before), struct_of(F.lit("insert"), None))
    ).otherwise(F.array(struct_of(F.col(CDC_OP), None)))
    return events.select(F.explode(halves).alias("e")).select("e.*")


@dataclass(frozen=True)
class MergeRules:
    """What to do beyond replacing a row by its newer version.

    ``guard_late`` keeps a stored row whose ``_cdc_ts`` (then ``_cdc_seq``) is later than
    the event. ``keep_tombstones`` stores deletes instead of dropping them, so that a late
    event cannot revive a deleted row; readers filter on ``_cdc_op``. ``unchanged`` names an
    array column listing the columns an update did not send, ``before`` a struct column with
    the key an update moved away from. ``order_by`` names columns that order events of one
    time, latest highest; those starting with ``__`` are not stored.

    ``retention_s`` bounds how long tombstones are kept: the target has a watermark that many seconds of event
    time behind its latest event. Tombstones behind it go when their part of the table is rewritten, and an event
    behind it is applied only to a row that is there to compare it with.
    """

    keys: tuple[str, ...]
    guard_late: bool = False
    keep_tombstones: bool = False
    unchanged: str | None = None
    before: str | None = None
    order_by: tuple[str, ...] = ()
    retention_s: int | None = None

    def __post_init__(self) -> None:
        if self.retention_s is not None and not (self.guard_late and self.keep_tombstones):
            raise ValueError("a retention is of tombstones that guard against late events")

    @property
    def not_stored(self) -> list[str]:
        """Columns of a batch that steer the merge and are no columns of the target."""
        hidden = [c for c in self.order_by if c.startswith("__")]
        return [*filter(None, [self.unchanged, self.before]), *hidden]


def latest_changes(changes: DataFrame, rules: MergeRules, keep_null_keys: bool = False) -> DataFrame:
    """The event that decides each key.

    Rows without a full key decide nothing. ``keep_null_keys`` passes them all on, so that one
    read of the batch yields both the changes and the quarantine.
    """
    keys = list(rules.keys)
    if rules.before:
        changes = expand_key_changes(changes, keys, rules.before).drop(rules.before)
    order = [*event_order(changes), *[F.col(c).desc_nulls_last() for c in rules.order_by]]
    if not keep_null_keys:
        latest = dedup_last_by_key(split_null_keys(changes, keys)[0], keys, order)
    else:
        apart = changes.withColumn("__apart", F.when(_has_null(keys), F.monotonically_increasing_id()))
        latest = dedup_last_by_key(apart, [*keys, "__apart"], order).drop("__apart")
    return latest.drop(*[c for c in rules.not_stored if c != rules.unchanged])


def without_late(latest: DataFrame, stored: DataFrame, keys: Sequence[str], watermark: Column) -> DataFrame:
    """Events but those at or behind the watermark whose key the table does not hold."""
    known = stored.select(*keys).join(latest.select(*keys), list(keys), "left_semi").withColumn("__known", F.lit(True))
    timely = F.col(CDC_TS).isNull() | (F.col(CDC_TS) > watermark) | F.col("__known").isNotNull()
    return latest.join(known, list(keys), "left").filter(timely).drop("__known")


def without_expired(rows: DataFrame, watermark: Column) -> DataFrame:
    """Rows but tombstones at or behind the watermark."""
    return rows.filter((F.col(CDC_OP) != "delete") | F.col(CDC_OP).isNull() | F.col(CDC_TS).isNull() | (F.col(CDC_TS) > watermark))


def apply_changes(target: DataFrame, changes: DataFrame, rules: MergeRules) -> DataFrame:
    """Target after a batch of change events, the last event of each key winning."""
    return apply_latest(target, latest_changes(changes, rules), rules)


def apply_latest(target: DataFrame, latest: DataFrame, rules: MergeRules) -> DataFrame:
    """``apply_changes`` for events already reduced to one per key.

    The events are used more than once: a caller whose batch is costly, or could read
    differently the second time, writes it down first.
    """
    keys = list(rules.keys)
    if rules.guard_late or rules.unchanged or carried_columns(target, latest):
        return _apply_with_old_rows(target, latest, rules)
    kept = merge_delete(target, latest, keys)
    return kept.unionByName(_stored(latest, rules), allowMissingColumns=True)


def _stored(events: DataFrame, rules: MergeRules) -> DataFrame:
    return events if rules.keep_tombstones else events.filter(F.col(CDC_OP) != "delete")


def _apply_with_old_rows(target: DataFrame, latest: DataFrame, rules: MergeRules) -> DataFrame:
    """Target rows beside their event, then the events of keys the target lacks."""
    keys = list(rules.keys)
    event = latest.withColumn("__hit", F.lit(True)).select(
        *keys, F.struct("__hit", *[c for c in latest.columns if c not in keys]).alias("__s")
    )
    both = target.join(event, keys, "left")
    take = F.col("__s").isNotNull()
    order = [c for c in (CDC_TS, CDC_SEQ) if c in target.columns and c in latest.columns]
    if rules.guard_late and order:
        newer = F.struct(*[F.col(f"__s.{c}") for c in order]) >= F.struct(*[F.col(c) for c in order])
        take = take & newer
    both = both.withColumn("__take", F.coalesce(take, F.lit(False)))
    if not rules.keep_tombstones:
        both = both.filter(~(F.col("__take") & (F.col(f"__s.{CDC_OP}") == "delete")))

    names = [*target.columns, *[c for c in latest.columns if c not in target.columns]]

    def pick(name: str) -> Column:
        if name in keys:
            return F.col(name)
        old = F.col(name) if name in target.columns else F.lit(None)
        if name not in latest.columns and (name in META_COLUMNS or name == RESCUED):
            return F.when(~F.col("__take"), old).alias(name)
        if name not in latest.columns:
            return old
        take_new = F.col("__take")
        if rules.unchanged and name in target.columns:
            not_sent = F.array_contains(F.col(f"__s.{rules.unchanged}"), name)
            take_new = take_new & ~F.coalesce(not_sent, F.lit(False))
        return F.when(take_new, F.col(f"__s.{name}")).otherwise(old).alias(name)

    updated = both.select(*[pick(c) for c in names if c != rules.unchanged])
    # Keys only, and with the small side on the right, so that the target is not shuffled for it.
    known = target.select(*keys).join(latest.select(*keys), keys, "left_semi")
    added = _stored(latest.join(known, keys, "left_anti"), rules)
    if rules.unchanged:
        added = added.drop(rules.unchanged)
    return updated.unionByName(added, allowMissingColumns=True)
