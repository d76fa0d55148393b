import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewell.operators import merge as M
from tidewell.operators.dedup import current_state, dedup_last_by_key, latest_n

T0 = datetime(2024, 1, 1)
EVENTS = "k int, v string, _cdc_op string, _cdc_ts timestamp_ntz, _cdc_seq int"


def at(n):
    return T0 + timedelta(seconds=n)


def events(spark, *rows):
    return spark.createDataFrame([(k, v, op, at(t), s) for k, v, op, t, s in rows], EVENTS)


def target(spark, *rows):
    return spark.createDataFrame(list(rows), "k int, v string")


RULES = M.MergeRules(("k",))


def state(df):
    return {r["k"]: r["v"] for r in df.collect()}


def test_last_event_wins_with_sequence_tie(spark):
    ev = events(spark, (1, "a", "insert", 0, 1), (1, "b", "update", 0, 2), (2, "c", "insert", 5, 1))
    assert state(dedup_last_by_key(ev, ["k"])) == {1: "b", 2: "c"}


def test_delete_then_reinsert_and_insert_then_delete(spark):
    ev = events(
        spark, (1, "x", "delete", 1, 1), (1, "y", "insert", 2, 2), (2, "z", "insert", 1, 3), (2, "z", "delete", 2, 4)
    )
    assert state(M.apply_changes(target(spark, (1, "old"), (3, "keep")), ev, RULES)) == {1: "y", 3: "keep"}
    assert state(current_state(ev, ["k"])) == {1: "y"}


def test_split_over_two_batches_gives_the_same(spark):
    rows = [(1, "x", "delete", 1, 1), (1, "y", "insert", 2, 2), (2, "z", "insert", 1, 3), (2, "z", "delete", 2, 4)]
    start = target(spark, (1, "old"))
    once = M.apply_changes(start, events(spark, *rows), RULES)
    twice = M.apply_changes(M.apply_changes(start, events(spark, *rows[:3]), RULES), events(spark, *rows[3:]), RULES)
    assert state(once) == state(twice)


def test_null_keys_never_match_and_are_quarantined(spark):
    ev = events(spark, (None, "lost", "insert", 1, 1), (1, "b", "update", 1, 2))
    good, bad = M.split_null_keys(ev, ["k"])
    assert state(good) == {1: "b"} and bad.count() == 1
    merged = M.apply_changes(target(spark, (None, "stored"), (1, "a")), ev, RULES)
    assert state(merged) == {None: "stored", 1: "b"}


def test_composite_key_with_one_null_part(spark):
    t = spark.createDataFrame([(1, 1, "a"), (1, None, "b")], "k int, j int, v string")
    c = spark.createDataFrame([(1, 1, "A"), (1, None, "B")], "k int, j int, v string")
    good, bad = M.split_null_keys(c, ["k", "j"])
    merged = M.merge_upsert(t, good, ["k", "j"])
    assert sorted(r["v"] for r in merged.collect()) == ["A", "b"] and bad.count() == 1


def test_key_change_removes_the_old_row(spark):
    ev = events(spark, (9, "moved", "update", 1, 1)).withColumn("before", F.struct(F.lit(1).alias("k")))
    changes = M.expand_key_changes(ev, ["k"]).drop("before")
    assert sorted((r["k"], r["_cdc_op"]) for r in changes.collect()) == [(1, "delete"), (9, "insert")]
    assert state(M.apply_changes(target(spark, (1, "a"), (2, "b")), changes, RULES)) == {9: "moved", 2: "b"}


def test_unchanged_key_is_not_expanded(spark):
    ev = events(spark, (1, "n", "update", 1, 1)).withColumn("before", F.struct(F.lit(1).alias("k")))
    assert [r["_cdc_op"] for r in M.expand_key_changes(ev, ["k"]).collect()] == ["update"]


def stored(spark, *rows):
    return spark.createDataFrame([(k, v, op, at(t), s) for k, v, op, t, s in rows], EVENTS)


def test_late_events_lose(spark):
    rules = M.MergeRules(("k",), guard_late=True)
    t = stored(spark, (1, "new", "update", 10, 1), (2, "old", "update", 1, 1))
    ev = events(spark, (1, "late", "update", 5, 1), (2, "newer", "update", 5, 1), (3, "added", "insert", 5, 1))
    assert state(M.apply_changes(t, ev, rules)) == {1: "new", 2: "newer", 3: "added"}


def test_late_delete_loses_and_tombstone_stops_revival(spark):
    rules = M.MergeRules(("k",), guard_late=True, keep_tombstones=True)
    t = stored(spark, (1, "new", "update", 10, 1))
    t = M.apply_changes(t, events(spark, (1, None, "delete", 5, 1)), rules)
    assert state(t) == {1: "new"}
    t = M.apply_changes(t, events(spark, (1, None, "delete", 20, 1)), rules)
    t = M.apply_changes(t, events(spark, (1, "late", "insert", 15, 1)), rules)
    assert [(r["k"], r["_cdc_op"]) for r in t.collect()] == [(1, "delete")]


def test_unchanged_columns_keep_the_stored_value(spark):
    rules = M.MergeRules(("k",), unchanged="unchanged")
    t = spark.createDataFrame([(1, "big", 1), (2, "big2", 2)], "k int, v string, n int")
    ev = spark.createDataFrame(
        [(1, None, 10, "update", at(1), ["v"]), (2, "set", 20, "update", at(1), []), (3, None, 30, "insert", at(1), ["v"])],
        "k int, v string, n int, _cdc_op string, _cdc_ts timestamp_ntz, unchanged array<string>",
    )
    out = M.apply_changes(t, ev, rules)
    assert "unchanged" not in out.columns
    assert {r["k"]: (r["v"], r["n"]) for r in out.collect()} == {1: ("big", 10), 2: ("set", 20), 3: (None, 30)}


def test_new_columns_are_added(spark):
    c = spark.createDataFrame([(2, "b", 5)], "k int, v string, extra int")
    out = M.merge_upsert(target(spark, (1, "a")), c, ["k"])
    assert {r["k"]: r["extra"] for r in out.collect()} == {1: None, 2: 5}


def brute(start, evs, guard):
    rows = dict(start)
    last = {}
    for e in evs:
        if e[0] not in last or (e[3], e[4]) > (last[e[0]][3], last[e[0]][4]):
            last[e[0]] = e
    for k, (_, v, op, t, s) in last.items():
        if guard and k in rows and (rows[k][1], rows[k][2]) > (t, s):
            continue
        if op == "delete":
            rows.pop(k, None)
        else:
            rows[k] = (v, t, s)
    return {k: r[0] for k, r in rows.items()}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("guard", [False, True])
def test_random_batches_agree_with_brute_force(spark, seed, guard):
    rng = random.Random(seed)
    evs = [
        (rng.randrange(12), f"v{i}", rng.choice(["insert", "update", "delete"]), rng.randrange(6), i) for i in range(60)
    ]
    start = {k: (f"s{k}", rng.randrange(6), -1) for k in range(0, 16, 2)}
    t = stored(spark, *[(k, v, "insert", ts, s) for k, (v, ts, s) in start.items()])
    rules = M.MergeRules(("k",), guard_late=guard)
    shuffled = rng.sample(evs, len(evs))
    assert state(M.apply_changes(t, events(spark, *shuffled), rules)) == brute(start, evs, guard)


def test_merge_is_idempotent(spark, rows):
    ev = events(spark, (1, "a", "update", 1, 1), (2, "b", "insert", 1, 2), (3, "c", "delete", 1, 3))
    start = target(spark, (1, "x"), (3, "y"), (4, "z"))
    once = M.apply_changes(start, ev, RULES)
    assert rows(once, "k", "v") == rows(M.apply_changes(once, ev, RULES), "k", "v")


def test_empty_sides(spark):
    none = events(spark).limit(0)
    assert state(M.apply_changes(target(spark, (1, "a")), none, RULES)) == {1: "a"}
    assert state(M.apply_changes(target(spark).limit(0), events(spark, (1, "a", "insert", 1, 1)), RULES)) == {1: "a"}


def test_merge_images(spark):
    before = spark.createDataFrame([(1,)], "k int")
    after = target(spark, (9, "moved"))
    assert state(M.merge_images(target(spark, (1, "a"), (9, "old"), (2, "b")), before, after, ["k"])) == {2: "b", 9: "moved"}


def test_rank_limit_reaches_the_map_side(spark, plan):
    ev = events(spark, (1, "a", "insert", 0, 1))
    for df in (dedup_last_by_key(ev, ["k"]), latest_n(ev, ["k"], [F.col("_cdc_ts").desc()], 20)):
        text = plan(df)
        assert "Partial" in text and "WindowGroupLimit" in text


def test_small_batch_does_not_shuffle_the_target(spark, plan, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    batch = orders.limit(10)
    text = plan(M.merge_upsert(orders, batch, ["o_orderkey"]))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_columns_missing_from_the_batch_keep_their_value(spark):
    t = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, v string, n int")
    c = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    expected = {1: ("a", 10), 2: ("B", 20), 3: ("c", None)}
    assert {r["k"]: (r["v"], r["n"]) for r in M.merge_upsert(t, c, ["k"]).collect()} == expected
    out = M.apply_changes(t, events(spark, (2, "B", "update", 1, 1), (3, "c", "insert", 1, 1)), RULES)
    assert {r["k"]: (r["v"], r["n"]) for r in out.collect()} == expected


def test_null_key_rows_are_all_passed_on(spark):
    ev = events(spark, (None, "x", "insert", 1, 1), (None, "x", "insert", 1, 1), (1, "a", "insert", 1, 1), (1, "b", "update", 2, 1))
    kept = M.latest_changes(ev, RULES, keep_null_keys=True).collect()
    assert sorted((r["k"] or 0, r["v"]) for r in kept) == [(0, "x"), (0, "x"), (1, "b")]


def test_hot_key_is_cut_before_the_shuffle_with_null_keys_too(spark, plan):
    ev = events(spark, (1, "a", "insert", 1, 1))
    assert "WindowGroupLimit" in plan(M.latest_changes(ev, RULES, keep_null_keys=True))
