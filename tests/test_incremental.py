import random
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidewell.operators import incremental as I
from tidewell.sources.dialects import default_cursor

PRODUCTS = [
    ("a", datetime(2026, 1, 1)), ("b", datetime(2026, 2, 1)), ("c", datetime(2026, 3, 1)),
    ("d", datetime(2026, 3, 15)), ("e", datetime(2026, 4, 15)),
]


@pytest.fixture
def products(spark):
    return spark.createDataFrame(PRODUCTS, "id string, created_at timestamp_ntz")


def test_cursor_after_a_day(products):
    assert I.cursor_after(products, "created_at", "2026-02-15", "timestamp").count() == 3
    assert I.cursor_after(products, "created_at", "2026-01-15T00:00:00Z", "timestamp").count() == 4


def test_no_watermark_reads_all_with_null_cursors_once(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 9)], "id int, c int")
    assert I.incremental_range(df, "c", None, 5, "integer").count() == 2
    assert I.incremental_range(df, "c", 5, 9, "integer").count() == 1
    assert I.incremental_range(df, "c", None, None, "integer").count() == 3


def test_ties_at_the_edge_are_in_exactly_one_run(spark):
    df = spark.createDataFrame([(i, i // 4) for i in range(20)], "id int, c int")
    first = I.incremental_range(df, "c", None, 2, "integer")
    second = I.incremental_range(df, "c", 2, 4, "integer")
    ids = [r["id"] for r in first.collect()] + [r["id"] for r in second.collect()]
    assert sorted(ids) == list(range(20))


@pytest.mark.parametrize("seed", range(3))
def test_runs_at_any_split_add_up_to_a_full_read(spark, sf, seed):
    rng = random.Random(seed)
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderdate")
    cuts = sorted(date(1995 + rng.randrange(7), rng.randrange(1, 13), rng.randrange(1, 28)).isoformat() for _ in range(3))
    lo, seen = None, 0
    for hi in [*cuts, "2100-01-01"]:
        seen += I.incremental_range(orders, "o_orderdate", lo, hi).count()
        lo = hi
    assert seen == orders.count()


def test_lookback_rereads(spark, products):
    assert I.incremental_range(products, "created_at", "2026-03-01").count() == 2
    assert I.incremental_range(products, "created_at", "2026-03-01", lookback=86_400).count() == 3


@pytest.mark.parametrize(
    "value,kind", [("None", "timestamp"), ("abc", "integer"), ("1.5", "millis"), ("x", "number"), ("1", "colour")]
)
def test_bad_watermarks_raise(value, kind):
    with pytest.raises(I.WatermarkError):
        I.parse_watermark(value, kind)


def test_numbers_compare_as_numbers(spark):
    df = spark.createDataFrame([(9,), (10,), (100,)], "c int")
    assert I.cursor_after(df, "c", "9", "integer").count() == 2


def test_timestamps_with_zone_and_without_agree(spark):
    df = spark.sql("SELECT timestamp'2026-02-01 00:00:00Z' AS z, timestamp_ntz'2026-02-01 00:00:00' AS n")
    for column in ("z", "n"):
        assert I.cursor_after(df, column, "2026-02-01T00:30:00+01:00", "timestamp").count() == 1
        assert I.cursor_after(df, column, "2026-02-01T00:00:00Z", "timestamp").count() == 0


def test_high_watermark_is_an_aware_instant(spark):
    df = spark.sql("SELECT timestamp'2026-02-01 01:02:03.000004Z' AS z")
    assert I.high_watermark_value(df, "z") == datetime(2026, 2, 1, 1, 2, 3, 4, tzinfo=timezone.utc)
    assert I.high_watermark_value(df.limit(0), "z") is None


def test_null_text_cursor_counts_as_empty(spark):
    df = spark.createDataFrame([(None,), ("b",)], "c string")
    assert I.cursor_after(df, "c", "a", "string").count() == 1


def test_timeuuid_orders_by_time(spark):
    early, late = "ffffffff-0000-1000-8000-000000000000", "00000000-0001-1000-8000-000000000000"
    df = spark.createDataFrame([(early,), (late,)], "u string")
    assert [r[0] for r in I.cursor_after(df, "u", early, "timeuuid").collect()] == [late]


def test_bounds_are_pushed_to_the_scan(spark, sf, plan):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    text = plan(I.incremental_range(orders, "o_orderdate", "1997-01-01", "2000-01-01"))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThan(o_orderdate" in text


def test_choose_cursor():
    assert I.choose_cursor(["a", "b"], ["b"], "c") == "c"
    assert I.choose_cursor(["a", "b"], ["b"], None, "a") == "a"
    assert I.choose_cursor(["a", "b"], ["b"], None, "zzz") == "b"
    assert I.choose_cursor(["a", "b"]) == "a"


@pytest.mark.parametrize(
    "source,table,config,expected",
    [
        ("postgres", "t", {}, None), ("mongodb", "t", {}, "_id"), ("clickhouse", "t", {}, "created_at"),
        ("clickhouse", "t", {"cursor_column": "u"}, "u"), ("dynamodb", "t", {"cursor_attribute": "z"}, "z"),
        ("pinot", "t", {}, "eventTime"), ("spanner", "t", {}, "UpdatedAt"), ("cosmos", "t", {}, "_ts"),
        ("hubspot", "owners", {}, "updatedAt"), ("hubspot", "contacts", {}, "hs_lastmodifieddate"),
        ("google_ads", "campaign_performance", {}, "date"), ("google_ads", "campaigns", {}, "campaign_id"),
        ("linkedin_ads", "ad_analytics", {}, "date"), ("linkedin_ads", "campaigns", {}, "last_modified"),
        ("s3", "t", {}, "last_modified"), ("hudi", "t", {}, "_hoodie_commit_time"), ("splunk", "t", {}, "_time"),
        ("salesforce", "t", {"cursor_field": "X"}, "X"), ("delta_lake", "t", {}, "_delta_version"),
    ],
)
def test_default_cursors(source, table, config, expected):
    assert default_cursor(source, table, config) == expected


TODAY = date(2025, 3, 20)


@pytest.mark.parametrize(
    "after,config,expected",
    [
        ("2025-03-15", {}, (date(2025, 3, 16), TODAY)),
        ("2025-03-20", {}, (date(2025, 3, 21), TODAY)),
        (None, {"start_date": "2025-01-01"}, (date(2025, 1, 1), TODAY)),
        (None, {"date_range_days": 7}, (date(2025, 3, 13), TODAY)),
        (None, {}, (date(2025, 2, 18), TODAY)),
        ("not a date", {"start_date": "2025-01-01"}, (date(2025, 2, 18), TODAY)),
    ],
)
def test_date_window(after, config, expected):
    assert I.date_window(TODAY, after, config) == expected


def test_date_window_after_today_is_empty(spark):
    df = spark.createDataFrame([("2025-03-20",), ("2025-03-21",)], "d string")
    assert I.filter_date_window(df, "d", I.date_window(TODAY, "2025-03-20")).count() == 0
    assert I.filter_date_window(df.select(F.to_date("d").alias("d")), "d", (TODAY, TODAY)).count() == 1


def test_search_window_is_inclusive_below(spark):
    df = spark.createDataFrame([(datetime(2026, 1, d),) for d in (1, 2, 3)], "t timestamp_ntz")
    assert I.time_window_limit(df, "t", "2026-01-02").count() == 2
    assert [r[0].day for r in I.time_window_limit(df, "t", "2026-01-01", max_count=1).collect()] == [3]


def test_pages_do_not_overlap(spark):
    df = spark.createDataFrame([(i, i // 5) for i in range(23)], "id int, c int")
    seen = [r["id"] for k in range(0, 25, 5) for r in I.page_offset(df, "c", k, 5, "id").collect()]
    assert sorted(seen) == list(range(23))


def test_watermarks_only_advance():
    assert I.advances("5", 9, "integer") and not I.advances(9, 5, "integer") and not I.advances(5, 5, "integer")
    assert not I.advances(5, None, "integer")
    assert I.advances("2024-01-01T00:00:00+00:00", datetime(2024, 1, 2, tzinfo=timezone.utc), "timestamp")
    early, late = "ffffffff-0000-1000-8000-000000000000", "00000000-0001-1000-8000-000000000000"
    assert I.advances(early, late, "timeuuid") and not I.advances(late, early, "timeuuid")


def test_high_watermark_of_timeuuids(spark):
    early, late = "ffffffff-0000-1000-8000-000000000000", "00000000-0001-1000-8000-000000000000"
    df = spark.createDataFrame([(early,), (late,)], "u string")
    assert I.high_watermark_value(df, "u", "timeuuid") == late
