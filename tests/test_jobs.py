"""Parts of landed pages that configured jobs ask for."""

import json
import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidewell.plans.load import LoadJob, prunes_pages
from tidewell.sources.readers import ConfiguredSource, read_landed
from tidewell.sources.windows import report_days, search, searches


def test_report_days_follow_the_last_one(spark):
    rows = spark.createDataFrame([(f"2024-01-{d:02}",) for d in range(1, 31)], "date string")
    days = lambda settings, last=None: sorted(r[0][-2:] for r in report_days("google_ads", "campaign_performance", rows, settings, last).collect())
    assert days({"date_range_days": 2, "today": "2024-01-10"}) == ["08", "09", "10"]
    assert days({"date_range_days": 2, "today": "2024-01-10"}, "2024-01-09") == ["10"]
    assert days({"start_date": "2024-01-28", "today": "2024-02-10"}) == ["28", "29", "30"]
    assert days({"date_range_days": 2, "today": "2024-01-10"}, "2024-01-10") == []
    assert len(days({"today": "2024-01-10"})) == 30
    assert report_days("google_ads", "campaigns", rows, {"date_range_days": 1}) is rows


@pytest.mark.parametrize("kind", ["timestamp", "string"])
def test_a_search_keeps_all_of_its_last_time(spark, kind):
    rows = spark.createDataFrame([(i, f"2024-01-01 00:00:{s:02}") for i, s in enumerate([1, 2, 2, 2, 3, 4])], "id int, t string")
    rows = rows.withColumn("_time", F.col("t").cast(kind))
    ids = lambda *a: sorted(r.id for r in search(rows, "_time", *a).collect())
    assert ids({"max_count": 2}) == [0, 1, 2, 3]
    assert ids({"max_count": 2}, "2024-01-01T00:00:02") == [1, 2, 3]
    assert ids({"max_count": 4}, "2024-01-01T00:00:02") == [1, 2, 3, 4]
    assert ids({"earliest": "2024-01-01T00:00:03", "latest": "2024-01-01T00:00:04"}) == [4]
    assert ids({"max_count": 2, "earliest": "2030-01-01"}) == []
    assert searches("splunk", {"max_count": 2}) and not searches("splunk", {}) and not searches("zendesk", {"max_count": 2})


def land(folder, table, name, *rows, at=None):
    os.makedirs(folder / table, exist_ok=True)
    path = folder / table / name
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    if at:
        os.utime(path, (at, at))


def test_object_scan_keeps_its_cursor(spark, tmp_path):
    record = {"Id": "1", "Name": "a", "Size": 3, "SystemModstamp": "2024-01-01"}
    land(tmp_path, "Account", "p.json", {"records": [record, {**record, "Id": "2", "Size": 9}]})
    got = read_landed(spark, "salesforce", "Account", str(tmp_path / "Account"), {}, {"fields": ["Id"], "where_clause": "Size > 5"})
    assert got.columns == ["Id", "SystemModstamp"] and [r.Id for r in got.collect()] == ["2"]


@pytest.mark.parametrize(
    "clients,expected",
    [
        ([("2", True, "ENABLED", 1), ("10", False, "ENABLED", 1), ("9", False, "ENABLED", 1)], ["9"]),
        ([("9", False, "ENABLED", 2), ("10", False, "ENABLED", 1)], ["10"]),
        ([("9", False, "CANCELED", 1), ("2", True, "ENABLED", 1)], []),
    ],
)
def test_a_manager_reports_for_its_first_enabled_client(spark, tmp_path, clients, expected):
    land(tmp_path, "accounts", "p.json", {"customer": {"id": "1", "manager": True}})
    land(tmp_path, "customer_clients", "p.json", *({"customerClient": dict(zip(("id", "manager", "status", "level"), c))} for c in clients))
    report = [{"campaign": {"id": i}, "segments": {"date": "2024-01-01"}, "customer": {"id": i}} for i in ("1", "2", "9", "10")]
    land(tmp_path, "campaign_performance", "p.json", *report)
    connection = {"landing": str(tmp_path), "customer_id": 1}
    got = read_landed(spark, "google_ads", "campaign_performance", str(tmp_path / "campaign_performance"), connection)
    assert "customer_id" not in got.columns and [str(r.campaign_id) for r in got.collect()] == expected


def test_pages_outside_the_times_are_not_opened(spark, tmp_path):
    for n, at in enumerate((1_700_000_000, 1_700_000_100, 1_700_000_200)):
        land(tmp_path, "campaigns", f"{n}.json", {"campaign": {"id": n}}, at=at)
    config = {"source_type": "google_ads", "connection": {"landing": str(tmp_path)}}
    source = ConfiguredSource(spark, config)
    newest = source.newest_page("campaigns")
    assert newest.timestamp() == 1_700_000_200
    rows = source.read("campaigns", pages=(datetime.fromtimestamp(1_700_000_100, timezone.utc), newest))
    assert sorted(r.campaign_id for r in rows.collect()) == [1, 2]
    plan = rows.select("campaign_id")._jdf.queryExecution()
    assert plan.toRdd().count() == 2
    assert plan.executedPlan().collectLeaves().apply(0).metrics().apply("numFiles").value() == 2


@pytest.mark.parametrize("setting", [{"max_count": 5}, {"where_clause": "a = 1"}, {"date_range_days": 3}])
def test_new_pages_only_is_refused_where_rows_would_be_left_out(setting):
    job = LoadJob("j", "zendesk", ("t",), tables_config={"t": {"new_pages_only": True, **setting}})
    with pytest.raises(ValueError, match="leave rows out"):
        prunes_pages(job, "t")
    assert prunes_pages(LoadJob("j", "zendesk", ("t",), tables_config={"t": {"new_pages_only": True}}), "t")
