import json

import pytest
from pyspark.sql import functions as F

from tidewell.functions.scalars import ad_metrics, date_from_parts, ms_to_date, urn_id
from tidewell.sources import payloads as P


def landed(spark, tmp_path, *objects):
    path = tmp_path / "page.json"
    path.write_text("\n".join(json.dumps(o) for o in objects))
    return str(path)


@pytest.mark.parametrize(
    "urn,expected",
    [("urn:li:sponsoredCampaign:123", 123), ("456", 456), ("urn:li:x:abc", None), ("", None), (None, None), ("a:1.5", None)],
)
def test_urn_id(spark, urn, expected):
    assert spark.createDataFrame([(urn,)], "u string").select(urn_id("u")).first()[0] == expected


@pytest.mark.parametrize(
    "ms,expected",
    [(0, "1970-01-01"), (-1, "1969-12-31"), (1742000000000, "2025-03-15"), (None, None), (10**15, None)],
)
def test_ms_to_date(spark, ms, expected):
    df = spark.createDataFrame([(ms,)], "m bigint").select(ms_to_date("m"))
    assert df.first()[0] == expected
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert df.first()[0] == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_date_parts(spark):
    df = spark.createDataFrame([(2025, 3, 5), (None, None, None)], "y int, m int, d int")
    out = df.select(date_from_parts(F.col("y"), F.col("m"), F.col("d")))
    assert [r[0] for r in out.collect()] == ["2025-03-05", "-00-00"]


@pytest.mark.parametrize(
    "imp,clk,cost,expected",
    [
        (1000, 50, "25.0", (0.05, 0.5, 25.0)), (0, 0, "5", (0.0, None, None)), (None, None, None, (0.0, None, None)),
        (10, 0, "5", (0.0, None, 500.0)), (10, 5, "0", (0.5, None, None)),
    ],
)
def test_metrics(spark, imp, clk, cost, expected):
    df = spark.createDataFrame([(imp, clk, cost)], "i bigint, c bigint, s string")
    m = ad_metrics(F.col("i"), F.col("c"), F.col("s"))
    row = df.select(m["ctr"], m["average_cpc"], m["average_cpm"]).first()
    assert tuple(row) == pytest.approx(expected)


@pytest.mark.parametrize("table", P.GOOGLE_ADS)
def test_every_search_ads_table_maps_its_paths(spark, tmp_path, table):
    mapping = P.GOOGLE_ADS[table]
    raw = {}
    for i, m in enumerate(mapping, 1):
        node = raw
        *parents, leaf = m.paths[0].split(".")
        for p in parents:
            node = node.setdefault(p, {})
        node[leaf] = [f"u{i}"] if m.kind == "list" else ("t%d" % i if m.type == "varchar" else str(i))
    row = P.read_payload(spark, landed(spark, tmp_path, raw), mapping).first().asDict()
    for i, m in enumerate(mapping, 1):
        expected = {"varchar": f"t{i}", "bigint": i, "double": float(i)}[m.type]
        assert row[m.name] == (f'["u{i}"]' if m.kind == "list" else expected), m.name


def test_short_names_are_a_fallback(spark, tmp_path):
    path = landed(spark, tmp_path, {"id": "7", "name": "n", "status": "S"}, {"campaign": {"id": "8", "name": ""}, "name": "m"})
    rows = P.read_payload(spark, path, P.GOOGLE_ADS["campaigns"]).collect()
    assert [(r["campaign_id"], r["campaign_name"], r["status"]) for r in rows] == [(7, "n", "S"), (8, "m", None)]


def test_missing_urls_are_empty_text(spark, tmp_path):
    path = landed(spark, tmp_path, {"adGroupAd": {"ad": {"id": "1"}}})
    assert P.read_payload(spark, path, P.GOOGLE_ADS["ads"]).first()["final_urls"] == ""


CAMPAIGN = {
    "id": "urn:li:sponsoredCampaign:314", "name": "c", "status": "ACTIVE", "type": "TEXT_AD",
    "campaignGroup": "urn:li:sponsoredCampaignGroup:2718", "objectiveType": "LEADS", "costType": "CPC",
    "unitCost": {"amount": "1.5"}, "dailyBudget": {"currencyCode": "EUR"},
    "changeAuditStamps": {"created": {"time": 1}, "lastModified": {"time": 2}},
}


def test_network_campaign(spark, tmp_path):
    row = P.read_payload(spark, landed(spark, tmp_path, CAMPAIGN), P.LINKEDIN_ADS["campaigns"], account_id="55").first()
    assert (row["id"], row["campaign_group_id"], row["account_id"]) == (314, 2718, 55)
    assert (row["unit_cost_amount"], row["daily_budget_amount"], row["total_budget_amount"]) == (1.5, 0.0, None)
    assert (row["created_time"], row["last_modified"]) == (1, 2)


@pytest.mark.parametrize("table", P.LINKEDIN_ADS)
def test_every_network_table_reads_an_empty_element(spark, tmp_path, table):
    df = P.read_payload(spark, landed(spark, tmp_path, {"id": "urn:li:x:5"}), P.LINKEDIN_ADS[table], account_id="1")
    row = df.first()
    assert row["id"] == 5 and df.columns == [m.name for m in P.LINKEDIN_ADS[table]]


def test_campaign_group_schedule(spark, tmp_path):
    path = landed(spark, tmp_path, {"id": "1", "runSchedule": {"start": 1742000000000}})
    row = P.read_payload(spark, path, P.LINKEDIN_ADS["campaign_groups"], account_id=1).first()
    assert (row["start_date"], row["end_date"]) == ("2025-03-15", None)


ELEMENT = {
    "pivotValue": "urn:li:sponsoredCampaign:42", "impressions": 1000, "clicks": 50,
    "dateRange": {"start": {"year": 2025, "month": 3, "day": 15}}, "costInLocalCurrency": "100.0", "costInUsd": "110.0",
    "externalWebsiteConversions": 5, "leads": 2,
}


@pytest.mark.parametrize("pivot,campaign,creative", [("CAMPAIGN", 42, None), ("CREATIVE", None, 42)])
def test_analytics(spark, pivot, campaign, creative):
    df = spark.read.json(spark.createDataFrame([(json.dumps(ELEMENT),)], "value string").rdd.map(lambda r: r[0]))
    row = P.map_analytics(df, pivot).first()
    assert (row["campaign_id"], row["creative_id"], row["date"]) == (campaign, creative, "2025-03-15")
    assert (row["ctr"], row["average_cpc"], row["average_cpm"]) == (0.05, 2.0, 100.0)
    assert (row["conversions"], row["external_website_conversions"], row["leads"], row["video_views"]) == (5, 5, 2, None)


def test_audience_counts_skip_campaigns_without_one(spark):
    campaigns = spark.createDataFrame([(1,), (2,)], "id bigint")
    counts = spark.createDataFrame([("urn:li:sponsoredCampaign:2", 30)], "campaign string, audience_count bigint")
    rows = P.audience_counts(campaigns, counts, "2025-01-01").collect()
    assert [tuple(r) for r in rows] == [(2, 30, "2025-01-01")]


@pytest.mark.parametrize(
    "manager,clients,expected",
    [
        (False, [], ["1"]),
        (True, [("5", True, "ENABLED", 0), ("6", False, "ENABLED", 1), ("7", False, "ENABLED", 2)], ["6"]),
        (True, [("5", True, "ENABLED", 0), ("6", False, "CLOSED", 1)], []),
    ],
)
def test_manager_gate(spark, manager, clients, expected):
    metrics = spark.createDataFrame([(c,) for c in ("1", "5", "6", "7")], "customer_id string")
    accounts = spark.createDataFrame([("1", manager)], "customer_id string, manager boolean")
    frame = spark.createDataFrame(clients, "customer_id string, manager boolean, status string, position int")
    assert [r[0] for r in P.manager_gate(metrics, accounts, frame, "1").collect()] == expected


def test_help_desk_page(spark, tmp_path):
    page = {"tickets": [{"id": 1, "tags": ["a", "b"], "subject": "s"}, {"id": 2, "priority": "high"}], "next_page": None}
    path = landed(spark, tmp_path, page)
    rows = P.zendesk_rows(spark.read.schema(P.zendesk_page_schema("tickets")).json(path), "tickets").collect()
    assert [(r["id"], r["tags"], r["subject"], r["priority"]) for r in rows] == [(1, "a, b", "s", None), (2, None, None, "high")]


@pytest.mark.parametrize("table", P.ZENDESK)
def test_help_desk_tables(spark, tmp_path, table):
    path = landed(spark, tmp_path, {table: [{"id": 3}]})
    rows = P.zendesk_rows(spark.read.schema(P.zendesk_page_schema(table)).json(path), table).collect()
    assert [r["id"] for r in rows] == [3]


def test_crm_objects_and_owners(spark, tmp_path):
    path = landed(spark, tmp_path, {"results": [{"id": "1", "properties": {"email": "e", "id": "x"}}]})
    assert P.hubspot_objects(spark.read.json(path)).first().asDict() == {"id": "1", "email": "e"}
    path = landed(spark, tmp_path, {"results": [{"id": "9", "email": "o", "userId": 4, "archived": False}]})
    row = P.hubspot_owners(spark.read.json(path)).first()
    assert (row["id"], row["userId"], row["archived"], row["lastName"]) == (9, 4, False, None)


def test_object_records(spark):
    raw = spark.sql("SELECT struct('x' AS type) AS attributes, 'a' AS Id, 5 AS n, X'00' AS Body")
    assert P.salesforce_records(raw, ["Body"]).columns == ["Id", "n"]
    assert P.salesforce_scan(raw, ["Id"], "n > 9").count() == 0


def test_schema_flags_keys():
    schema = P.output_schema(P.GOOGLE_ADS["campaign_performance"])
    assert [f.name for f in schema if f.metadata.get("primary_key")] == ["campaign_id", "date"]
