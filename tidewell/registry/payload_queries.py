"""Checked queries: API payloads, made as raw JSON from whole given tables."""

from datetime import date

from pyspark.sql import functions as F

from tidewell.functions.scalars import ad_metrics as derive_metrics
from tidewell.functions.scalars import date_from_parts, pivot_ids
from tidewell.functions.scalars import ms_to_date as to_date
from tidewell.functions.scalars import urn_id as to_id
from tidewell.operators import flatten as FL
from tidewell.operators import incremental as I
from tidewell.registry.base import query
from tidewell.session import fresh_dir, read_table
from tidewell.sources import payloads as P

RECORDS_PER_PAGE = 100

SQL_TEXT = "CAST({} AS VARCHAR)"


def _text(name):
    return F.col(name).cast("string")


def _tickets(spark, sf):
    """Orders as help-desk tickets, on pages of a fixed size."""
    orders = read_table(spark, sf, "orders")
    ticket = F.struct(
        _text("o_orderkey").alias("id"),
        F.concat(F.lit("order "), _text("o_orderkey")).alias("subject"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        _text("o_custkey").alias("requester_id"),
        F.array(F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)).alias("tags"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"),
    )
    page = F.floor(F.col("o_orderkey") / RECORDS_PER_PAGE).alias("page")
    return orders.groupBy(page).agg(F.collect_list(ticket).alias("tickets"))


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status, o_orderpriority AS priority FROM orders"""
)
def unnest_pages(spark, sf):
    return FL.unnest_pages(_tickets(spark, sf), "tickets").select("id", "status", "priority")


@query(
    """SELECT o_orderkey AS id, 'order ' || o_orderkey AS subject, CAST(NULL AS VARCHAR) AS description,
      o_orderstatus AS status, o_orderpriority AS priority, CAST(NULL AS VARCHAR) AS type, o_custkey AS requester_id,
      CAST(NULL AS BIGINT) AS assignee_id, CAST(NULL AS BIGINT) AS organization_id, CAST(NULL AS BIGINT) AS group_id,
      o_orderstatus || ', ' || substr(o_orderpriority, 1, 1) AS tags, CAST(NULL AS VARCHAR) AS created_at,
      strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS updated_at
    FROM orders"""
)
def zendesk_flatten(spark, sf):
    """Landed pages, read with the schema of the table."""
    folder = fresh_dir(spark, "tickets")
    _tickets(spark, sf).select("tickets").write.json(folder)
    pages = spark.read.schema(P.zendesk_page_schema("tickets")).json(folder)
    return P.zendesk_rows(pages, "tickets")


def _accounts(spark, sf):
    return read_table(spark, sf, "customer").select(
        F.struct(F.lit("Account").alias("type"), F.concat(F.lit("/acc/"), _text("c_custkey")).alias("url")).alias("attributes"),
        F.concat(F.lit("001"), F.lpad(_text("c_custkey"), 12, "0")).alias("Id"),
        F.col("c_name").alias("Name"),
        F.col("c_mktsegment").alias("Industry"),
        F.col("c_acctbal").alias("AnnualRevenue"),
        (F.col("c_acctbal") > 0).alias("IsActive"),
        F.unhex(F.hex("c_name")).alias("Photo"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("c_nationkey")), "yyyy-MM-dd'T'00:00:00.000'Z'")
        .alias("SystemModstamp"),
    )


SQL_ACCOUNTS = """
accounts AS (
  SELECT '001' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS "Id", c_name AS "Name", c_mktsegment AS "Industry",
    c_acctbal AS "AnnualRevenue", c_acctbal > 0 AS "IsActive",
    strftime(DATE '2024-01-01' + c_nationkey, '%Y-%m-%dT00:00:00.000Z') AS "SystemModstamp"
  FROM customer)
"""


@query(f"WITH {SQL_ACCOUNTS} SELECT * FROM accounts")
def salesforce_records(spark, sf):
    return P.salesforce_records(_accounts(spark, sf), binary_fields=["Photo"])


@query(
    f"""WITH {SQL_ACCOUNTS} SELECT "Id", "Name", "SystemModstamp" FROM accounts
    WHERE "AnnualRevenue" > 1000 AND "Industry" IN ('BUILDING', 'MACHINERY') AND "SystemModstamp" > '2024-01-10'"""
)
def salesforce_filtered(spark, sf):
    records = P.salesforce_records(_accounts(spark, sf), binary_fields=["Photo"])
    later = I.cursor_after(records, "SystemModstamp", "2024-01-10", "string")
    where = "AnnualRevenue > 1000 AND Industry IN ('BUILDING', 'MACHINERY')"
    return P.salesforce_scan(later, ["Id", "Name", "SystemModstamp"], where)


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS firstname, c_mktsegment AS lifecyclestage, c_acctbal AS annualrevenue FROM customer")
def hubspot_flatten(spark, sf):
    records = read_table(spark, sf, "customer").select(
        _text("c_custkey").alias("id"),
        F.struct(
            F.col("c_name").alias("firstname"),
            F.col("c_mktsegment").alias("lifecyclestage"),
            F.col("c_acctbal").alias("annualrevenue"),
        ).alias("properties"),
    )
    return FL.promote_properties(records)


@query(
    """SELECT s_suppkey AS id, lower(s_name) || '@crm.org' AS email, s_name AS "firstName", CAST(NULL AS VARCHAR) AS "lastName",
      CAST(s_nationkey AS BIGINT) AS "userId", CAST(NULL AS VARCHAR) AS "createdAt",
      '2024-01-' || lpad(CAST(s_nationkey + 1 AS VARCHAR), 2, '0') AS "updatedAt", s_acctbal < 0 AS archived FROM supplier"""
)
def hubspot_owners(spark, sf):
    supplier = read_table(spark, sf, "supplier")
    owner = F.struct(
        _text("s_suppkey").alias("id"),
        F.concat(F.lower("s_name"), F.lit("@crm.org")).alias("email"),
        F.col("s_name").alias("firstName"),
        _text("s_nationkey").alias("userId"),
        F.concat(F.lit("2024-01-"), F.lpad((F.col("s_nationkey") + 1).cast("string"), 2, "0")).alias("updatedAt"),
        (F.col("s_acctbal") < 0).alias("archived"),
    )
    page = F.floor(F.col("s_suppkey") / RECORDS_PER_PAGE).alias("page")
    return P.hubspot_owners(supplier.groupBy(page).agg(F.collect_list(owner).alias("results")))


def _nested(spark, sf):
    return read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.struct(
            F.col("c_name").alias("name"),
            F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("place"),
        ).alias("who"),
        F.array("c_nationkey", "c_custkey").alias("codes"),
    )


@query(
    """SELECT c_custkey AS id, c_name AS who_name, c_nationkey AS who_place_nation, c_mktsegment AS who_place_segment,
      '[' || c_nationkey || ',' || c_custkey || ']' AS codes FROM customer"""
)
def flatten_underscore(spark, sf):
    return FL.flatten_underscore(_nested(spark, sf))


@query(
    """SELECT c_custkey AS id, '{"name":"' || c_name || '","place":{"nation":' || c_nationkey || ',"segment":"'
      || c_mktsegment || '"}}' AS who, '[' || c_nationkey || ',' || c_custkey || ']' AS codes FROM customer"""
)
def flatten_one_level(spark, sf):
    return FL.flatten_one_level(_nested(spark, sf))


@query(
    """SELECT c_custkey AS campaign_id, CASE WHEN c_nationkey = 3 THEN 'plain ' || c_name ELSE c_name END AS campaign_name,
      CASE WHEN c_acctbal > 0 THEN 'ENABLED' ELSE 'PAUSED' END AS status, c_mktsegment AS advertising_channel_type,
      CAST(NULL AS VARCHAR) AS bidding_strategy_type, CAST(floor(c_acctbal) AS BIGINT) * 1000000 AS budget_amount_micros,
      CASE WHEN c_nationkey <> 7 THEN c_nationkey / 4 END AS optimization_score FROM customer"""
)
def gads_campaigns(spark, sf):
    """Landed result rows; 64-bit numbers arrive as text, one nation uses the short field names."""
    folder = fresh_dir(spark, "ads")
    short = F.col("c_nationkey") == 3
    customer = read_table(spark, sf, "customer")
    customer.select(
        F.struct(
            F.when(~short, _text("c_custkey")).alias("id"),
            F.when(~short, F.col("c_name")).alias("name"),
            F.when(F.col("c_acctbal") > 0, "ENABLED").otherwise("PAUSED").alias("status"),
            F.col("c_mktsegment").alias("advertisingChannelType"),
            F.when(F.col("c_nationkey") != 7, F.col("c_nationkey") / 4).alias("optimizationScore"),
        ).alias("campaign"),
        F.struct((F.floor("c_acctbal") * 1_000_000).cast("bigint").cast("string").alias("amountMicros")).alias("campaignBudget"),
        F.when(short, _text("c_custkey")).alias("id"),
        F.when(short, F.concat(F.lit("plain "), F.col("c_name"))).alias("name"),
    ).write.json(folder)
    return P.read_payload(spark, folder, P.GOOGLE_ADS["campaigns"])


@query(
    """SELECT user_id AS campaign_id, 'user ' || user_id AS campaign_name, CAST(NULL AS VARCHAR) AS status,
      strftime(ts, '%Y-%m-%d') AS date, count(*) AS impressions, count(*) FILTER (event_type = 'click') AS clicks,
      CAST(sum(CAST(floor(value) AS BIGINT)) * 1000000 AS BIGINT) AS cost_micros,
      CAST(count(*) FILTER (event_type = 'purchase') AS DOUBLE) AS conversions, CAST(NULL AS DOUBLE) AS conversions_value,
      CAST(NULL AS DOUBLE) AS ctr, CAST(NULL AS DOUBLE) AS average_cpc, CAST(NULL AS BIGINT) AS video_views,
      CAST(NULL AS BIGINT) AS view_through_conversions
    FROM events GROUP BY user_id, strftime(ts, '%Y-%m-%d')"""
)
def gads_performance(spark, sf):
    folder = fresh_dir(spark, "ads")
    daily = read_table(spark, sf, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("date")).agg(
        F.count("*").alias("seen"),
        F.count(F.when(F.col("event_type") == "click", 1)).alias("clicked"),
        F.count(F.when(F.col("event_type") == "purchase", 1)).alias("bought"),
        (F.sum(F.floor("value")) * 1_000_000).alias("micros"),
    )
    daily.select(
        F.struct(_text("user_id").alias("id"), F.concat(F.lit("user "), _text("user_id")).alias("name")).alias("campaign"),
        F.struct("date").alias("segments"),
        F.struct(
            _text("seen").alias("impressions"), _text("clicked").alias("clicks"), _text("micros").alias("costMicros"),
            F.col("bought").cast("double").alias("conversions"),
        ).alias("metrics"),
    ).write.json(folder)
    return P.read_payload(spark, folder, P.GOOGLE_ADS["campaign_performance"])


def _campaigns(spark, sf):
    """Customers as campaigns with URN identifiers and budgets that may be absent."""
    money = lambda present, amount: F.when(present, F.struct(amount.alias("amount")))
    key = F.col("c_custkey")
    stamp = lambda n: F.struct((key * n).alias("time"))
    return read_table(spark, sf, "customer").select(
        F.concat(F.lit("urn:li:sponsoredCampaign:"), _text("c_custkey")).alias("id"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") > 0, "ACTIVE").otherwise("PAUSED").alias("status"),
        F.concat(F.lit("urn:li:sponsoredCampaignGroup:"), _text("c_nationkey")).alias("campaignGroup"),
        F.col("c_mktsegment").alias("type"),
        F.lit("LEADS").alias("objectiveType"),
        F.lit("CPM").alias("costType"),
        money(F.col("c_nationkey") != 5, F.col("c_acctbal").cast("string")).alias("unitCost"),
        money(F.col("c_nationkey") > 9, F.when(F.col("c_nationkey") != 11, F.lit("25.5"))).alias("dailyBudget"),
        F.struct(stamp(1000).alias("created"), stamp(2000).alias("lastModified")).alias("changeAuditStamps"),
    )


SQL_CAMPAIGNS = """
campaigns AS (
  SELECT c_custkey AS id, c_name AS name, CASE WHEN c_acctbal > 0 THEN 'ACTIVE' ELSE 'PAUSED' END AS status,
    CAST(c_nationkey AS BIGINT) AS campaign_group_id, CAST(512 AS BIGINT) AS account_id, c_mktsegment AS type,
    'LEADS' AS objective_type, 'CPM' AS cost_type, CASE WHEN c_nationkey <> 5 THEN c_acctbal END AS unit_cost_amount,
    CASE WHEN c_nationkey = 11 THEN 0.0 WHEN c_nationkey > 9 THEN 25.5 END AS daily_budget_amount,
    CAST(NULL AS DOUBLE) AS total_budget_amount, c_custkey * 1000 AS created_time, c_custkey * 2000 AS last_modified
  FROM customer)
"""


@query(f"WITH {SQL_CAMPAIGNS} SELECT * REPLACE (CAST(daily_budget_amount AS DOUBLE) AS daily_budget_amount) FROM campaigns")
def linkedin_campaigns(spark, sf):
    return P.map_payload(_campaigns(spark, sf), P.LINKEDIN_ADS["campaigns"], account_id="512")


@query(
    """SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN p_partkey END AS id FROM part"""
)
def urn_id(spark, sf):
    urn = (
        F.when(F.col("p_size") % 4 != 0, F.concat(F.lit("urn:li:thing:"), _text("p_partkey")))
        .when(F.col("p_size") % 8 == 0, F.concat(F.lit("urn:li:"), F.col("p_name")))
    )
    return read_table(spark, sf, "part").select("p_partkey", to_id(urn).alias("id"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def ms_to_date(spark, sf):
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return read_table(spark, sf, "events").select("event_id", to_date(millis).alias("day"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def date_parts(spark, sf):
    when = F.col("o_orderdate")
    return read_table(spark, sf, "orders").select(
        "o_orderkey", date_from_parts(F.year(when), F.month(when), F.dayofmonth(when)).alias("day")
    )


SQL_DAILY = """
daily AS (
  SELECT user_id, CAST(ts AS DATE) AS day, event_type = 'click' AS by_campaign,
    nullif(count(*) FILTER (value < 90), 0) AS imp, count(*) FILTER (value < 40) AS clk,
    CAST(sum(CASE WHEN value >= 20 THEN CAST(value AS DECIMAL(18, 2)) ELSE 0 END) AS DOUBLE) AS cost
  FROM events GROUP BY ALL)
"""


@query(
    f"""WITH {SQL_DAILY}
    SELECT user_id, CAST(day AS VARCHAR) AS day, by_campaign, coalesce(imp, 0) AS impressions, clk AS clicks,
      nullif(cost, 0) AS cost_in_local_currency, coalesce(clk / imp, 0.0) AS ctr,
      nullif(cost, 0) / nullif(clk, 0) AS average_cpc, nullif(cost, 0) / imp * 1000 AS average_cpm,
      CASE WHEN by_campaign THEN user_id END AS campaign_id, CASE WHEN NOT by_campaign THEN user_id END AS creative_id
    FROM daily"""
)
def ad_metrics(spark, sf):
    value = F.col("value")
    daily = read_table(spark, sf, "events").groupBy(
        "user_id", F.to_date("ts").cast("string").alias("day"), (F.col("event_type") == "click").alias("by_campaign")
    ).agg(
        F.nullif(F.count(F.when(value < 90, 1)), F.lit(0)).alias("imp"),
        F.count(F.when(value < 40, 1)).alias("clk"),
        F.sum(F.when(value >= 20, value.cast("decimal(18,2)")).otherwise(F.lit(0))).alias("cost"),
    )
    urn = F.concat(F.lit("urn:li:sponsored:"), _text("user_id"))
    pivot = F.when(F.col("by_campaign"), "CAMPAIGN").otherwise("CREATIVE")
    columns = {**derive_metrics(F.col("imp"), F.col("clk"), F.col("cost")), **pivot_ids(pivot, urn)}
    return daily.select("user_id", "day", "by_campaign", *[c.alias(n) for n, c in columns.items()])


@query(
    """WITH days AS (
      SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS imp, count(*) FILTER (event_type = 'click') AS clk
      FROM events GROUP BY ALL)
    SELECT user_id AS campaign_id, CAST(NULL AS BIGINT) AS creative_id, strftime(day, '%Y-%m-%d') AS date,
      imp AS impressions, clk AS clicks, CAST(CASE WHEN clk > 0 THEN clk * 2.5 END AS DOUBLE) AS cost_in_local_currency,
      clk / imp AS ctr, CASE WHEN clk > 0 THEN CAST(2.5 AS DOUBLE) END AS average_cpc,
      CASE WHEN clk > 0 THEN CAST(clk * 2.5 AS DOUBLE) / imp * 1000 END AS average_cpm, CAST(NULL AS DOUBLE) AS cost_in_usd,
      clk AS conversions, clk AS external_website_conversions, CAST(NULL AS BIGINT) AS leads,
      CAST(NULL AS BIGINT) AS video_views, CAST(NULL AS BIGINT) AS viral_impressions, CAST(NULL AS BIGINT) AS viral_clicks
    FROM days"""
)
def linkedin_analytics(spark, sf):
    """Daily analytics elements, campaign pivot."""
    day = F.col("day")
    elements = (
        read_table(spark, sf, "events")
        .groupBy("user_id", F.to_date("ts").alias("day"))
        .agg(F.count("*").alias("impressions"), F.count(F.when(F.col("event_type") == "click", 1)).alias("clicks"))
        .select(
            F.concat(F.lit("urn:li:sponsoredCampaign:"), _text("user_id")).alias("pivotValue"),
            F.struct(
                F.struct(F.year(day).alias("year"), F.month(day).alias("month"), F.dayofmonth(day).alias("day")).alias("start")
            ).alias("dateRange"),
            "impressions",
            "clicks",
            (F.col("clicks") * 2.5).cast("string").alias("costInLocalCurrency"),
            F.lit(None).cast("string").alias("costInUsd"),
            F.col("clicks").alias("externalWebsiteConversions"),
        )
    )
    return P.map_analytics(elements, "CAMPAIGN")


@query(
    """SELECT c_custkey AS campaign_id, n AS audience_count, '2024-02-01' AS fetched_at
    FROM customer JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) ON user_id = c_custkey"""
)
def audience_join(spark, sf):
    campaigns = P.map_payload(_campaigns(spark, sf), P.LINKEDIN_ADS["campaigns"], account_id="512")
    landed = read_table(spark, sf, "events").groupBy(
        F.concat(F.lit("urn:li:sponsoredCampaign:"), _text("user_id")).alias("campaign")
    ).agg(F.count("*").alias("audience_count"))
    return P.audience_counts(campaigns, landed, "2024-02-01")


@query(
    """SELECT o_custkey AS customer_id, o_orderkey, o_totalprice FROM orders
    WHERE o_custkey = (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY' AND c_acctbal > 0
                         AND c_custkey IN (SELECT o_custkey FROM orders) ORDER BY c_custkey LIMIT 1)"""
)
def manager_gate(spark, sf):
    """Machinery customers are managers; the first other customer in credit that ordered reports."""
    customer, orders = read_table(spark, sf, "customer"), read_table(spark, sf, "orders")
    ordered = orders.select(F.col("o_custkey").alias("c_custkey"))
    clients = customer.join(ordered, "c_custkey", "left_semi").select(
        F.col("c_custkey").alias("customer_id"),
        (F.col("c_mktsegment") == "MACHINERY").alias("manager"),
        F.when(F.col("c_acctbal") > 0, "ENABLED").otherwise("CLOSED").alias("status"),
        F.col("c_custkey").alias("position"),
    )
    accounts = customer.agg(F.max("c_custkey").cast("string").alias("customer_id")).withColumn("manager", F.lit(True))
    top = customer.agg(F.max("c_custkey")).first()[0]
    metrics = orders.select(F.col("o_custkey").alias("customer_id"), "o_orderkey", "o_totalprice")
    return P.manager_gate(metrics, accounts, clients, str(top))


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-09' AND ts < TIMESTAMP '2024-01-21'")
def date_range_incremental(spark, sf):
    window = I.date_window(date(2024, 1, 20), start_after="2024-01-08")
    return I.filter_date_window(read_table(spark, sf, "events").select("event_id", "ts"), "ts", window)


@query(
    """SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts < TIMESTAMP '2024-01-25'
    ORDER BY ts DESC LIMIT 2000"""
)
def time_window_limit(spark, sf):
    events = read_table(spark, sf, "events").select("event_id", "ts")
    return I.time_window_limit(events, "ts", "2024-01-10T06:00:00", "2024-01-25", max_count=2000)
