"""Checked queries: configured jobs over landed API pages, made from whole given tables."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.plans.config import run_configured
from tidewell.plans.state import StateStore
from tidewell.plans.tables import Target
from tidewell.registry.base import query
from tidewell.session import fresh_dir, read_table

PER_PAGE = 100


class Landing:
    """A landing folder and the target of one job over it."""

    def __init__(self, spark, source_type: str, table: str, connection=None, settings=None):
        self.spark, self.table, self.name = spark, table, f"{table}_{uuid.uuid4().hex[:10]}"
        self.folder, self.root = fresh_dir(spark, "pages"), fresh_dir(spark, "jobs")
        self.state = StateStore(spark, self.root, f"state_{self.name}")
        self.job = {"id": self.name, "source_type": source_type, "tables": [table], "target_table": self.name, "connection": {"landing": self.folder, **(connection or {})}}
        self.settings = settings or {}

    def land(self, rows: DataFrame, table: str | None = None) -> None:
        rows.write.mode("append").json(f"{self.folder}/{table or self.table}")

    def run(self, **settings) -> int:
        """Run the job with these settings of its table; the number of rows it wrote."""
        job = {**self.job, "tables_config": {self.table: {**self.settings, **settings}}}
        ((result,),) = run_configured(self.spark, {"jobs": [job]}, self.root, self.state).values()
        if result.error:
            raise RuntimeError(result.error)
        return result.rows

    def rows(self) -> DataFrame:
        return Target(self.spark, self.name, self.root).read()


def _text(name):
    return F.col(name).cast("string")


def _daily(spark, sf, *customer):
    """Users' days as rows of an ad report."""
    daily = read_table(spark, sf, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("date")).agg(F.count("*").alias("seen"))
    return daily.select(
        F.struct(_text("user_id").alias("id")).alias("campaign"), F.struct("date").alias("segments"), F.struct(_text("seen").alias("impressions")).alias("metrics"), *customer
    )


@query(
    """SELECT user_id AS campaign_id, strftime(ts, '%Y-%m-%d') AS date, count(*) AS impressions FROM events
    WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-24' GROUP BY ALL"""
)
def job_report_days(spark, sf):
    """An ad report loaded for ten days back, then for the days since; nothing is left for a day already loaded."""
    ads = Landing(spark, "google_ads", "campaign_performance", settings={"date_range_days": 10})
    ads.land(_daily(spark, sf))
    ads.run(today="2024-01-15")
    ads.run(today="2024-01-23")
    if ads.run(today="2024-01-23"):
        raise RuntimeError("a day was loaded twice")
    return ads.rows().select("campaign_id", "date", "impressions")


@query("SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-03 12:00:00' AND ts < TIMESTAMP '2024-01-28'")
def job_search_window(spark, sf):
    """A search of log events in portions, each from the time where the one before ended, until none is left."""
    events = read_table(spark, sf, "events")
    total = events.count()
    logs = Landing(spark, "splunk", "events", settings={"primary_key": ["event_id"], "schema": "_time TIMESTAMP, event_id BIGINT, value DOUBLE"})
    logs.land(events.select(F.col("ts").alias("_time"), "event_id", "value"))
    portion = {"earliest": "2024-01-03T12:00:00", "latest": "2024-01-28", "max_count": total // 2}
    # The third portion begins with the last time of the second, and finds only that.
    wrote = [logs.run(**portion) for _ in range(3)]
    if wrote[2] >= wrote[0]:
        raise RuntimeError(f"a search did not go on where it ended: {wrote}")
    return logs.rows().select("event_id", "value")


@query("SELECT CAST(c_custkey AS VARCHAR) AS Id, c_name AS Name FROM customer WHERE c_acctbal > 1000 AND c_mktsegment <> 'MACHINERY'")
def job_object_filter(spark, sf):
    """A job over object records with a field list and a where clause; envelope and binary fields stay out."""
    day = F.date_format(F.timestamp_seconds(F.col("c_custkey") * 60), "yyyy-MM-dd'T'HH:mm:ss")
    record = F.struct(
        F.struct(F.lit("Account").alias("type")).alias("attributes"), _text("c_custkey").alias("Id"), F.col("c_name").alias("Name"), F.lit("AAAA").alias("Body"),
        F.col("c_acctbal").alias("Balance"), F.col("c_mktsegment").alias("Segment"), day.alias("SystemModstamp"),
    )
    pages = read_table(spark, sf, "customer").groupBy(F.floor(F.col("c_custkey") / PER_PAGE)).agg(F.collect_list(record).alias("records"))
    wanted = {"primary_key": ["Id"], "fields": ["Id", "Name"], "where_clause": "Balance > 1000 AND Segment <> 'MACHINERY'", "binary_fields": ["Body"]}
    objects = Landing(spark, "salesforce", "Account", settings=wanted)
    objects.land(pages.select("records"))
    objects.run()
    if "Body" in objects.rows().columns or objects.run():
        raise RuntimeError("a field or a row too many")
    return objects.rows().select("Id", "Name")


@query(
    """WITH reporting AS (SELECT min(c_custkey) AS id FROM customer WHERE c_mktsegment <> 'MACHINERY' AND c_acctbal > 0)
    SELECT user_id AS campaign_id, strftime(ts, '%Y-%m-%d') AS date, count(*) AS impressions
    FROM events WHERE user_id % 5 = (SELECT id FROM reporting) % 5 GROUP BY ALL"""
)
def job_manager_gate(spark, sf):
    """A manager account's report is that of its first enabled client; users are spread over five clients."""
    ads = Landing(spark, "google_ads", "campaign_performance", connection={"customer_id": "manager"})
    customer = read_table(spark, sf, "customer")
    client = F.struct(
        _text("c_custkey").alias("id"), (F.col("c_mktsegment") == "MACHINERY").alias("manager"),
        F.when(F.col("c_acctbal") > 0, "ENABLED").otherwise("CANCELED").alias("status"), F.lit(1).alias("level"),
    )
    ads.land(customer.select(client.alias("customerClient")), "customer_clients")
    ads.land(customer.limit(1).select(F.struct(F.lit("manager").alias("id"), F.lit(True).alias("manager")).alias("customer")), "accounts")
    usable = customer.filter((F.col("c_mktsegment") != "MACHINERY") & (F.col("c_acctbal") > 0))
    first = usable.agg(F.min("c_custkey")).first()[0]
    # Of five clients next to one another one is the reporting one; a report has rows of all five.
    of = (F.lit(first) + F.pmod(F.col("campaign.id").cast("long") - F.lit(first), F.lit(5))).cast("string")
    ads.land(_daily(spark, sf, F.struct(F.lit("").alias("id")).alias("customer")).withColumn("customer", F.struct(of.alias("id"))))
    ads.run()
    return ads.rows().select("campaign_id", "date", "impressions")


@query(
    """SELECT c_custkey AS campaign_id, count(*) + CASE WHEN c_custkey % 7 = 0 THEN 1000 ELSE 0 END AS audience_count
    FROM customer JOIN events ON user_id = c_custkey GROUP BY c_custkey"""
)
def job_audience_counts(spark, sf):
    """Audience sizes of landed campaigns; a seventh is landed again with other counts, which win."""
    counts = read_table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("audience_count"))
    counts = counts.select(F.concat(F.lit("urn:li:sponsoredCampaign:"), _text("user_id")).alias("campaign"), "user_id", "audience_count")
    ads = Landing(spark, "linkedin_ads", "audience_counts", connection={"account_id": 512}, settings={"primary_key": ["campaign_id"]})
    campaign = F.concat(F.lit("urn:li:sponsoredCampaign:"), _text("c_custkey")).alias("id")
    ads.land(read_table(spark, sf, "customer").select(campaign, F.col("c_name").alias("name")), "campaigns")
    ads.land(counts.drop("user_id"))
    ads.run()
    ads.land(counts.filter("user_id % 7 = 0").select("campaign", (F.col("audience_count") + 1000).alias("audience_count")))
    ads.run()
    return ads.rows().select("campaign_id", "audience_count")


@query(
    """SELECT CAST(c_custkey AS BIGINT) AS campaign_id, CASE WHEN c_custkey % 3 = 0 THEN 'New ' || c_name ELSE c_name END AS campaign_name,
    (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0) AS second_run FROM customer"""
)
def job_new_pages(spark, sf):
    """A job that opens only the pages landed since its last run: the second writes just the renamed third."""
    ads = Landing(spark, "google_ads", "campaigns", settings={"new_pages_only": True})
    customer = read_table(spark, sf, "customer")
    page = lambda rows, name: rows.select(F.struct(F.col("c_custkey").alias("id"), name.alias("name")).alias("campaign"))
    ads.land(page(customer, F.col("c_name")))
    ads.run()
    # The time of the newest page counts again, so pages of one time are read twice rather than missed.
    again = ads.run()
    renamed = customer.filter("c_custkey % 3 = 0")
    ads.land(page(renamed, F.concat(F.lit("New "), "c_name")))
    second = ads.run() - again
    return ads.rows().select("campaign_id", "campaign_name", F.lit(second).cast("long").alias("second_run"))
