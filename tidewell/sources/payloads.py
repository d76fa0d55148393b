"""Typed tables from landed API payloads.

A table is a list of ``column type path`` lines. The same lines give the schema to read the
raw JSON with, so that no inference pass runs over the data, and the projection.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.scalars import ad_metrics, date_from_parts, ms_to_date, pivot_ids, urn_id
from tidewell.model import canonical_type, field, with_primary_key
from tidewell.operators.flatten import flatten_joined, promote_properties, unnest_pages


@dataclass(frozen=True)
class Mapped:
    """One output column: its type, where its value is, and how it is converted."""

    name: str
    type: str
    paths: tuple[str, ...]
    kind: str = "value"
    primary_key: bool = False


def _table(text: str) -> tuple[Mapped, ...]:
    """Read ``name type path|path [kind]`` lines; ``*`` after a name marks a key."""
    rows = []
    for line in text.strip().splitlines():
        name, type_name, paths, *kind = line.split()
        rows.append(
            Mapped(name.rstrip("*"), type_name, tuple(paths.split("|")), kind[0] if kind else "value", name.endswith("*"))
        )
    return tuple(rows)


# Search-ads tables, the path of each column in a raw result row.
GOOGLE_ADS: dict[str, tuple[Mapped, ...]] = {
    "campaigns": _table("""
campaign_id* bigint campaign.id|id
campaign_name varchar campaign.name|name
status varchar campaign.status|status
advertising_channel_type varchar campaign.advertisingChannelType
bidding_strategy_type varchar campaign.biddingStrategyType
budget_amount_micros bigint campaignBudget.amountMicros
optimization_score double campaign.optimizationScore
"""),
    "ad_groups": _table("""
ad_group_id* bigint adGroup.id
ad_group_name varchar adGroup.name
status varchar adGroup.status
type varchar adGroup.type
campaign_id bigint campaign.id
campaign_name varchar campaign.name
cpc_bid_micros bigint adGroup.cpcBidMicros
target_cpa_micros bigint adGroup.targetCpaMicros
"""),
    "ads": _table("""
ad_id* bigint adGroupAd.ad.id
ad_name varchar adGroupAd.ad.name
ad_type varchar adGroupAd.ad.type
status varchar adGroupAd.status
ad_group_id bigint adGroup.id
ad_group_name varchar adGroup.name
campaign_id bigint campaign.id
campaign_name varchar campaign.name
final_urls varchar adGroupAd.ad.finalUrls list
display_url varchar adGroupAd.ad.displayUrl
"""),
    "keywords": _table("""
criterion_id* bigint adGroupCriterion.criterionId
keyword_text varchar adGroupCriterion.keyword.text
match_type varchar adGroupCriterion.keyword.matchType
status varchar adGroupCriterion.status
cpc_bid_micros bigint adGroupCriterion.cpcBidMicros
quality_score bigint adGroupCriterion.qualityInfo.qualityScore
ad_group_id bigint adGroup.id
ad_group_name varchar adGroup.name
campaign_id bigint campaign.id
campaign_name varchar campaign.name
"""),
    "campaign_performance": _table("""
campaign_id* bigint campaign.id
campaign_name varchar campaign.name
status varchar campaign.status
date* varchar segments.date
impressions bigint metrics.impressions
clicks bigint metrics.clicks
cost_micros bigint metrics.costMicros
conversions double metrics.conversions
conversions_value double metrics.conversionsValue
ctr double metrics.ctr
average_cpc double metrics.averageCpc
video_views bigint metrics.videoViews
view_through_conversions bigint metrics.viewThroughConversions
"""),
    "ad_group_performance": _table("""
ad_group_id* bigint adGroup.id
ad_group_name varchar adGroup.name
campaign_id bigint campaign.id
campaign_name varchar campaign.name
date* varchar segments.date
impressions bigint metrics.impressions
clicks bigint metrics.clicks
cost_micros bigint metrics.costMicros
conversions double metrics.conversions
conversions_value double metrics.conversionsValue
ctr double metrics.ctr
average_cpc double metrics.averageCpc
"""),
    "search_terms": _table("""
search_term varchar searchTermView.searchTerm
status varchar searchTermView.status
campaign_id bigint campaign.id
campaign_name varchar campaign.name
ad_group_id bigint adGroup.id
ad_group_name varchar adGroup.name
date varchar segments.date
impressions bigint metrics.impressions
clicks bigint metrics.clicks
cost_micros bigint metrics.costMicros
conversions double metrics.conversions
ctr double metrics.ctr
average_cpc double metrics.averageCpc
"""),
    "geographic_performance": _table("""
country_criterion_id bigint geographicView.countryCriterionId
resource_name varchar geographicView.resourceName
campaign_id bigint campaign.id
campaign_name varchar campaign.name
date varchar segments.date
impressions bigint metrics.impressions
clicks bigint metrics.clicks
cost_micros bigint metrics.costMicros
conversions double metrics.conversions
ctr double metrics.ctr
"""),
    "audience_performance": _table("""
resource_name varchar adGroupAudienceView.resourceName
ad_group_id bigint adGroup.id
ad_group_name varchar adGroup.name
campaign_id bigint campaign.id
campaign_name varchar campaign.name
date varchar segments.date
impressions bigint metrics.impressions
clicks bigint metrics.clicks
cost_micros bigint metrics.costMicros
conversions double metrics.conversions
"""),
}

# Professional-network ads tables.
LINKEDIN_ADS: dict[str, tuple[Mapped, ...]] = {
    "accounts": _table("""
id* bigint id urn
name varchar name
status varchar status
type varchar type
currency varchar currency
total_budget double totalBudget.amount money
created_time bigint changeAuditStamps.created.time
last_modified bigint changeAuditStamps.lastModified.time
"""),
    "campaign_groups": _table("""
id* bigint id urn
name varchar name
status varchar status
account_id bigint - account
total_budget double totalBudget.amount money
start_date varchar runSchedule.start ms_date
end_date varchar runSchedule.end ms_date
created_time bigint changeAuditStamps.created.time
last_modified bigint changeAuditStamps.lastModified.time
"""),
    "campaigns": _table("""
id* bigint id urn
name varchar name
status varchar status
campaign_group_id bigint campaignGroup urn
account_id bigint - account
type varchar type
objective_type varchar objectiveType
cost_type varchar costType
unit_cost_amount double unitCost.amount money
daily_budget_amount double dailyBudget.amount money
total_budget_amount double totalBudget.amount money
created_time bigint changeAuditStamps.created.time
last_modified bigint changeAuditStamps.lastModified.time
"""),
    "creatives": _table("""
id* bigint id urn
campaign_id bigint campaign urn
status varchar status
type varchar type
reference varchar reference
created_time bigint changeAuditStamps.created.time
last_modified bigint changeAuditStamps.lastModified.time
"""),
    "conversions": _table("""
id* bigint id urn
name varchar name
enabled boolean enabled
type varchar type
attribution_type varchar attributionType
value_in_local_currency double valueInLocalCurrency.amount money
account_id bigint - account
created_time bigint changeAuditStamps.created.time
last_modified bigint changeAuditStamps.lastModified.time
"""),
}

# Fields an analytics row carries besides its metrics.
ANALYTICS_COUNTS = _table("""
conversions bigint externalWebsiteConversions
external_website_conversions bigint externalWebsiteConversions
leads bigint leads
video_views bigint videoViews
viral_impressions bigint viralImpressions
viral_clicks bigint viralClicks
""")

# Columns of the owners table of the CRM source.
HUBSPOT_OWNERS = _table("""
id bigint id
email varchar email
firstName varchar firstName
lastName varchar lastName
userId bigint userId
createdAt varchar createdAt
updatedAt varchar updatedAt
archived boolean archived
""")

# Columns of the help-desk tables.
ZENDESK: dict[str, tuple[Mapped, ...]] = {
    "tickets": (
        Mapped("id", "bigint", ("id",)),
        Mapped("subject", "varchar", ("subject",)),
        Mapped("description", "varchar", ("description",)),
        Mapped("status", "varchar", ("status",)),
        Mapped("priority", "varchar", ("priority",)),
        Mapped("type", "varchar", ("type",)),
        Mapped("requester_id", "bigint", ("requester_id",)),
        Mapped("assignee_id", "bigint", ("assignee_id",)),
        Mapped("organization_id", "bigint", ("organization_id",)),
        Mapped("group_id", "bigint", ("group_id",)),
        Mapped("tags", "varchar", ("tags",)),
        Mapped("created_at", "varchar", ("created_at",)),
        Mapped("updated_at", "varchar", ("updated_at",)),
    ),
    "users": (
        Mapped("id", "bigint", ("id",)),
        Mapped("name", "varchar", ("name",)),
        Mapped("email", "varchar", ("email",)),
        Mapped("role", "varchar", ("role",)),
        Mapped("active", "boolean", ("active",)),
        Mapped("organization_id", "bigint", ("organization_id",)),
        Mapped("created_at", "varchar", ("created_at",)),
        Mapped("updated_at", "varchar", ("updated_at",)),
    ),
    "organizations": (
        Mapped("id", "bigint", ("id",)),
        Mapped("name", "varchar", ("name",)),
        Mapped("domain_names", "varchar", ("domain_names",)),
        Mapped("group_id", "bigint", ("group_id",)),
        Mapped("created_at", "varchar", ("created_at",)),
        Mapped("updated_at", "varchar", ("updated_at",)),
    ),
    "groups": (
        Mapped("id", "bigint", ("id",)),
        Mapped("name", "varchar", ("name",)),
        Mapped("description", "varchar", ("description",)),
        Mapped("deleted", "boolean", ("deleted",)),
        Mapped("created_at", "varchar", ("created_at",)),
        Mapped("updated_at", "varchar", ("updated_at",)),
    ),
    "ticket_metrics": (
        Mapped("id", "bigint", ("id",)),
        Mapped("ticket_id", "bigint", ("ticket_id",)),
        Mapped("reopens", "integer", ("reopens",)),
        Mapped("replies", "integer", ("replies",)),
        Mapped("first_reply_time_calendar", "integer", ("first_reply_time_calendar",)),
        Mapped("full_resolution_time_calendar", "integer", ("full_resolution_time_calendar",)),
        Mapped("created_at", "varchar", ("created_at",)),
        Mapped("updated_at", "varchar", ("updated_at",)),
    ),
    "satisfaction_ratings": (
        Mapped("id", "bigint", ("id",)),
        Mapped("ticket_id", "bigint", ("ticket_id",)),
        Mapped("score", "varchar", ("score",)),
        Mapped("comment", "varchar", ("comment",)),
        Mapped("created_at", "varchar", ("created_at",)),
        Mapped("updated_at", "varchar", ("updated_at",)),
    ),
}

LIST_FIELDS = {"tags", "domain_names"}


def output_schema(table: Sequence[Mapped]) -> T.StructType:
    """Typed schema of a mapped table, its keys flagged."""
    return T.StructType([field(m.name, m.type, primary_key=m.primary_key) for m in table])


def raw_schema(table: Sequence[Mapped]) -> T.StructType:
    """Schema of the raw JSON: exactly the fields the mapping reads, leaves as text."""
    tree: dict = {}
    for m in table:
        for path in m.paths:
            if path == "-":
                continue
            node = tree
            *parents, leaf = path.split(".")
            for p in parents:
                node = node.setdefault(p, {})
            node[leaf] = "array<string>" if m.kind == "list" else "string"

    def struct(node: Mapping) -> T.StructType:
        return T.StructType(
            [
                T.StructField(k, struct(v) if isinstance(v, dict) else T._parse_datatype_string(v))
                for k, v in node.items()
            ]
        )

    return struct(tree)


def _has(schema: T.StructType, path: str) -> bool:
    kind: T.DataType = schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return False
        kind = kind[part].dataType
    return True


def _first_filled(schema: T.StructType, paths: Sequence[str]) -> Column:
    """First path with a non-empty value; paths the rows do not have are null."""
    cols = [F.col(p) for p in paths if _has(schema, p)]
    if not cols:
        return F.lit(None).cast("string")
    if len(cols) == 1:
        return cols[0]
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in cols[:-1]], cols[-1].cast("string"))


def _money(schema: T.StructType, path: str) -> Column:
    """Amount of a budget struct: null without the struct, 0 without an amount in it."""
    parent = path.rsplit(".", 1)[0]
    if not _has(schema, parent):
        return F.lit(None).cast("double")
    amount = F.col(path).try_cast("double") if _has(schema, path) else F.lit(None).cast("double")
    return F.when(F.col(parent).isNotNull(), F.coalesce(amount, F.lit(0.0)))


def map_payload(
    raw: DataFrame, table: Sequence[Mapped], account_id: int | str | None = None, keep: Sequence[Column] = ()
) -> DataFrame:
    """Raw nested rows to the typed columns of a mapping, its keys flagged, in one projection.

    ``keep`` are columns of the raw rows passed on.
    """
    schema = raw.schema
    kinds: dict[str, Callable[[Mapped], Column]] = {
        "value": lambda m: _first_filled(schema, m.paths),
        "list": lambda m: F.coalesce(F.to_json(_first_filled(schema, m.paths)), F.lit("")),
        "urn": lambda m: urn_id(_first_filled(schema, m.paths).cast("string")),
        "ms_date": lambda m: ms_to_date(_first_filled(schema, m.paths).cast("bigint")),
        "money": lambda m: _money(schema, m.paths[0]),
        "account": lambda m: F.lit(account_id),
    }
    columns = [kinds[m.kind](m).try_cast(canonical_type(m.type)).alias(m.name) for m in table]
    return with_primary_key(raw.select(*columns, *keep), [m.name for m in table if m.primary_key])


def read_payload(spark: SparkSession, paths: str | Sequence[str], table: Sequence[Mapped], **kwargs) -> DataFrame:
    """Landed NDJSON rows as a typed table."""
    return map_payload(spark.read.schema(raw_schema(table)).json(paths), table, **kwargs)


def map_analytics(elements: DataFrame, pivot: str) -> DataFrame:
    """Daily ad analytics by campaign or by creative, with derived ratios."""
    start = lambda p: F.col(f"dateRange.start.{p}")
    counts = {m.name: _first_filled(elements.schema, m.paths).cast("bigint") for m in ANALYTICS_COUNTS}
    usd = F.nullif(F.col("costInUsd").cast("double"), F.lit(0.0))
    metrics = ad_metrics(
        F.col("impressions").cast("bigint"), F.col("clicks").cast("bigint"), F.col("costInLocalCurrency")
    )
    columns = {
        **pivot_ids(F.lit(pivot), F.col("pivotValue")),
        "date": date_from_parts(start("year"), start("month"), start("day")),
        **metrics,
        "cost_in_usd": usd,
        **counts,
    }
    keys = ("creative_id" if pivot == "CREATIVE" else "campaign_id", "date")
    return with_primary_key(elements.select(*[c.alias(n) for n, c in columns.items()]), keys)


def audience_counts(campaigns: DataFrame, landed: DataFrame, fetched_at: str | Column, *keep: str) -> DataFrame:
    """Audience size of the campaigns for which a count was landed; ``keep`` are columns of the counts passed on."""
    counts = landed.select(urn_id("campaign").alias("campaign_id"), "audience_count", F.lit(fetched_at).alias("fetched_at"), *keep)
    return campaigns.select(F.col("id").alias("campaign_id")).join(counts, "campaign_id")


def manager_gate(metrics: DataFrame, accounts: DataFrame, clients: DataFrame, customer_id: str) -> DataFrame:
    """Metrics of the account to report on.

    An ordinary account reports for itself. A manager account reports for its first enabled
    client that is no manager, and for nobody when there is none.
    """
    kind = metrics.schema["customer_id"].dataType
    managers = accounts.filter((F.col("customer_id") == customer_id) & F.col("manager"))
    is_manager = managers.agg((F.count(F.lit(1)) > 0).alias("m")).scalar()
    usable = clients.filter(~F.col("manager") & (F.col("status") == "ENABLED"))
    first = usable.agg(F.min_by("customer_id", "position").cast(kind).alias("c")).scalar()
    return metrics.filter(F.col("customer_id") == F.when(is_manager, first).otherwise(F.lit(customer_id).cast(kind)))


def salesforce_records(raw: DataFrame, binary_fields: Sequence[str] = ()) -> DataFrame:
    """Records without their envelope field and without base64 fields."""
    return raw.drop("attributes", *binary_fields)


def salesforce_scan(
    records: DataFrame, fields: Sequence[str], where: str | None = None, order_by: str | None = None
) -> DataFrame:
    """Field list and where clause of an object query."""
    kept = records.filter(F.expr(where)) if where else records
    kept = kept.select(*fields)
    return kept.orderBy(order_by) if order_by else kept


def hubspot_owners(pages: DataFrame) -> DataFrame:
    return map_payload(unnest_pages(pages, "results"), HUBSPOT_OWNERS)


def hubspot_objects(pages: DataFrame) -> DataFrame:
    """CRM objects with their properties as columns."""
    return promote_properties(unnest_pages(pages, "results"))


def zendesk_rows(pages: DataFrame, table: str) -> DataFrame:
    """Rows of the pages of one help-desk table, lists joined to text, columns typed."""
    return map_payload(flatten_joined(unnest_pages(pages, table)), ZENDESK[table])


def zendesk_page_schema(table: str) -> T.StructType:
    """Schema of a landed page of one help-desk table."""
    record = T.StructType(
        [
            T.StructField(m.name, T.ArrayType(T.StringType()) if m.name in LIST_FIELDS else T.StringType())
            for m in ZENDESK[table]
        ]
    )
    return T.StructType([T.StructField(table, T.ArrayType(record))])


def dynamodb_items(export: DataFrame, item: str = "Item") -> DataFrame:
    """Rows of a table export, whose attributes are wrapped in their type: ``{"n": {"N": "1"}}``.

    Numbers become doubles; sets, lists and maps become JSON text.
    """

    def unwrap(attribute: T.StructField) -> Column:
        kinds = set(attribute.dataType.names)
        at = lambda kind: F.col(f"`{item}`.`{attribute.name}`.`{kind}`")
        if kinds <= {"N", "NULL"} and "N" in kinds:
            return at("N").try_cast("double")
        if kinds <= {"BOOL", "NULL"} and "BOOL" in kinds:
            return at("BOOL").cast("boolean")
        parts = [at(k).cast("string") for k in ("S", "N", "BOOL", "B") if k in kinds]
        parts += [F.to_json(at(k)) for k in ("SS", "NS", "BS", "L", "M") if k in kinds]
        return F.coalesce(*parts) if parts else F.lit(None).cast("string")

    attributes = export.schema[item].dataType.fields
    return export.select(*[unwrap(a).alias(a.name) for a in attributes])
