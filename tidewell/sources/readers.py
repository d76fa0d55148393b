"""One reader per registered source type, chosen by a job's configuration."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators.incremental import high_watermark_value
from tidewell.sources import payloads
from tidewell.sources.dialects import DIALECTS, PERFORMANCE_TABLES, SOURCE_TYPES, SourceType
from tidewell.sources.files import FileOptions, list_files, read_detected, resolve_prefix
from tidewell.sources.jdbc import KEY_CATALOGS, cursor_bound_query, primary_key_of, read_database
from tidewell.sources.splits import read_split
from tidewell.sources.table_formats import current_version, delta_changes, delta_snapshot, hudi_table

# When the page a row came with was landed. Of rows with one key the latest counts; it is not stored.
LANDED = "__landed"
SPLITS = 32
PAYLOAD_TABLES = {"google_ads": payloads.GOOGLE_ADS, "linkedin_ads": payloads.LINKEDIN_ADS}


@dataclass
class ConfiguredSource:
    """The source a job's configuration describes."""

    spark: SparkSession
    config: Mapping[str, Any]
    newest_file: dict[str, Any] = field(default_factory=dict)

    @property
    def source(self) -> SourceType:
        source_type = self.config["source_type"]
        if source_type not in SOURCE_TYPES:
            raise ValueError(f"unknown source type: {source_type}")
        return SOURCE_TYPES[source_type]

    def _table_config(self, table: str) -> Mapping[str, Any]:
        return self.config.get("tables_config", {}).get(table, {})

    def read(self, table: str, newer_than: Any = None, pages: tuple[Any, Any] | None = None) -> DataFrame | None:
        """Rows of one table. ``newer_than`` limits file sources to later files; None where
        there are no files. ``pages`` limits landed pages to those from one time to another.

        API sources are read from the folder their raw pages were landed in, named by
        ``connection.landing``.
        """
        spark, source, settings = self.spark, self.source, self._table_config(table)
        connection = self.config.get("connection", {})
        if source.dialect == "dynamodb" and "export" in connection:
            return payloads.dynamodb_items(spark.read.json(resolve_prefix(connection["export"], table)))
        if source.kind == "database" and settings.get("split_by") and DIALECTS[source.dialect].format == "jdbc":
            rows = read_split(spark, source.dialect, connection, table, settings["split_by"], int(settings.get("splits", SPLITS)), settings)
            return rows.select(*settings["columns"]) if settings.get("columns") else rows
        if source.kind == "database":
            return read_database(
                spark, source.dialect, connection, table, settings.get("columns"), settings, settings.get("partition")
            )
        if source.kind == "format":
            options = {**connection.get("options", {}), **settings.get("options", {})}
            return spark.read.format(connection["format"]).options(**options).load(settings.get("path"))
        if source.kind in ("files", "blobs"):
            options = FileOptions.from_config(connection, settings)
            listing = list_files(spark, resolve_prefix(connection["path"], table), newer_than, max_files=options.max_files)
            rows, newest = read_detected(spark, listing, options, blob=source.kind == "blobs")
            self.newest_file[table] = newest
            return rows
        path = resolve_prefix(connection.get("path") or connection.get("landing", ""), table)
        if source.kind == "delta":
            return delta_snapshot(spark, path)
        if source.kind == "hudi":
            return hudi_table(spark, path)
        return read_landed(spark, self.config["source_type"], table, path, connection, settings, pages)

    def newest_page(self, table: str) -> datetime | None:
        """When the newest landed page of a table was written."""
        connection = self.config.get("connection", {})
        files = list_files(self.spark, resolve_prefix(connection.get("path") or connection.get("landing", ""), table))
        return high_watermark_value(files, "modificationTime")

    def changes(self, table: str, last: int | None) -> tuple[DataFrame | None, int | None]:
        """Change feed of the versions after ``last``, and the current version; no frame where there is no newer one.

        A table of the versioned format gives its rows the first time. Any other reader must give the feed itself.
        """
        connection = self.config.get("connection", {})
        if self.source.kind == "delta":
            path = resolve_prefix(connection["path"], table)
            current = current_version(self.spark, path)
            return delta_changes(self.spark, path, last, current), current
        feed = self.read(table)
        current = feed.agg(F.max("_commit_version")).first()[0]
        if current is None or (last is not None and last >= current):
            return None, last
        newer = feed if last is None else feed.filter(F.col("_commit_version") > last)
        return newer.filter(F.col("_commit_version") <= current), current

    def keys(self, table: str) -> tuple[str, ...]:
        """Primary key by the catalog of the database; none for a query or another kind of source."""
        source = self.source
        if source.dialect not in KEY_CATALOGS or self._table_config(table).get("query"):
            return ()
        return primary_key_of(self.spark, source.dialect, self.config.get("connection", {}), table)

    def high_watermark(self, table: str, cursor: str, rows: DataFrame, cursor_type: str = "") -> Any:
        """Maximum cursor. For files it is that of the very files ``read`` listed; a database
        reached by JDBC computes it itself."""
        source, settings = self.source, self._table_config(table)
        if table in self.newest_file and cursor == source.default_cursor:
            return self.newest_file[table]
        if source.kind != "database" or DIALECTS[source.dialect].format != "jdbc" or settings.get("query"):
            return high_watermark_value(rows, cursor, cursor_type)
        connection = self.config.get("connection", {})
        query = cursor_bound_query(source.dialect, table, cursor, default=connection.get("schema"))
        top = read_database(self.spark, source.dialect, connection, table, config={"query": query})
        return high_watermark_value(top, top.columns[0])


def landed_pages(spark: SparkSession, path: str, schema: Any = None, pages: tuple[Any, Any] | None = None) -> DataFrame:
    """Landed pages, those between two times, both included, where ``pages`` names them: others are not opened."""
    reader = spark.read.schema(schema) if schema else spark.read
    found = reader.json(path)
    if pages is None:
        return found
    low, high = (F.lit(t.isoformat(sep=" ")).cast("timestamp") for t in pages)
    return found.filter(F.col("_metadata.file_modification_time").between(low, high))


def reporting_account(spark: SparkSession, rows: DataFrame, connection: Mapping[str, Any]) -> DataFrame:
    """Rows with a ``customer_id`` that the configured account reports for, a manager for its first enabled client.

    Clients are ordered by level and id.
    """
    customer, client = "customer STRUCT<id: STRING, manager: BOOLEAN>", "customerClient STRUCT<id: STRING, manager: BOOLEAN, status: STRING, level: INT>"
    accounts = spark.read.schema(customer).json(resolve_prefix(connection["landing"], "accounts"))
    clients = spark.read.schema(client).json(resolve_prefix(connection["landing"], "customer_clients"))
    accounts = accounts.select(F.col("customer.id").alias("customer_id"), F.coalesce("customer.manager", F.lit(False)).alias("manager"))
    of = lambda name: F.col(f"customerClient.{name}")
    position = F.struct(F.coalesce(of("level"), F.lit(0)), of("id").cast("long"))
    clients = clients.select(of("id").alias("customer_id"), F.coalesce(of("manager"), F.lit(False)).alias("manager"), of("status").alias("status"), position.alias("position"))
    return payloads.manager_gate(rows, accounts, clients, str(connection["customer_id"]))


def read_landed(
    spark: SparkSession,
    source_type: str,
    table: str,
    path: str,
    connection: Mapping[str, Any],
    settings: Mapping[str, Any] | None = None,
    pages: tuple[Any, Any] | None = None,
) -> DataFrame:
    """Typed rows of landed API pages. ``schema`` in the settings is that of a page, where none is fixed."""
    settings = settings or {}
    mapping = PAYLOAD_TABLES.get(source_type, {}).get(table)
    if mapping:
        extra = {"account_id": connection["account_id"]} if source_type == "linkedin_ads" else {}
        schema, keep = payloads.raw_schema(mapping), [F.col("_metadata.file_modification_time").alias(LANDED)]
        gated = source_type == "google_ads" and table in PERFORMANCE_TABLES and connection.get("customer_id") is not None
        if gated:
            schema = T.StructType([*schema.fields, T.StructField("customer", T.StructType([T.StructField("id", T.StringType())]))])
            keep.append(F.col("customer.id").alias("customer_id"))
        rows = payloads.map_payload(landed_pages(spark, path, schema, pages), mapping, keep=keep, **extra)
        return reporting_account(spark, rows, connection).drop("customer_id") if gated else rows
    if source_type == "linkedin_ads" and table == "audience_counts":
        # Counts of the campaigns that were landed too; the time of a count is that of its page.
        campaigns = read_landed(spark, source_type, "campaigns", resolve_prefix(connection["landing"], "campaigns"), connection)
        counts = landed_pages(spark, path, "campaign STRING, audience_count BIGINT")
        counts = counts.select("*", F.col("_metadata.file_modification_time").alias(LANDED))
        return payloads.audience_counts(campaigns.select("id").distinct(), counts, F.col(LANDED), LANDED)
    if source_type == "zendesk":
        found = landed_pages(spark, path, payloads.zendesk_page_schema(table), pages)
        return payloads.zendesk_rows(found, table)
    found = landed_pages(spark, path, settings.get("schema"), pages)
    if source_type == "hubspot":
        return payloads.hubspot_owners(found) if table == "owners" else payloads.hubspot_objects(found)
    if source_type == "salesforce":
        records = payloads.salesforce_records(payloads.unnest_pages(found, "records"), settings.get("binary_fields", ()))
        fields = settings.get("fields") or records.columns
        # The cursor is always among the fields, or the next load would not know where to go on.
        cursor = [c for c in (SOURCE_TYPES[source_type].default_cursor,) if c in records.columns and c not in fields]
        return payloads.salesforce_scan(records, [*fields, *cursor], settings.get("where_clause"))
    if source_type == "linkedin_ads" and table in ("ad_analytics", "ad_analytics_creative"):
        elements = payloads.unnest_pages(found, "elements")
        return payloads.map_analytics(elements, "CREATIVE" if table.endswith("creative") else "CAMPAIGN")
    return found
