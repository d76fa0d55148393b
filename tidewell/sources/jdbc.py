"""Database reads through one reader parameterised by a dialect record.

The cursor range and the column list stay DataFrame operations, so that Spark pushes them
to the database. A numeric key gives parallel, range-partitioned reads.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.model import default_schema
from tidewell.operators.schema import lookup_type, primary_key_columns
from tidewell.sources.dialects import DIALECTS, Dialect, bare_type


def table_reference(dialect: Dialect, table: str, default: str | None = None) -> str:
    """Quoted multi-part name; an undotted table lives in the default schema."""
    if "." not in table and not (default or dialect.default_schema):
        return dialect.quoted(table)
    schema, name = default_schema(table, default or dialect.default_schema)
    return f"{dialect.quoted(schema)}.{dialect.quoted(name)}"


def reader_options(
    source: str,
    connection: Mapping[str, Any],
    table: str,
    config: Mapping[str, Any] | None = None,
    partition: Mapping[str, Any] | None = None,
) -> dict[str, str]:
    """Options for ``spark.read``.

    ``config`` may hold ``query`` (replaces the table), ``settings`` (session settings) and
    ``fetch_size``. ``partition`` holds ``column, lower, upper, num``.
    """
    dialect, config = DIALECTS[source], config or {}
    if dialect.format != "jdbc":
        names = {**connection, "table": table}
        if source == "cassandra" and "." in table:
            names["keyspace"], names["table"] = table.split(".", 1)
        options = {k: v.format(**names) for k, v in dialect.connector_options.items()}
        if config.get("query") and source == "cosmosdb":
            options["spark.cosmos.read.customQuery"] = config["query"]
        return options
    options = {
        "url": dialect.connection_url(connection),
        "driver": dialect.driver,
        "fetchsize": str(config.get("fetch_size", dialect.fetch_size)),
    }
    if connection.get("token"):
        options.update(user="token", password=str(connection["token"]))
    options.update({k: str(connection[k]) for k in ("user", "password") if k in connection})
    if config.get("query") and not partition:
        options["query"] = config["query"]
    elif config.get("query"):
        options["dbtable"] = f"({config['query']}) q"
    else:
        options["dbtable"] = table_reference(dialect, table, connection.get("schema"))
    if config.get("settings"):
        options["sessionInitStatement"] = "SET " + ", ".join(f"{k} = {v}" for k, v in config["settings"].items())
    if partition:
        options.update(
            partitionColumn=dialect.quoted(partition["column"]),
            lowerBound=str(partition["lower"]),
            upperBound=str(partition["upper"]),
            numPartitions=str(partition["num"]),
        )
    return options


def read_database(
    spark: SparkSession,
    source: str,
    connection: Mapping[str, Any],
    table: str,
    columns: Sequence[str] | None = None,
    config: Mapping[str, Any] | None = None,
    partition: Mapping[str, Any] | None = None,
) -> DataFrame:
    options = reader_options(source, connection, table, config, partition)
    df = spark.read.format(DIALECTS[source].format).options(**options).load()
    return df.select(*columns) if columns else df


def cursor_bound_query(source: str, table: str, cursor: str, fn: str = "MAX", default: str | None = None) -> str:
    """Query that lets the database itself compute a watermark or a partition bound."""
    dialect = DIALECTS[source]
    alias = dialect.quoted("bound")
    return f"SELECT {fn}({dialect.quoted(cursor)}) AS {alias} FROM {table_reference(dialect, table, default)}"


# Catalog queries: columns, and the columns of primary keys.
COLUMNS_QUERY = (
    "SELECT table_schema, table_name, column_name, ordinal_position, data_type "
    "FROM information_schema.columns"
)
POSTGRES_COLUMNS_QUERY = (
    "SELECT n.nspname AS table_schema, c.relname AS table_name, a.attname AS column_name, "
    "a.attnum AS ordinal_position, CAST(a.atttypid AS text) AS data_type "
    "FROM pg_attribute a JOIN pg_class c ON c.oid = a.attrelid JOIN pg_namespace n ON n.oid = c.relnamespace "
    "WHERE a.attnum > 0 AND NOT a.attisdropped"
)
KEY_COLUMNS_QUERY = (
    "SELECT k.table_schema, k.table_name, k.column_name "
    "FROM information_schema.table_constraints c JOIN information_schema.key_column_usage k "
    "ON c.constraint_name = k.constraint_name AND c.table_schema = k.table_schema "
    "AND c.table_name = k.table_name WHERE c.constraint_type = 'PRIMARY KEY'"
)

ORACLE_COLUMNS_QUERY = (
    'SELECT owner AS "table_schema", table_name AS "table_name", column_name AS "column_name", '
    'column_id AS "ordinal_position", data_type AS "data_type" FROM all_tab_columns'
)
ORACLE_KEY_COLUMNS_QUERY = (
    'SELECT k.owner AS "table_schema", k.table_name AS "table_name", k.column_name AS "column_name" '
    "FROM all_constraints c JOIN all_cons_columns k "
    "ON c.owner = k.owner AND c.constraint_name = k.constraint_name WHERE c.constraint_type = 'P'"
)
SNOWFLAKE_COLUMNS_QUERY = (
    'SELECT table_schema AS "table_schema", table_name AS "table_name", column_name AS "column_name", '
    'ordinal_position AS "ordinal_position", data_type AS "data_type" FROM information_schema.columns'
)
COLUMN_CATALOGS = {
    "postgres": POSTGRES_COLUMNS_QUERY,
    "oracle": ORACLE_COLUMNS_QUERY,
    "snowflake": SNOWFLAKE_COLUMNS_QUERY,
}
# Key columns of the dialects whose catalog can be asked for them by a query. That of Snowflake cannot: its keys are
# told by a command alone, and a job over it needs them in its configuration.
KEY_CATALOGS = {
    "postgres": KEY_COLUMNS_QUERY,
    "mysql": KEY_COLUMNS_QUERY,
    "sqlserver": KEY_COLUMNS_QUERY,
    "databricks": KEY_COLUMNS_QUERY,
    "oracle": ORACLE_KEY_COLUMNS_QUERY,
}
# Dialects whose type names are told apart by case, or are numbers.
EXACT_TYPES = ("postgres", "clickhouse", "spanner")


def read_catalog(spark: SparkSession, source: str, connection: Mapping[str, Any]) -> DataFrame:
    """Columns of all tables with their normalised type and their part in the primary key, if the catalog tells it."""
    dialect = DIALECTS[source]
    query = COLUMN_CATALOGS.get(source, COLUMNS_QUERY)
    columns = read_database(spark, source, connection, "columns", config={"query": query})
    native = bare_type(F.col("data_type"))
    native = native if source in EXACT_TYPES else F.lower(native)
    typed = columns.withColumn("data_type", lookup_type(dict(dialect.type_map), native))
    if source not in KEY_CATALOGS:
        return typed.withColumn("primary_key", F.lit(False))
    return primary_key_columns(typed, read_database(spark, source, connection, "keys", config={"query": KEY_CATALOGS[source]}))


def primary_key_of(spark: SparkSession, source: str, connection: Mapping[str, Any], table: str) -> tuple[str, ...]:
    """Key columns of one table by the catalog; none where it has no key or the catalog no such table.

    The filters are pushed to the database. An undotted table of a dialect without a default schema lies
    in the connection's database, or in the schema of its user where names are upper-case.
    """
    dialect = DIALECTS[source]
    own = connection.get("user" if dialect.upper_names else "database", "")
    schema, name = default_schema(table, connection.get("schema") or dialect.default_schema or own)
    found = read_database(spark, source, connection, "keys", config={"query": KEY_CATALOGS[source]})
    found = found.filter((F.col("table_schema") == dialect.folded(schema)) & (F.col("table_name") == dialect.folded(name)))
    return tuple(sorted(r["column_name"] for r in found.collect()))
