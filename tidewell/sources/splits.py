"""Splits of a table for a parallel read: ranges of a column that hold about equally many rows.

Bounds come from a quantile sketch of the column, so a column whose values crowd together still gives even
tasks. A value that holds more rows than a split should is a split by itself.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.sources.dialects import DIALECTS, Dialect
from tidewell.sources.jdbc import read_database, reader_options

ACCURACY = 100_000


def split_bounds(rows: DataFrame, column: str, parts: int) -> list[Any]:
    """At most ``parts - 1`` bounds, ascending: split i holds values from bound i - 1 on and below bound i.

    Numbers of any kind, dates and timestamps; the sketch is merged from those of the tasks.
    """
    kind = rows.schema[column].dataType
    value = F.col(column)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        value = F.unix_micros(value.cast("timestamp"))
    elif not isinstance(kind, T.NumericType):
        raise ValueError(f"{column} is {kind.simpleString()}; a split needs a number or a time")
    shares = [i / parts for i in range(1, parts)]
    if not shares:
        return []
    found = rows.agg(F.percentile_approx(value, shares, ACCURACY).alias("q"), F.min(value).alias("low")).first()
    # A bound at the least value would leave the first split empty.
    bounds = sorted({x for x in found["q"] or [] if x > found["low"]})
    if isinstance(kind, T.NumericType):
        return bounds
    times = rows.sparkSession.createDataFrame([(int(b),) for b in bounds], "us long").select(F.timestamp_micros("us").cast(kind).alias("t"))
    return sorted(r["t"] for r in times.collect())


def literal(value: Any) -> str:
    """A bound as SQL every database reads."""
    if isinstance(value, datetime):
        return f"TIMESTAMP '{value.replace(tzinfo=None).isoformat(sep=' ')}'"
    return f"DATE '{value.isoformat()}'" if isinstance(value, date) else str(value)


def split_predicates(column: str, bounds: list[Any]) -> list[str]:
    """One condition a split: together they hold for every row, null in the first, and no two for the same row."""
    if not bounds:
        return ["1 = 1"]
    edges = [literal(b) for b in bounds]
    first = f"{column} < {edges[0]} OR {column} IS NULL"
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(edges, edges[1:])]
    return [first, *inner, f"{column} >= {edges[-1]}"]


def jdbc_arguments(
    source: str, connection: Mapping[str, Any], table: str, predicates: list[str], config: Mapping[str, Any] | None = None
) -> dict[str, Any]:
    """Arguments for ``spark.read.jdbc`` with one task a predicate."""
    options = reader_options(source, connection, table, config)
    if "query" in options:
        options["dbtable"] = f"({options.pop('query')}) q"
    return {"url": options.pop("url"), "table": options.pop("dbtable"), "predicates": predicates, "properties": options}


def read_split(
    spark: SparkSession,
    source: str,
    connection: Mapping[str, Any],
    table: str,
    column: str,
    parts: int,
    config: Mapping[str, Any] | None = None,
) -> DataFrame:
    """The table in about ``parts`` even splits by a column, of which only that column is read first."""
    dialect: Dialect = DIALECTS[source]
    keys = read_database(spark, source, connection, table, [column], config)
    predicates = split_predicates(dialect.quoted(column), split_bounds(keys, column, parts))
    return spark.read.jdbc(**jdbc_arguments(source, connection, table, predicates, config))
