"""Data model: operations, canonical types, key metadata, change-event columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The four operations of a change event.
OPERATIONS = ("insert", "update", "delete", "snapshot")

# Metadata columns carried by every target row.
CDC_OP = "_cdc_op"
CDC_SOURCE = "_cdc_source"
CDC_TS = "_cdc_ts"
CDC_INGEST_TS = "_cdc_ingest_ts"
META_COLUMNS = (CDC_OP, CDC_SOURCE, CDC_TS, CDC_INGEST_TS)

# Added by us: a tie-break inside one timestamp.
CDC_SEQ = "_cdc_seq"

RESCUED = "_rescued"

# Normalised type name -> Spark type. Anything else is a string.
CANONICAL_TYPES: dict[str, str] = {
    "varchar": "string",
    "text": "string",
    "char": "string",
    "string": "string",
    "uuid": "string",
    "json": "string",
    "jsonb": "string",
    "interval": "string",
    "time": "string",
    "int": "int",
    "integer": "int",
    "serial": "int",
    "smallint": "int",
    "bigint": "bigint",
    "bigserial": "bigint",
    "int64": "bigint",
    "float": "float",
    "double": "double",
    "float64": "double",
    "numeric": "decimal",
    "decimal": "decimal",
    "boolean": "boolean",
    "bool": "boolean",
    "timestamp": "timestamp",
    "date": "date",
    "bytea": "binary",
    "bytes": "binary",
    "varbinary": "binary",
}


def canonical_type(name: str, decimal_mode: str = "decimal") -> str:
    """Spark DDL type for a normalised type name such as ``NUMERIC(12,2)``.

    A decimal keeps its precision when the name states one; without one, or with
    ``decimal_mode='double'``, it becomes a double.
    """
    lowered = name.strip().lower()
    base, _, params = lowered.partition("(")
    spark_type = CANONICAL_TYPES.get(base.strip(), "string")
    if spark_type != "decimal":
        return spark_type
    digits = params.rstrip(") ").replace(" ", "")
    if decimal_mode == "double" or not digits:
        return "double"
    return f"decimal({digits})" if "," in digits else f"decimal({digits},0)"


def normalize_type(col: Column | str) -> Column:
    """Column form of ``canonical_type`` for whole catalog frames."""
    col = F.col(col) if isinstance(col, str) else col
    lowered = F.lower(F.trim(col))
    base = F.trim(F.substring_index(lowered, "(", 1))
    params = F.regexp_replace(F.regexp_extract(lowered, r"\(([^)]*)\)", 1), " ", "")
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(CANONICAL_TYPES.items())])
    known = F.coalesce(F.try_element_at(lookup, base), F.lit("string"))
    decimal = (
        F.when(params == "", F.lit("double"))
        .when(params.contains(","), F.concat(F.lit("decimal("), params, F.lit(")")))
        .otherwise(F.concat(F.lit("decimal("), params, F.lit(",0)")))
    )
    return F.when(known == "decimal", decimal).otherwise(known)


def field(name: str, type_name: str, nullable: bool = True, primary_key: bool = False) -> T.StructField:
    data_type = T._parse_datatype_string(canonical_type(type_name))
    metadata = {"primary_key": True} if primary_key else {}
    return T.StructField(name, data_type, nullable and not primary_key, metadata)


def primary_keys(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if f.metadata.get("primary_key")]


def with_primary_key(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Flag key columns so that writers and merges can find them."""
    for key in keys:
        df = df.withMetadata(key, {"primary_key": True})
    return df


def default_schema(table: str, default: str) -> tuple[str, str]:
    """Split a dotted identity; an undotted one lives in ``default``."""
    schema, dot, name = table.partition(".")
    return (schema, name) if dot else (default, table)


def normalize_identifier(col: Column | str, lakehouse: bool = False) -> Column:
    """Target table name: dots become underscores; a lakehouse name also folds
    dashes and case."""
    col = F.col(col) if isinstance(col, str) else col
    return F.lower(F.translate(col, ".-", "__")) if lakehouse else F.translate(col, ".", "_")


def target_name(table: str, lakehouse: bool = False) -> str:
    name = table.replace(".", "_")
    return name.replace("-", "_").lower() if lakehouse else name


def checked_op(op: Column) -> Column:
    """The operation, or an error naming the value that is none of the four."""
    known = op.isin(*OPERATIONS)
    return F.when(known, op).otherwise(
        F.raise_error(F.concat(F.lit("unknown operation: "), F.coalesce(op, F.lit("null"))))
    )


def add_cdc_meta(
    df: DataFrame,
    source: str,
    op: Column | str = "snapshot",
    ts: Column | None = None,
    seq: Column | None = None,
    ingest: bool = True,
) -> DataFrame:
    """Promote payload rows to change events."""
    columns = {
        CDC_OP: F.lit(op) if isinstance(op, str) else checked_op(op),
        CDC_SOURCE: F.lit(source),
        CDC_TS: F.current_timestamp() if ts is None else ts,
    }
    if seq is not None:
        columns[CDC_SEQ] = seq
    if ingest:
        columns[CDC_INGEST_TS] = F.current_timestamp()
    return df.withColumns(columns)


def event_row(before: str = "before", after: str = "after", op: str = "op") -> Column:
    """The current image of an event: ``after``, but ``before`` for a delete."""
    return F.when(F.col(op) == "delete", F.col(before)).otherwise(F.col(after))


def payload_columns(columns: Iterable[str]) -> list[str]:
    return [c for c in columns if c not in (*META_COLUMNS, CDC_SEQ)]


def drop_prefix(df: DataFrame, *prefixes: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(tuple(prefixes))])


def positional_remap(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Give a frame its real column names when the log carries only positions."""
    placeholder = all(c.upper().startswith("UNKNOWN_COL") for c in df.columns)
    return df.toDF(*names) if placeholder and len(names) == len(df.columns) else df


def map_expr(values: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])
