"""Nested payloads to flat rows. The schema is walked once on the driver."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NESTED = (T.StructType, T.ArrayType, T.MapType, T.VariantType)


def unnest_pages(pages: DataFrame, result_key: str, *keep: str) -> DataFrame:
    """One row per element of the result array of every landed page."""
    exploded = pages.select(*keep, F.explode(F.col(result_key)).alias("__record"))
    record = exploded.schema["__record"].dataType
    inner = "__record.*" if isinstance(record, T.StructType) else "__record"
    return exploded.select(*keep, inner)


def _quoted(path: tuple[str, ...]) -> Column:
    return F.col(".".join(f"`{p}`" for p in path))


def _leaves(schema: T.StructType, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], T.DataType]]:
    for f in schema.fields:
        here = (*path, f.name)
        if isinstance(f.dataType, T.StructType):
            yield from _leaves(f.dataType, here)
        else:
            yield here, f.dataType


def flatten_underscore(df: DataFrame, sep: str = "_") -> DataFrame:
    """Every leaf as its own column, names joined; arrays and maps as JSON text."""
    columns = []
    for path, data_type in _leaves(df.schema):
        col = _quoted(path)
        if isinstance(data_type, NESTED):
            col = F.to_json(col)
        columns.append(col.alias(sep.join(path)))
    return df.select(*columns)


def flatten_one_level(df: DataFrame) -> DataFrame:
    """Top-level columns stay; whatever is nested becomes JSON text."""
    return df.select(
        *[
            (F.to_json(_quoted((f.name,))) if isinstance(f.dataType, NESTED) else _quoted((f.name,))).alias(f.name)
            for f in df.schema.fields
        ]
    )


def flatten_joined(df: DataFrame, sep: str = ", ") -> DataFrame:
    """Arrays as joined text, structs and maps as JSON text."""

    def text(f: T.StructField) -> Column:
        col = _quoted((f.name,))
        if isinstance(f.dataType, T.ArrayType):
            item = f.dataType.elementType
            as_text = (lambda x: F.to_json(x)) if isinstance(item, NESTED) else (lambda x: x.cast("string"))
            return F.array_join(F.transform(col, as_text), sep)
        return F.to_json(col) if isinstance(f.dataType, NESTED) else col

    return df.select(*[text(f).alias(f.name) for f in df.schema.fields])


def promote_properties(df: DataFrame, id_col: str = "id", properties: str = "properties") -> DataFrame:
    """``{id, properties{...}}`` to one flat row."""
    names = [f.name for f in df.schema[properties].dataType.fields if f.name != id_col]
    return df.select(id_col, *[F.col(f"{properties}.{n}").alias(n) for n in names])


def _utc_text(col: Column, data_type: T.DataType) -> Column:
    zoned = isinstance(data_type, T.TimestampType)
    wall = F.to_utc_timestamp(col, F.current_timezone()) if zoned else col
    return F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def normalize_values(df: DataFrame) -> DataFrame:
    """Plain values: ISO text for times, JSON for nested, hex for bytes, double for decimals."""

    def plain(f: T.StructField) -> Column:
        col = _quoted((f.name,))
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return _utc_text(col, f.dataType)
        if isinstance(f.dataType, T.DateType):
            return col.cast("string")
        if isinstance(f.dataType, T.BinaryType):
            return F.lower(F.hex(col))
        if isinstance(f.dataType, T.DecimalType):
            return col.cast("double")
        return F.to_json(col) if isinstance(f.dataType, NESTED) else col

    return df.select(*[plain(f).alias(f.name) for f in df.schema.fields])


def canonicalize_values(df: DataFrame) -> DataFrame:
    """Values as a SQL literal would carry them: millisecond times, doubles, hex bytes."""

    def literal(f: T.StructField) -> Column:
        col = _quoted((f.name,))
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_trunc("MILLISECOND", col).cast(f.dataType)
        if isinstance(f.dataType, T.DecimalType):
            return col.cast("double")
        if isinstance(f.dataType, T.BinaryType):
            return F.lower(F.hex(col))
        return col

    return df.select(*[literal(f).alias(f.name) for f in df.schema.fields])
