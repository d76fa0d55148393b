"""Schema inference, evolution, drift and conformance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.scalars import try_whole
from tidewell.model import META_COLUMNS, RESCUED, map_expr

# Inferred types from widest to narrowest.
WIDENING = ("varchar", "double", "bigint", "boolean")


def _classify(value: Column) -> Column:
    """Inferred type of one JSON value."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "BOOLEAN", "boolean")
        .when((kind == "BIGINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$"), "bigint")
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "double")
        .otherwise("varchar")
    )


def json_fields(df: DataFrame, json_col: str, *keep: str) -> DataFrame:
    """One row per key of every JSON object: ``key`` and its inferred type ``data_type``."""
    spark = df.sparkSession
    docs = df.select(*keep, F.try_parse_json(F.col(json_col)).alias("__doc"))
    fields = docs.lateralJoin(spark.tvf.variant_explode(F.col("__doc").outer()))
    return fields.select(
        *keep, F.col("key").alias("column_name"), _classify(F.col("value")).alias("data_type")
    )


def _rank() -> Column:
    """Place of a type among the widening order, as a number: aggregates over it stay in hash
    tables, where text would have to be sorted."""
    return F.array_position(F.array(*[F.lit(t) for t in WIDENING]), F.col("data_type")).cast("int")


def _type_of_rank(rank: str) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in WIDENING]), F.col(rank)).alias("data_type")


def infer_widest(df: DataFrame, json_col: str) -> DataFrame:
    """Union of keys with the widest type each one takes. Order-free, combined map-side."""
    ranked = json_fields(df, json_col).groupBy("column_name").agg(F.min(_rank()).alias("rank"))
    return ranked.select("column_name", _type_of_rank("rank"))


def infer_first(df: DataFrame, json_col: str, ordinal: str) -> DataFrame:
    """Union of keys; the first document that has a key decides its type."""
    ranked = json_fields(df, json_col, ordinal).groupBy("column_name").agg(F.min_by(_rank(), ordinal).alias("rank"))
    return ranked.select("column_name", _type_of_rank("rank"))


def infer_document(df: DataFrame, json_col: str, ordinal: str, key: str = "_id") -> DataFrame:
    """Columns of the first document only, flagging the document key."""
    first = df.select(json_col, ordinal).orderBy(ordinal).limit(1)
    return json_fields(first, json_col).withColumn("primary_key", F.col("column_name") == key)


def schema_frame(df: DataFrame, table: str) -> DataFrame:
    """Columns of a frame as rows."""
    rows = [
        (table, i, f.name, f.dataType.simpleString(), f.nullable, bool(f.metadata.get("primary_key")))
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "table_name string, ordinal int, column_name string, data_type string, "
        "nullable boolean, primary_key boolean",
    )


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames under the union of their columns; absent ones are null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def evolve_schema(target: T.StructType, source: T.StructType) -> T.StructType:
    """Target plus the columns it lacks, nullable. Nothing is widened, dropped or renamed."""
    known = set(target.names)
    added = [T.StructField(f.name, f.dataType, True) for f in source.fields if f.name not in known]
    return T.StructType([*target.fields, *added])


def added_columns(target: T.StructType, source: T.StructType) -> list[T.StructField]:
    return evolve_schema(target, source).fields[len(target.fields):]


def schema_diff(source: DataFrame, target: DataFrame, on: Sequence[str] = ("table_name", "column_name")) -> DataFrame:
    """Source columns the target lacks."""
    return source.join(target.select(*on), list(on), "left_anti")


def schema_drift(stored: DataFrame, current: DataFrame, on: Sequence[str] = ("table_name", "column_name")) -> DataFrame:
    """Columns added, dropped or retyped between two catalog frames."""
    both = stored.select(*on, F.col("data_type").alias("stored_type")).join(
        current.select(*on, F.col("data_type").alias("current_type")), list(on), "full_outer"
    )
    change = (
        F.when(F.col("stored_type").isNull(), "added")
        .when(F.col("current_type").isNull(), "dropped")
        .when(F.col("stored_type") != F.col("current_type"), "retyped")
    )
    return both.withColumn("change", change).filter(F.col("change").isNotNull())


def primary_key_columns(columns: DataFrame, key_columns: DataFrame) -> DataFrame:
    """Catalog columns, each flagged when a primary-key constraint names it."""
    on = ["table_schema", "table_name", "column_name"]
    flagged = key_columns.select(*on).distinct().withColumn("__pk", F.lit(True))
    return columns.join(flagged, on, "left").withColumn(
        "primary_key", F.coalesce(F.col("__pk"), F.lit(False))
    ).drop("__pk")


def conform(df: DataFrame, schema: T.StructType, rescue: bool = True) -> DataFrame:
    """Rows in the target's columns and types.

    A missing column is null. A value that does not cast is null too, and its text is kept
    in ``_rescued`` instead of changing the type of the column.
    """
    present = {f.name: f.dataType for f in df.schema.fields}
    columns, failures, lost_any = [], [], F.lit(False)
    for f in schema.fields:
        if f.name not in present:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif present[f.name] == f.dataType:
            columns.append(F.col(f.name))
        else:
            whole = isinstance(present[f.name], T.StringType) and isinstance(f.dataType, T.IntegralType)
            cast = (
                try_whole(F.col(f.name), f.dataType.simpleString()) if whole else F.col(f.name).try_cast(f.dataType)
            )
            columns.append(cast.alias(f.name))
            lost = F.col(f.name).isNotNull() & cast.isNull()
            failures.append(F.when(lost, F.col(f.name).cast("string")).alias(f.name))
            lost_any = lost_any | lost
    if rescue:
        text = F.to_json(F.struct(*failures)) if failures else F.lit(None).cast("string")
        columns.append(F.when(lost_any, text).alias(RESCUED))
    return df.select(*columns)


def with_meta_schema(schema: T.StructType, ingest: bool = True) -> T.StructType:
    """Schema of a target: payload plus the metadata columns."""
    kinds = dict(zip(META_COLUMNS, (T.StringType(), T.StringType(), T.TimestampType(), T.TimestampType())))
    wanted = META_COLUMNS if ingest else META_COLUMNS[:3]
    meta = T.StructType([T.StructField(n, kinds[n], True) for n in wanted])
    return evolve_schema(schema, meta)


def lookup_type(type_map: dict[str, str], col: Column, default: str = "varchar") -> Column:
    """Normalised type of a source's own type name, for whole catalog frames."""
    return F.coalesce(F.try_element_at(map_expr(type_map), col), F.lit(default))
