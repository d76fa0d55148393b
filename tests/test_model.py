import pytest
from pyspark.sql import functions as F

from tidewell import model as M


@pytest.mark.parametrize(
    "name,expected",
    [
        ("VARCHAR(255)", "string"), ("uuid", "string"), ("serial", "int"), ("SMALLINT", "int"),
        ("bigserial", "bigint"), ("int64", "bigint"), ("float64", "double"), ("numeric(10, 4)", "decimal(10,4)"),
        ("decimal(8)", "decimal(8,0)"), ("numeric", "double"), ("bytea", "binary"), ("varbinary", "binary"),
        ("time", "string"), ("geometry", "string"), (" Timestamp ", "timestamp"),
    ],
)
def test_canonical_type_in_both_forms(spark, name, expected):
    assert M.canonical_type(name) == expected
    one = spark.createDataFrame([(name,)], "t string").select(M.normalize_type("t"))
    assert one.first()[0] == expected


def test_decimal_mode_double():
    assert M.canonical_type("numeric(10,4)", decimal_mode="double") == "double"


def test_primary_key_metadata(spark):
    df = M.with_primary_key(spark.createDataFrame([(1, 2, 3)], "a int, b int, c int"), ["a", "c"])
    assert M.primary_keys(df.schema) == ["a", "c"]
    assert M.primary_keys(df.filter("a > 0").schema) == ["a", "c"]


def test_names():
    assert M.target_name("Public.My-Table") == "Public_My-Table"
    assert M.target_name("Public.My-Table", lakehouse=True) == "public_my_table"
    assert M.default_schema("t", "dbo") == ("dbo", "t")
    assert M.default_schema("s.t", "dbo") == ("s", "t")


def test_event_row_is_before_for_deletes(spark):
    df = spark.createDataFrame(
        [("delete", (1,), None), ("update", (1,), (2,)), ("snapshot", None, (3,))],
        "op string, before struct<v:int>, after struct<v:int>",
    )
    assert [r[0] for r in df.select(M.event_row().getField("v")).collect()] == [1, 2, 3]


def test_unknown_operation_raises(spark):
    df = M.add_cdc_meta(spark.createDataFrame([("truncate",)], "o string"), "s", op=F.col("o"))
    with pytest.raises(Exception, match="unknown operation: truncate"):
        df.collect()


def test_meta_columns(spark):
    df = M.add_cdc_meta(spark.createDataFrame([(1,)], "a int"), "src")
    assert df.columns == ["a", *M.META_COLUMNS]
    row = df.first()
    assert (row["_cdc_op"], row["_cdc_source"]) == ("snapshot", "src")


def test_positional_remap_needs_placeholders_and_arity(spark):
    df = spark.createDataFrame([(1, 2)], "UNKNOWN_COL0 int, UNKNOWN_COL1 int")
    assert M.positional_remap(df, ["a", "b"]).columns == ["a", "b"]
    assert M.positional_remap(df, ["a"]).columns == df.columns
    named = spark.createDataFrame([(1, 2)], "x int, y int")
    assert M.positional_remap(named, ["a", "b"]).columns == ["x", "y"]
