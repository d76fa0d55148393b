import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators import flatten as FL
from tidewell.operators import schema as S


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "n int, doc string")


def kinds(df):
    return {r["column_name"]: r["data_type"] for r in df.collect()}


def test_widest_type_is_order_free(spark):
    texts = ('{"a": 1, "b": true, "c": 1.5, "d": "x"}', '{"a": 2.5, "b": 1, "e": null}', '{"a": 1, "c": "t", "f": [1], "g": {}}')
    expected = dict(a="double", b="bigint", c="varchar", d="varchar", e="varchar", f="varchar", g="varchar")
    assert kinds(S.infer_widest(docs(spark, *texts), "doc")) == expected
    assert kinds(S.infer_widest(docs(spark, *reversed(texts)), "doc")) == expected


def test_first_seen_type_decides(spark):
    df = docs(spark, '{"a": 1}', '{"a": "x", "b": 1e3}', '{"b": true}')
    assert kinds(S.infer_first(df, "doc", "n")) == {"a": "bigint", "b": "double"}


def test_first_document(spark):
    df = docs(spark, '{"_id": "x", "a": 12345678901234567890}', '{"b": 1}')
    out = {r["column_name"]: (r["data_type"], r["primary_key"]) for r in S.infer_document(df, "doc", "n").collect()}
    assert out == {"_id": ("varchar", True), "a": ("bigint", False)}


def test_broken_documents_are_no_columns(spark):
    assert kinds(S.infer_widest(docs(spark, "{oops", None, '{"a": 1}'), "doc")) == {"a": "bigint"}


def test_evolution_only_adds(spark):
    target = T._parse_datatype_string("a int, b string")
    source = T._parse_datatype_string("b int, c double")
    assert S.evolve_schema(target, source).simpleString() == "struct<a:int,b:string,c:double>"
    assert [f.name for f in S.added_columns(target, source)] == ["c"]


def test_conform_rescues_what_does_not_cast(spark):
    df = spark.createDataFrame([("1", "x", 5), ("no", "y", 6), (None, "z", 7)], "a string, b string, extra int")
    out = S.conform(df, T._parse_datatype_string("a int, b string, c date"))
    rows = [(r["a"], r["b"], r["c"], r["_rescued"]) for r in out.collect()]
    assert rows == [(1, "x", None, None), (None, "y", None, '{"a":"no"}'), (None, "z", None, None)]


def test_drift(spark):
    ddl = "table_name string, column_name string, data_type string"
    stored = spark.createDataFrame([("t", "a", "int"), ("t", "b", "int"), ("t", "c", "int")], ddl)
    current = spark.createDataFrame([("t", "a", "int"), ("t", "b", "string"), ("t", "d", "int")], ddl)
    out = {r["column_name"]: r["change"] for r in S.schema_drift(stored, current).collect()}
    assert out == {"b": "retyped", "c": "dropped", "d": "added"}


def test_primary_key_columns(spark):
    columns = spark.createDataFrame(
        [("dbo", "t", "id", 1), ("dbo", "t", "v", 2), ("x", "t", "id", 1)],
        "table_schema string, table_name string, column_name string, ordinal_position int",
    )
    keys = spark.createDataFrame([("dbo", "t", "id"), ("dbo", "t", "id")], "table_schema string, table_name string, column_name string")
    out = S.primary_key_columns(columns, keys)
    assert {(r["table_schema"], r["column_name"]): r["primary_key"] for r in out.collect()} == {
        ("dbo", "id"): True, ("dbo", "v"): False, ("x", "id"): False,
    }


def test_flatten_nested(spark):
    df = spark.createDataFrame(
        [(1, ("n", (2, ["x", "y"])), {"k": 1})], "id int, a struct<b:string,c:struct<d:int,e:array<string>>>, m map<string,int>"
    )
    flat = FL.flatten_underscore(df)
    assert flat.columns == ["id", "a_b", "a_c_d", "a_c_e", "m"]
    assert tuple(flat.first()) == (1, "n", 2, '["x","y"]', '{"k":1}')
    one = FL.flatten_one_level(df).first()
    assert one["a"] == '{"b":"n","c":{"d":2,"e":["x","y"]}}'


def test_field_names_with_dots(spark):
    df = spark.createDataFrame([(1, (2,))], "`a.b` int, s struct<`c.d`:int>")
    assert FL.flatten_underscore(df).columns == ["a.b", "s_c.d"]


def test_joined_lists(spark):
    df = spark.createDataFrame([([1, 2], (3,), None)], "l array<int>, s struct<x:int>, e array<string>")
    assert tuple(FL.flatten_joined(df).first()) == ("1, 2", '{"x":3}', None)


def test_normalize_and_canonicalize(spark):
    df = spark.sql(
        "SELECT timestamp'2024-01-02 03:04:05.678901Z' AS z, timestamp_ntz'2024-01-02 03:04:05.678901' AS n, "
        "date'2024-01-02' AS d, X'00FF' AS b, cast(1.25 AS decimal(5,2)) AS m, array(1) AS l"
    )
    row = FL.normalize_values(df).first().asDict()
    assert row["z"] == row["n"] == "2024-01-02T03:04:05.678901"
    assert (row["d"], row["b"], row["m"], row["l"]) == ("2024-01-02", "00ff", 1.25, "[1]")
    cut = FL.canonicalize_values(df).select(F.unix_micros("z")).first()[0]
    assert cut % 1_000_000 == 678_000


def test_union_by_name(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("s",)], "y string")
    assert S.union_by_name([a, b]).columns == ["x", "y"]


@pytest.mark.parametrize("meta", [True, False])
def test_meta_schema(meta):
    out = S.with_meta_schema(T._parse_datatype_string("a int"), ingest=meta)
    assert ("_cdc_ingest_ts" in out.names) is meta
