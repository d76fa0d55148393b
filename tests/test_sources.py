import json
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from tidewell.model import canonical_type
from tidewell.operators.schema import lookup_type
from tidewell.sources import dialects as D
from tidewell.sources import jdbc as J
from tidewell.sources import table_formats as TF
from tidewell.sources.readers import ConfiguredSource

REGISTERED = (
    "s3 minio s3_compat azure_blob adls gcs postgres mysql mariadb mongodb sqlserver snowflake databricks oracle "
    "salesforce delta delta_lake hudi cosmosdb cosmos dynamodb pinot splunk spanner hubspot zendesk google_ads "
    "linkedin_ads cassandra clickhouse"
).split()


def test_all_source_types_are_known():
    assert len(REGISTERED) == 30 and set(REGISTERED) <= set(D.SOURCE_TYPES)


@pytest.mark.parametrize(
    "table,native,expected",
    [
        (D.POSTGRES_OIDS, "1184", "timestamp"), (D.POSTGRES_OIDS, "3802", "jsonb"), (D.POSTGRES_OIDS, "21", "smallint"),
        (D.MYSQL_TYPES, "mediumint", "integer"), (D.MYSQL_TYPES, "set", "varchar"), (D.MYSQL_TYPES, "blob", "bytea"),
        (D.SQLSERVER_TYPES, "real", "float"), (D.SQLSERVER_TYPES, "float", "double"), (D.SQLSERVER_TYPES, "bit", "boolean"),
        (D.SQLSERVER_TYPES, "uniqueidentifier", "varchar"), (D.BSON_TYPES, "objectId", "varchar"),
        (D.CLICKHOUSE_TYPES, "UInt32", "bigint"), (D.CLICKHOUSE_TYPES, "Int32", "integer"), (D.SPANNER_TYPES, "INT64", "bigint"),
        (D.PINOT_TYPES, "LONG", "bigint"), (D.CQL_TYPES, "time", "bigint"), (D.ORACLE_TYPES, "binary_double", "double"),
        (D.SNOWFLAKE_TYPES, "timestamp_ltz", "timestamp"), (D.DATABRICKS_TYPES, "struct", "json"),
    ],
)
def test_type_tables(spark, table, native, expected):
    assert table[native] == expected
    df = spark.createDataFrame([(native,), ("no such type",)], "n string")
    assert [r[0] for r in df.select(lookup_type(table, F.col("n"))).collect()] == [expected, "varchar"]
    assert canonical_type(expected)


def test_bare_types(spark):
    want = {
        "list<text>": "list", "frozen<map<a,b>>": "frozen", "INT": "INT", "Nullable(Int32)": "Int32",
        "LowCardinality(Nullable(String))": "String", "Nullable(Decimal(9, 2))": "Decimal", "DateTime64(3)": "DateTime64",
        "TIMESTAMP(6) WITH TIME ZONE": "TIMESTAMP", "LONG RAW": "LONG RAW", " STRING(MAX) ": "STRING", "": "",
    }
    rows = spark.createDataFrame([(x,) for x in [*want, None]], "n string")
    assert {r[0]: r[1] for r in rows.select("n", D.bare_type(F.col("n"))).collect()} == {**want, None: None}


CONNECTION = {"host": "db", "database": "shop", "user": "u", "password": "p"}


@pytest.mark.parametrize(
    "source,table,url,dbtable",
    [
        ("postgres", "orders", "jdbc:postgresql://db:5432/shop", '"public"."orders"'),
        ("postgres", "s.orders", "jdbc:postgresql://db:5432/shop", '"s"."orders"'),
        ("mysql", "orders", "jdbc:mysql://db:3306/shop", "`orders`"),
        ("sqlserver", "orders", "jdbc:sqlserver://db:1433;databaseName=shop", "[dbo].[orders]"),
        ("oracle", "HR.T", "jdbc:oracle:thin:@//db:1521/shop", '"HR"."T"'),
        ("clickhouse", "orders", "jdbc:clickhouse://db:8123/shop", "`default`.`orders`"),
        ("pinot", "views", "jdbc:pinot://db:9000", '"views"'),
    ],
)
def test_jdbc_options(source, table, url, dbtable):
    options = J.reader_options(source, CONNECTION, table)
    assert (options["url"], options["dbtable"]) == (url, dbtable)
    assert options["user"] == "u" and options["driver"] and options["fetchsize"] == "10000"


def test_other_jdbc_urls():
    cloud = J.reader_options("spanner", {"project": "p", "instance": "i", "database": "d"}, "T")
    assert cloud["url"] == "jdbc:cloudspanner:/projects/p/instances/i/databases/d"
    snow = J.reader_options("snowflake", {"account": "a", "warehouse": "w", "database": "d"}, "T")
    assert snow["url"] == "jdbc:snowflake://a.snowflakecomputing.com/?db=d&schema=PUBLIC&warehouse=w"
    assert snow["dbtable"] == '"PUBLIC"."T"'
    bricks = J.reader_options("databricks", {"server_hostname": "h", "http_path": "/x"}, "s.t")
    assert bricks["url"] == "jdbc:databricks://h:443;httpPath=/x"


def test_query_settings_and_partitions():
    options = J.reader_options("clickhouse", CONNECTION, "t", {"query": "SELECT 1", "settings": {"max_threads": 2}})
    assert options["query"] == "SELECT 1" and "dbtable" not in options
    assert options["sessionInitStatement"] == "SET max_threads = 2"
    cut = {"column": "id", "lower": 1, "upper": 100, "num": 8}
    options = J.reader_options("postgres", CONNECTION, "t", partition=cut)
    assert (options["partitionColumn"], options["numPartitions"], options["upperBound"]) == ('"id"', "8", "100")
    both = J.reader_options("postgres", CONNECTION, "t", {"query": "SELECT 1 id"}, cut)
    assert both["dbtable"] == "(SELECT 1 id) q" and "query" not in both


@pytest.mark.parametrize(
    "source,connection,table,expected",
    [
        ("cassandra", {"keyspace": "k"}, "t", {"keyspace": "k", "table": "t"}),
        ("cassandra", {"keyspace": "k"}, "j.t", {"keyspace": "j", "table": "t"}),
        ("mongodb", {"uri": "m", "database": "d"}, "t", {"connection.uri": "m", "database": "d", "collection": "t"}),
        ("dynamodb", {"region_name": "r"}, "t", {"tableName": "t", "region": "r"}),
        (
            "cosmosdb", {"endpoint": "e", "key": "k", "database": "d"}, "t",
            {"spark.cosmos.accountEndpoint": "e", "spark.cosmos.accountKey": "k", "spark.cosmos.database": "d", "spark.cosmos.container": "t"},
        ),
    ],
)
def test_connector_options(source, connection, table, expected):
    assert J.reader_options(source, connection, table) == expected


def test_bound_query_and_quoting():
    assert J.cursor_bound_query("mysql", "t", "a`b") == "SELECT MAX(`a``b`) AS `bound` FROM `t`"
    assert J.cursor_bound_query("postgres", "t", "c", "MIN") == 'SELECT MIN("c") AS "bound" FROM "public"."t"'


def test_files_source_and_custom_format(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.jsonl").write_text('{"id": 1}\n{"id": 2}\n')
    source = ConfiguredSource(spark, {"source_type": "s3", "connection": {"path": str(tmp_path)}})
    rows = source.read("t")
    assert rows.count() == 2 and "last_modified" in rows.columns
    assert source.high_watermark("t", "last_modified", rows) is not None
    custom = ConfiguredSource(
        spark, {"source_type": "format", "connection": {"format": "json"}, "tables_config": {"t": {"path": str(tmp_path / "t")}}}
    )
    assert custom.read("t").count() == 2


def test_landed_payload_source(spark, tmp_path):
    (tmp_path / "campaigns").mkdir()
    (tmp_path / "campaigns" / "p.json").write_text(json.dumps({"campaign": {"id": "5", "name": "n"}}))
    source = ConfiguredSource(spark, {"source_type": "google_ads", "connection": {"landing": str(tmp_path)}})
    assert source.read("campaigns").first()["campaign_id"] == 5


def test_table_export(spark, tmp_path):
    (tmp_path / "t").mkdir()
    lines = [
        {"Item": {"id": {"S": "a"}, "n": {"N": "1.5"}, "ok": {"BOOL": True}, "tags": {"SS": ["x", "y"]}, "mix": {"S": "s"}}},
        {"Item": {"id": {"S": "b"}, "n": {"NULL": True}, "mix": {"N": "7"}}},
    ]
    (tmp_path / "t" / "a.json").write_text("\n".join(json.dumps(x) for x in lines))
    source = ConfiguredSource(spark, {"source_type": "dynamodb", "connection": {"export": str(tmp_path)}})
    rows = {r["id"]: (r["n"], r["ok"], r["tags"], r["mix"]) for r in source.read("t").collect()}
    assert rows == {"a": (1.5, True, '["x","y"]', "s"), "b": (None, None, None, "7")}


def test_catalog(spark, monkeypatch):
    columns = spark.createDataFrame(
        [("public", "t", "id", 1, "20"), ("public", "t", "at", 2, "1184"), ("public", "t", "x", 3, "99999")],
        "table_schema string, table_name string, column_name string, ordinal_position int, data_type string",
    )
    keys = spark.createDataFrame([("public", "t", "id")], "table_schema string, table_name string, column_name string")
    monkeypatch.setattr(J, "read_database", lambda s, src, c, table, **k: columns if table == "columns" else keys)
    out = {r["column_name"]: (r["data_type"], r["primary_key"]) for r in J.read_catalog(spark, "postgres", {}).collect()}
    assert out == {"id": ("bigint", True), "at": ("timestamp", False), "x": ("varchar", False)}


@pytest.mark.parametrize(
    "source,types,expected,keyed",
    [
        ("oracle", ("NUMBER", "TIMESTAMP(6)", "SDO_GEOMETRY"), ("numeric", "timestamp", "varchar"), True),
        ("snowflake", ("NUMBER", "TIMESTAMP_NTZ", "GEOGRAPHY"), ("numeric", "timestamp", "varchar"), False),
        ("databricks", ("decimal(10,2)", "array<int>", "void"), ("numeric", "json", "varchar"), True),
        ("clickhouse", ("Nullable(Int32)", "DateTime64(3)", "Ring"), ("integer", "timestamp", "varchar"), False),
    ],
)
def test_catalogs_of_dialects(spark, monkeypatch, source, types, expected, keyed):
    rows = [("S", "T", name, i, kind) for i, (name, kind) in enumerate(zip(("ID", "AT", "X"), types))]
    columns = spark.createDataFrame(rows, "table_schema string, table_name string, column_name string, ordinal_position int, data_type string")
    keys = spark.createDataFrame([("S", "T", "ID")], "table_schema string, table_name string, column_name string")
    asked = {}
    monkeypatch.setattr(J, "read_database", lambda s, src, c, table, config: asked.update({table: config["query"]}) or (columns if table == "columns" else keys))
    out = {r["column_name"]: (r["data_type"], r["primary_key"]) for r in J.read_catalog(spark, source, {}).collect()}
    assert out == {"ID": (expected[0], keyed), "AT": (expected[1], False), "X": (expected[2], False)}
    assert ("keys" in asked) == keyed and ("all_tab_columns" in asked["columns"]) == (source == "oracle")


def test_keys_and_names_of_dialects(spark, monkeypatch):
    assert J.table_reference(D.DIALECTS["oracle"], "hr.t") == '"HR"."T"'
    oracle = J.reader_options("oracle", {"host": "h", "service_name": "x"}, "t")
    assert oracle["url"] == "jdbc:oracle:thin:@//h:1521/x" and oracle["dbtable"] == '"T"'
    bricks = J.reader_options("databricks", {"host": "h", "http_path": "/x", "token": "k", "catalog": "c", "schema": "s"}, "t")
    assert bricks["url"] == "jdbc:databricks://h:443;httpPath=/x;AuthMech=3;ConnCatalog=c;ConnSchema=s"
    assert (bricks["user"], bricks["password"], bricks["dbtable"]) == ("token", "k", "`s`.`t`")
    snow = J.reader_options("snowflake", {"account": "a", "warehouse": "w", "database": "d", "role": "r"}, "T")
    assert snow["url"].endswith("&warehouse=w&role=r")
    keys = spark.createDataFrame([("HR", "T", "ID"), ("default", "t", "k")], "table_schema string, table_name string, column_name string")
    monkeypatch.setattr(J, "read_database", lambda *a, **k: keys)
    assert J.primary_key_of(spark, "oracle", {"user": "hr"}, "t") == ("ID",) == J.primary_key_of(spark, "oracle", {}, "hr.t")
    assert J.primary_key_of(spark, "databricks", {}, "t") == ("k",)
    assert ConfiguredSource(spark, {"source_type": "oracle", "connection": {"user": "hr"}}).keys("t") == ("ID",)
    assert ConfiguredSource(spark, {"source_type": "snowflake", "connection": {}}).keys("t") == ()


def test_given_schema_spares_inference(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.jsonl").write_text('{"id": 1, "other": 2}\n')
    config = {"source_type": "gcs", "connection": {"path": str(tmp_path)}, "tables_config": {"t": {"schema": "id string"}}}
    assert ConfiguredSource(spark, config).read("t").drop("_source_file", "last_modified").columns == ["id"]


def test_unknown_source_type(spark):
    with pytest.raises(ValueError, match="unknown source type"):
        ConfiguredSource(spark, {"source_type": "ftp"}).read("t")


# --- table formats


def test_change_feed(spark):
    feed = spark.createDataFrame(
        [(1, "a", "insert", 1), (1, "a", "update_preimage", 2), (1, "b", "update_postimage", 2), (2, "c", "delete", 3)],
        "id int, v string, _change_type string, _commit_version bigint",
    ).withColumn("_commit_timestamp", F.current_timestamp())
    out = TF.cdf_to_events(feed)
    assert not [c for c in out.columns if c.startswith(("_change_", "_commit_"))]
    assert sorted((r["v"], r["_cdc_op"]) for r in out.collect()) == [("a", "insert"), ("b", "update"), ("c", "delete")]


def test_same_delta_version_reads_nothing(spark):
    assert TF.delta_changes(spark, "/nowhere", 5, 5) is None


def test_a_job_reads_the_table_by_the_reader_of_the_format(spark, tmp_path):
    class Rows(DataSource):
        @classmethod
        def name(cls):
            return "hudi"

        def schema(self):
            return "path string, v int, _hoodie_is_deleted boolean"

        def reader(self, schema):
            where = self.options["path"]

            class Reader(DataSourceReader):
                def read(self, partition):
                    yield from [(where, 1, None), (where, 2, True), (where, 3, False)]

            return Reader()

    spark.dataSource.register(Rows)
    source = ConfiguredSource(spark, {"source_type": "hudi", "connection": {"path": str(tmp_path)}})
    got = source.read("rides").collect()
    assert sorted(r.v for r in got) == [1, 3] and all(r.path.endswith("/rides") for r in got)
