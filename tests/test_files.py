import os
from datetime import datetime, timezone

import pytest

from tidewell.sources import files as FS


@pytest.fixture
def folder(tmp_path):
    return tmp_path


def put(path, text, mtime=None, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    if mtime:
        os.utime(path, (mtime, mtime))
    return str(path)


@pytest.mark.parametrize(
    "name,fmt,blob",
    [
        ("a.PARQUET", "parquet", "parquet"), ("a.pq", "parquet", "json"), ("a.avro", "avro", "avro"),
        ("a.ndjson", "ndjson", "json"), ("a.jsonl", "ndjson", "json"), ("a.JSON", "json", "json"),
        ("a.csv", "csv", "csv"), ("a.tsv", "csv", "json"), ("noext", "csv", "json"), ("a.json.gz", "csv", "json"),
    ],
)
def test_detect(spark, name, fmt, blob):
    df = spark.createDataFrame([(name,)], "path string")
    assert df.select(FS.detect_format("path"), FS.detect_format("path", blob=True)).first() == (fmt, blob)


def test_csv_header_values_are_text(spark, folder):
    put(folder / "a.csv", 'id,name\n1,"x, ""y"""\n02,"line\nbreak"\n3,\n')
    df = FS.read_files(spark, str(folder), "csv")
    assert [tuple(r) for r in df.collect()] == [("1", 'x, "y"'), ("02", "line\nbreak"), ("3", None)]
    empty = FS.read_files(spark, str(folder), "csv", FS.FileOptions(csv_empty_text=True))
    assert empty.collect()[2]["name"] == ""


def test_csv_without_header_and_delimiter(spark, folder):
    put(folder / "a.csv", "1;x\n2;y\n")
    df = FS.read_files(spark, str(folder), "csv", FS.FileOptions(csv_delimiter=";", csv_has_header=False))
    assert df.columns == ["col_0", "col_1"] and df.count() == 2


def test_csv_bom_and_bad_bytes(spark, folder):
    put(folder / "a.csv", "﻿id,v\n1,x\n")
    assert FS.read_files(spark, str(folder), "csv").columns == ["id", "v"]
    (folder / "b").mkdir()
    (folder / "b" / "b.csv").write_bytes(b"id,v\n1,\xff\n")
    assert FS.read_files(spark, str(folder / "b"), "csv").first()["v"] == "�"


def test_json_shapes(spark, folder):
    put(folder / "one" / "a.json", '{"a": 1}')
    put(folder / "array" / "a.json", '[{"a": 1}, {"a": 2}]')
    put(folder / "lines" / "a.json", '{"a": 1}\n\n{"a": 2}\n  \n{"a": 3}\n')
    put(folder / "pretty" / "a.json", '[\n {"a": 1},\n {"a": 2}\n]')
    read = lambda n, **o: FS.read_files(spark, str(folder / n), "json", FS.FileOptions(**o)).count()
    assert (read("one"), read("array")) == (1, 2)
    assert read("lines") == 3
    put(folder / "broken" / "a.json", '{"a": 1}\n{oops\n')
    with pytest.raises(Exception, match="MALFORMED"):
        FS.read_files(spark, str(folder / "broken"), "json", schema="a int").collect()
    assert read("pretty", json_document=True) == 2


def test_mixed_folder_with_key_union(spark, folder):
    put(folder / "a.csv", "id,x\n1,one\n")
    put(folder / "b.jsonl", '{"id": "2", "y": "two"}\n')
    rows, newest = FS.read_detected(spark, FS.list_files(spark, str(folder)))
    assert {r["id"]: (r["x"], r["y"]) for r in rows.collect()} == {"1": ("one", None), "2": (None, "two")}
    assert {os.path.basename(r["_source_file"]) for r in rows.collect()} == {"a.csv", "b.jsonl"}
    assert newest.tzinfo is not None


def test_listing_is_strict_sorted_then_capped(spark, folder):
    base = 1_700_000_000
    for i, name in enumerate("dcba"):
        put(folder / f"{name}.csv", "x\n1\n", base + i)
    after = datetime.fromtimestamp(base, tz=timezone.utc)
    found = FS.list_files(spark, str(folder), newer_than=after, max_files=2)
    assert [os.path.basename(r["path"]) for r in found.collect()] == ["c.csv", "b.csv"]
    bounded = FS.list_files(spark, str(folder), after, datetime.fromtimestamp(base + 2, tz=timezone.utc))
    assert bounded.count() == 2


def test_list_wins_over_pattern(spark, folder):
    for name in ("a.csv", "b.csv", "c.txt"):
        put(folder / "sub" / name, "x\n1\n")
    names = lambda **k: sorted(os.path.basename(r["path"]) for r in FS.list_files(spark, str(folder), **k).collect())
    assert names(pattern=r"^sub/.*\.csv$") == ["a.csv", "b.csv"]
    assert names(files=["sub/c.txt"], pattern=r"\.csv$") == ["c.txt"]


def test_incremental_files_reads_whole_files(spark, folder):
    old, new = 1_700_000_000, 1_700_000_100
    put(folder / "old.csv", "v\n1\n2\n", old)
    put(folder / "new.csv", "v\n3\n4\n", new)
    df = FS.incremental_files(FS.read_files(spark, str(folder), "csv"), datetime.fromtimestamp(old, tz=timezone.utc))
    assert sorted(r["v"] for r in df.collect()) == ["3", "4"]
    assert {os.path.basename(r["_source_file"]) for r in df.collect()} == {"new.csv"}


@pytest.mark.parametrize("table,expected", [("2024/", "b/2024"), ("*", "b"), ("", "b"), ("x", "b/x")])
def test_prefix(table, expected):
    assert FS.resolve_prefix("b/", table) == expected


def test_table_options_overlay_connection():
    options = FS.FileOptions.from_config(
        {"file_format": "csv", "csv_delimiter": "|", "bucket": "x"}, {"csv_delimiter": ";", "csv_has_header": "false", "max_files_per_run": "3"}
    )
    assert (options.file_format, options.csv_delimiter, options.csv_has_header, options.max_files) == ("csv", ";", False, 3)


def test_avro_needs_its_package(spark, folder):
    put(folder / "a.avro", "x")
    try:
        FS.read_files(spark, str(folder), "avro").count()
    except Exception as exc:  # noqa: BLE001
        assert "avro" in str(exc).lower()


def test_unknown_format(spark, folder):
    with pytest.raises(ValueError):
        FS.read_files(spark, str(folder), "xlsx")


def test_projection_reaches_the_scan(spark, sf, plan):
    df = FS.read_files(spark, f"{sf}/lineitem.parquet", "parquet").select("l_orderkey").filter("l_orderkey > 5")
    text = plan(df)
    assert "ReadSchema: struct<l_orderkey:bigint>" in text and "GreaterThan(l_orderkey,5)" in text




def test_csv_rows_do_not_depend_on_the_split_size(spark, folder):
    put(folder / "broken" / "a.csv", "id,v\n" + "".join(f'{i},"x\r{i}"\n' for i in range(200)) + '999,"two\nlines"\n')
    before, counts = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    try:
        for size in ("128m", "1000b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            counts.append(FS.read_files(spark, str(folder / "broken"), "csv").count())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert counts == [201, 201]


def test_cap_keeps_all_files_of_one_time(spark, folder):
    for name in "abc":
        put(folder / "in" / f"{name}.csv", "id\n1\n", 1_700_000_000)
    put(folder / "in" / "d.csv", "id\n1\n", 1_700_000_100)
    first = FS.list_files(spark, str(folder / "in"), max_files=2)
    assert first.count() == 3
    assert FS.list_files(spark, str(folder / "in"), newer_than=datetime.fromtimestamp(1_700_000_000, timezone.utc), max_files=2).count() == 1
