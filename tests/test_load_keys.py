"""Where the key of a load comes from, and tables that are read whole each time."""

import json
import uuid

import pytest

from tidewell.model import primary_keys
from tidewell.plans.config import run_configured
from tidewell.plans.state import StateStore
from tidewell.sources import jdbc as J
from tidewell.sources import payloads as P
from tidewell.sources.dialects import refetched
from tidewell.sources.readers import LANDED, ConfiguredSource

CATALOG = "table_schema string, table_name string, column_name string"


def land(tmp_path, name, *rows):
    (tmp_path / "campaigns").mkdir(exist_ok=True)
    (tmp_path / "campaigns" / name).write_text("\n".join(map(json.dumps, rows)))


def ads(tmp_path, tag, source, mode):
    connection = {"landing": str(tmp_path), "account_id": "7"}
    job = {"id": tag, "source_type": source, "load_mode": mode, "connection": connection}
    return {"jobs": [{**job, "tables": ["campaigns"], "target_table": f"campaigns_{tag}"}]}


@pytest.mark.parametrize("mode", ["incremental", "full"])
@pytest.mark.parametrize("source", ["google_ads", "linkedin_ads"])
def test_entities_are_read_whole_and_merged(spark, tmp_path, source, mode):
    tag = uuid.uuid4().hex[:8]
    config = ads(tmp_path, tag, source, mode)
    state = StateStore(spark, str(tmp_path / "state"), f"k_{tag}")
    key = "campaign_id" if source == "google_ads" else "id"
    name = "campaign_name" if source == "google_ads" else "name"

    def load():
        (result,) = run_configured(spark, config, str(tmp_path / "out"), state)[tag]
        assert result.status == "success", result.error
        return sorted(tuple(r) for r in spark.table(f"campaigns_{tag}").select(key, name).collect())

    land(tmp_path, "a.json", {"id": 11, "name": "old"}, {"id": 12, "name": "same"})
    assert load() == [(11, "old"), (12, "same")]
    assert LANDED not in spark.table(f"campaigns_{tag}").columns
    assert load() == [(11, "old"), (12, "same")]
    # A changed campaign below the watermark; both pages lie in the folder now.
    (tmp_path / "campaigns" / "b.json").write_text(json.dumps({"id": 11, "name": "new"}))
    assert load() == [(11, "new"), (12, "same")]


def test_which_tables_are_read_whole():
    assert refetched("google_ads", "ads") and refetched("linkedin_ads", "creatives")
    assert not refetched("google_ads", "search_terms") and not refetched("linkedin_ads", "ad_analytics")
    assert not refetched("postgres", "campaigns")


def test_mapped_rows_carry_their_keys(spark):
    raw = spark.createDataFrame([], P.raw_schema(P.GOOGLE_ADS["campaign_performance"]))
    assert primary_keys(P.map_payload(raw, P.GOOGLE_ADS["campaign_performance"]).schema) == ["campaign_id", "date"]


def test_key_of_a_database_table(spark, monkeypatch):
    rows = [("public", "t", "id"), ("public", "t", "at"), ("other", "t", "x"), ("shop", "u", "n")]
    catalog = spark.createDataFrame(rows, CATALOG)
    monkeypatch.setattr(J, "read_database", lambda *a, **k: catalog)
    assert J.primary_key_of(spark, "postgres", {}, "t") == ("at", "id")
    assert J.primary_key_of(spark, "postgres", {}, "other.t") == ("x",)
    assert J.primary_key_of(spark, "mysql", {"database": "shop"}, "u") == ("n",)
    assert J.primary_key_of(spark, "postgres", {}, "gone") == ()
    source = ConfiguredSource(spark, {"source_type": "postgres", "tables_config": {"q": {"query": "SELECT 1"}}})
    assert source.keys("t") == ("at", "id") and source.keys("q") == ()
    assert ConfiguredSource(spark, {"source_type": "s3"}).keys("t") == ()
