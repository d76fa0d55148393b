import json
import uuid

import pytest

from tidewell.plans.config import parse_config, run_configured
from tidewell.plans.state import StateStore

YAML = """
jobs:
  - id: orders_{tag}
    source_type: s3
    load_mode: incremental
    connection: {{path: {folder}, file_format: csv}}
    tables: [orders, gone]
    tables_config:
      orders: {{primary_key: [id]}}
    masking:
      fields: {{email: hash}}
    target_table: orders_{tag}
  - id: copied_{tag}
    source_type: copy_into
    source_location: {folder}/orders
    file_format: csv
    target_table: copied_{tag}
"""


def test_configured_jobs(spark, tmp_path):
    pytest.importorskip("yaml")
    tag = uuid.uuid4().hex[:8]
    (tmp_path / "orders").mkdir()
    (tmp_path / "orders" / "a.csv").write_text("id,email\n1,a@b.c\n2,d@e.f\n")
    config = parse_config(YAML.format(tag=tag, folder=tmp_path))
    state = StateStore(spark, str(tmp_path / "state"), f"s_{tag}")
    results = run_configured(spark, config, str(tmp_path / "out"), state)
    assert [(r.table, r.status) for r in results[f"orders_{tag}"]] == [("orders", "success"), ("gone", "error")]
    assert [r.rows for r in results[f"copied_{tag}"]] == [2]
    assert {len(r["email"]) for r in spark.table(f"orders_{tag}_orders").collect()} == {64}
    assert spark.table(f"copied_{tag}").count() == 2
    assert state.runs().count() == 3
    assert "email" in state.get_schema(f"orders_{tag}", "orders").names
    again = run_configured(spark, config, str(tmp_path / "out"), state)
    assert [r.rows for r in again[f"copied_{tag}"]] == [0]
    assert (again[f"orders_{tag}"][0].status, again[f"orders_{tag}"][0].rows) == ("success", 0)
    (tmp_path / "orders" / "b.csv").write_text("id,email\n2,new@e.f\n3,g@h.i\n")
    third = run_configured(spark, config, str(tmp_path / "out"), state)
    assert (third[f"orders_{tag}"][0].rows, third[f"copied_{tag}"][0].rows) == (2, 2)
    assert spark.table(f"orders_{tag}_orders").count() == 3


def test_json_config():
    assert parse_config(json.dumps({"jobs": []})) == {"jobs": []}
