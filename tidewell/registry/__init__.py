"""Checked queries: each pairs a Spark plan with SQL for an independent engine."""

from tidewell.registry import analytics, feeds, jobs, loads, masks, payload_queries, recovery, scans, streams
from tidewell.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
