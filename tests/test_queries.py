"""Registered queries against their SQL checks.

A spread of quick queries runs by default; PANELSPARK_ALL=1 runs every one.
"""

from __future__ import annotations

import os

import pytest

from tests.conftest import SF

QUICK = (
    "week_spine", "exact_date_lag", "rolling_slope", "trend_features", "continuity",
    "per_entity_gapfill", "entity_persistence_metrics", "schema_contract", "strict_date",
    "baseline_guard", "hourly_completeness", "provenance_crosscheck", "component_rollup",
    "conflict_resolve", "conflict_pairs", "group_quarantine", "interval_overlap_join", "period_infer",
    "area_weights", "ring_area_weights", "hourly_to_daily", "daily_keep_last", "readiness_summary",
    "coverage_summary", "baseline_seasonal_mean", "scan_projected_cutoff", "html_link_discovery",
    "text_table_extract", "manifest_verify", "missing_weeks", "series_gap_breaks",
)


def _names():
    from panelspark.queries import ORACLES

    return list(ORACLES) if os.environ.get("PANELSPARK_ALL") else list(QUICK)


@pytest.mark.parametrize("name", _names())
def test_matches_sql(name, spark, duck):
    from check import compare

    from panelspark.queries import ORACLES, QUERIES

    ok, note = compare(QUERIES[name](spark, SF), duck, ORACLES[name])
    assert ok, note


def test_every_query_is_callable_and_checks_are_known():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 190


def test_entry_has_rows_and_a_stable_schema(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["entity_id", "n", "mae", "rmse", "r2", "poisson_deviance", "bias"]
    assert df.count() > 0
