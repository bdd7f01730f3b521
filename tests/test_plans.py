"""Plan properties that decide how the operators scale."""

from __future__ import annotations

import pytest
from plans import findings, plan_text

from panelspark.operators import calendar, features
from panelspark.queries import QUERIES
from panelspark.sources.panels import Panels
from tests.conftest import SF


def test_cutoff_reaches_the_parquet_scan(spark):
    text = plan_text(QUERIES["scan_projected_cutoff"](spark, SF))
    assert "LessThan(o_orderdate" in text
    assert "o_totalprice" not in text


def test_only_needed_columns_are_read(spark):
    text = plan_text(Panels(spark, SF).weekly_obs)
    assert "o_orderstatus" not in text and "c_acctbal" not in text


@pytest.mark.parametrize(
    "name",
    [
        "week_spine", "exact_date_lag", "interval_overlap_join", "conflict_pairs", "latest_covering_source",
        "baseline_seasonal_mean", "group_quarantine", "text_table_extract", "zonal_rainfall", "horizon_availability",
    ],
)
def test_no_products_or_nested_loops(name, spark):
    assert not findings(plan_text(QUERIES[name](spark, SF)))


def test_spine_needs_no_shuffle(spark):
    p = Panels(spark, SF)
    text = plan_text(calendar.week_spine(p.entities, p.weekly_obs))
    outer = text.split("Subquery")[0]
    assert "Exchange" not in outer


def test_all_features_share_one_window_sort(spark):
    panel = Panels(spark, SF).obs_panel.withColumnRenamed("value", "cases")
    lags = features.lag_columns({"cases_lag": ("cases", (1, 2, 3, 4))})
    text = plan_text(panel.withColumns({**lags, **features.trend_columns("cases")}))
    windows = [line for line in text.splitlines() if "Window [" in line]
    assert len(windows) <= 2
