"""What the fitted study reads and repeats: every large table once per query, and no pass that its groups do not need."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions import quantiles
from panelspark.operators import boosting
from panelspark.sources.panels import Panels

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_staged_sources_equal_the_tables_and_leave_them_unread(spark):
    plain, staged = Panels(spark, SF), Panels(spark, SF)
    staged.stage_sources()
    for name in ("weekly_obs", "rain_daily", "climate_daily"):
        assert getattr(staged, name).columns == getattr(plain, name).columns
        assert rows(getattr(staged, name)) == rows(getattr(plain, name)), name
    large = lambda df: {t for f in df.inputFiles() for t in ("orders", "lineitem") if t in f}
    assert large(plain.feature_panel) == {"orders", "lineitem"}
    assert large(staged.feature_panel) == large(staged.origins) == set()


def test_a_query_builds_the_study_panel_once(spark):
    p = Panels(spark, SF)
    assert p.study_panel is p.study_panel


@pytest.mark.parametrize("ordered", [5, 1000])
def test_quantiles_of_small_groups_need_no_slots(spark, monkeypatch, ordered):
    df = spark.range(300).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 7 > 0, F.pow("id", F.lit(1.5))).alias("v"))
    want = {(r.k, p): r[p] for r in df.groupBy("k").agg(F.percentile("v", 0.5).alias("a"), F.percentile("v", 0.9).alias("b")).collect() for p in "ab"}
    calls, cuts = [], quantiles._cuts
    monkeypatch.setattr(quantiles, "_cuts", lambda *a: calls.append(1) or cuts(*a))
    got = {(r.k, p): r[p] for r in quantiles.exact_quantiles(df, ["k"], "v", {"a": 0.5, "b": 0.9}, ordered=ordered).collect() for p in "ab"}
    assert got == pytest.approx(want)
    assert bool(calls) == (ordered == 5)


def test_scoring_passes_all_trees_at_once_with_the_same_sums(monkeypatch):
    rng = np.random.default_rng(3)
    groups, sets, rounds, depth, width, n = 3, 2, 9, 3, 6, 500
    shape = (groups, sets, rounds, (1 << depth) - 1)
    forest = boosting.Forest(
        np.zeros(groups), [np.arange(width)] * sets, rng.integers(0, width, shape).astype(np.int32),
        rng.choice([0, 1, 2, 255], shape).astype(np.int32), rng.normal(size=(groups, sets, rounds, 1 << depth)),
    )
    group, bins = rng.integers(0, groups, n), rng.integers(0, 4, (n, width)).astype(np.uint8)
    want = np.zeros(n)
    for t in range(2, rounds):
        want += forest.value[group, 1, t, forest.node(group, bins, np.arange(n), 1, t, depth)]
    monkeypatch.setattr(boosting, "ROWS_AT_ONCE", 64)
    monkeypatch.setattr(boosting.Forest, "node", None)
    assert np.array_equal(forest.grown(group, bins, 1, 2, rounds, depth), want)
    assert not forest.grown(group, bins, 1, 4, 4, depth).any()
