"""Operators on small literal frames: values, missing data, ties, empty groups."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions.quantiles import exact_quantiles
from panelspark.functions.runs import run_lengths
from panelspark.operators import baselines as B
from panelspark.operators import calendar, cohorts, contracts, features, geo, importance, metrics
from panelspark.operators import normalize as N
from panelspark.operators import preprocess as P
from panelspark.operators import resample as R
from panelspark.operators import weather
from panelspark.sources import sinks

D = dt.date


def weeks(n, start=D(2023, 1, 7)):
    return [start + dt.timedelta(days=7 * i) for i in range(n)]


@pytest.fixture(scope="module")
def history(spark):
    rows = []
    for entity, offset in (("A", 0.0), ("B", 1000.0)):
        for i, w in enumerate(weeks(62)):
            missing = entity == "A" and w == D(2023, 2, 4)
            rows.append((entity, w, None if missing else offset + i))
    return spark.createDataFrame(rows, "entity_id string, week_start date, cases double")


@pytest.fixture(scope="module")
def validation(spark):
    rows = [("A", D(2024, 3, 9)), ("A", D(2023, 2, 11)), ("B", D(2024, 3, 9))]
    return spark.createDataFrame(rows, "entity_id string, week_start date")


def test_exact_history_baselines(history, validation):
    out = {(r.entity_id, r.week_start): r for r in B.history_baselines(validation, history).collect()}
    a, gap, b = out[("A", D(2024, 3, 9))], out[("A", D(2023, 2, 11))], out[("B", D(2024, 3, 9))]
    assert (a.naive_last_week, gap.naive_last_week, b.naive_last_week) == (61, 5, 1061)
    assert (a.naive_4w_mean, gap.naive_4w_mean, b.naive_4w_mean) == (59.5, None, 1059.5)
    assert a.naive_8w_mean == 57.5 and gap.naive_8w_mean is None
    # the seasonal value lies 51 weeks before the origin
    assert (a.seasonal_52w, gap.seasonal_52w, b.seasonal_52w) == (10, None, 1010)


def test_baseline_coverage(history, validation):
    wide = B.baseline_table(history, validation, history)
    cov = {r.baseline: r.coverage for r in B.baseline_coverage(B.long_baselines(wide, ["entity_id"])).collect()}
    assert cov["naive_last_week"] == 1.0
    assert cov["naive_4w_mean"] == pytest.approx(2 / 3)


def test_seasonal_mean_uses_training_history_up_to_the_origin(spark):
    train = spark.createDataFrame(
        [
            ("A", D(2022, 3, 5), 10.0), ("A", D(2023, 3, 4), 30.0), ("B", D(2022, 3, 5), 500.0),
            ("B", D(2023, 3, 4), 700.0), ("A", D(2025, 3, 1), 9999.0),
        ],
        "entity_id string, week_start date, cases double",
    )
    origins = spark.createDataFrame(
        [("A", D(2024, 2, 24)), ("B", D(2024, 2, 24)), ("C", D(2024, 2, 24))],
        "entity_id string, week_start date",
    )
    out = {r.entity_id: r.entity_seasonal_mean for r in B.seasonal_mean(train, origins).collect()}
    assert out == {"A": 20.0, "B": 600.0, "C": None}


def test_preprocess_state_and_transform(spark):
    rows = spark.createDataFrame(
        [("f", "X", 1.0, 1.0, None), ("f", "Y", 2.0, None, None), ("f", "X", 9.0, 1.0, None)],
        "fold_id string, entity_id string, lag double, rain double, empty double",
    )
    names = ["lag", "rain", "empty"]
    state = {r.feature: r for r in P.fit_numeric(rows, "fold_id", names).collect()}
    assert state["lag"].median == 2.0 and state["rain"].median == 1.0
    assert state["empty"].dropped and not state["lag"].dropped
    assert state["lag"].scale == pytest.approx(np.std([1, 2, 9]))
    assert state["rain"].scale == 1.0  # a constant column is divided by one
    new = spark.createDataFrame(
        [("f", "Z", None, 5.0, None)],
        "fold_id string, entity_id string, lag double, rain double, empty double",
    )
    fitted = P.fit_numeric(rows, "fold_id", names)
    out = P.transform_numeric(new, fitted, "fold_id", names, scale=False)
    row = out.withColumns(dict(P.one_hot(out, "entity_id", ["X", "Y"]))).first()
    assert (row.lag, row["lag__missing"], row.rain, row["rain__missing"]) == (2.0, 1.0, 5.0, 0.0)
    assert row.empty is None and row["entity_id__X"] == 0.0 and row["entity_id__Y"] == 0.0
    one_fold = {k: state[k].asDict() for k in ("lag", "rain")}
    same = P.transform_numeric(rows, fitted, "fold_id", ["lag", "rain"], scale=True)
    literal = P.transform_fold(rows, one_fold, scale=True)
    pick = ["lag", "lag__missing", "rain", "rain__missing"]
    for left, right in zip(same.orderBy("lag").select(*pick).collect(), literal.orderBy("lag").select(*pick).collect()):
        assert list(left) == pytest.approx(list(right))


def test_label_cutoff(spark):
    df = spark.createDataFrame([(D(2024, 1, 6),)], "week_start date")
    assert cohorts.label_available(df, horizon=1, cutoff="2024-01-13").count() == 0
    assert cohorts.label_available(df, horizon=1, cutoff="2024-01-19").count() == 1


def test_quantiles_of_a_skewed_table(spark):
    rng = np.random.default_rng(3)
    data = {"hot": np.round(rng.exponential(10, 6000), 3), "ties": np.array([5.0] * 400 + [7.0] * 3), "one": np.array([4.0])}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("hot", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(8)
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.9, "c": 0.999}).collect()}
    for k, vs in data.items():
        expect = np.quantile(vs, [0.25, 0.9, 0.999])
        assert [got[k].a, got[k].b, got[k].c] == pytest.approx(list(expect))
    whole = exact_quantiles(df, [], "v", {"m": 0.5}).first().m
    assert whole == pytest.approx(np.median(np.concatenate(list(data.values()))))
    assert exact_quantiles(df.filter("k = 'none'"), ["k"], "v", {"m": 0.5}).count() == 0


def test_quantiles_refine_slots_until_small(spark, monkeypatch):
    """A million distinct values of one key, at most 1,000 of them ordered in one task."""
    from panelspark.functions import quantiles

    slots = []
    stage = quantiles.stage_table
    monkeypatch.setattr(quantiles, "stage_table", lambda df, name: [stage(df, name), slots.append(name)][0])
    value = F.pmod(F.col("id") * 1_000_003, F.lit(15_485_863)).cast("double") / 7
    # a second key with heavy ties next to the hot one
    df = spark.range(1_000_000).select(F.lit("hot").alias("k"), (value * value).alias("v")).unionByName(
        spark.range(5000).select(F.lit("ties").alias("k"), F.pmod("id", F.lit(3)).cast("double").alias("v"))
    )
    wanted = {"low": 0.0, "q1": 0.25, "m": 0.5, "p": 0.9, "top": 0.99999, "high": 1.0}
    got = {r.k: [r[n] for n in wanted] for r in exact_quantiles(df, ["k"], "v", wanted, ordered=1000).collect()}
    exact = df.groupBy("k").agg(F.percentile("v", list(wanted.values())).alias("q")).collect()
    for row in exact:
        assert got[row.k] == pytest.approx(row.q, rel=1e-12)
    assert slots.count("slots") == 2
    assert sorted(got) == ["hot", "ties"]


def test_quantiles_end_when_a_sketch_is_too_coarse(spark):
    df = spark.range(3000).select(F.col("id").cast("double").alias("v"))
    assert exact_quantiles(df, [], "v", {"m": 0.5}, accuracy=1, ordered=1).first().m == 1499.5


def test_runs(spark):
    w = weeks(10)
    df = spark.createDataFrame([(w[i],) for i in (0, 1, 2, 5, 6, 9)], "week_start date")
    runs = run_lengths(df.withColumn("g", F.lit(1)), ["g"], "week_start").orderBy("run_start").collect()
    assert [r.run_length for r in runs] == [3, 2, 1]


def test_spine_and_rolling_need_full_support(spark):
    w = weeks(6)
    obs = spark.createDataFrame(
        [("A", w[0], 1), ("A", w[1], 2), ("A", w[3], 4), ("B", w[5], 6)],
        "entity_id string, week_start date, cases long",
    )
    entities = spark.createDataFrame([("A",), ("B",), ("C",)], "entity_id string")
    spine = calendar.week_spine(entities, obs)
    assert spine.count() == 18
    roll = features.rolling_columns([features.Rolling("r", "cases", "mean", (2,))])
    out = (
        spine.join(obs, ["entity_id", "week_start"], "left").withColumns(roll)
        .filter("entity_id = 'A'").orderBy("week_start").collect()
    )
    assert [r.r_mean_2 for r in out] == [None, 1.5, None, None, None, None]
    own = calendar.entity_spine(obs).groupBy("entity_id").count().orderBy("entity_id").collect()
    assert [(r.entity_id, r["count"]) for r in own] == [("A", 4), ("B", 1)]


def test_slope_matches_polyfit(spark):
    values = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0]
    df = spark.createDataFrame([("A", w, v) for w, v in zip(weeks(6), values)], "entity_id string, week_start date, cases double")
    out = df.select("week_start", features.slope_column().alias("s")).orderBy("week_start").collect()
    assert [r.s for r in out[:3]] == [None, None, None]
    for i in (3, 4, 5):
        assert out[i].s == pytest.approx(np.polyfit(range(4), values[i - 3 : i + 1], 1)[0])


def test_metrics_edge_cases(spark):
    df = spark.createDataFrame(
        [("a", 2.0, 1.0), ("a", 2.0, 3.0), ("b", 5.0, 5.0), ("c", 0.0, 0.0), ("c", 4.0, 2.0)],
        "g string, y double, p double",
    )
    out = {
        r.g: r
        for r in df.groupBy("g").agg(*[c.alias(n) for n, c in metrics.metric_columns("y", "p").items()]).collect()
    }
    assert out["a"].mae == 1.0 and out["a"].r2 is None and out["b"].r2 is None
    assert out["c"].poisson_deviance == pytest.approx((2 * 1e-12 + 2 * (4 * math.log(2) - 2)) / 2)
    high = metrics.high_incidence_columns("y", "p", {"top": "limit"})
    row = df.withColumn("limit", F.lit(100.0)).agg(*[c.alias(n) for n, c in high.items()]).first()
    assert row.mae_top is None and row.underprediction_rate_top is None


def test_strict_dates_and_quality_tokens(spark):
    df = spark.createDataFrame([(" 2024-01-06 ",), ("2024-01-06 00:00:00",), ("2024-13-01",), ("x",), (None,)], "t string")
    assert [r.d for r in df.select(contracts.strict_date("t").alias("d")).collect()] == [D(2024, 1, 6), None, None, None, None]
    flags = spark.createDataFrame([("OK ",), ("low_temporal_coverage; Rain_Missing",), (";",), ("odd",), (None,)], "f string")
    got = [r.q for r in flags.select(contracts.normalize_quality_tokens("f").alias("q")).collect()]
    assert got == ["OK", "LOW_TEMPORAL_COVERAGE;RAIN_MISSING", None, None, None]


def test_enforce_raises_only_on_violations(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    with pytest.raises(contracts.ContractViolation):
        contracts.enforce(contracts.duplicate_keys(df, ["k"]), "keys")
    contracts.enforce(contracts.duplicate_keys(df.distinct(), ["k"]), "keys")


def test_columns_must_match_exactly(spark):
    df = spark.createDataFrame([(1, 2)], "a int, c int")
    assert contracts.missing_or_extra_columns(df, ["a", "b"]) == (["b"], ["c"])


def test_conflicts_become_missing(spark):
    df = spark.createDataFrame(
        [(1, "b", 5, "observed"), (1, "a", 5, "observed"), (2, "a", 1, "observed"), (2, "b", 2, "observed"), (3, "a", None, "missing")],
        "k int, source string, value int, case_status string",
    )
    out = {r.k: r for r in N.resolve_conflicts(df, ["k"], value="value", status="case_status", order=["source"]).collect()}
    assert (out[1].source, out[1].value, out[1].is_conflict) == ("a", 5, False)
    assert (out[2].value, out[2].case_status, out[2].is_conflict) == (None, "missing", True)
    assert out[3].value is None and not out[3].is_conflict


@pytest.mark.parametrize("longest", [30, 40_000])
def test_overlap_join_equals_brute_force(spark, longest):
    rng = np.random.default_rng(longest)
    base = D(1900, 1, 1)

    def intervals(n):
        out = []
        for i in range(n):
            s = base + dt.timedelta(days=int(rng.integers(0, 4 * longest)))
            out.append((int(rng.integers(0, 2)), s, s + dt.timedelta(days=int(longest ** rng.random()) - 1), i))
        return [*out, (0, base, None, n), (0, None, base, n + 1), (1, base + dt.timedelta(days=9), base, n + 2), out[0]]

    a, b = intervals(60), intervals(60)
    schema = "entity_id int, start date, end date, id int"
    got = N.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).select("a_id", "b_id", "overlap_days")
    whole = lambda rows: [r for r in rows if r[1] and r[2] and r[1] <= r[2]]
    expect = sorted(
        (x[3], y[3], (min(x[2], y[2]) - max(x[1], y[1])).days + 1)
        for x in whole(a) for y in whole(b) if x[0] == y[0] and x[1] <= y[2] and x[2] >= y[1]
    )
    assert expect and sorted(tuple(r) for r in got.collect()) == expect


def test_copies_of_an_interval_are_bounded(spark):
    spans = [1, 7, 8, 56, 57, 449, 11_000, 100_000, 700_000]
    df = spark.createDataFrame([(D(1950, 1, 5) - dt.timedelta(days=min(n, 600_000)), n) for n in spans], "s date, n int")
    df = df.withColumn("e", F.expr("date_add(s, n - 1)"))
    every = F.lit(list(range(7)))
    out = N.spread_intervals(df, "s", "e", every).groupBy("n", "_class", "_level").count().collect()
    assert all(r["count"] <= 2 and N.CLASS_DAYS[r._level] >= r.n for r in out)
    assert {r.n: r._class for r in out} == {1: 0, 7: 0, 8: 1, 56: 1, 57: 2, 449: 3, 11_000: 4, 100_000: 5, 700_000: 6}


def test_weekly_weather_joint_coverage(spark):
    w = D(2024, 1, 6)
    spine = spark.createDataFrame([("A", w, w + dt.timedelta(days=6)), ("B", w, w + dt.timedelta(days=6))], "entity_id string, week_start date, week_end date")
    days = [w + dt.timedelta(days=i) for i in range(7)]
    rain = spark.createDataFrame(
        [("A", d, None if i == 0 else float(i), 95.0, 4) for i, d in enumerate(days)],
        "entity_id string, day date, rainfall_mm double, spatial_coverage_pct double, grid_cells long",
    )
    climate = spark.createDataFrame(
        [("A", d, 25.0, 20.0, 30.0, None if i == 6 else 70.0, 80.0 if i == 6 else 92.0, 9) for i, d in enumerate(days)],
        "entity_id string, day date, temp_mean_c double, temp_min_c double, temp_max_c double,"
        " humidity_mean_pct double, spatial_coverage_pct double, grid_cells long",
    )
    out = {r.entity_id: r for r in weather.weekly_weather(spine, rain, climate).collect()}
    a, b = out["A"], out["B"]
    assert a.rainfall_sum_mm == 21.0 and a.rain_days_1mm == 6 and a.weather_available_days == 5
    assert a.weather_spatial_coverage_pct == 92.0  # days without valid climate do not count
    assert a.weather_quality_flag == "low_temporal_coverage" and a.weather_grid_cells == 9
    assert b.weather_quality_flag == "low_temporal_coverage;rain_missing;climate_missing"
    assert b.rainfall_sum_mm is None and b.weather_spatial_coverage_pct is None


def test_humidity_is_held_to_100(spark):
    df = spark.createDataFrame([(20.0, 20.0), (20.0, 25.0), (30.0, 10.0)], "t double, d double")
    got = [r.h for r in df.select(weather.relative_humidity("t", "d").alias("h")).collect()]
    assert got[0] == pytest.approx(100.0) and got[1] == 100.0 and 0 < got[2] < 100


RINGS = "entity_id string, hole boolean, ring array<struct<lon:double,lat:double>>"


def clipped_area(ring, box):
    """Area of a projected ring inside a box, edge by edge of the box."""
    for axis, limit, sign in ((0, box[0], 1), (0, box[1], -1), (1, box[2], 1), (1, box[3], -1)):
        kept = []
        for p, q in zip(ring, ring[1:] + ring[:1]):
            dp, dq = sign * (p[axis] - limit), sign * (q[axis] - limit)
            if dp >= 0:
                kept.append(p)
            if dp * dq < 0:
                t = dp / (dp - dq)
                kept.append((p[0] + (q[0] - p[0]) * t, p[1] + (q[1] - p[1]) * t))
        ring = kept
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1]))) / 2


def star(rng, lon, lat, size, n):
    turn = sorted(rng.random(n) * 2 * np.pi)
    reach = size * (0.3 + 0.7 * rng.random(n))
    return [(lon + float(r * np.cos(t)), lat + float(r * np.sin(t))) for t, r in zip(turn, reach)]


def test_area_weights_of_many_rings_equal_clipping(spark):
    """A ragged area with a hole and an island, rings either way round, closed or open."""
    rng = np.random.default_rng(5)
    outer, island = star(rng, 80.0, 6.0, 2.0, 60), star(rng, 84.0, 7.0, 0.6, 9)
    hole = [(80.0 + 0.25 * (x - 80.0), 6.0 + 0.25 * (y - 6.0)) for x, y in outer]
    box = [(79.875, 6.125), (80.375, 6.125), (80.375, 6.625), (79.875, 6.625)]
    rows = [
        ("many", False, outer + outer[:1]), ("many", True, hole), ("many", None, island[::-1]),
        ("cells", False, box), ("line", False, [(80.0, 6.0), (81.0, 7.0), (80.0, 6.0)]), ("none", False, []), ("null", False, None),
    ]
    rings = spark.createDataFrame(rows, RINGS)
    got = {(r.entity_id, r.cell_id): r for r in geo.ring_area_weights(rings, 0.25).collect()}

    def planar(points):
        df = spark.createDataFrame(points, "lon double, lat double")
        return [tuple(r) for r in df.select(geo.project_x(F.col("lon")), geo.project_y(F.col("lat"))).collect()]

    parts = [(planar(outer), 1), (planar(hole), -1), (planar(island), 1)]
    every = (-1e9, 1e9, -1e9, 1e9)
    total = sum(sign * clipped_area(r, every) for r, sign in parts)
    span = [(c, r) for c in range(310, 345) for r in range(12, 36)]
    sides = planar([(c * 0.25 + d, r * 0.25 + d) for c, r in span for d in (-0.125, 0.125)])
    want = {}
    for k, (c, r) in enumerate(span):
        (w, s), (e, n) = sides[2 * k], sides[2 * k + 1]
        area = sum(sign * clipped_area(ring, (w, e, s, n)) for ring, sign in parts)
        if area > 1.0:
            want[f"{r * 0.25:.4f},{c * 0.25:.4f}"] = area
    mine = {c: r for (e, c), r in got.items() if e == "many"}
    assert mine.keys() == want.keys() and len(want) > 100
    assert all(mine[c].intersection_area_m2 == pytest.approx(a, rel=1e-6, abs=1.0) for c, a in want.items())
    assert all(r.entity_area_m2 == pytest.approx(total, rel=1e-9) for r in mine.values())
    assert sum(r.weight for r in mine.values()) == pytest.approx(1.0, abs=1e-9)
    assert sorted(c for e, c in got if e == "cells") == ["6.2500,80.0000", "6.2500,80.2500", "6.5000,80.0000", "6.5000,80.2500"]
    assert {e for e, _ in got} == {"many", "cells"}

    centre = {r.entity_id: r for r in geo.ring_area_centroid(rings).collect()}
    assert centre["many"].area_km2 == pytest.approx(total / 1e6, rel=1e-9)
    assert centre["line"].area_km2 == 0 and centre["line"].centroid_lat is None
    moment = lambda ring: sum((p[0] + q[0]) * (p[0] * q[1] - q[0] * p[1]) for p, q in zip(ring, ring[1:] + ring[:1])) / 6
    turn = lambda ring: math.copysign(1, sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1])))
    x = sum(sign * turn(r) * moment(r) for r, sign in parts) / total
    assert centre["many"].centroid_lon == pytest.approx(math.degrees(x / (geo.A * geo.K0)), abs=1e-7)


def test_triangle_weights_sum_to_one(spark):
    ring = [(80.0, 6.0), (81.0, 6.1), (80.4, 7.0), (80.0, 6.0)]
    df = spark.createDataFrame([("T", ring)], "entity_id string, ring array<struct<lon:double,lat:double>>")
    w = geo.ring_area_weights(df, 0.25)
    assert w.agg(F.sum("weight")).first()[0] == pytest.approx(1.0)
    assert "Python" not in w._jdf.queryExecution().executedPlan().toString()
    c = geo.ring_area_centroid(df).first()
    assert c.centroid_lon == pytest.approx(sum(p[0] for p in ring[:3]) / 3, abs=1e-6)
    assert c.centroid_lat == pytest.approx(sum(p[1] for p in ring[:3]) / 3, abs=1e-3)


def test_seeded_sample_is_the_smallest_digests(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("g"), "id")
    got = importance.seeded_sample(df, ["g"], ["id"], rows=30, seed=5)
    assert {r.g: r["count"] for r in got.groupBy("g").count().collect()} == {0: 30, 1: 30}
    again = importance.seeded_sample(df.repartition(7), ["g"], ["id"], rows=30, seed=5)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in again.collect())


def test_draws_cover_each_run_once_per_replicate(spark):
    w = weeks(30)
    df = spark.createDataFrame([(1, d) for i, d in enumerate(w) if i not in (10, 11)], "fold int, origin_start date")
    pos = R.week_positions(df, ["fold"])
    draws = R.draw_weights(pos, ["fold"], reps=20)
    totals = {r.rep: r.t for r in draws.groupBy("rep").agg(F.sum("times").alias("t")).collect()}
    assert totals == {rep: 28 for rep in range(20)}
    s = R.support(pos, ["fold"]).first()
    assert s.run_lengths == "10,18" and s.run_block_counts == "7,15" and s.insufficient_reason is None
    short = R.week_positions(df.filter(F.col("origin_start") < F.lit(w[3])), ["fold"])
    assert R.support(short, ["fold"]).first().insufficient_reason == R.SHORT_RUN


def test_upsert_rejects_duplicate_batches(spark):
    old = spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string")
    new = spark.createDataFrame([(2, "b"), (3, "b")], "k int, v string")
    got = sorted((r.k, r.v) for r in sinks.checked_upsert(old, new, ["k"]).collect())
    assert got == [(1, "a"), (2, "b"), (3, "b")]
    with pytest.raises(contracts.ContractViolation):
        sinks.checked_upsert(old, new.union(new), ["k"])


def test_year_chunks_keep_the_last_week_whole(spark):
    df = spark.createDataFrame([(D(2023, 6, 1), D(2026, 1, 2))], "lo date, hi date")
    rows = calendar.year_chunks(df, tail=(2025, "2026-01-02")).orderBy("year").collect()
    assert [(r.year, r.chunk_start, r.chunk_end) for r in rows] == [
        (2023, D(2023, 6, 1), D(2023, 12, 31)),
        (2024, D(2024, 1, 1), D(2024, 12, 31)),
        (2025, D(2025, 1, 1), D(2026, 1, 2)),
    ]


def test_date_shift_ignores_gaps_and_other_weekdays(spark):
    w = weeks(4)
    df = spark.createDataFrame(
        [("A", w[0], 1), ("A", w[1], 2), ("A", w[3], 4), ("A", w[3] - dt.timedelta(days=8), 9)],
        "entity_id string, week_start date, v int",
    )
    out = features.exact_date_shift(df, "v", {"back": 1, "ahead": -2}).orderBy("week_start").collect()
    got = {r.week_start: (r.back, r.ahead) for r in out}
    assert got[w[1]] == (1, 4) and got[w[3]] == (None, None) and got[w[0]] == (None, None)


def test_links_resolve_like_urls(spark):
    from urllib.parse import urljoin

    from panelspark.sources.documents import discover_links, join_url

    bases = ["https://x.org/a/b/page.html", "https://x.org", "https://x.org/a/?q=1", "http://x.org/p?u=/q/r"]
    hrefs = ["v.pdf", "../v.pdf", "../../../v.pdf", "./v.pdf?x=../y", "/v/./w/../z.pdf", "//h.org/v.pdf", "https://o.org/v", "?n=2", "#top", "c/..", ""]
    rows = [(b, h) for b in bases for h in hrefs]
    out = spark.createDataFrame(rows, "b string, h string").select("b", "h", join_url(F.col("b"), F.col("h")).alias("u")).collect()
    assert {(r.b, r.h): r.u for r in out} == {(b, h): urljoin(b, h) for b, h in rows}
    html = "<a href='n/vol_41_no_8.pdf'>Q &amp; A</a><a class=z href=../vol_42_no_9.pdf>R</a><a data-href=\"vol_43.pdf\">no</a>"
    pages = spark.createDataFrame([(1, bases[0], html)], "page_id int, url string, html string")
    found = discover_links(pages, start_year=2010, end_year=2025).collect()
    assert {(r.url, r.title, r.volume, r.issue_week) for r in found} == {
        ("https://x.org/a/b/n/vol_41_no_8.pdf", "Q & A", 41, 8), ("https://x.org/a/vol_42_no_9.pdf", "R", 42, 9),
    }


def test_contract_kinds_and_key(spark):
    from panelspark.operators.contracts import ColumnRule, TableContract, check_schema

    df = spark.createDataFrame(
        [(1, True, "a", 1), (1, None, "b", 0), (2, False, None, None), (None, None, " ", 7), (None, True, "c", 1)],
        "k int, flag boolean, name string, number int",
    )
    rules = {"flag": ColumnRule("boolean"), "name": ColumnRule("string", nullable=False), "number": ColumnRule("boolean")}
    got = {(r.column_name, r.rule): r.violations for r in check_schema(df, TableContract("t", ("k",), rules)).collect()}
    assert got == {("flag", "not_boolean"): 0, ("name", "null"): 1, ("name", "not_string"): 0, ("number", "not_boolean"): 4, ("k", "repeated_key"): 2}
    strict = {"flag": ColumnRule("boolean", nullable=False), "number": ColumnRule("string")}
    got = {(r.column_name, r.rule): r.violations for r in check_schema(df, TableContract("t", ("k", "gone"), strict)).collect()}
    assert got == {("flag", "null"): 2, ("flag", "not_boolean"): 0, ("number", "not_string"): 4, ("gone", "missing_column"): 1}
    empty = {(r.column_name, r.rule): r.violations for r in check_schema(df.limit(0), TableContract("t", ("k",), rules)).collect()}
    assert set(empty.values()) == {0} and len(empty) == 5
    assert check_schema(df, TableContract("t", (), {})).count() == 0


def test_zonal_means_keep_entities_without_cells(spark):
    from panelspark.operators.weather import weights_out_of_range, zonal_mean

    weights = spark.createDataFrame([("A", 1, 0.75), ("A", 2, 0.25), ("B", 9, 1.0)], "entity_id string, cell_id int, weight double")
    cells = spark.createDataFrame([(1, 1, 4.0), (2, 1, None), (1, 2, None), (2, 2, 8.0)], "cell_id int, day int, v double")
    every = spark.createDataFrame([("A",), ("B",), ("B",), ("C",)], "entity_id string")
    got = {(r.entity_id, r.day): (r.v, r.spatial_coverage_pct, r.grid_cells) for r in zonal_mean(weights, cells, ["v"], entities=every).collect()}
    none = (None, 0.0, 0)
    assert got == {("A", 1): (4.0, 75.0, 2), ("A", 2): (8.0, 25.0, 2), ("B", 1): none, ("B", 2): none, ("C", 1): none, ("C", 2): none}
    assert zonal_mean(weights, cells.limit(0), ["v"], entities=every).count() == 0
    assert weights_out_of_range(weights).count() == 0
    bad = spark.createDataFrame(
        [("sum", 1, 0.9), ("sum", 2, 0.8), ("low", 1, -0.5), ("null", 1, None), ("nan", 1, float("nan")), ("twice", 1, 0.5), ("twice", 1, 0.5), ("fine", 1, 1.0)],
        "entity_id string, cell_id int, weight double",
    )
    rows = {r.entity_id: (r.bad_weights, r.repeated_cells) for r in weights_out_of_range(bad).collect()}
    assert rows == {"sum": (0, 0), "low": (1, 0), "null": (1, 0), "nan": (1, 0), "twice": (0, 1)}


def test_cells_that_are_no_counts_say_so(spark):
    from panelspark.operators.normalize import cohort_status, wide_to_long

    df = spark.createDataFrame([(1, "12.5", "7*"), (2, "-5", " "), (3, "1,234", None), (4, "nil", "NA")], "k int, a string, b string")
    strict = {(r.k, r.component): (r.value, r.revised, r.problem) for r in wide_to_long(df, ["k"], ["a", "b"]).collect()}
    assert strict[1, "a"] == (None, False, "not_numeric") and strict[2, "a"] == (None, False, "not_numeric")
    assert strict[1, "b"] == (7, True, None) and strict[2, "b"][2] == strict[3, "b"][2] == "blank"
    assert strict[3, "a"] == (1234, False, None) and strict[4, "a"] == (0, False, None) and strict[4, "b"][2] == "not_numeric"
    digits = {(r.k, r.component): (r.value, r.problem) for r in wide_to_long(df, ["k"], ["a", "b"], lenient=True).collect()}
    assert digits[1, "a"] == (125, None) and digits[2, "a"] == (5, None) and digits[4, "b"] == (None, "not_numeric")
    index = spark.createDataFrame([("in", "2001-05-05", 0, 24), ("bad", "2001-05-05", 1, 25), ("old", "1990-05-05", 0, 25), ("empty", "2001-05-05", 0, None)], "d string, w string, failed int, n int")
    out = cohort_status(index.withColumn("w", F.col("w").cast("date")), date="w", failed="failed", first="2000-01-01", last="2002-01-01", rows="n")
    assert {r.d: (r.status, r.accepted_rows) for r in out.collect()} == {
        "in": ("parsed", 24), "bad": ("quarantined", 0), "old": ("excluded_outside_cohort", 0), "empty": ("parsed", 0)}


def test_strict_counts_and_printed_months(spark):
    from panelspark.functions.text import infer_period_end, number_word, printed_period, strict_count

    cells = {"12.5": None, "-5": None, "1,234*": 1234, "nil": 0, "12 ": 12, "1,23": None, "": None, "x7": None}
    df = spark.createDataFrame([(c,) for c in [*cells, None]], "c string")
    assert {r.c: r.n for r in df.select("c", strict_count("c").alias("n")).collect()} == {**cells, None: None}
    texts = ["30th Sept - 6th Oct 2023 (40th week)", "30th Foo - 6th Oct 2023 (40th week)", "30th - 6th Oct 2023 (40th week)"]
    parts = spark.createDataFrame([(t,) for t in texts], "t string").withColumns(printed_period("t")).withColumn("issue", F.lit(None).cast("int"))
    end = infer_period_end(start_day="start_day", start_month="start_month", end_day="end_day", end_month="end_month", printed_year="source_year", issue_year="issue")
    assert [(r.start_month, r.e) for r in parts.select("t", "start_month", end.alias("e")).collect()] == [(9, D(2023, 10, 6)), (0, None), (None, D(2023, 10, 6))]
    assert (number_word(4), number_word(12)) == ("four", "12")


def test_set_digest_tells_cohorts_apart(spark):
    from panelspark.functions.columns import set_digest

    one = lambda n: spark.range(n).repartition(3).agg(set_digest("id").alias("d")).first().d
    assert one(50) == one(50) != one(51)
    assert all(part.isdigit() for part in one(50).split(":"))
