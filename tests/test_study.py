"""Fits of many groups and feature sets at once, and the schedule that runs them."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import boosting, study
from panelspark.operators.importance import numbered
from panelspark.plans import forecasts
from panelspark.session import stage_table
from panelspark.sources.panels import Panels
from tests.conftest import SF


@pytest.fixture(scope="module")
def panel():
    """Two folds and one horizon of counts with a missing feature, a category and an unseen level."""
    rng = np.random.default_rng(3)
    rows = []
    for fold, n in ((2000, 300), (2001, 500)):
        for i in range(n):
            a, b, e = rng.normal(), rng.normal(), int(rng.integers(0, 4))
            train = i < n - 60
            y = int(rng.poisson(np.exp(0.8 + 0.5 * a - 0.3 * (b > 0) + 0.1 * e)))
            rows.append((fold, 1, 9 if not train and i % 20 == 0 else e, i, a, None if i % 7 == 0 else float(b), None, y, train))
    return rows


@pytest.fixture(scope="module")
def data(spark, panel):
    kinds = "fold long, horizon int, entity_id int, i int, a double, b double, never double, target long, train boolean"
    df = spark.createDataFrame(panel, kinds).withColumns(
        {"week_start": F.date_add(F.lit("2000-01-01").cast("date"), F.col("i") * 7), "cases": F.col("target")}
    ).withColumn("week_end", F.date_add("week_start", 6))
    df = stage_table(df, "panel")
    sets = {"small": ["entity_id", "a"], "all": ["entity_id", "a", "b", "never"]}
    return study.prepare(df.filter("train").drop("train"), df.filter("NOT train").drop("train"), sets)


def matrix(panel, fold, names, train=True):
    """The plain design of one fold: standardised imputed values, indicators, category columns."""
    own = [r for r in panel if r[0] == fold and r[8]]
    rows = own if train else [r for r in panel if r[0] == fold and not r[8]]
    parts, marks = [], []
    for c in names:
        k = {"a": 4, "b": 5}[c]
        median = float(np.median([r[k] for r in own if r[k] is not None]))
        fill = lambda rs: np.array([median if r[k] is None else r[k] for r in rs])  # noqa: B023, E731
        parts.append((fill(rows) - fill(own).mean()) / fill(own).std())
        marks.append(np.array([float(r[k] is None) for r in rows]))
    hot = [np.array([float(r[2] == e) for r in rows]) for e in range(4)]
    return np.stack(parts + marks + hot, axis=1), np.array([float(r[7]) for r in rows])


@pytest.mark.parametrize(("s", "names"), [("small", ["a"]), ("all", ["a", "b"])])
def test_ridge_of_all_groups_equals_the_closed_form(spark, panel, data, s, names):
    fitted = study.fit_family(data, "ridge", {"alpha": 2.0})
    assert data.groups == [(2000, 1), (2001, 1)] and fitted.coefficients.slope.max() < 1e-9
    out = study.predictions(fitted, data, "ridge").filter(F.col("feature_set") == s)
    for g, fold in enumerate((2000, 2001)):
        x, y = matrix(panel, fold, names)
        xc, yc = x - x.mean(0), y - y.mean()
        beta = np.linalg.solve(xc.T @ xc + 2.0 * np.eye(x.shape[1]), xc.T @ yc)
        weights = {r["feature_set"]: r["weights"] for r in study.fit_rows(fitted, data, "ridge") if r["fold"] == fold}[s]
        want = dict(zip([*names, *[f"{c}__missing" for c in names], *[f"entity_id__{e}" for e in range(4)]], beta))
        assert {k: weights[k] for k in want} == pytest.approx(want, abs=1e-8)
        assert abs(weights.get("never", 0.0)) < 1e-12
        new, truth = matrix(panel, fold, names, train=False)
        expected = np.maximum(new @ beta + y.mean() - x.mean(0) @ beta, 0.0)
        got = sorted((r.origin_start, r.observed_target, r.prediction_model) for r in out.filter(F.col("fold") == fold).collect())
        assert [r[2] for r in got] == pytest.approx(expected.tolist(), abs=1e-8) and [r[1] for r in got] == truth.tolist()


def test_poisson_solves_its_score_equations(panel, data):
    fitted = study.fit_family(data, "poisson", {"alpha": 0.1})
    for g, fold in enumerate((2000, 2001)):
        x, y = matrix(panel, fold, ["a", "b"])
        names = data.names
        beta = fitted.coefficients.beta[g, 1]
        at = [names.index(c) for c in ("a", "b", "a__missing", "b__missing", *[f"entity_id__{e}" for e in range(4)])]
        b = beta[1:][at]
        mean = np.exp(beta[0] + x @ b)
        assert np.mean(y - mean) == pytest.approx(0.0, abs=1e-8)
        assert x.T @ (y - mean) / len(y) - 0.1 * b == pytest.approx(np.zeros(len(b)), abs=1e-8)


def plain_tree(bins, g, h, sizes, depth, min_child):
    """Greedy tree by trying every split of every node; the leaf of each row."""
    node = np.zeros(len(g), int)
    for _ in range(depth):
        after = 2 * node
        for k in np.unique(node):
            mine, best = node == k, (0.0, None)
            for f, size in enumerate(sizes):
                for c in range(size - 1):
                    left = mine & (bins[:, f] <= c)
                    right = mine & ~left
                    if h[left].sum() < min_child or h[right].sum() < min_child:
                        continue
                    gain = sum(g[m].sum() ** 2 / h[m].sum() for m in (left, right)) - g[mine].sum() ** 2 / h[mine].sum()
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, c))
            if best[1]:
                after[mine & (bins[:, best[1][0]] > best[1][1])] += 1
        node = after
    return node


@pytest.mark.parametrize(("loss", "rate"), [("squared", 0.3), ("poisson", 1.0)])
def test_boosting_of_many_fits_equals_single_greedy_trees(spark, monkeypatch, loss, rate):
    monkeypatch.setattr(boosting, "STAGE", 2)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(8)
    sizes = [6, 2, 5, 2]
    rows = []
    for g in range(2):
        for i in range(350):
            bins = [int(rng.integers(0, s)) for s in sizes]
            y = float(rng.poisson(0.5 + bins[0] + 2 * bins[1] * (bins[2] > 2)))
            rows.append((g, i < 300, y, bytearray(bins), i))
    df = spark.createDataFrame(rows, "g int, train boolean, y double, bins binary, i int")
    sets = [[0, 1], [0, 1, 2, 3]]
    p = boosting.Boosting(loss, rounds=5, depth=2, rate=rate, min_child=5.0)
    forest, scored = boosting.fit_many(df, 2, sets, sizes, p)
    got = {(r.g, r.i): r.margin for r in scored.collect()}
    for g in range(2):
        mine = [r for r in rows if r[0] == g and r[1]]
        bins, y = np.array([list(r[3]) for r in mine]), np.array([r[2] for r in mine])
        for s, used in enumerate(sets):
            margin = np.full(len(y), y.mean() if loss == "squared" else np.log(y.mean()))
            for t in range(p.rounds):
                gr, h, cost = boosting.residuals(loss, y, margin)
                assert forest.losses[t][g, s] == pytest.approx(cost.sum())
                leaf = plain_tree(bins[:, used], gr, h, [sizes[f] for f in used], p.depth, p.min_child)
                for k in np.unique(leaf):
                    margin[leaf == k] += boosting.leaf_value(gr[leaf == k].sum(), h[leaf == k].sum(), p)
                if loss == "poisson":
                    # At rate 1 the leaves estimated anew predict as many counts as they saw.
                    assert [np.exp(margin)[leaf == k].sum() for k in np.unique(leaf)] == pytest.approx([y[leaf == k].sum() for k in np.unique(leaf)], abs=1e-4)
            assert [got[(g, r[4])][s] for r in mine] == pytest.approx(margin.tolist(), abs=1e-9)
            losses = [x[g, s] for x in forest.losses]
            assert all(b <= a + 1e-9 for a, b in zip(losses, losses[1:]))
    shares = boosting.importance(forest, ["f0", "f1", "f2", "f3"])
    assert {(g, s) for g, s, _, _ in shares} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert all(sum(x for a, b, _, x in shares if (a, b) == k) == pytest.approx(1.0) for k in {(g, s) for g, s, _, _ in shares})


def test_leaf_without_counts_and_constant_targets_stay_finite(spark):
    df = spark.createDataFrame([(0, True, 0.0, bytearray([i % 3]), i) for i in range(60)], "g int, train boolean, y double, bins binary, i int")
    for loss in ("squared", "poisson"):
        _, scored = boosting.fit_many(df, 1, [[0]], [3], boosting.Boosting(loss, rounds=2, depth=2, rate=1.0, min_child=1.0))
        assert scored.agg(F.max(F.abs(F.get("margin", F.lit(0))))).first()[0] < 100


def test_boosted_study_scores_unseen_rows(data):
    fitted = study.fit_family(data, "boosted_poisson", {"rounds": 15, "depth": 2, "rate": 0.2})
    out = study.predictions(fitted, data, "boosted_poisson")
    assert out.count() == 2 * 60 * 2 and out.filter("prediction_model IS NULL OR prediction_model < 0").count() == 0
    err = out.agg(F.avg(F.abs(F.col("prediction_model") - F.col("observed_target"))).alias("m"), F.avg(F.abs(F.col("observed_target") - 3)).alias("z")).first()
    assert err.m < 1.6
    rows = study.fit_rows(fitted, data, "boosted_poisson")
    assert {r["n_train"] for r in rows} == {240, 440} and all(r["losses"][-1] < r["losses"][0] for r in rows)


@pytest.mark.parametrize(("family", "params"), [("ridge", {}), ("poisson", {"alpha": 0.1}), ("boosted", {"rounds": 12, "depth": 2, "rate": 0.3})])
def test_permutation_equals_scoring_swapped_rows(spark, data, family, params):
    """Against scores of rows swapped here, in the order of the digests."""
    fitted = study.fit_family(data, family, params)
    got = {(r.fold, r.feature_set, r.feature, r.repeat): r for r in study.permutation(fitted, data, family, rows=25, repeats=2, seed=3).collect()}
    features = {"small": ["a", "entity_id"], "all": ["a", "b", "never", "entity_id"]}
    assert set(got) == {(f, s, c, k) for f in (2000, 2001) for s, names in features.items() for c in names for k in (0, 1)}
    rows = {r["g"]: [] for r in data.rows.select("g").distinct().collect()}
    mark = lambda *parts: int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)
    for r in data.rows.filter("NOT train").collect():
        rows[r.g].append(r)
    sums = lambda margin: np.exp(margin) if family == "poisson" else np.maximum(margin, 0.0)
    wide = len(data.numeric)

    def errors(g, some):
        df = spark.createDataFrame([(i, g, x, level, float(y)) for i, (x, level, y) in enumerate(some)], "i int, g int, x array<double>, level int, y double")
        out = study.rescored(fitted, data, family, df, ["i"]).orderBy("i").collect()
        return np.abs(sums(np.array([r.margin for r in out])) - np.array([y for _, _, y in some])[:, None]).mean(axis=0)

    for g, mine in rows.items():
        mine = sorted(sorted(mine, key=lambda r: (mark(3, r.entity_id, r.week_start), r.entity_id, r.week_start))[:25], key=lambda r: (r.entity_id, r.week_start))
        base = errors(g, [(r.x, r.level, r.y) for r in mine])
        for j, c in enumerate([*data.numeric, "entity_id"]):
            order = sorted(mine, key=lambda r: (mark(3, c, 1, r.entity_id, r.week_start), r.entity_id, r.week_start))
            swapped = []
            for r, d in zip(mine, order):
                x = list(r.x)
                if j < wide:
                    x[j], x[wide + j] = d.x[j], d.x[wide + j]
                swapped.append((x, d.level if j == wide else r.level, r.y))
            for s, (name, e) in enumerate(zip(features, errors(g, swapped))):
                if c in features[name]:
                    r = got[data.groups[g][0], name, c, 1]
                    assert (r.baseline_mae, r.permuted_mae) == pytest.approx((base[s], e), abs=1e-9) and r.n_rows == 25


@pytest.mark.parametrize(("family", "ordered"), [("ridge", 60), ("boosted", 60), ("ridge", 1000)])
def test_permutation_takes_every_evaluation_row(spark, monkeypatch, family, ordered):
    """More rows than a sample would hold, put in order whole or in parts; the error of the unchanged rows is that of the predictions."""
    monkeypatch.setattr(study, "ORDERED", ordered)
    rng, held = np.random.default_rng(11), {2000: 230, 2001: 310}
    rows = [(fold, e, i // 5, float(a), None if i % 6 == 0 else float(b), int(rng.poisson(np.exp(0.6 + 0.5 * a + 0.2 * e))), train)
            for fold, n in held.items() for train, m in ((True, 300), (False, n)) for i in range(m) for e, a, b in ((i % 5, rng.normal(), rng.normal()),)]
    df = spark.createDataFrame(rows, "fold long, entity_id int, i int, a double, b double, target long, train boolean").withColumns(
        {"horizon": F.lit(1), "week_start": F.date_add(F.lit("2000-01-01").cast("date"), F.col("i") * 7), "cases": F.col("target")}
    ).withColumn("week_end", F.date_add("week_start", 6))
    df = stage_table(df, "panel")
    data = study.prepare(df.filter("train").drop("train"), df.filter("NOT train").drop("train"), {"all": ["entity_id", "a", "b"]})
    fitted = study.fit_family(data, family, {"rounds": 12, "depth": 2, "rate": 0.3} if family == "boosted" else {})
    got = {(r.fold, r.feature): r for r in study.permutation(fitted, data, family, repeats=1).collect()}
    assert {k: r.n_rows for k, r in got.items()} == {(fold, c): n for fold, n in held.items() for c in ("a", "b", "entity_id")}
    error = F.avg(F.abs(F.col("prediction_model") - F.col("observed_target"))).alias("e")
    base = {r.fold: r.e for r in study.predictions(fitted, data, family).groupBy("fold").agg(error).collect()}
    assert {k: r.baseline_mae for k, r in got.items()} == pytest.approx({(fold, c): base[fold] for fold, c in got})

    mark = lambda *parts: int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)
    every = data.rows.filter("NOT train").collect()
    for j, c in enumerate([*data.numeric, "entity_id"]):
        swapped = []
        for fold in held:
            mine = sorted((r for r in every if r.fold == fold), key=lambda r: (r.entity_id, r.week_start))
            for r, d in zip(mine, sorted(mine, key=lambda r: (mark(7, c, 0, r.entity_id, r.week_start), r.entity_id, r.week_start))):
                x = [d.x[k] if k % len(data.numeric) == j else v for k, v in enumerate(r.x)]
                swapped.append((fold, r.g, x, d.level if c == "entity_id" else r.level, r.y))
        some = spark.createDataFrame(swapped, "fold long, g int, x array<double>, level int, y double")
        out = study.rescored(fitted, data, family, some, ["fold", "y"]).collect()
        for fold in held:
            assert got[fold, c].permuted_mae == pytest.approx(np.mean([abs(max(r.margin[0], 0.0) - r.y) for r in out if r.fold == fold]))


def test_numbers_cross_buckets_in_order(spark):
    """Against sorting here; the bucket comes with nulls, and keys come twice."""
    rng = np.random.default_rng(2)
    rows = [(g, None if e == 4 else e, int(rng.integers(0, 30)), i) for g, n in ((None, 40), (0, 90), (1, 1)) for i in range(n) for e in (int(rng.integers(0, 5)),)]
    df = spark.createDataFrame(rows, "g int, e int, w int, i int")
    got = {(r.g, r.i): r.n for r in numbered(df, ["g"], "e", ["w", "i"], "n").collect()}
    first = lambda v: (v is not None, v or 0)
    for g in (None, 0, 1):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (first(r[1]), r[2], r[3]))
        assert [got[g, r[3]] for r in mine] == list(range(1, len(mine) + 1))


def test_study_permutes_all_evaluation_rows_and_a_sample_apart(spark, monkeypatch, tmp_path):
    """One fold of ridge fits: importance over as many rows as are predicted, its sample over 200 of them."""
    monkeypatch.setattr(forecasts, "shared_dir", lambda _: str(tmp_path))
    schedule = forecasts.run_study(Panels(spark, SF), (2000,), "2001-07-01", ("ridge",))
    predicted = {r.fit_id: r["count"] for r in schedule.table().groupBy("fit_id").count().collect()}
    used = schedule.table("importance").groupBy("part", "fit_id").agg(F.min("n_rows").alias("a"), F.max("n_rows").alias("b")).collect()
    assert len(predicted) == 12 and min(predicted.values()) > 200
    assert {(r.part, r.fit_id): (r.a, r.b) for r in used} == {("all", k): (n, n) for k, n in predicted.items()} | {("sample", k): (200, 200) for k in predicted}


def test_schedule_goes_on_after_a_failure_and_never_repeats_a_fit(spark, tmp_path):
    root, calls = str(tmp_path / "study"), []
    units = {"u1": {"a", "b"}, "u2": {"c"}}

    def work(unit):
        calls.append(unit)
        if unit == "u2" and calls.count("u2") == 1:
            raise RuntimeError("lost")
        fits = sorted(units[unit])
        entry = lambda f: {"fit_id": f, "fold": 1, "horizon": 1, "feature_set": "s", "family": "ridge", "n_train": 3, "slope": 0.0, "losses": None, "weights": {"x": 1.0}}
        rows = spark.createDataFrame([(f, 1.0) for f in fits], "fit_id string, prediction_model double")
        return {"predictions": rows, "importance": rows.select("fit_id")}, [entry(f) for f in fits]

    schedule = study.Schedule(spark, root, workers=2)
    assert schedule.done() == set()
    with pytest.raises(ValueError, match="no fit"):
        schedule.table()
    with pytest.raises(RuntimeError, match="lost"):
        schedule.run(units, work)
    assert schedule.done() == {"a", "b"}
    units["u1"].add("d")
    assert sorted(study.Schedule(spark, root).run(units, work)) == ["u1", "u2"]
    assert schedule.run(units, work) == []
    assert sorted(r.fit_id for r in schedule.table().collect()) == ["a", "b", "c", "d"]
    assert schedule.registry().count() == 4 and schedule.table("importance").count() == 4


@pytest.mark.parametrize("loss", ["squared", "poisson"])
def test_small_groups_take_one_job_and_large_ones_the_same_trees(spark, monkeypatch, loss):
    """Groups of one block are grown in one job whatever the rounds; with blocks of 200 rows one of them needs passes."""
    rng = np.random.default_rng(5)
    rows = [(g, i % 6 > 0, float(rng.poisson(2 + 3 * g + a)), bytearray([a, int(rng.integers(0, 2)), int(rng.integers(0, 9))]), i) for g, n in ((0, 150), (1, 400)) for i in range(n) for a in (i % 7,)]
    df = stage_table(spark.createDataFrame(rows, "g int, train boolean, y double, bins binary, i int"), "small_groups")
    p = boosting.Boosting(loss, rounds=12, depth=3, min_child=5.0)

    def grown(label):
        spark.sparkContext.setJobGroup(label, label)
        try:
            forest, scored = boosting.fit_many(df, 2, [[0, 1], [0, 1, 2]], [7, 2, 9], p)
            margins = {(r.g, r.i): list(r.margin) for r in scored.collect()}
            return forest, margins, len(spark.sparkContext.statusTracker().getJobIdsForGroup(label))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    whole, margins, jobs = grown(f"whole-{loss}")
    assert 0 < jobs < p.rounds
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 200)
    mixed, again, passes = grown(f"mixed-{loss}")
    assert passes >= p.rounds * p.depth
    for name in ("feature", "cut"):
        assert (getattr(whole, name) == getattr(mixed, name)).all()
    assert whole.value == pytest.approx(mixed.value, abs=1e-9) and np.array(whole.losses) == pytest.approx(np.array(mixed.losses))
    assert set(margins) == set(again) and all(margins[k] == pytest.approx(again[k], abs=1e-9) for k in margins)


def test_equal_splits_give_the_first_feature_whatever_rounding_says():
    sizes = np.array([2, 2])
    g, h = np.array([-30.0, 30.0, -30.0 - 1e-12, 30.0]), np.array([40.0, 40.0, 40.0, 40.0])
    for sums in (np.stack([g, h]), np.stack([g[[2, 3, 0, 1]], h])):
        assert boosting.best_split(sums, np.array([0, 1]), sizes, boosting.Boosting())[:2] == (0, 0)
