"""A study: every horizon, feature set, family and fold fitted on the panel, into one prediction table.

The rows of all folds and horizons are prepared once: medians, means and scales come from each fold's training
rows in one aggregation, and imputed values, indicators and the category's level are written as one table.
A unit of work is a family at a horizon: all folds and feature sets of it share their passes. Units run from
a bounded pool of threads. A unit's predictions and permutation importance are tables of their own, and its fits enter
the registry only when those stand, so a study that was interrupted goes on with the fits that are not registered.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions.columns import digest_int, plus_days
from panelspark.operators import boosting, linear
from panelspark.operators import preprocess as P
from panelspark.operators.importance import numbered, seeded_sample
from panelspark.session import stage_table

# Default parameters of the families.
FAMILIES: dict[str, tuple[str, Mapping[str, float]]] = {
    "ridge": ("squared", {"alpha": 1.0}),
    "poisson": ("poisson", {"alpha": 1.0}),
    "boosted": ("squared", {"rounds": 100, "depth": 3, "rate": 0.08}),
    "boosted_poisson": ("poisson", {"rounds": 100, "depth": 3, "rate": 0.08}),
}
LINEAR = ("ridge", "poisson")
BINS = 32
#: Rows of a group that a task puts into the order of their digests.
ORDERED = 1 << 16
KEYS = ("fold", "horizon", "entity_id", "week_start", "week_end", "cases")


@dataclass
class Prepared:
    """The prepared rows of all folds of some horizons.

    ``rows`` has g, fold, horizon, train, y, x (values, then indicators), level and the row's keys; ``most`` is the
    largest number of evaluation rows of a group.
    """

    rows: DataFrame
    groups: list[tuple[int, int]]
    numeric: list[str]
    levels: list[str]
    state: list[dict[str, Mapping]]
    sets: dict[str, tuple[int, ...]]
    most: int

    @property
    def names(self) -> list[str]:
        """Transformed names in column order."""
        return [*self.numeric, *[f"{c}__missing" for c in self.numeric], *[f"entity_id__{v}" for v in self.levels]]

    def of_horizon(self, horizon: int) -> Prepared:
        """The groups of one horizon, numbered anew."""
        kept = [k for k, (_, h) in enumerate(self.groups) if h == horizon]
        number = F.create_map(*[x for new, old in enumerate(kept) for x in (F.lit(old), F.lit(new))])
        rows = self.rows.filter(F.col("horizon") == horizon).withColumn("g", number[F.col("g")])
        return replace(self, rows=rows, groups=[self.groups[k] for k in kept], state=[self.state[k] for k in kept])

    @cached_property
    def design(self) -> linear.Design:
        table = lambda key, none: np.array([[s[c][key] if c in s and s[c][key] is not None else none for c in self.numeric] for s in self.state], float)
        return linear.Design(table("mean", 0.0), table("scale", 1.0), len(self.levels), tuple(self.sets.values()))

    @cached_property
    def cuts(self) -> np.ndarray:
        """[group, column, cut] values between the bins, from each group's training rows; filled up with infinity."""
        p, at = len(self.numeric), [k / BINS for k in range(1, BINS)]
        found = self.rows.filter("train").groupBy("g").agg(*[F.percentile_approx(F.get("x", F.lit(i)), at, 1000).alias(str(i)) for i in range(p)]).collect()
        cuts = np.full((len(self.groups), 2 * p + len(self.levels), BINS - 1), np.inf)
        for r in found:
            for i in range(p):
                values = np.unique(np.array(r[str(i)] or [], float))
                cuts[r.g, i, : len(values)] = values
        cuts[:, p:, 0] = 0.5
        return cuts

    @property
    def sizes(self) -> list[int]:
        """The number of bins of each column over all groups."""
        return (np.isfinite(self.cuts).sum(axis=2).max(axis=0) + 1).tolist()

    def binned(self, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep`` of some prepared rows with one byte per column."""
        hot = F.transform(F.sequence(F.lit(0), F.lit(max(len(self.levels) - 1, 0))), lambda v: (v == F.col("level")).cast("double"))
        every = F.concat("x", hot if self.levels else F.array().cast("array<double>"))
        return boosting.binned(rows.select(*dict.fromkeys([*keep, "g", "y"]), every.alias("every")), "every", self.cuts)


def prepare(training: DataFrame, evaluation: DataFrame, sets: Mapping[str, Sequence[str]], *, category: str = "entity_id") -> Prepared:
    """Imputes and codes the rows of every (fold, horizon) with the state of its training rows.

    Both frames have fold, horizon, target, entity, week and the features. Levels of the category are as many
    as entities, states as many as folds x horizons x features; both enter later steps as arrays.
    """
    numeric = list(dict.fromkeys(c for names in sets.values() for c in names if c != category))
    keep = ["fold", "horizon", "entity_id", "week_start", "week_end", F.col("target").cast("double").alias("y"), "cases", *[c for c in numeric if c != "cases"]]
    both = training.select(*keep, F.lit(True).alias("train")).unionByName(evaluation.select(*keep, F.lit(False).alias("train")))
    groups = sorted((r.fold, r.horizon) for r in training.select("fold", "horizon").distinct().collect())
    number = F.create_map(*[x for k, (f, h) in enumerate(groups) for x in (F.lit(f"{f}|{h}"), F.lit(k))])
    both = both.withColumn("g", number[F.concat_ws("|", "fold", "horizon")]).filter("g IS NOT NULL")
    both = stage_table(both, "study_rows")
    state = stage_table(P.fit_numeric(both.filter("train"), "g", numeric), "study_state")
    levels = both.filter("train").select(F.col(category).cast("string").alias("_name")).distinct().filter("_name IS NOT NULL")
    levels = stage_table(levels.withColumn("level", F.row_number().over(Window.orderBy("_name")) - 1), "study_levels")
    out = both.withColumn("_cases", F.col("cases"))
    out = P.transform_numeric(out, state, "g", numeric, scale=False)
    x = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in [*numeric, *[f"{c}__missing" for c in numeric]]])
    out = out.join(levels, F.col(category).cast("string") == F.col("_name"), "left")
    out = out.select("g", "train", "y", "fold", "horizon", "entity_id", "week_start", "week_end", F.col("_cases").alias("cases"), x.alias("x"), F.coalesce("level", F.lit(-1)).alias("level"))
    held: list[dict] = [{} for _ in groups]
    for r in state.filter("NOT dropped").collect():
        held[r["g"]][r["feature"]] = r.asDict()
    names = [r._name for r in levels.orderBy("level").collect()]
    p, index = len(numeric), {c: i for i, c in enumerate(numeric)}
    columns = {}
    for s, used in sets.items():
        own = [index[c] for c in used if c != category]
        columns[s] = (*own, *[p + i for i in own], *([2 * p + v for v in range(len(names))] if category in used else []))
    out = stage_table(out, "study_prepared")
    sizes = out.filter("NOT train").groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()
    return Prepared(out, groups, numeric, names, held, columns, max([r.n for r in sizes], default=0))


@dataclass
class Fitted:
    """What one family left: the scored rows, its parameters, and its coefficients or trees."""

    scored: DataFrame
    params: Mapping[str, float]
    coefficients: linear.Coefficients | None = None
    forest: boosting.Forest | None = None


def boosting_of(family: str, params: Mapping[str, float]) -> boosting.Boosting:
    return boosting.Boosting(FAMILIES[family][0], **{k: int(v) if k in ("rounds", "depth") else v for k, v in params.items()})


def fit_family(data: Prepared, family: str, params: Mapping[str, float] | None = None) -> Fitted:
    """All folds, horizons and feature sets of ``data`` for one family."""
    loss, defaults = FAMILIES[family]
    given = {**defaults, **(params or {})}
    keep = ["g", "train", "y", *KEYS]
    if family in LINEAR:
        found = linear.fit_many(data.rows, len(data.groups), data.design, loss, given["alpha"])
        return Fitted(linear.score(data.rows, data.design, loss, found, keep), given, coefficients=found)
    forest, scored = boosting.fit_many(data.binned(data.rows, keep), len(data.groups), list(data.sets.values()), data.sizes, boosting_of(family, given))
    return Fitted(scored.drop("bins"), given, forest=forest)


def rescored(fitted: Fitted, data: Prepared, family: str, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` of other prepared rows with ``margin``, the scores of a family that is fitted already."""
    if fitted.coefficients:
        return linear.score(rows, data.design, FAMILIES[family][0], fitted.coefficients, keep)
    return boosting.score(data.binned(rows, keep), fitted.forest, data.sizes, boosting_of(family, fitted.params), keep)


def _value(family: str) -> Column:
    """The prediction of a margin ``_m``: clipped at zero, null where it is not finite."""
    value = F.exp("_m") if FAMILIES[family][0] == "poisson" else F.col("_m")
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), F.greatest(value, F.lit(0.0)))


def permutation(fitted: Fitted, data: Prepared, family: str, *, rows: int | None = None, repeats: int = 3, seed: int = 7) -> DataFrame:
    """How much the error of each fit grows when a feature's values change places within a fold's evaluation rows.

    Works on all evaluation rows of a group, or, where ``rows`` is given, on that many with the smallest seeded digests. Digests of
    one feature and repeat make the order the rows receive each other's values in. A value travels with its missing
    mark, so this equals permuting the raw column before it is imputed; the category is one feature.
    """
    return permutations(fitted, data, family, {"": rows}, repeats=repeats, seed=seed).drop("part")


def permutations(fitted: Fitted, data: Prepared, family: str, parts: Mapping[str, int | None], *, repeats: int = 3, seed: int = 7) -> DataFrame:
    """``permutation`` for several numbers of rows (None: all) in one pass; ``part`` names which one a row is of."""
    p, key, group = len(data.numeric), ["entity_id", "week_start"], ["part", "g"]
    raw = [*data.numeric, *(["entity_id"] if data.levels else [])]
    held = data.rows.filter("NOT train")
    pieces = max(1, -(-data.most // ORDERED))
    some = [held if n is None else seeded_sample(held, ["g"], key, rows=n, seed=seed) for n in parts.values()]
    some = reduce(DataFrame.unionByName, [rows.withColumn("part", F.lit(name)) for name, rows in zip(parts, some)])
    some = stage_table(numbered(some, group, "entity_id" if pieces > 1 else None, key, "_pos"), "study_permutable")
    given = some.select(*group, "_pos", *key, "x", F.col("level").alias("_level"), F.explode(F.sequence(F.lit(0), F.lit(len(raw) - 1))).alias("_j"))
    value, mark = F.get("x", F.col("_j")).alias("_value"), F.get("x", F.col("_j") + p).alias("_mark")
    given = given.select(*group, "_j", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"), F.col("_pos").alias("_from"), *key, value, mark, "_level")
    given = given.withColumn("_draw", digest_int(F.lit(seed), F.element_at(F.lit(raw), F.col("_j") + 1), "repeat", *key))
    given = given.withColumn("_piece", F.shiftright(F.col("_draw") * pieces, 32))
    turns = numbered(given, [*group, "_j", "repeat"], "_piece" if pieces > 1 else None, ["_draw", *key, "_from"], "_pos")
    both = some.join(turns.select(*group, "_pos", "_j", "repeat", "_value", "_mark", "_level"), [*group, "_pos"])
    j, rest = F.col("_j"), lambda n: F.greatest(n, F.lit(0))
    swapped = F.concat(F.slice("x", F.lit(1), j), F.array("_value"), F.slice("x", j + 2, rest(F.lit(p - 1))), F.array("_mark"), F.slice("x", j + p + 2, rest(p - 1 - j)))
    keep = [*group, "y", "fold", "horizon", "_j", "repeat"]
    both = both.withColumns({"x": F.when(j < p, swapped).otherwise(F.col("x")), "level": F.when(j == p, F.col("_level")).otherwise(F.col("level"))})
    every = both.select(*keep, "x", "level").unionByName(some.withColumns({"_j": F.lit(-1), "repeat": F.lit(0)}).select(*keep, "x", "level"))
    long = rescored(fitted, data, family, every, keep).select(*keep, F.posexplode("margin").alias("_s", "_m")).withColumn("_v", _value(family))
    fit = [*group, "fold", "horizon", "_s"]
    per = stage_table(long.groupBy(*fit, "_j", "repeat").agg(F.avg(F.abs(F.col("y") - F.col("_v"))).alias("mae"), F.count("_v").alias("n_rows")), "study_permuted")
    base = per.filter("_j < 0").select(*fit, F.col("mae").alias("baseline_mae"))
    used = [sorted({i % p if i < 2 * p else p for i in at}) for at in data.sets.values()]
    out = per.filter(F.array_contains(F.get(F.lit(used), F.col("_s")), F.col("_j"))).join(base, fit)
    out = out.withColumns({"feature_set": F.get(F.lit(list(data.sets)), F.col("_s")), "family": F.lit(family)})
    return out.select(
        fit_id().alias("fit_id"), "fold", F.col("horizon").cast("long").alias("horizon"), "feature_set", "family", F.get(F.lit(raw), F.col("_j")).alias("feature"),
        F.col("repeat").cast("long").alias("repeat"), "n_rows", "baseline_mae", F.col("mae").alias("permuted_mae"), (F.col("mae") - F.col("baseline_mae")).alias("mae_increase"), "part",
    )


def fit_id() -> Column:
    return F.concat_ws("__", F.concat(F.lit("h"), F.col("horizon").cast("string")), "feature_set", "family", F.col("fold").cast("string"))


def predictions(fitted: Fitted, data: Prepared, family: str) -> DataFrame:
    """Long prediction rows of the evaluation rows, clipped at zero; scores that are not finite are null."""
    long = fitted.scored.filter("NOT train").select("*", F.posexplode("margin").alias("_s", "_m"))
    long = long.withColumns({"feature_set": F.get(F.lit(list(data.sets)), F.col("_s")), "family": F.lit(family)})
    start = plus_days("week_start", F.col("horizon") * 7)
    return long.select(
        fit_id().alias("fit_id"), "fold", F.col("horizon").cast("long").alias("horizon"), "feature_set", "family", "entity_id",
        F.col("week_start").alias("origin_start"), F.col("week_end").alias("origin_end"), start.alias("target_start"), plus_days(start, 6).alias("target_end"),
        F.col("cases").alias("observed_current"), F.col("y").cast("long").alias("observed_target"),
        _value(family).alias("prediction_model"), F.col("cases").cast("double").alias("prediction_persistence"),
    )


#: One row per finished fit; ``weights`` are coefficients (ridge, poisson) or shares of the gain (boosted).
REGISTRY = "fit_id string, fold long, horizon long, feature_set string, family string, unit string, path string, n_train long, slope double, losses array<double>, weights map<string,double>"


def fit_rows(fitted: Fitted, data: Prepared, family: str) -> list[dict]:
    """What the registry keeps of each fit."""
    out, names, counts = [], data.names, {r.g: r.n for r in data.rows.filter("train").groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares: dict[tuple[int, int], dict[str, float]] = {}
    for g, s, name, share in boosting.importance(fitted.forest, names) if fitted.forest else []:
        shares.setdefault((g, s), {})[name] = share
    for g, (fold, horizon) in enumerate(data.groups):
        for s, (feature_set, used) in enumerate(data.sets.items()):
            one = {"fit_id": f"h{horizon}__{feature_set}__{family}__{fold}", "fold": fold, "horizon": horizon, "feature_set": feature_set, "family": family, "n_train": counts.get(g, 0)}
            if fitted.forest:
                one |= {"slope": None, "losses": [float(x[g, s]) for x in fitted.forest.losses], "weights": shares.get((g, s), {})}
            else:
                beta = fitted.coefficients.beta[g, s]
                one |= {"slope": float(fitted.coefficients.slope[g, s]), "losses": None, "weights": {"intercept": float(beta[0])} | {names[j]: float(beta[1 + j]) for j in used}}
            out.append(one)
    return out


@dataclass
class Schedule:
    """Runs units of fits once: ``root`` holds the registry of finished fits and the tables of each unit."""

    spark: SparkSession
    root: str
    workers: int = 4
    _lock: threading.Lock = field(default_factory=threading.Lock)

    @property
    def registry_path(self) -> str:
        return f"{self.root}/registry"

    def registry(self) -> DataFrame | None:
        """The finished fits, or None before the first one."""
        try:
            return self.spark.read.schema(REGISTRY).parquet(self.registry_path)
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def done(self) -> set[str]:
        found = self.registry()
        return set() if found is None else {r.fit_id for r in found.select("fit_id").distinct().collect()}

    def run(self, units: Mapping[str, set[str]], work: Callable[[str], tuple[Mapping[str, DataFrame], list[dict]]]) -> list[str]:
        """Runs the units that have fits not done yet and returns their names.

        ``work`` gives a unit's tables (rows with fit_id) and registry rows. A failed unit ends the run after the units under way;
        what they finished stays, and the next run goes on from there.
        """
        done = self.done()
        todo = [u for u, fits in units.items() if not fits <= done]

        def one(unit: str) -> None:
            path = f"{self.root}/units/{unit}-{uuid.uuid4().hex}"
            tables, fits = work(unit)
            wanted = units[unit] - done
            for name, rows in tables.items():
                rows.filter(F.col("fit_id").isin(sorted(wanted))).write.parquet(f"{path}/{name}")
            entries = [r | {"unit": unit, "path": path} for r in fits if r["fit_id"] in wanted]
            with self._lock:
                self.spark.createDataFrame(entries, REGISTRY).coalesce(1).write.mode("append").parquet(self.registry_path)

        with ThreadPoolExecutor(max_workers=max(1, self.workers)) as pool:
            for job in [pool.submit(inheritable_thread_target(self.spark)(one), u) for u in todo]:
                job.result()
        return todo

    def table(self, name: str = "predictions") -> DataFrame:
        """A table of all registered fits."""
        found = self.registry()
        if found is None:
            raise ValueError("no fit is registered")
        return self.spark.read.parquet(*sorted(f"{r.path}/{name}" for r in found.select("path").distinct().collect()))
