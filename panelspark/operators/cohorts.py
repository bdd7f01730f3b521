"""Direct-horizon cohorts: training rows, availability, thresholds, fingerprints, integrity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.columns import (
    all_of,
    count_where,
    finite_nonnegative,
    plus_days,
    present,
    set_digest,
)
from panelspark.functions.quantiles import weighted_quantiles
from panelspark.operators.features import HORIZONS, eligible, target_end

ENTITY, WEEK, WEEK_END = "entity_id", "week_start", "week_end"


def label_available(
    df: DataFrame, *, horizon: int, cutoff: str, week: str = WEEK
) -> DataFrame:
    """Rows whose target week has ended by the cutoff."""
    return df.filter(target_end(week, horizon) <= F.lit(cutoff).cast("date"))


def fold_origins(panel: DataFrame, years: Sequence[int]) -> DataFrame:
    """First evaluation origin of each fold year that has an eligible origin."""
    return (
        panel.filter(eligible() & F.year(WEEK).isin(*years))
        .groupBy(F.year(WEEK).cast("long").alias("fold"))
        .agg(F.min(WEEK).alias("first_origin"))
    )


def long_targets(panel: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """One row per (origin, horizon) that is eligible for that horizon."""
    options = F.array(
        *[
            F.when(
                eligible(horizons=(h,)),
                F.struct(F.lit(h).alias("h"), F.col(f"target_h{h}").alias("t")),
            )
            for h in horizons
        ]
    )
    keep = [c for c in panel.columns if not c.startswith("target_h")]
    return (
        panel.select(*keep, F.explode(F.array_compact(options)).alias("_o"))
        .select(*keep, F.col("_o.h").alias("horizon"), F.col("_o.t").alias("target"))
        .withColumn("target_end", target_end(WEEK, F.col("horizon")))
    )


def training_from(rows: DataFrame, origins: DataFrame, *, boundary: str) -> DataFrame:
    """Mark each (origin, horizon) row with the first fold it may train.

    The embargo is monotone: a row that may train one fold may train all later ones. So a cohort
    is "first_fold <= fold", and rows need not be copied per fold.
    """
    folds = origins.agg(
        F.array_sort(F.collect_list(F.struct("first_origin", "fold")))
    ).scalar()
    free_from = plus_days("target_end", 7)
    return (
        rows.filter(
            (F.col("target_end") < F.lit(boundary).cast("date"))
            & (F.col(WEEK_END) < F.lit(boundary).cast("date"))
        )
        .withColumn("_folds", folds)
        .withColumn(
            "first_fold",
            F.get(F.filter("_folds", lambda f: f["first_origin"] > free_from), F.lit(0))["fold"],
        )
        .drop("_folds")
        .filter(F.col("first_fold").isNotNull())
    )


def expand_folds(counts: DataFrame, origins: DataFrame) -> DataFrame:
    """Spread per-first-fold aggregates to every fold that uses them."""
    folds = origins.agg(F.collect_list("fold")).scalar()
    return (
        counts.withColumn("_folds", folds)
        .withColumn("fold", F.explode(F.filter("_folds", lambda f: f >= F.col("first_fold"))))
        .drop("first_fold", "_folds")
    )


def training_rows(rows: DataFrame, origins: DataFrame, *, boundary: str) -> DataFrame:
    """Materialised training rows per (fold, horizon), for fitting."""
    return expand_folds(training_from(rows, origins, boundary=boundary), origins)


def evaluation_rows(panel: DataFrame, years: Sequence[int]) -> DataFrame:
    """Common cohort of each fold year: origins with current, lags and all targets."""
    return panel.filter(eligible() & F.year(WEEK).isin(*years)).withColumn(
        "fold", F.year(WEEK).cast("long")
    )


def horizon_availability(panel: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Per origin: observed, history, each target, all targets, common cohort."""
    history = all_of(present(f"cases_lag_{k}") for k in (1, 2, 3, 4))
    targets = {f"target_h{h}_available": present(f"target_h{h}") for h in horizons}
    every = all_of(targets.values())
    return panel.select(
        ENTITY,
        WEEK,
        present("cases").alias("observed"),
        history.alias("history_available"),
        *[c.alias(n) for n, c in targets.items()],
        every.alias("all_targets_available"),
        (present("cases") & history & every).alias("common_cohort"),
    )


def availability_summary(availability: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Rows, weeks and entities by horizon and for the common cohort.

    Counted over (entity) and (week) sub-totals rather than distinct sets over all rows.
    """
    usable = F.col("observed") & F.col("history_available")
    groups = [
        F.when(usable & F.col(f"target_h{h}_available"), F.lit(f"h{h}")) for h in horizons
    ]
    groups.append(F.when(F.col("common_cohort"), F.lit("common")))
    long = availability.select(
        ENTITY, WEEK, F.explode(F.array_compact(F.array(*groups))).alias("cohort")
    )
    by_entity = long.groupBy("cohort", ENTITY).agg(F.count(F.lit(1)).alias("n"))
    by_week = long.groupBy("cohort", WEEK).agg(F.count(F.lit(1)).alias("n"))
    rows = by_entity.groupBy("cohort").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("entities")
    )
    weeks = by_week.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("weeks"),
        F.min(WEEK).alias("first_week"),
        F.max(WEEK).alias("last_week"),
    )
    return rows.join(weeks, "cohort")


def cohort_fingerprint(
    rows: DataFrame,
    by: Sequence[str],
    *,
    target: str | None = None,
    values: Sequence[str] = (),
) -> DataFrame:
    """Row count and order-free digests of keys, targets and other values.

    A digest is two 64-bit sums, and sums are associative: no sort, no collect, one partial aggregation.
    """
    key = [ENTITY, WEEK]
    out = [F.count(F.lit(1)).alias("row_count"), set_digest(*key).alias("key_digest")]
    if target:
        out.append(set_digest(*key, F.col(target)).alias("target_digest"))
    if values:
        text = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in values]
        out.append(set_digest(*key, *text).alias("value_digest"))
    return rows.groupBy(*by).agg(*out)


def threshold_binding(
    training: DataFrame, origins: DataFrame, *, current: str = "cases", target: str = "target"
) -> DataFrame:
    """Training-only thresholds per (fold, horizon).

    Input rows carry ``first_fold`` (see :func:`training_from`). Distinct values are counted once
    per first fold and only the counts are spread over the later folds.
    """
    delta = F.col(target) - F.col(current)
    kinds = F.array_compact(
        F.array(
            F.struct(F.lit("target").alias("k"), F.col(target).cast("double").alias("v")),
            F.struct(F.lit("abs").alias("k"), F.abs(delta).cast("double").alias("v")),
            F.when(
                delta > 0, F.struct(F.lit("up").alias("k"), delta.cast("double").alias("v"))
            ),
            F.when(
                delta < 0, F.struct(F.lit("down").alias("k"), (-delta).cast("double").alias("v"))
            ),
        )
    )
    counts = (
        training.select("first_fold", "horizon", F.explode(kinds).alias("_k"))
        .groupBy("first_fold", "horizon", F.col("_k.k").alias("kind"), F.col("_k.v").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    keys = ["fold", "horizon", "kind"]
    spread = expand_folds(counts, origins).groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    quantiles = weighted_quantiles(
        spread, keys, "value", "n", {"q25": 0.25, "q90": 0.9, "q95": 0.95}
    )
    sizes = spread.groupBy(*keys).agg(F.sum("n").alias("n"))
    pick = lambda kind, col: F.max(F.when(F.col("kind") == kind, F.col(col)))
    size = lambda kind: F.coalesce(pick(kind, "n"), F.lit(0))
    return (
        quantiles.join(sizes, keys)
        .groupBy("fold", "horizon")
        .agg(
            size("target").alias("n_train"),
            pick("target", "q90").alias("q90_incidence"),
            pick("target", "q95").alias("q95_incidence"),
            pick("abs", "q25").alias("stable_abs_delta_q25"),
            pick("up", "q90").alias("large_up_q90"),
            pick("down", "q90").alias("large_down_abs_q90"),
            size("up").alias("n_up"),
            size("down").alias("n_down"),
            (size("target") - size("up") - size("down")).alias("n_stable"),
        )
    )


def select_keys(
    rows: DataFrame, keys: DataFrame, *, boundary: str, on: Sequence[str] = (ENTITY, WEEK)
) -> DataFrame:
    """Frozen keys with their rows and the problem of each key that cannot be used."""
    found = keys.select(*on).join(
        rows.withColumn("_hit", F.lit(True)), list(on), "left"
    )
    problem = F.when(F.col("_hit").isNull(), "missing").when(
        F.col(WEEK) < F.lit(boundary).cast("date"), "before_boundary"
    )
    return found.withColumn("problem", problem).drop("_hit")


def embargo_violations(
    training: DataFrame, evaluation: DataFrame, by: Sequence[str]
) -> DataFrame:
    """Per fit: keys shared by both sides and training rows inside the embargo."""
    keys = [*by, ENTITY, WEEK]
    shared = (
        training.select(*keys)
        .join(evaluation.select(*keys), keys, "left_semi")
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("shared_keys"))
    )
    first = evaluation.groupBy(*by).agg(F.min(WEEK).alias("_first"))
    late = training.groupBy(*by).agg(F.max("target_end").alias("_last"), F.count(F.lit(1)).alias("n_train"))
    return (
        first.join(late, list(by), "left")
        .join(shared, list(by), "left")
        .select(
            *by,
            F.coalesce("n_train", F.lit(0)).alias("n_train"),
            F.coalesce("shared_keys", F.lit(0)).alias("shared_keys"),
            F.coalesce(plus_days("_last", 7) >= F.col("_first"), F.lit(False)).alias(
                "embargo_broken"
            ),
        )
    )


def interval_bounds(training: DataFrame, evaluation: DataFrame, by: Sequence[str]) -> DataFrame:
    """Origin ranges, last target ends and the embargo limit of each fit."""
    t = training.groupBy(*by).agg(
        F.min(WEEK).alias("train_start"),
        F.max(WEEK).alias("train_end"),
        F.max("target_end").alias("train_target_end"),
    )
    e = evaluation.groupBy(*by).agg(
        F.min(WEEK).alias("eval_start"),
        F.max(WEEK).alias("eval_end"),
        F.max("target_end").alias("eval_target_end"),
    )
    return t.join(e, list(by)).withColumn("embargo_limit", plus_days("train_target_end", 7))


def unshared_cohorts(fingerprints: DataFrame, by: Sequence[str], digest: str) -> DataFrame:
    """Groups whose members do not all have the same cohort digest."""
    return (
        fingerprints.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.min(digest).alias("_lo"),
            F.max(digest).alias("_hi"),
        )
        .withColumn("shared", F.col("_lo") == F.col("_hi"))
        .drop("_lo", "_hi")
    )


def feature_missingness(
    df: DataFrame, feature_sets: dict[str, Sequence[str]], *, year: Column | None = None
) -> DataFrame:
    """Per feature set and year: missing cells, rows with any missing feature, rows."""
    y = (year if year is not None else F.year(WEEK)).cast("long").alias("year")
    members = F.array(
        *[
            F.struct(
                F.lit(name).alias("feature_set"),
                sum(((~present(c)).cast("long") for c in cols), F.lit(0).cast("long")).alias("m"),
                F.lit(len(cols)).cast("long").alias("w"),
            )
            for name, cols in feature_sets.items()
        ]
    )
    long = df.select(y, F.explode(members).alias("_f")).select("year", "_f.*")
    return long.groupBy("feature_set", "year").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max("w").alias("features"),
        F.sum("m").alias("missing_cells"),
        count_where(F.col("m") > 0).alias("rows_with_missing"),
    )
