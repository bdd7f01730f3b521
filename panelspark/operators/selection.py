"""Fold summaries and choices between configurations. All inputs are per-fold metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.columns import count_where, ratio

# Fixed values.
TIE_TOLERANCE = 1e-9
CLOSE_RELATIVE_GAP = 0.01
FEATURE_SET_ORDER = ("cases_only", "cases_rainfall", "cases_full_weather", "full_context")


def relative_improvement(base: Column, value: Column) -> Column:
    return ratio(base - value, base) * 100.0


def order_of(column: str, order: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))


def config_summary(
    fold_metrics: DataFrame, keys: Sequence[str], *, required_folds: int | None = None
) -> DataFrame:
    """Equal-weight mean, median and population std of fold MAE per configuration."""
    out = fold_metrics.groupBy(*keys).agg(
        F.count_distinct("fold").alias("fold_count"),
        F.avg("mae").alias("mean_fold_mae"),
        F.percentile("mae", 0.5).alias("median_fold_mae"),
        F.stddev_pop("mae").alias("std_fold_mae"),
    )
    if required_folds is not None:
        out = out.filter(F.col("fold_count") == required_folds)
    return out


def full_coverage_ranking(fold_metrics: DataFrame, series: str = "baseline") -> DataFrame:
    """Series available on every row of every fold, best mean fold MAE first."""
    ranked = (
        fold_metrics.groupBy(series)
        .agg(F.min("coverage").alias("min_coverage"), F.avg("mae").alias("mean_fold_mae"))
        .filter(F.col("min_coverage") == 1.0)
    )
    return ranked.orderBy("mean_fold_mae", series)


def pick_first(
    df: DataFrame, by: Sequence[str], order: Sequence[str | Column], columns: Sequence[str]
) -> DataFrame:
    """Row with the smallest order tuple per group, as a partial aggregate."""
    return (
        df.groupBy(*by)
        .agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_r"))
        .select(*by, *[f"_r.{c}" for c in columns])
    )


def tuning_feature_set(summary: DataFrame) -> DataFrame:
    """Per family the feature set with the lowest mean fold MAE, ties by name."""
    return pick_first(
        summary, ["family"], ["mean_fold_mae", "feature_set"], ["feature_set", "mean_fold_mae"]
    )


def champion_per_horizon(
    fold_metrics: DataFrame, feature_counts: dict[str, int], *, first_family: str
) -> DataFrame:
    """Per horizon: lowest mean fold MAE, then family, fewer features, feature-set order."""
    summary = fold_metrics.groupBy("horizon", "feature_set", "family").agg(
        F.avg("mae").alias("mean_fold_mae"), F.avg("rmse").alias("mean_fold_rmse")
    )
    counts = F.create_map(*[F.lit(x) for kv in feature_counts.items() for x in kv])
    order = [
        "mean_fold_mae",
        (F.col("family") != first_family).cast("int"),
        counts[F.col("feature_set")],
        order_of("feature_set", FEATURE_SET_ORDER),
    ]
    return pick_first(
        summary, ["horizon"], order, ["feature_set", "family", "mean_fold_mae", "mean_fold_rmse"]
    )


def champion_ranking(
    fold_metrics: DataFrame,
    *,
    config: str = "config_id",
    simplicity: Column | None = None,
    fingerprint: str | None = None,
) -> DataFrame:
    """Rank configurations of one comparison; the input has one row per config and fold.

    Order: mean fold MAE (ties within 1e-9 of the best), high-incidence MAE, fold std, simplicity,
    id. Configurations that do not share the folds and cohort digests of all others are marked.
    """
    per = fold_metrics.groupBy(config).agg(
        F.avg("mae").alias("mean_mae"),
        F.avg("mae_high").alias("high_mae"),
        F.stddev_pop("mae").alias("fold_std"),
        F.min(simplicity if simplicity is not None else F.lit(0)).alias("simplicity"),
        F.count(F.lit(1)).alias("folds"),
        F.sum(fingerprint if fingerprint else F.lit(0)).alias("cohort"),
    )
    bounds = per.agg(
        F.struct(
            F.min("mean_mae").alias("best"),
            (F.count_distinct("folds", "cohort") == 1).alias("comparable"),
        )
    ).scalar()
    scored = per.withColumn("_b", bounds)
    tie = F.when(
        F.abs(F.col("mean_mae") - F.col("_b.best")) <= TIE_TOLERANCE, F.col("_b.best")
    ).otherwise(F.col("mean_mae"))
    scored = scored.withColumn("_tie", tie)
    # configurations are few (one row each), so a single ordered partition is bounded
    w = Window.orderBy("_tie", "high_mae", "fold_std", "simplicity", config)
    first = F.first("mean_mae").over(w)
    gap = F.when(first == 0, 0.0).otherwise((F.col("mean_mae") - first) / first)
    return (
        scored.withColumn("rank", F.row_number().over(w))
        .withColumn("relative_gap", gap)
        .withColumn("close", F.col("relative_gap") <= CLOSE_RELATIVE_GAP + TIE_TOLERANCE)
        .withColumn("comparable", F.col("_b.comparable"))
        .drop("_tie", "_b", "cohort")
    )


def ablation_table(
    fold_metrics: DataFrame, keys: Sequence[str], *, base: str = "cases_only"
) -> DataFrame:
    """Per configuration and feature set: fold summary, wins against the base set and paired steps."""
    sets = [s for s in FEATURE_SET_ORDER]
    # one row per (configuration, fold) with the feature sets side by side
    wide = fold_metrics.groupBy(*keys, "fold").agg(
        *[F.max(F.when(F.col("feature_set") == s, F.col("mae"))).alias(s) for s in sets]
    )
    steps = list(zip(sets[1:], sets[:-1], strict=True))
    delta = wide.groupBy(*keys).agg(
        *[F.avg(F.col(a) - F.col(b)).alias(f"step_{a}") for a, b in steps],
        F.avg(base).alias("_base_mean"),
    )
    cells = F.array(
        *[
            F.struct(F.lit(s).alias("feature_set"), F.col(s).alias("mae"), F.col(base).alias("base"))
            for s in sets
        ]
    )
    long = wide.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*").filter(
        F.col("mae").isNotNull()
    )
    summary = long.groupBy(*keys, "feature_set").agg(
        F.count(F.lit(1)).alias("fold_count"),
        F.avg("mae").alias("mean_mae"),
        F.percentile("mae", 0.5).alias("median_mae"),
        F.stddev_pop("mae").alias("std_mae"),
        count_where(F.col("mae") < F.col("base")).alias("fold_wins_vs_base"),
    )
    return (
        summary.join(delta, list(keys))
        .withColumn(
            "relative_improvement_pct",
            relative_improvement(F.col("_base_mean"), F.col("mean_mae")),
        )
        .drop("_base_mean")
    )


def weather_effect(
    fold_metrics: DataFrame, comparisons: Sequence[tuple[str, str, str]]
) -> DataFrame:
    """Paired fold differences of an added feature set against its base."""
    wide = fold_metrics.groupBy("horizon", "family", "fold").agg(
        *[
            F.max(F.when(F.col("feature_set") == s, F.col("mae"))).alias(s)
            for s in FEATURE_SET_ORDER
        ]
    )
    pairs = F.array(
        *[
            F.struct(
                F.lit(label).alias("comparison"),
                F.lit(added).alias("added_feature_set"),
                F.lit(base).alias("baseline_feature_set"),
                (F.col(added) - F.col(base)).alias("diff"),
            )
            for label, added, base in comparisons
        ]
    )
    long = wide.select("horizon", "family", "fold", F.explode(pairs).alias("_p")).select(
        "horizon", "family", "fold", "_p.*"
    )
    return (
        long.filter(F.col("diff").isNotNull())
        .groupBy("horizon", "family", "comparison", "added_feature_set", "baseline_feature_set")
        .agg(
            F.count(F.lit(1)).alias("folds"),
            F.avg("diff").alias("mean_difference"),
            count_where(F.col("diff") < 0).alias("folds_lower"),
            count_where(F.col("diff") > 0).alias("folds_higher"),
            count_where(F.col("diff") == 0).alias("folds_tied"),
        )
    )


def mean_or_null(
    fold_metrics: DataFrame, keys: Sequence[str], columns: Sequence[str], required_folds: int
) -> DataFrame:
    """Mean over all required folds, or null with a reason and the number of defined folds."""
    long = fold_metrics.select(
        *keys,
        "fold",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                    for c in columns
                ]
            )
        ).alias("_m"),
    ).select(*keys, "fold", "_m.*")
    agg = long.groupBy(*keys, "metric").agg(
        F.count(F.lit(1)).alias("fold_count"),
        F.count("value").alias("valid_fold_count"),
        F.avg("value").alias("_mean"),
    )
    reason = F.when(F.col("fold_count") != required_folds, "missing_required_folds").when(
        F.col("valid_fold_count") != required_folds, "one_or_more_required_folds_undefined"
    )
    return (
        agg.withColumn("null_reason", reason)
        .withColumn("mean_value", F.when(F.col("null_reason").isNull(), F.col("_mean")))
        .drop("_mean")
    )
