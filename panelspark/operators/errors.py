"""Error tables over long prediction rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.columns import count_where, finite, plus_days, ratio
from panelspark.functions.quantiles import exact_quantiles
from panelspark.operators import metrics as M
from panelspark.operators.selection import relative_improvement

FIT = ("horizon", "feature_set", "family")
TARGET, MODEL, PERSIST = "observed_target", "prediction_model", "prediction_persistence"


def prediction_table(
    rows: DataFrame, models: Mapping[tuple[str, str], Column], *, entity: str = "entity_id"
) -> DataFrame:
    """Long prediction rows: identity, origin and target intervals, model and persistence.

    ``models`` maps (family, feature_set) to a scoring column.
    """
    cells = F.array(
        *[
            F.struct(
                F.lit(family).alias("family"),
                F.lit(fs).alias("feature_set"),
                M.clip_nonnegative(score).alias("p"),
            )
            for (family, fs), score in models.items()
        ]
    )
    h = F.col("horizon")
    return (
        rows.withColumn("_c", F.explode(cells))
        .select(
            F.concat_ws(
                "__", F.concat(F.lit("h"), h.cast("string")), "_c.feature_set", "_c.family",
                F.col("fold").cast("string"),
            ).alias("fit_id"),
            "fold",
            h.cast("long").alias("horizon"),
            F.col("_c.feature_set").alias("feature_set"),
            F.col("_c.family").alias("family"),
            entity,
            F.col("week_start").alias("origin_start"),
            plus_days("week_start", 6).alias("origin_end"),
            plus_days("week_start", h * 7).alias("target_start"),
            plus_days("week_start", h * 7 + 6).alias("target_end"),
            F.col("cases").alias("observed_current"),
            F.col("target").alias(TARGET),
            F.col("_c.p").alias(MODEL),
            F.col("cases").cast("double").alias(PERSIST),
        )
    )


def group_metrics(target: str, prediction: str) -> dict[str, Column]:
    """n, mean target, MAE, RMSE, bias, MAE relative to the mean target."""
    mean_target = F.avg(F.col(target).cast("double"))
    mae = M.mae(target, prediction)
    return {
        "n": F.count(F.col(prediction)),
        "mean_target": mean_target,
        "mae": mae,
        "rmse": M.rmse(target, prediction),
        "bias": M.bias(target, prediction),
        "mae_relative_to_mean_target": F.when(mean_target > 0, mae / mean_target),
    }


def named(columns: Mapping[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in columns.items()]


def entity_errors(pred: DataFrame, by: Sequence[str], *, entity: str = "entity_id") -> DataFrame:
    """Metrics per entity; its rows are bounded by the calendar, so the median is an aggregate."""
    median = F.percentile(F.abs(M.error(TARGET, MODEL)), 0.5).alias("median_absolute_error")
    return pred.groupBy(*by, entity).agg(*named(group_metrics(TARGET, MODEL)), median)


def week_band(day: Column) -> Column:
    """Quarter-like band of the ISO week. Band limits and names."""
    w = F.weekofyear(day)
    return (
        F.when(w <= 13, "weeks_01_13")
        .when(w <= 26, "weeks_14_26")
        .when(w <= 39, "weeks_27_39")
        .otherwise("weeks_40_53")
    )


def temporal_errors(pred: DataFrame, by: Sequence[str], *, day: str = "target_start") -> DataFrame:
    """The same metrics by year, month, quarter and week band of the target date.

    Each row is listed under its four group values, so one aggregation replaces four. A group may
    hold a large share of all rows, so its median goes through the slotted exact quantile.
    """
    d = F.col(day)
    groups = {
        "year": F.year(d).cast("string"),
        "month": F.month(d).cast("string"),
        "quarter": F.quarter(d).cast("string"),
        "week_band": week_band(d),
    }
    cells = F.array(
        *[F.struct(F.lit(n).alias("grouping"), c.alias("group_value")) for n, c in groups.items()]
    )
    long = pred.select(*by, TARGET, MODEL, F.explode(cells).alias("_g")).select(
        *by, TARGET, MODEL, "_g.*"
    )
    keys = [*by, "grouping", "group_value"]
    medians = exact_quantiles(
        long, keys, F.abs(M.error(TARGET, MODEL)), {"median_absolute_error": 0.5}
    )
    return long.groupBy(*keys).agg(*named(group_metrics(TARGET, MODEL))).join(medians, keys)


def outbreak_errors(
    pred: DataFrame, by: Sequence[str], subsets: Mapping[str, str]
) -> DataFrame:
    """Errors at or above each threshold column; an empty subset keeps its row with nulls."""
    aggs: list[Column] = []
    for name, col in subsets.items():
        inside = F.col(TARGET) >= F.col(col)
        aggs.append(
            F.struct(
                F.lit(name).alias("subset"),
                F.min(col).alias("threshold_min"),
                F.max(col).alias("threshold_max"),
                count_where(inside).alias("subset_n"),
                M.mae(TARGET, MODEL, inside).alias("mae"),
                M.rmse(TARGET, MODEL, inside).alias("rmse"),
                M.bias(TARGET, MODEL, inside).alias("bias"),
                M.under_rate(TARGET, MODEL, inside).alias("underprediction_rate"),
            ).alias(f"s_{name}")
        )
    wide = pred.groupBy(*by).agg(*aggs)
    return wide.select(
        *by, F.explode(F.array(*[F.col(f"s_{n}") for n in subsets])).alias("_s")
    ).select(*by, "_s.*")


def largest_errors(
    pred: DataFrame, context: DataFrame, on: Sequence[str], *, limit: int, ties: Sequence[str]
) -> DataFrame:
    """The report of the largest absolute errors with context columns.

    The top rows are taken first (a bounded top-k per task), then joined to their context.
    """
    err = F.abs(M.error(TARGET, MODEL))
    top = (
        pred.withColumn("absolute_error", err)
        .orderBy(F.desc("absolute_error"), *ties)
        .limit(limit)
    )
    return top.join(context, list(on), "left")


def missingness_errors(
    pred: DataFrame, by: Sequence[str], masks: Mapping[str, Column]
) -> DataFrame:
    """Errors of overlapping row groups; groups without rows keep n = 0 and null metrics."""
    aggs = []
    for name, mask in masks.items():
        e = F.when(mask, M.error(TARGET, MODEL))
        y = F.when(mask, F.col(TARGET).cast("double"))
        aggs.append(
            F.struct(
                F.lit(name).alias("missingness_group"),
                F.count(e).alias("n"),
                F.avg(y).alias("mean_target"),
                F.avg(F.abs(e)).alias("mae"),
                F.sqrt(F.avg(e * e)).alias("rmse"),
                F.avg(e).alias("bias"),
            ).alias(f"g_{name}")
        )
    wide = pred.groupBy(*by).agg(*aggs)
    return wide.select(
        *by, F.explode(F.array(*[F.col(f"g_{n}") for n in masks])).alias("_g")
    ).select(*by, "_g.*")


def fold_table(pred: DataFrame) -> DataFrame:
    """Per fit: model and persistence MAE and RMSE, difference, improvement, strict wins."""
    agg = pred.groupBy(*FIT, "fold", "fit_id").agg(
        F.count(F.lit(1)).alias("n"),
        M.mae(TARGET, MODEL).alias("mae_model"),
        M.mae(TARGET, PERSIST).alias("mae_persistence"),
        M.rmse(TARGET, MODEL).alias("rmse_model"),
        M.rmse(TARGET, PERSIST).alias("rmse_persistence"),
    )
    return agg.withColumns(
        {
            "mae_difference": F.col("mae_model") - F.col("mae_persistence"),
            "relative_improvement_pct": relative_improvement(
                F.col("mae_persistence"), F.col("mae_model")
            ),
            "strict_mae_win": F.col("mae_model") < F.col("mae_persistence"),
            "strict_rmse_win": F.col("rmse_model") < F.col("rmse_persistence"),
        }
    )


def config_table(folds: DataFrame) -> DataFrame:
    """Unweighted fold means per configuration with fold wins."""
    out = folds.groupBy(*FIT).agg(
        F.count(F.lit(1)).alias("fold_count"),
        F.avg("mae_model").alias("mean_mae_model"),
        F.avg("mae_persistence").alias("mean_mae_persistence"),
        F.avg("mae_difference").alias("mean_mae_difference"),
        F.avg("rmse_model").alias("mean_rmse_model"),
        F.avg("rmse_persistence").alias("mean_rmse_persistence"),
        count_where(F.col("strict_mae_win")).alias("mae_fold_wins"),
        count_where(F.col("strict_rmse_win")).alias("rmse_fold_wins"),
    )
    return out.withColumn(
        "relative_improvement_pct",
        relative_improvement(F.col("mean_mae_persistence"), F.col("mean_mae_model")),
    )


def entity_improvement(
    pred: DataFrame, by: Sequence[str], *, entity: str = "entity_id"
) -> DataFrame:
    """Model against persistence per entity, with a reason where the percentage is undefined."""
    y = F.col(TARGET).cast("double")
    agg = pred.groupBy(*by, entity).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(y).alias("target_total"),
        F.avg(y).alias("target_mean"),
        M.mae(TARGET, MODEL).alias("model_mae"),
        M.mae(TARGET, PERSIST).alias("persistence_mae"),
    )
    gain = F.col("persistence_mae") - F.col("model_mae")
    return agg.withColumns(
        {
            "improvement": gain,
            "improvement_pct": ratio(gain, "persistence_mae") * 100.0,
            "null_reason": F.when(
                F.col("persistence_mae") == 0, "zero_persistence_mae_denominator"
            ),
            "normalized_mae": ratio("model_mae", "target_mean"),
        }
    )


def _pair_errors(where: Column) -> list[Column]:
    return [
        count_where(where).alias("count"),
        M.mae(TARGET, MODEL, where).alias("mae_model"),
        M.mae(TARGET, PERSIST, where).alias("mae_persistence"),
        M.bias(TARGET, MODEL, where).alias("bias_model"),
        M.bias(TARGET, PERSIST, where).alias("bias_persistence"),
    ]


def high_incidence_errors(
    pred: DataFrame, thresholds: DataFrame, groups: Mapping[str, str]
) -> DataFrame:
    """Per fit and incidence group: count, errors of both series, reason for nulls."""
    joined = pred.join(thresholds, ["fold", "horizon"])
    keys = [*FIT, "fold", "fit_id"]
    aggs = [
        F.struct(
            F.lit(name).alias("incidence_group"),
            F.max(col).alias("threshold"),
            *_pair_errors(F.col(TARGET) >= F.col(col)),
        ).alias(f"g_{name}")
        for name, col in groups.items()
    ]
    wide = joined.groupBy(*keys).agg(*aggs)
    return (
        wide.select(*keys, F.explode(F.array(*[F.col(f"g_{n}") for n in groups])).alias("_g"))
        .select(*keys, "_g.*")
        .withColumn("null_reason", F.when(F.col("count") == 0, "empty_subset"))
    )


# Categories of week-to-week change.
CHANGE_CATEGORIES = (
    "stable",
    "directional_up",
    "large_up",
    "directional_down",
    "large_down",
    "uncategorized",
)


def change_category(delta: Column, *, stable: str, up: str, down: str) -> Column:
    """Stable within the training cut-off; large when a present large cut-off is reached."""
    s = F.col(stable)
    return (
        F.when(F.abs(delta) <= s, "stable")
        .when((delta > s) & F.coalesce(delta >= F.col(up), F.lit(False)), "large_up")
        .when(delta > s, "directional_up")
        .when((delta < -s) & F.coalesce(-delta >= F.col(down), F.lit(False)), "large_down")
        .when(delta < -s, "directional_down")
        .otherwise("uncategorized")
    )


def categorized(pred: DataFrame, thresholds: DataFrame) -> DataFrame:
    delta = F.col(TARGET).cast("double") - F.col("observed_current").cast("double")
    joined = pred.join(
        thresholds.select(
            "fold", "horizon", "stable_abs_delta_q25", "large_up_q90", "large_down_abs_q90"
        ),
        ["fold", "horizon"],
    )
    return joined.withColumn(
        "category",
        change_category(
            delta, stable="stable_abs_delta_q25", up="large_up_q90", down="large_down_abs_q90"
        ),
    )


def change_category_errors(cat: DataFrame) -> DataFrame:
    """Per fit and every category, including empty ones: count and errors."""
    keys = [*FIT, "fold", "fit_id"]
    aggs = [
        F.struct(
            F.lit(c).alias("category"), *_pair_errors(F.col("category") == c)
        ).alias(f"c_{c}")
        for c in CHANGE_CATEGORIES
    ]
    wide = cat.groupBy(*keys).agg(*aggs)
    return (
        wide.select(
            *keys, F.explode(F.array(*[F.col(f"c_{c}") for c in CHANGE_CATEGORIES])).alias("_c")
        )
        .select(*keys, "_c.*")
        .withColumn("null_reason", F.when(F.col("count") == 0, "empty_subset"))
    )


def category_pivot(cat: DataFrame, by: Sequence[str]) -> DataFrame:
    return cat.groupBy(*by).agg(
        *[count_where(F.col("category") == c).alias(c) for c in CHANGE_CATEGORIES]
    )


def metric_document(pred: DataFrame, thresholds: DataFrame) -> DataFrame:
    """All metrics of both series per fit in one aggregation, improvement with its null reason."""
    joined = pred.join(thresholds, ["fold", "horizon"])
    limits = {"top_10pct": "q90_incidence", "top_5pct": "q95_incidence"}
    aggs: list[Column] = []
    for tag, series in (("model", MODEL), ("persistence", PERSIST)):
        cols = {
            **M.metric_columns(TARGET, series, "q90_incidence"),
            **M.high_incidence_columns(TARGET, series, limits),
        }
        aggs.extend(c.alias(f"{n}_{tag}") for n, c in cols.items() if n != "n")
    out = joined.groupBy(*FIT, "fold", "fit_id").agg(
        F.count(F.lit(1)).alias("n"),
        count_where(F.col(TARGET) >= F.col("q90_incidence")).alias("top_10_count"),
        count_where(F.col(TARGET) >= F.col("q95_incidence")).alias("top_5_count"),
        *aggs,
    )
    pct = relative_improvement(F.col("mae_persistence"), F.col("mae_model"))
    return out.withColumns(
        {
            "relative_improvement_pct": pct,
            "relative_improvement_reason": F.when(
                pct.isNull(), "zero_or_undefined_persistence_mae"
            ),
            "strict_mae_win": F.col("mae_model") < F.col("mae_persistence"),
            "strict_rmse_win": F.col("rmse_model") < F.col("rmse_persistence"),
        }
    )


def shared_support(
    model: DataFrame, long_baselines: DataFrame, *, keys: Sequence[str], fold: str, names: Sequence[str]
) -> DataFrame:
    """Model against each baseline on pairwise-available rows and on the intersection of all.

    ``model`` has (keys, fold, target, prediction, threshold90, threshold95). The baselines are
    laid side by side once, so both supports come from one join and one aggregation.
    """
    wide = long_baselines.groupBy(*keys).agg(
        *[F.max(F.when(F.col("baseline") == b, F.col("prediction"))).alias(b) for b in names]
    )
    joined = model.join(wide, list(keys))
    ok_model = finite("target") & finite("prediction")
    every = ok_model
    for b in names:
        every = every & finite(b)
    cells = []
    for b in names:
        pair = ok_model & finite(b)
        cells.append(_support("pairwise_baseline_available", "model", b, pair, "prediction"))
        cells.append(_support("pairwise_baseline_available", "baseline", b, pair, b))
        cells.append(_support("all_baselines_intersection", "baseline", b, every, b))
    cells.append(_support("all_baselines_intersection", "model", "", every, "prediction"))
    long = joined.select(
        fold, "entity_id", "target", "threshold90", "threshold95", F.explode(F.array(*cells)).alias("_s")
    ).select(fold, "entity_id", "target", "threshold90", "threshold95", "_s.*")
    inside = F.col("inside")
    limits = {"top_90": "threshold90", "top_95": "threshold95"}
    p = F.when(inside, F.col("p"))
    y = F.when(inside, F.col("target").cast("double"))
    rows = long.withColumns({"p": p, "y": y})
    by = [fold, "support_type", "series_role", "baseline"]
    entities = rows.filter(inside).groupBy(*by, "entity_id").agg(F.lit(1).alias("one"))
    counted = entities.groupBy(*by).agg(F.count(F.lit(1)).alias("entities"))
    agg = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        *named(M.metric_columns("y", "p")),
        *[
            M.mae("y", "p", F.col("y") >= F.col(col)).alias(f"mae_{name}")
            for name, col in limits.items()
        ],
    )
    return (
        agg.join(counted, by, "left")
        .withColumn("entities", F.coalesce("entities", F.lit(0)))
        .withColumn("coverage", F.col("n") / F.col("total"))
    )


def _support(kind: str, role: str, baseline: str, inside: Column, value: str) -> Column:
    return F.struct(
        F.lit(kind).alias("support_type"),
        F.lit(role).alias("series_role"),
        F.lit(baseline).alias("baseline"),
        inside.alias("inside"),
        F.col(value).cast("double").alias("p"),
    )


def representative_entities(pred: DataFrame, *, entity: str = "entity_id") -> DataFrame:
    """Low, medium and high volume entity and the entities with the best and worst MAE.

    Medium volume is position n // 2 in volume order; ties go to the smaller id. Everything is an
    aggregate over one row per entity, so no entity list is sorted in one place.
    """
    per = pred.groupBy(entity).agg(
        F.avg(F.col(TARGET).cast("double")).alias("mean_target"),
        M.mae(TARGET, MODEL).alias("mae"),
    )
    n = per.count()
    middle = (n // 2) / (n - 1) if n > 1 else 0.0
    mid = exact_quantiles(per, [], "mean_target", {"mid": middle}).scalar()
    near = per.withColumn("_d", F.abs(F.col("mean_target") - mid))
    pick = lambda c: F.min_by(entity, F.struct(c, F.col(entity)))
    wide = near.agg(
        pick(F.col("mean_target")).alias("low_volume"),
        pick(F.col("_d")).alias("medium_volume"),
        pick(-F.col("mean_target")).alias("high_volume"),
        pick(F.col("mae")).alias("best_cv_mae"),
        pick(-F.col("mae")).alias("worst_cv_mae"),
    )
    return wide.unpivot([], wide.columns, "role", entity)


def series_with_breaks(
    df: DataFrame, keys: Sequence[str], date: str, value: str, *, segment: str
) -> DataFrame:
    """Series points plus a null point before every gap in dates or change of segment."""
    w = Window.partitionBy(*keys).orderBy(date)
    flagged = df.select(
        *keys,
        date,
        segment,
        value,
        F.lag(date).over(w).alias("_pd"),
        F.lag(segment).over(w).alias("_ps"),
    )
    broken = F.col("_pd").isNotNull() & (
        (F.datediff(date, "_pd") != 7) | (F.col(segment) != F.col("_ps"))
    )
    points = flagged.select(*keys, date, segment, value, F.lit(False).alias("is_break"))
    breaks = flagged.filter(broken).select(
        *keys,
        plus_days("_pd", 1).alias(date),
        F.col("_ps").alias(segment),
        F.lit(None).cast(df.schema[value].dataType).alias(value),
        F.lit(True).alias("is_break"),
    )
    return points.unionByName(breaks)


def missingness_masks() -> dict[str, Column]:
    """Overlapping row groups by history, imputation, quality and trainability flags."""
    flag = lambda c, absent: F.coalesce(F.col(c), F.lit(absent))
    return {
        "complete_recent_case_history": ~flag("case_history_missing_flag", True),
        "partial_historical_case_context": flag("case_history_missing_flag", True),
        "rows_requiring_feature_imputation": flag("weather_missing_flag", True),
        "rows_with_quality_warnings": flag("row_quality_flag", "OK") != "OK",
        "not_trainable": ~flag("is_trainable", False),
    }


def final_table(final: DataFrame, development: DataFrame, reference: str = "ridge") -> DataFrame:
    """Final fits with the flags fixed by the development folds; ``reference`` wins ties."""
    summary = development.groupBy("horizon", "feature_set", "family").agg(F.avg("mae").alias("_m"))
    order = F.struct("_m", (F.col("family") != reference).cast("int"), "feature_set")
    best = summary.groupBy("horizon").agg(
        F.min_by(F.struct("feature_set", "family"), order).alias("_b")
    )
    mine = F.struct("feature_set", "family")
    return final.join(best, "horizon").select(
        "fit_id",
        "horizon",
        "feature_set",
        "family",
        F.col("n").alias("evaluation_count"),
        F.col("model_mae").alias("mae_model"),
        F.col("persistence_mae").alias("mae_persistence"),
        (F.col("model_mae") - F.col("persistence_mae")).alias("mae_difference"),
        (mine == F.col("_b")).alias("preselected_champion"),
        ((F.col("feature_set") == "cases_only") & (F.col("family") == reference)).alias(
            "fixed_reference"
        ),
    )
