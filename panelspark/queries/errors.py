"""Error tables, resampling and importance over prediction rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import errors as E
from panelspark.operators import importance as I
from panelspark.operators import metrics as M
from panelspark.operators import resample as R
from panelspark.plans import forecasts as FC
from panelspark.queries.base import cte, query
from panelspark.queries.contracts import sql_digest
from panelspark.queries.evaluation import _round, predictions, sql_metrics, staged_predictions
from panelspark.queries.splits import evaluation, thresholds
from panelspark.session import stage_table
from panelspark.sources.panels import Panels

LIMITS = {"top_10pct": "q90_incidence", "top_5pct": "q95_incidence"}

cte(
    "scored",
    """
SELECT p.*, t.* EXCLUDE (fold, horizon), prediction_model - observed_target AS err, prediction_persistence - observed_target AS perr,
  observed_target::DOUBLE AS y FROM predictions p JOIN thresholds t ON t.fold = p.fold AND t.horizon = p.horizon
""",
)
_GROUP = """count(*)::BIGINT AS n, round(avg(observed_target), 8) AS mean_target, round(avg(abs(prediction_model - observed_target)), 8) AS mae,
  round(sqrt(avg((prediction_model - observed_target) ** 2)), 8) AS rmse, round(avg(prediction_model - observed_target), 8) + 0.0 AS bias,
  round(CASE WHEN avg(observed_target) > 0 THEN avg(abs(prediction_model - observed_target)) / avg(observed_target) END, 8) AS mae_relative_to_mean_target,
  round(median(abs(prediction_model - observed_target)), 8) AS median_absolute_error"""
_GM = ("mean_target", "mae", "rmse", "bias", "mae_relative_to_mean_target", "median_absolute_error")


@query("entity_error", f"SELECT feature_set, family, entity_id, {_GROUP} FROM predictions GROUP BY 1, 2, 3")
def entity_error(p: Panels) -> DataFrame:
    return _round(E.entity_errors(predictions(p), ["feature_set", "family"]), *_GM)


@query(
    "temporal_error",
    f"""
WITH g AS (SELECT *, unnest(['year', 'month', 'quarter', 'week_band']) AS grouping, unnest([year(target_start)::VARCHAR, month(target_start)::VARCHAR,
  quarter(target_start)::VARCHAR, CASE WHEN weekofyear(target_start) <= 13 THEN 'weeks_01_13' WHEN weekofyear(target_start) <= 26 THEN 'weeks_14_26'
  WHEN weekofyear(target_start) <= 39 THEN 'weeks_27_39' ELSE 'weeks_40_53' END]) AS group_value FROM predictions)
SELECT feature_set, family, grouping, group_value, {_GROUP} FROM g GROUP BY 1, 2, 3, 4
""",
)
def temporal_error(p: Panels) -> DataFrame:
    return _round(E.temporal_errors(staged_predictions(p), ["feature_set", "family"]), *_GM)


@query(
    "outbreak_error",
    """
WITH s AS (SELECT *, unnest(['top_10pct', 'top_5pct']) AS subset, unnest([q90_incidence, q95_incidence]) AS limit_value FROM scored)
SELECT feature_set, family, fold, subset, min(limit_value) AS threshold_min, max(limit_value) AS threshold_max, count(*) FILTER (y >= limit_value)::BIGINT AS subset_n,
  round(avg(abs(err)) FILTER (y >= limit_value), 8) AS mae, round(sqrt(avg(err * err) FILTER (y >= limit_value)), 8) AS rmse,
  round(avg(err) FILTER (y >= limit_value), 8) + 0.0 AS bias, round(avg((err < 0)::INT) FILTER (y >= limit_value), 8) AS underprediction_rate
FROM s GROUP BY 1, 2, 3, 4
""",
)
def outbreak_error(p: Panels) -> DataFrame:
    pred = predictions(p).join(thresholds(p), ["fold", "horizon"])
    out = E.outbreak_errors(pred, ["feature_set", "family", "fold"], LIMITS)
    return _round(out, "mae", "rmse", "bias", "underprediction_rate")


@query(
    "largest_errors",
    """
SELECT fit_id, t.entity_id, origin_start, observed_target, round(prediction_model, 8) AS prediction_model, round(absolute_error, 8) AS absolute_error,
  o.cases_lag_1, o.cases_lag_4, round(w.rainfall_sum_mm, 8) AS rainfall_sum_mm
FROM (SELECT *, abs(prediction_model - observed_target) AS absolute_error FROM predictions
      ORDER BY absolute_error DESC, fit_id, entity_id, origin_start LIMIT 50) t
JOIN origins o ON o.entity_id = t.entity_id AND o.week_start = t.origin_start
JOIN weather_weekly w ON w.entity_id = t.entity_id AND w.week_start = t.origin_start
""",
)
def largest_errors(p: Panels) -> DataFrame:
    context = (
        p.origins.select("entity_id", "week_start", "cases_lag_1", "cases_lag_4")
        .join(p.weather_weekly.select("entity_id", "week_start", "rainfall_sum_mm"), ["entity_id", "week_start"])
        .withColumnRenamed("week_start", "origin_start")
    )
    out = E.largest_errors(
        predictions(p), context, ["entity_id", "origin_start"], limit=50,
        ties=["fit_id", "entity_id", "origin_start"],
    )
    out = out.select(
        "fit_id", "entity_id", "origin_start", "observed_target", "prediction_model", "absolute_error",
        "cases_lag_1", "cases_lag_4", "rainfall_sum_mm",
    )
    return _round(out, "prediction_model", "absolute_error", "rainfall_sum_mm")


_MASKS = {
    "complete_recent_case_history": "coalesce(m.case_history_missing_flag, true) = false",
    "partial_historical_case_context": "coalesce(m.case_history_missing_flag, true)",
    "rows_requiring_feature_imputation": "coalesce(m.weather_missing_flag, true)",
    "rows_with_quality_warnings": "coalesce(m.row_quality_flag, 'OK') <> 'OK'",
    "not_trainable": "NOT coalesce(m.is_trainable, false)",
}


@query(
    "missingness_sensitivity",
    " UNION ALL ".join(
        f"""SELECT feature_set, family, '{name}' AS missingness_group, count(CASE WHEN {cond} THEN 1 END)::BIGINT AS n,
  round(avg(CASE WHEN {cond} THEN observed_target END), 8) AS mean_target, round(avg(CASE WHEN {cond} THEN abs(prediction_model - observed_target) END), 8) AS mae,
  round(sqrt(avg(CASE WHEN {cond} THEN (prediction_model - observed_target) ** 2 END)), 8) AS rmse,
  round(avg(CASE WHEN {cond} THEN prediction_model - observed_target END), 8) + 0.0 AS bias
FROM predictions p LEFT JOIN model_panel m ON m.entity_id = p.entity_id AND m.week_start = p.origin_start GROUP BY 1, 2"""
        for name, cond in _MASKS.items()
    ),
)
def missingness_sensitivity(p: Panels) -> DataFrame:
    quality = p.model_panel_plan.select(
        "entity_id", F.col("week_start").alias("origin_start"), "case_history_missing_flag",
        "weather_missing_flag", "row_quality_flag", "is_trainable",
    )
    pred = predictions(p).join(quality, ["entity_id", "origin_start"], "left")
    out = E.missingness_errors(
        pred, ["feature_set", "family"], E.missingness_masks()
    )
    return _round(out, "mean_target", "mae", "rmse", "bias")


@query(
    "entity_improvement",
    """
SELECT horizon, feature_set, family, entity_id, count(*)::BIGINT AS row_count, sum(observed_target)::DOUBLE AS target_total, round(avg(observed_target), 8) AS target_mean,
  round(avg(abs(prediction_model - observed_target)), 8) AS model_mae, round(avg(abs(prediction_persistence - observed_target)), 8) AS persistence_mae,
  round(avg(abs(prediction_persistence - observed_target)) - avg(abs(prediction_model - observed_target)), 8) + 0.0 AS improvement,
  round(100 * (avg(abs(prediction_persistence - observed_target)) - avg(abs(prediction_model - observed_target)))
    / nullif(avg(abs(prediction_persistence - observed_target)), 0), 6) + 0.0 AS improvement_pct,
  CASE WHEN avg(abs(prediction_persistence - observed_target)) = 0 THEN 'zero_persistence_mae_denominator' END AS null_reason,
  round(avg(abs(prediction_model - observed_target)) / nullif(avg(observed_target), 0), 8) AS normalized_mae
FROM predictions GROUP BY 1, 2, 3, 4
""",
)
def entity_improvement(p: Panels) -> DataFrame:
    out = E.entity_improvement(predictions(p), E.FIT)
    out = _round(out, "target_mean", "model_mae", "persistence_mae", "improvement", "normalized_mae")
    return _round(out, "improvement_pct", digits=6)


def _pair(cond: str) -> str:
    return f"""count(*) FILTER ({cond})::BIGINT AS count, round(avg(abs(err)) FILTER ({cond}), 8) AS mae_model, round(avg(abs(perr)) FILTER ({cond}), 8) AS mae_persistence,
  round(avg(err) FILTER ({cond}), 8) + 0.0 AS bias_model, round(avg(perr) FILTER ({cond}), 8) + 0.0 AS bias_persistence,
  CASE WHEN count(*) FILTER ({cond}) = 0 THEN 'empty_subset' END AS null_reason"""


_PAIR = ("mae_model", "mae_persistence", "bias_model", "bias_persistence")


@query(
    "high_incidence_table",
    f"""
WITH s AS (SELECT *, unnest(['q90_primary', 'q95_supplementary']) AS incidence_group, unnest([q90_incidence, q95_incidence]) AS limit_value FROM scored)
SELECT horizon, feature_set, family, fold, fit_id, incidence_group, round(max(limit_value), 8) AS threshold, {_pair("y >= limit_value")} FROM s GROUP BY 1, 2, 3, 4, 5, 6
""",
)
def high_incidence_table(p: Panels) -> DataFrame:
    out = E.high_incidence_errors(
        predictions(p), thresholds(p), {"q90_primary": "q90_incidence", "q95_supplementary": "q95_incidence"}
    )
    return _round(out, "threshold", *_PAIR)


cte(
    "categorized",
    """
SELECT *, CASE WHEN abs(y - observed_current) <= stable_abs_delta_q25 THEN 'stable'
  WHEN y - observed_current > stable_abs_delta_q25 AND y - observed_current >= large_up_q90 THEN 'large_up'
  WHEN y - observed_current > stable_abs_delta_q25 THEN 'directional_up'
  WHEN y - observed_current < -stable_abs_delta_q25 AND observed_current - y >= large_down_abs_q90 THEN 'large_down'
  WHEN y - observed_current < -stable_abs_delta_q25 THEN 'directional_down' ELSE 'uncategorized' END AS category FROM scored
""",
)
_CATS = "'" + "', '".join(E.CHANGE_CATEGORIES) + "'"


@query(
    "change_category_error",
    f"""
WITH c AS (SELECT *, unnest([{_CATS}]) AS cat FROM categorized)
SELECT horizon, feature_set, family, fold, fit_id, cat AS category, {_pair("category = cat")} FROM c GROUP BY 1, 2, 3, 4, 5, 6
""",
)
def change_category_error(p: Panels) -> DataFrame:
    out = E.change_category_errors(E.categorized(predictions(p), thresholds(p)))
    return _round(out, *_PAIR)


@query(
    "change_categories",
    "SELECT fit_id, entity_id, origin_start, category FROM categorized",
)
def change_categories(p: Panels) -> DataFrame:
    return E.categorized(predictions(p), thresholds(p)).select(
        "fit_id", "entity_id", "origin_start", "category"
    )


@query(
    "category_pivot",
    "SELECT horizon, feature_set, family, fold, "
    + ", ".join(f"count(*) FILTER (category = '{c}')::BIGINT AS {c}" for c in E.CHANGE_CATEGORIES)
    + " FROM categorized GROUP BY 1, 2, 3, 4",
)
def category_pivot(p: Panels) -> DataFrame:
    return E.category_pivot(E.categorized(predictions(p), thresholds(p)), ["horizon", "feature_set", "family", "fold"])


def _doc_sql(tag: str, col: str) -> str:
    metrics = sql_metrics("observed_target", col).replace("count(" + col + ")::BIGINT AS n, ", "")
    for name in ("mae", "rmse", "r2", "poisson_deviance", "bias"):
        metrics = metrics.replace(f" AS {name}", f" AS {name}_{tag}")
    e = f"({col} - observed_target)"
    parts = [metrics, f"round(avg(abs{e}) FILTER (y >= q90_incidence), 8) AS mae_top_decile_{tag}"]
    for suffix, lim in LIMITS.items():
        w = f"FILTER (y >= {lim})"
        parts += [
            f"round(avg(abs{e}) {w}, 8) AS mae_{suffix}_{tag}",
            f"round(sqrt(avg({e} * {e}) {w}), 8) AS rmse_{suffix}_{tag}",
            f"round(avg{e} {w}, 8) + 0.0 AS bias_{suffix}_{tag}",
            f"round(avg(({e} < 0)::INT) {w}, 8) AS underprediction_rate_{suffix}_{tag}",
        ]
    return ", ".join(parts)


_DOC_COLS = [
    f"{m}_{t}"
    for t in ("model", "persistence")
    for m in (
        "mae", "rmse", "r2", "poisson_deviance", "bias", "mae_top_decile",
        *[f"{k}_{s}" for s in LIMITS for k in ("mae", "rmse", "bias", "underprediction_rate")],
    )
]


@query(
    "metric_document",
    f"""
SELECT * EXCLUDE (raw_p, raw_m), round(100 * (raw_p - raw_m) / nullif(raw_p, 0), 8) + 0.0 AS relative_improvement_pct,
  CASE WHEN coalesce(raw_p, 0) = 0 THEN 'zero_or_undefined_persistence_mae' END AS relative_improvement_reason,
  raw_m < raw_p AS strict_mae_win, rmse_model < rmse_persistence AS strict_rmse_win FROM (
SELECT horizon, feature_set, family, fold, fit_id, count(*)::BIGINT AS n, avg(abs(perr)) AS raw_p, avg(abs(err)) AS raw_m, count(*) FILTER (y >= q90_incidence)::BIGINT AS top_10_count,
  count(*) FILTER (y >= q95_incidence)::BIGINT AS top_5_count, {_doc_sql("model", "prediction_model")}, {_doc_sql("persistence", "prediction_persistence")}
FROM scored GROUP BY 1, 2, 3, 4, 5)
""",
)
def metric_document(p: Panels) -> DataFrame:
    out = E.metric_document(predictions(p), thresholds(p))
    return _round(out, *_DOC_COLS, "relative_improvement_pct")


@query(
    "high_incidence_metrics",
    """
SELECT fold, horizon, round(avg(abs(perr)) FILTER (y >= q90_incidence), 8) AS mae_top_10pct, round(sqrt(avg(perr * perr) FILTER (y >= q90_incidence)), 8) AS rmse_top_10pct,
  round(avg(perr) FILTER (y >= q90_incidence), 8) + 0.0 AS bias_top_10pct, round(avg((perr < 0)::INT) FILTER (y >= q90_incidence), 8) AS underprediction_rate_top_10pct,
  round(avg(abs(perr)) FILTER (y >= q95_incidence), 8) AS mae_top_5pct, round(sqrt(avg(perr * perr) FILTER (y >= q95_incidence)), 8) AS rmse_top_5pct,
  round(avg(perr) FILTER (y >= q95_incidence), 8) + 0.0 AS bias_top_5pct, round(avg((perr < 0)::INT) FILTER (y >= q95_incidence), 8) AS underprediction_rate_top_5pct
FROM scored WHERE feature_set = 'cases_only' AND family = 'blend_6' GROUP BY 1, 2
""",
)
def high_incidence_metrics(p: Panels) -> DataFrame:
    rows = evaluation(p).withColumn("horizon", F.col("horizon")).join(thresholds(p), ["fold", "horizon"])
    cols = M.high_incidence_columns("target", "cases", LIMITS)
    out = rows.groupBy("fold", F.col("horizon").cast("long").alias("horizon")).agg(*E.named(cols))
    return _round(out, *cols)


@query(
    "metric_bundle",
    f"SELECT horizon, feature_set, family, fold, {sql_metrics('observed_target', 'prediction_model')} FROM predictions GROUP BY 1, 2, 3, 4",
)
def metric_bundle(p: Panels) -> DataFrame:
    cols = M.metric_columns(E.TARGET, E.MODEL)
    out = predictions(p).groupBy(*E.FIT, "fold").agg(*E.named(cols))
    return _round(out, "mae", "rmse", "r2", "poisson_deviance", "bias")


@query(
    "representative_entities",
    """
WITH e AS (SELECT entity_id, avg(observed_target) AS mt, avg(abs(prediction_model - observed_target)) AS mae FROM predictions GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY mt, entity_id) AS rn, count(*) OVER () AS n FROM e),
mid AS (SELECT mt FROM o WHERE rn = n // 2 + 1)
SELECT 'low_volume' AS role, (SELECT entity_id FROM e ORDER BY mt, entity_id LIMIT 1) AS entity_id
UNION ALL SELECT 'medium_volume', (SELECT min(entity_id) FROM e, mid WHERE e.mt = mid.mt)
UNION ALL SELECT 'high_volume', (SELECT entity_id FROM e ORDER BY mt DESC, entity_id LIMIT 1)
UNION ALL SELECT 'best_cv_mae', (SELECT entity_id FROM e ORDER BY mae, entity_id LIMIT 1)
UNION ALL SELECT 'worst_cv_mae', (SELECT entity_id FROM e ORDER BY mae DESC, entity_id LIMIT 1)
""",
)
def representative_entities(p: Panels) -> DataFrame:
    return E.representative_entities(staged_predictions(p))


@query(
    "series_gap_breaks",
    """
WITH s AS (SELECT entity_id, week_start, year(week_start)::BIGINT AS year, value FROM weekly_obs),
l AS (SELECT *, lag(week_start) OVER w AS pd, lag(year) OVER w AS py FROM s WINDOW w AS (PARTITION BY entity_id ORDER BY week_start))
SELECT entity_id, week_start, year, value, false AS is_break FROM s
UNION ALL SELECT entity_id, (pd + 1)::DATE, py, NULL, true FROM l WHERE pd IS NOT NULL AND (week_start - pd <> 7 OR py <> year)
""",
)
def series_gap_breaks(p: Panels) -> DataFrame:
    obs = p.weekly_obs.withColumn("year", F.year("week_start").cast("long"))
    return E.series_with_breaks(obs, ["entity_id"], "week_start", "value", segment="year")


# ---- resampling --------------------------------------------------------------------------------

cte(
    "boot_weeks",
    """
WITH w AS (SELECT DISTINCT fold, origin_start FROM predictions),
g AS (SELECT *, CASE WHEN origin_start - lag(origin_start) OVER (PARTITION BY fold ORDER BY origin_start) = 7 THEN 0 ELSE 1 END AS starts FROM w),
r AS (SELECT fold, origin_start, sum(starts) OVER (PARTITION BY fold ORDER BY origin_start)::BIGINT AS run_id FROM g)
SELECT *, row_number() OVER (PARTITION BY fold, run_id ORDER BY origin_start) - 1 AS pos, count(*) OVER (PARTITION BY fold, run_id) AS run_length FROM r
""",
)
cte(
    "boot_draws",
    f"""
WITH runs AS (SELECT fold, run_id, max(run_length) AS n FROM boot_weeks GROUP BY 1, 2 HAVING max(run_length) >= 4),
slots AS (SELECT *, {sql_digest("'42|' || fold || '|' || run_id || '|' || rep || '|' || slot")} % (n - 3) AS start FROM (
  SELECT r.*, t.rep, s.slot FROM runs r, unnest(generate_series(0, 999)) AS t(rep), unnest(generate_series(0, ((n + 3) // 4) - 1)) AS s(slot))),
d AS (SELECT fold, run_id, rep, start + j AS pos FROM slots, unnest([0, 1, 2, 3]) AS u(j) WHERE slot * 4 + j < n)
SELECT d.fold, w.origin_start, d.rep, count(*)::DOUBLE AS times FROM d JOIN boot_weeks w ON w.fold = d.fold AND w.run_id = d.run_id AND w.pos = d.pos GROUP BY 1, 2, 3
""",
)
cte(
    "boot_weekly",
    """
SELECT horizon, feature_set, family, fold, origin_start, count(*)::DOUBLE AS n, sum(abs(prediction_model - observed_target)) AS model,
  sum(abs(prediction_persistence - observed_target)) AS persistence FROM predictions GROUP BY 1, 2, 3, 4, 5
""",
)
cte(
    "boot_reason",
    """
SELECT min(CASE WHEN run_length < 4 THEN 'one_or_more_required_contiguous_runs_has_fewer_than_4_origin_weeks' END) AS insufficient_reason FROM boot_weeks
""",
)


@query(
    "run_support",
    """
WITH r AS (SELECT fold, run_id, count(*) AS n FROM boot_weeks WHERE NOT (fold = 1999 AND origin_start BETWEEN DATE '1999-03-01' AND DATE '1999-04-20')
  GROUP BY 1, 2),
w AS (SELECT DISTINCT fold, origin_start FROM predictions WHERE NOT (fold = 1999 AND origin_start BETWEEN DATE '1999-01-15' AND DATE '1999-04-20')),
g AS (SELECT *, CASE WHEN origin_start - lag(origin_start) OVER (PARTITION BY fold ORDER BY origin_start) = 7 THEN 0 ELSE 1 END AS starts FROM w),
x AS (SELECT fold, origin_start, sum(starts) OVER (PARTITION BY fold ORDER BY origin_start) AS run_id FROM g),
k AS (SELECT fold, run_id, count(*) AS n, greatest(count(*) - 3, 0) AS b FROM x GROUP BY 1, 2)
SELECT fold, sum(n)::BIGINT AS origin_weeks, count(*)::BIGINT AS n_runs, string_agg(n::VARCHAR, ',' ORDER BY run_id) AS run_lengths,
  string_agg(b::VARCHAR, ',' ORDER BY run_id) AS run_block_counts, min(n)::BIGINT AS min_run_weeks, min(b)::BIGINT AS min_run_blocks,
  CASE WHEN min(n) < 4 THEN 'one_or_more_required_contiguous_runs_has_fewer_than_4_origin_weeks' END AS insufficient_reason
FROM k GROUP BY 1
""",
)
def run_support(p: Panels) -> DataFrame:
    hole = (F.col("fold") == 1999) & F.col("origin_start").between(
        F.lit("1999-01-15").cast("date"), F.lit("1999-04-20").cast("date")
    )
    weeks = evaluation(p).withColumnRenamed("week_start", "origin_start").filter(~hole)
    out = R.support(R.week_positions(weeks, ["fold"]), ["fold"])
    return out.withColumns(
        {c: F.col(c).cast("long") for c in ("origin_weeks", "min_run_weeks", "min_run_blocks")}
    )


_CI = ("point_estimate", "ci_low", "ci_high")


@query(
    "block_bootstrap_model",
    """
WITH f AS (SELECT horizon, feature_set, family, b.fold, rep, (sum(model * times) - sum(persistence * times)) / sum(n * times) AS stat
  FROM boot_weekly b JOIN boot_draws d ON d.fold = b.fold AND d.origin_start = b.origin_start GROUP BY 1, 2, 3, 4, 5),
r AS (SELECT horizon, feature_set, family, rep, avg(stat) AS stat FROM f GROUP BY 1, 2, 3, 4),
i AS (SELECT horizon, feature_set, family, count(*)::BIGINT AS reps, quantile_cont(stat, 0.025) AS ci_low, quantile_cont(stat, 0.975) AS ci_high FROM r GROUP BY 1, 2, 3),
p AS (SELECT horizon, feature_set, family, avg(s) AS point_estimate FROM (SELECT horizon, feature_set, family, fold, (sum(model) - sum(persistence)) / sum(n) AS s
  FROM boot_weekly GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)
SELECT p.horizon, p.feature_set, p.family, round(point_estimate, 8) + 0.0 AS point_estimate, reps, round(CASE WHEN insufficient_reason IS NULL THEN ci_low END, 8) + 0.0 AS ci_low,
  round(CASE WHEN insufficient_reason IS NULL THEN ci_high END, 8) + 0.0 AS ci_high, insufficient_reason
FROM p JOIN i ON i.horizon = p.horizon AND i.feature_set = p.feature_set AND i.family = p.family, boot_reason
""",
)
def block_bootstrap_model(p: Panels) -> DataFrame:
    weekly = stage_table(R.weekly_error_sums(predictions(p), list(E.FIT)), "weekly_errors")
    return _round(R.model_vs_persistence(weekly, list(E.FIT)), *_CI)


@query(
    "block_bootstrap_weather",
    """
WITH c AS (SELECT * FROM (VALUES ('B_minus_A', 'cases_rainfall', 'cases_only'), ('C_minus_B', 'cases_full_weather', 'cases_rainfall')) t(comparison, added_set, base_set)),
w AS (SELECT a.horizon, a.family, comparison, a.fold, a.origin_start, a.model AS added, a.n AS added_n, b.model AS base, b.n AS base_n FROM c
  JOIN boot_weekly a ON a.feature_set = added_set JOIN boot_weekly b ON b.feature_set = base_set AND b.horizon = a.horizon AND b.family = a.family
    AND b.fold = a.fold AND b.origin_start = a.origin_start),
f AS (SELECT horizon, family, comparison, w.fold, rep, sum(added * times) / sum(added_n * times) - sum(base * times) / sum(base_n * times) AS stat
  FROM w JOIN boot_draws d ON d.fold = w.fold AND d.origin_start = w.origin_start GROUP BY 1, 2, 3, 4, 5),
r AS (SELECT horizon, family, comparison, rep, avg(stat) AS stat FROM f GROUP BY 1, 2, 3, 4),
i AS (SELECT horizon, family, comparison, count(*)::BIGINT AS reps, quantile_cont(stat, 0.025) AS ci_low, quantile_cont(stat, 0.975) AS ci_high FROM r GROUP BY 1, 2, 3),
p AS (SELECT horizon, family, comparison, avg(s) AS point_estimate FROM (SELECT horizon, family, comparison, fold, sum(added) / sum(added_n) - sum(base) / sum(base_n) AS s
  FROM w GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)
SELECT p.horizon, p.family, p.comparison, round(point_estimate, 8) + 0.0 AS point_estimate, reps, round(CASE WHEN insufficient_reason IS NULL THEN ci_low END, 8) + 0.0 AS ci_low,
  round(CASE WHEN insufficient_reason IS NULL THEN ci_high END, 8) + 0.0 AS ci_high, insufficient_reason
FROM p JOIN i ON i.horizon = p.horizon AND i.family = p.family AND i.comparison = p.comparison, boot_reason
""",
)
def block_bootstrap_weather(p: Panels) -> DataFrame:
    weekly = stage_table(R.weekly_error_sums(predictions(p), list(E.FIT)), "weekly_errors")
    return _round(R.added_vs_base(weekly, FC.COMPARISONS), *_CI)


@query(
    "block_bootstrap_weekly",
    f"""
WITH b AS (SELECT horizon, feature_set, family, origin_start, sum(model - persistence) / sum(n) AS diff FROM boot_weekly GROUP BY 1, 2, 3, 4),
w AS (SELECT DISTINCT origin_start FROM b),
g AS (SELECT *, CASE WHEN origin_start - lag(origin_start) OVER (ORDER BY origin_start) = 7 THEN 0 ELSE 1 END AS starts FROM w),
x AS (SELECT origin_start, sum(starts) OVER (ORDER BY origin_start)::BIGINT AS run_id FROM g),
ps AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY origin_start) - 1 AS pos, count(*) OVER (PARTITION BY run_id) AS n FROM x),
runs AS (SELECT run_id, max(n) AS n FROM ps GROUP BY 1 HAVING max(n) >= 4),
slots AS (SELECT *, {sql_digest("'42|0|' || run_id || '|' || rep || '|' || slot")} % (n - 3) AS start FROM (
  SELECT r.*, t.rep, s.slot FROM runs r, unnest(generate_series(0, 999)) AS t(rep), unnest(generate_series(0, ((n + 3) // 4) - 1)) AS s(slot))),
d AS (SELECT rep, origin_start FROM (SELECT run_id, rep, start + j AS pos FROM slots, unnest([0, 1, 2, 3]) AS u(j) WHERE slot * 4 + j < n) z JOIN ps USING (run_id, pos)),
r AS (SELECT horizon, feature_set, family, rep, avg(diff) AS stat FROM b JOIN d USING (origin_start) GROUP BY 1, 2, 3, 4),
i AS (SELECT horizon, feature_set, family, count(*)::BIGINT AS reps, quantile_cont(stat, 0.025) AS ci_low, quantile_cont(stat, 0.975) AS ci_high FROM r GROUP BY 1, 2, 3),
p AS (SELECT horizon, feature_set, family, avg(diff) AS point_estimate FROM b GROUP BY 1, 2, 3),
y AS (SELECT min(CASE WHEN n < 4 THEN 'one_or_more_required_contiguous_runs_has_fewer_than_4_origin_weeks' END) AS insufficient_reason FROM ps)
SELECT p.horizon, p.feature_set, p.family, round(point_estimate, 8) + 0.0 AS point_estimate, reps, round(CASE WHEN insufficient_reason IS NULL THEN ci_low END, 8) + 0.0 AS ci_low,
  round(CASE WHEN insufficient_reason IS NULL THEN ci_high END, 8) + 0.0 AS ci_high, insufficient_reason
FROM p JOIN i ON i.horizon = p.horizon AND i.feature_set = p.feature_set AND i.family = p.family, y
""",
)
def block_bootstrap_weekly(p: Panels) -> DataFrame:
    weekly = stage_table(R.weekly_error_sums(predictions(p), list(E.FIT)), "weekly_errors")
    return _round(R.weekly_cluster_interval(weekly, list(E.FIT)), *_CI)


# ---- importance --------------------------------------------------------------------------------

SAMPLE_ROWS = 200
PERM_FEATURES = ("cases", "cases_lag_1", "cases_lag_2", "cases_lag_3", "cases_lag_4")
cte(
    "sample_rows",
    f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY {sql_digest("'42|' || entity_id || '|' || week_start")}, entity_id, week_start) AS rn
  FROM eval_long) WHERE rn <= {SAMPLE_ROWS}
""",
)


def sample_rows(p: Panels) -> DataFrame:
    return I.seeded_sample(
        evaluation(p), ["horizon"], ["entity_id", "week_start"], rows=SAMPLE_ROWS, seed=42
    )


@query(
    "seeded_sample",
    "SELECT horizon::BIGINT AS horizon, fold, entity_id, week_start, cases, target FROM sample_rows",
)
def seeded_sample(p: Panels) -> DataFrame:
    return sample_rows(p).select(
        F.col("horizon").cast("long").alias("horizon"), "fold", "entity_id", "week_start", "cases", "target"
    )


_PERM_SQL = f"""
WITH s AS (SELECT * FROM sample_rows),
c AS (SELECT s.*, unnest(['cases', 'cases_lag_1', 'cases_lag_2', 'cases_lag_3', 'cases_lag_4']) AS feature,
    unnest([cases, cases_lag_1, cases_lag_2, cases_lag_3, cases_lag_4])::DOUBLE AS own FROM s),
r AS (SELECT c.*, rep FROM c, unnest([0, 1, 2]) AS t(rep)),
k AS (SELECT *, row_number() OVER (PARTITION BY horizon, feature, rep ORDER BY entity_id, week_start) AS pos,
  row_number() OVER (PARTITION BY horizon, feature, rep ORDER BY {sql_digest("'7|' || feature || '|' || rep || '|' || entity_id || '|' || week_start")}, entity_id, week_start) AS dpos FROM r),
j AS (SELECT a.*, b.own AS given FROM k a JOIN k b ON a.horizon = b.horizon AND a.feature = b.feature AND a.rep = b.rep AND a.pos = b.dpos),
sc AS (SELECT horizon, feature, rep, target, greatest((6 * cases + 7 * (cases_lag_1 + cases_lag_2 + cases_lag_3 + cases_lag_4) / 4.0) / 13.0, 0) AS bp,
  greatest((6 * cases + 7 * (cases_lag_1 + cases_lag_2 + cases_lag_3 + cases_lag_4) / 4.0) / 13.0
    + (given - own) * CASE WHEN feature = 'cases' THEN 6 / 13.0::DOUBLE ELSE 7 / 52.0::DOUBLE END, 0) AS pp FROM j)
SELECT horizon::BIGINT AS horizon, feature, rep::INT AS repeat, avg(abs(bp - target)) AS baseline_mae, avg(abs(pp - target)) AS permuted_mae FROM sc GROUP BY 1, 2, 3
"""
cte("permuted", _PERM_SQL)


def permuted(p: Panels) -> DataFrame:
    def scorer(x):
        lags = x["cases_lag_1"] + x["cases_lag_2"] + x["cases_lag_3"] + x["cases_lag_4"]
        return (x["cases"] * 6.0 + lags / 4.0 * 7.0) / 13.0

    sample = sample_rows(p).withColumn("horizon", F.col("horizon").cast("long"))
    return I.permutation_importance(
        sample, PERM_FEATURES, scorer, key=["entity_id", "week_start"], target="target", repeats=3, seed=7, by=["horizon"]
    )


@query(
    "permutation_importance",
    "SELECT horizon, feature, repeat::BIGINT AS repeat, round(baseline_mae, 8) AS baseline_mae, round(permuted_mae, 8) AS permuted_mae,"
    " round(permuted_mae - baseline_mae, 8) + 0.0 AS mae_increase FROM permuted",
)
def permutation_importance(p: Panels) -> DataFrame:
    out = permuted(p).withColumn("repeat", F.col("repeat").cast("long"))
    return _round(out, "baseline_mae", "permuted_mae", "mae_increase")


@query(
    "top_importance",
    """
SELECT horizon, feature, round(m, 8) + 0.0 AS mean_increase, repeats, rank FROM (
  SELECT horizon, feature, avg(permuted_mae - baseline_mae) AS m, count(*)::BIGINT AS repeats,
    row_number() OVER (PARTITION BY horizon ORDER BY avg(permuted_mae - baseline_mae) DESC, feature)::BIGINT AS rank FROM permuted GROUP BY 1, 2) WHERE rank <= 3
""",
)
def top_importance(p: Panels) -> DataFrame:
    means = I.importance_means(permuted(p), ["horizon"])
    top = I.top_features(means, ["horizon"], value="mean_increase", name="feature", n=3)
    return _round(
        top.select("horizon", "feature", "mean_increase", "repeats", F.col("rank").cast("long").alias("rank")),
        "mean_increase",
    )


