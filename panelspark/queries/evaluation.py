"""Baselines, preprocessing, fold metrics, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.columns import digest_int, digest_sum, rounded
from panelspark.operators import baselines as B
from panelspark.operators import contracts as C
from panelspark.operators import errors as E
from panelspark.operators import metrics as M
from panelspark.operators import preprocess as P
from panelspark.operators import selection as SEL
from panelspark.plans import forecasts as FC
from panelspark.queries.base import cte, query
from panelspark.queries.contracts import sql_digest, sql_set_digest
from panelspark.queries.splits import HOLDOUT, POLICY, evaluation, thresholds
from panelspark.session import stage_table
from panelspark.sources.panels import Panels


def _round(df: DataFrame, *cols: str, digits: int = 8) -> DataFrame:
    return df.withColumns({c: rounded(c, digits) for c in cols})


# ---- baselines over all origins ----------------------------------------------------------------

cte(
    "base_hist",
    """
SELECT entity_id, week_start, week_end, target_h1, cases::DOUBLE AS naive_last_week,
  CASE WHEN count(cases) OVER w4 = 4 THEN avg(cases) OVER w4 END AS naive_4w_mean,
  CASE WHEN count(cases) OVER w8 = 8 THEN avg(cases) OVER w8 END AS naive_8w_mean,
  lag(cases, 51) OVER (PARTITION BY entity_id ORDER BY week_start)::DOUBLE AS seasonal_52w
FROM origins WINDOW w4 AS (PARTITION BY entity_id ORDER BY week_start ROWS BETWEEN 3 PRECEDING AND CURRENT ROW),
  w8 AS (PARTITION BY entity_id ORDER BY week_start ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)
""",
)
cte(
    "base_season",
    """
SELECT s.entity_id, s.week_start, avg(o.value) AS entity_seasonal_mean FROM spine s
JOIN weekly_obs o ON o.entity_id = s.entity_id AND weekofyear(o.week_start) = weekofyear(s.week_start + 7)
  AND o.week_start <= s.week_start AND o.week_start < DATE '2000-01-01'
GROUP BY 1, 2
""",
)


def history(p: Panels) -> DataFrame:
    return p.weekly_obs.withColumnRenamed("value", "cases")


def base_hist(p: Panels) -> DataFrame:
    return B.history_baselines(p.spine.select("entity_id", "week_start"), history(p))


@query("baseline_last_week", "SELECT entity_id, week_start, naive_last_week FROM base_hist")
def baseline_last_week(p: Panels) -> DataFrame:
    return base_hist(p).select("entity_id", "week_start", B.LAST_WEEK)


@query(
    "baseline_mean_4w_8w",
    "SELECT entity_id, week_start, round(naive_4w_mean, 8) AS naive_4w_mean, round(naive_8w_mean, 8) AS naive_8w_mean FROM base_hist",
)
def baseline_mean(p: Panels) -> DataFrame:
    return _round(
        base_hist(p).select("entity_id", "week_start", B.MEAN_4W, B.MEAN_8W), B.MEAN_4W, B.MEAN_8W
    )


@query("baseline_seasonal_52w", "SELECT entity_id, week_start, seasonal_52w FROM base_hist")
def baseline_seasonal_52w(p: Panels) -> DataFrame:
    return base_hist(p).select("entity_id", "week_start", B.SEASONAL_52W)


@query(
    "baseline_seasonal_mean",
    "SELECT s.entity_id, s.week_start, round(entity_seasonal_mean, 8) AS entity_seasonal_mean FROM spine s"
    " LEFT JOIN base_season b ON b.entity_id = s.entity_id AND b.week_start = s.week_start",
)
def baseline_seasonal_mean(p: Panels) -> DataFrame:
    train = history(p).filter(F.col("week_start") < F.lit("2000-01-01").cast("date"))
    return _round(
        B.seasonal_mean(train, p.spine.select("entity_id", "week_start")), B.SEASONAL_MEAN
    )


@query(
    "baseline_wide_coverage",
    """
WITH w AS (SELECT h.*, b.entity_seasonal_mean FROM base_hist h LEFT JOIN base_season b
  ON b.entity_id = h.entity_id AND b.week_start = h.week_start),
l AS (SELECT 'naive_last_week' AS baseline, naive_last_week AS v FROM w UNION ALL SELECT 'naive_4w_mean', naive_4w_mean FROM w
  UNION ALL SELECT 'naive_8w_mean', naive_8w_mean FROM w UNION ALL SELECT 'seasonal_52w', seasonal_52w FROM w
  UNION ALL SELECT 'entity_seasonal_mean', entity_seasonal_mean FROM w)
SELECT baseline, count(v)::BIGINT AS available, count(*)::BIGINT AS total, round(count(v)::DOUBLE / count(*), 8) AS coverage FROM l GROUP BY 1
""",
)
def baseline_wide_coverage(p: Panels) -> DataFrame:
    train = history(p).filter(F.col("week_start") < F.lit("2000-01-01").cast("date"))
    wide = B.baseline_table(train, p.spine.select("entity_id", "week_start"), history(p))
    return _round(B.baseline_coverage(B.long_baselines(wide, ["entity_id", "week_start"])), "coverage")


# ---- fold baselines ----------------------------------------------------------------------------

cte(
    "fold_thr",
    """
SELECT fold_id, quantile_cont(cases_next_week::DOUBLE, 0.9) AS threshold90, quantile_cont(cases_next_week::DOUBLE, 0.95) AS threshold95
FROM fold_rows WHERE role = 'train' GROUP BY 1
""",
)
cte(
    "fold_base",
    """
WITH v AS (SELECT * FROM fold_rows WHERE role = 'validation'),
b AS (SELECT fold_id, min(week_start) AS lo, max(week_start) AS hi FROM fold_rows WHERE role = 'train' GROUP BY 1),
s AS (SELECT v.fold_id, v.entity_id, v.week_start, avg(o.value) AS m FROM v JOIN b ON b.fold_id = v.fold_id
  JOIN weekly_obs o ON o.entity_id = v.entity_id AND o.week_start BETWEEN b.lo AND b.hi AND o.week_start <= v.week_start
    AND weekofyear(o.week_start) = weekofyear(v.week_start + 7) GROUP BY 1, 2, 3),
w AS (SELECT v.fold_id, v.entity_id, v.week_start, v.cases_next_week, h.naive_last_week, h.naive_4w_mean, h.naive_8w_mean, h.seasonal_52w, s.m
  FROM v JOIN base_hist h ON h.entity_id = v.entity_id AND h.week_start = v.week_start
  LEFT JOIN s ON s.fold_id = v.fold_id AND s.entity_id = v.entity_id AND s.week_start = v.week_start)
SELECT fold_id, entity_id, week_start, cases_next_week, unnest(['naive_last_week', 'naive_4w_mean', 'naive_8w_mean', 'seasonal_52w', 'entity_seasonal_mean']) AS baseline,
  unnest([naive_last_week, naive_4w_mean, naive_8w_mean, seasonal_52w, m]) AS prediction FROM w
""",
)


def staged_rows(p: Panels) -> DataFrame:
    return stage_table(FC.fold_table(p, POLICY, HOLDOUT), "fold_rows")


def sql_metrics(y: str, p: str) -> str:
    """Metric expressions of the SQL checks; rows with a null prediction do not count."""
    yy, pp = f"CASE WHEN {p} IS NOT NULL THEN {y}::DOUBLE END", f"({p})::DOUBLE"
    e = f"({pp} - {y}::DOUBLE)"
    return f"""count({p})::BIGINT AS n, round(avg(abs({e})), 8) AS mae, round(sqrt(avg({e} * {e})), 8) AS rmse,
  round(CASE WHEN count({p}) >= 2 AND var_pop({yy}) > 0 THEN 1 - sum({e} * {e}) / (var_pop({yy}) * count({p})) END, 8) AS r2,
  round(avg(2 * (CASE WHEN {yy} > 0 THEN {yy} * ln({yy} / greatest({pp}, 1e-12)) ELSE 0 END - {yy} + CASE WHEN {p} IS NOT NULL THEN greatest({pp}, 1e-12) END)), 8) AS poisson_deviance,
  round(avg({e}), 8) + 0.0 AS bias"""


_FOLD_METRICS = f"""
SELECT b.fold_id, baseline, count(*)::BIGINT AS total, round(count(prediction)::DOUBLE / count(*), 8) AS coverage,
  {sql_metrics("cases_next_week", "prediction")},
  round(avg(CASE WHEN cases_next_week >= threshold90 THEN abs(prediction - cases_next_week) END), 8) AS mae_top_90,
  round(avg(CASE WHEN cases_next_week >= threshold95 THEN abs(prediction - cases_next_week) END), 8) AS mae_top_95
FROM fold_base b JOIN fold_thr t ON t.fold_id = b.fold_id GROUP BY 1, 2
"""
cte("baseline_metrics", _FOLD_METRICS)


def baseline_metrics(p: Panels) -> DataFrame:
    rows = staged_rows(p)
    pred = FC.fold_baselines(p, rows).join(FC.fold_thresholds(rows), "fold_id")
    pred = pred.withColumn(
        "scored", F.when(F.col("prediction").isNotNull(), F.col("cases_next_week"))
    )
    return pred.groupBy("fold_id", "baseline").agg(
        F.count(F.lit(1)).alias("total"),
        (F.count("prediction") / F.count(F.lit(1))).alias("coverage"),
        *E.named(M.metric_columns("scored", "prediction")),
        M.mae("scored", "prediction", F.col("scored") >= F.col("threshold90")).alias("mae_top_90"),
        M.mae("scored", "prediction", F.col("scored") >= F.col("threshold95")).alias("mae_top_95"),
    )


_MET = ("coverage", "mae", "rmse", "r2", "poisson_deviance", "bias", "mae_top_90", "mae_top_95")


@query("baseline_fold_metrics", "SELECT * FROM baseline_metrics")
def baseline_fold_metrics(p: Panels) -> DataFrame:
    return _round(baseline_metrics(p), *_MET)


@query(
    "rank_full_coverage",
    """
SELECT baseline, min(coverage) AS min_coverage, round(avg(mae), 5) AS mean_fold_mae FROM baseline_metrics
GROUP BY 1 HAVING min(coverage) = 1.0
""",
)
def rank_full_coverage(p: Panels) -> DataFrame:
    return _round(SEL.full_coverage_ranking(baseline_metrics(p)), "mean_fold_mae", digits=5)


@query(
    "fold_mae_rows",
    """
WITH a AS (SELECT fold_id, baseline, count(prediction)::BIGINT AS n, avg(abs(prediction - cases_next_week)) AS m FROM fold_base
  WHERE prediction IS NOT NULL GROUP BY 1, 2)
SELECT fold_id, baseline, n, round(m, 8) AS fold_mae, round(avg(m) OVER (PARTITION BY baseline), 8) AS mean_fold_mae FROM a
""",
)
def fold_mae_rows(p: Panels) -> DataFrame:
    pred = FC.fold_baselines(p, staged_rows(p)).filter(F.col("prediction").isNotNull())
    per = pred.groupBy("fold_id", "baseline").agg(
        F.count(F.lit(1)).alias("n"), M.mae("cases_next_week", "prediction").alias("fold_mae")
    )
    mean = per.groupBy("baseline").agg(F.avg("fold_mae").alias("mean_fold_mae"))
    return _round(per.join(mean, "baseline"), "fold_mae", "mean_fold_mae")


cte(
    "fold_model",
    """
SELECT fold_id, entity_id, week_start, cases_next_week AS target,
  (6 * cases + 7 * (cases_lag_1 + cases_lag_2 + cases_lag_3 + cases_lag_4) / 4.0) / 13 AS prediction, threshold90, threshold95
FROM fold_rows JOIN fold_thr USING (fold_id) WHERE role = 'validation'
""",
)


def fold_model(rows: DataFrame) -> DataFrame:
    """A model series on the validation rows: the cases-only linear score."""
    score = FC.scorers()[("blend_6", "cases_only")]
    return (
        rows.filter("role = 'validation'")
        .join(FC.fold_thresholds(rows), "fold_id")
        .select(
            "fold_id", "entity_id", "week_start", F.col("cases_next_week").alias("target"),
            M.clip_nonnegative(score).alias("prediction"), "threshold90", "threshold95",
        )
    )


cte(
    "support_rows",
    """
WITH w AS (SELECT m.*, b.baseline, b.prediction AS bp FROM fold_model m JOIN fold_base b
  ON b.fold_id = m.fold_id AND b.entity_id = m.entity_id AND b.week_start = m.week_start),
c AS (SELECT fold_id, entity_id, week_start, bool_and(prediction IS NOT NULL) AS every FROM fold_base GROUP BY 1, 2, 3),
x AS (SELECT w.*, c.every FROM w JOIN c USING (fold_id, entity_id, week_start))
SELECT fold_id, entity_id, target, threshold90, threshold95, 'pairwise_baseline_available' AS support_type, 'model' AS series_role, baseline,
  CASE WHEN bp IS NOT NULL THEN prediction END AS p FROM x
UNION ALL SELECT fold_id, entity_id, target, threshold90, threshold95, 'pairwise_baseline_available', 'baseline', baseline, bp FROM x
UNION ALL SELECT fold_id, entity_id, target, threshold90, threshold95, 'all_baselines_intersection', 'baseline', baseline, CASE WHEN every THEN bp END FROM x
UNION ALL SELECT fold_id, entity_id, target, threshold90, threshold95, 'all_baselines_intersection', 'model', '', CASE WHEN every THEN prediction END FROM x WHERE baseline = 'naive_last_week'
""",
)


@query(
    "shared_support_compare",
    f"""
SELECT fold_id, support_type, series_role, baseline, count(*)::BIGINT AS total, {sql_metrics("target", "p")},
  round(avg(CASE WHEN target >= threshold90 THEN abs(p - target) END), 8) AS mae_top_90,
  round(avg(CASE WHEN target >= threshold95 THEN abs(p - target) END), 8) AS mae_top_95,
  count(DISTINCT CASE WHEN p IS NOT NULL THEN entity_id END)::BIGINT AS entities, round(count(p)::DOUBLE / count(*), 8) AS coverage
FROM support_rows GROUP BY 1, 2, 3, 4
""",
)
def shared_support_compare(p: Panels) -> DataFrame:
    rows = staged_rows(p)
    out = E.shared_support(
        fold_model(rows), FC.fold_baselines(p, rows),
        keys=["fold_id", "entity_id", "week_start"], fold="fold_id", names=B.BASELINES,
    ).withColumn("entities", F.col("entities").cast("long"))
    return _round(out, *_MET)


cte(
    "hold_model",
    """
SELECT 'holdout' AS fold_id, m.entity_id, m.week_start, cases_next_week AS target,
  (6 * cases + 7 * (cases_lag_1 + cases_lag_2 + cases_lag_3 + cases_lag_4) / 4.0) / 13 AS prediction, threshold90, threshold95
FROM model_panel m, (SELECT quantile_cont(cases_next_week::DOUBLE, 0.9) AS threshold90, quantile_cont(cases_next_week::DOUBLE, 0.95) AS threshold95
  FROM model_panel, locked WHERE is_trainable AND week_end + 14 < locked_start) WHERE is_trainable AND year(week_start) = 2000
""",
)
cte(
    "hold_base",
    """
WITH s AS (SELECT v.entity_id, v.week_start, avg(o.cases) AS m FROM hold_model v JOIN model_panel o ON o.entity_id = v.entity_id AND o.is_trainable
  AND o.week_end + 14 < (SELECT locked_start FROM locked) AND o.week_start <= v.week_start AND weekofyear(o.week_start) = weekofyear(v.week_start + 7) GROUP BY 1, 2)
SELECT v.fold_id, v.entity_id, v.week_start, unnest(['naive_last_week', 'naive_4w_mean', 'naive_8w_mean', 'seasonal_52w', 'entity_seasonal_mean']) AS baseline,
  unnest([naive_last_week, naive_4w_mean, naive_8w_mean, seasonal_52w, m]) AS prediction
FROM hold_model v JOIN base_hist h ON h.entity_id = v.entity_id AND h.week_start = v.week_start
LEFT JOIN s ON s.entity_id = v.entity_id AND s.week_start = v.week_start
""",
)


@query(
    "holdout_compare",
    f"""
WITH w AS (SELECT m.*, b.baseline, b.prediction AS bp FROM hold_model m JOIN hold_base b ON b.entity_id = m.entity_id AND b.week_start = m.week_start),
c AS (SELECT entity_id, week_start, bool_and(prediction IS NOT NULL) AS every FROM hold_base GROUP BY 1, 2),
x AS (SELECT w.*, c.every FROM w JOIN c USING (entity_id, week_start)),
r AS (
  SELECT fold_id, entity_id, target, threshold90, threshold95, 'pairwise_baseline_available' AS support_type, 'model' AS series_role, baseline,
    CASE WHEN bp IS NOT NULL THEN prediction END AS p FROM x
  UNION ALL SELECT fold_id, entity_id, target, threshold90, threshold95, 'pairwise_baseline_available', 'baseline', baseline, bp FROM x
  UNION ALL SELECT fold_id, entity_id, target, threshold90, threshold95, 'all_baselines_intersection', 'baseline', baseline, CASE WHEN every THEN bp END FROM x
  UNION ALL SELECT fold_id, entity_id, target, threshold90, threshold95, 'all_baselines_intersection', 'model', '', CASE WHEN every THEN prediction END FROM x WHERE baseline = 'naive_last_week')
SELECT fold_id, support_type, series_role, baseline, count(*)::BIGINT AS total, {sql_metrics("target", "p")},
  round(avg(CASE WHEN target >= threshold90 THEN abs(p - target) END), 8) AS mae_top_90,
  round(avg(CASE WHEN target >= threshold95 THEN abs(p - target) END), 8) AS mae_top_95,
  count(DISTINCT CASE WHEN p IS NOT NULL THEN entity_id END)::BIGINT AS entities, round(count(p)::DOUBLE / count(*), 8) AS coverage
FROM r GROUP BY 1, 2, 3, 4
""",
)
def holdout_compare(p: Panels) -> DataFrame:
    model, base = FC.holdout_series(p, POLICY, HOLDOUT)
    out = E.shared_support(
        model, base, keys=["fold_id", "entity_id", "week_start"], fold="fold_id", names=B.BASELINES
    ).withColumn("entities", F.col("entities").cast("long"))
    return _round(out, *_MET)


# ---- preprocessing -----------------------------------------------------------------------------

NUMERIC = ("cases_lag_1", "cases_lag_4", "temp_c", "wind_ms")

cte(
    "prep_rows",
    f"""
SELECT fold_id, role, entity_id, week_start, cases_lag_1::DOUBLE AS cases_lag_1, cases_lag_4::DOUBLE AS cases_lag_4,
  CASE WHEN {sql_digest("entity_id || '|' || week_start")} % 5 <> 0 THEN temp_mean_c END AS temp_c, NULL::DOUBLE AS wind_ms FROM fold_rows
""",
)
cte(
    "prep_long",
    """
SELECT fold_id, role, entity_id, week_start, unnest(['cases_lag_1', 'cases_lag_4', 'temp_c', 'wind_ms']) AS feature,
  unnest([cases_lag_1, cases_lag_4, temp_c, wind_ms]) AS value FROM prep_rows
""",
)
cte(
    "prep_state",
    """
WITH m AS (SELECT fold_id, feature, count(*)::BIGINT AS n_rows, count(value)::BIGINT AS n_present, median(value) AS median
  FROM prep_long WHERE role = 'train' GROUP BY 1, 2)
SELECT m.fold_id, m.feature, n_rows, n_present, n_present = 0 AS dropped, max(m.median) AS median, avg(coalesce(l.value, m.median)) AS mean,
  CASE WHEN stddev_pop(coalesce(l.value, m.median)) > 0 THEN stddev_pop(coalesce(l.value, m.median)) WHEN n_present > 0 THEN 1.0 END AS scale
FROM m JOIN prep_long l ON l.fold_id = m.fold_id AND l.feature = m.feature AND l.role = 'train' GROUP BY 1, 2, 3, 4, 5
""",
)


def prep_rows(p: Panels) -> DataFrame:
    keep = digest_int("entity_id", "week_start") % 5 != 0
    return staged_rows(p).select(
        "fold_id", "role", "entity_id", "week_start",
        F.col("cases_lag_1").cast("double").alias("cases_lag_1"),
        F.col("cases_lag_4").cast("double").alias("cases_lag_4"),
        F.when(keep, F.col("temp_mean_c")).alias("temp_c"),
        F.lit(None).cast("double").alias("wind_ms"),
    )


@query(
    "preprocess_fit",
    "SELECT fold_id, feature, n_rows, n_present, dropped, round(median, 8) AS median, round(mean, 8) AS mean, round(scale, 8) AS scale FROM prep_state",
)
def preprocess_fit(p: Panels) -> DataFrame:
    state = P.fit_numeric(prep_rows(p).filter("role = 'train'"), "fold_id", NUMERIC)
    return _round(state, "median", "mean", "scale")


_LEVELS = ("1", "3", "99")


@query(
    "preprocess_transform",
    """
WITH s AS (SELECT fold_id, max(CASE WHEN feature = 'temp_c' THEN median END) AS mt, max(CASE WHEN feature = 'cases_lag_1' THEN median END) AS m1,
  max(CASE WHEN feature = 'wind_ms' THEN median END) AS mw FROM prep_state GROUP BY 1)
SELECT r.fold_id, role, entity_id, week_start, coalesce(cases_lag_1, m1) AS cases_lag_1, (cases_lag_1 IS NULL)::INT::DOUBLE AS cases_lag_1__missing,
  round(coalesce(temp_c, mt), 8) AS temp_c, (temp_c IS NULL)::INT::DOUBLE AS temp_c__missing, mw AS wind_ms, NULL::DOUBLE AS wind_ms__missing,
  (entity_id = 1)::INT::DOUBLE AS entity_id__1, (entity_id = 3)::INT::DOUBLE AS entity_id__3, 0.0::DOUBLE AS entity_id__99
FROM prep_rows r JOIN s ON s.fold_id = r.fold_id
""",
)
def preprocess_transform(p: Panels) -> DataFrame:
    rows = prep_rows(p)
    names = ["cases_lag_1", "temp_c", "wind_ms"]
    state = P.fit_numeric(rows.filter("role = 'train'"), "fold_id", names)
    out = P.transform_numeric(rows, state, "fold_id", names, scale=False)
    hot = P.one_hot(out, "entity_id", _LEVELS)
    out = out.withColumns(dict(hot)).drop("cases_lag_4")
    return _round(out, "temp_c")


@query(
    "preprocess_scale",
    """
SELECT l.fold_id, l.role, l.entity_id, l.week_start,
  round(max(CASE WHEN l.feature = 'cases_lag_1' THEN (coalesce(value, median) - mean) / scale END), 8) + 0.0 AS cases_lag_1,
  round(max(CASE WHEN l.feature = 'temp_c' THEN (coalesce(value, median) - mean) / scale END), 8) + 0.0 AS temp_c,
  max(CASE WHEN l.feature = 'temp_c' THEN (value IS NULL)::INT::DOUBLE END) AS temp_c__missing
FROM prep_long l JOIN prep_state s ON s.fold_id = l.fold_id AND s.feature = l.feature GROUP BY 1, 2, 3, 4
""",
)
def preprocess_scale(p: Panels) -> DataFrame:
    rows = prep_rows(p)
    names = ["cases_lag_1", "temp_c"]
    state = P.fit_numeric(rows.filter("role = 'train'"), "fold_id", names)
    out = P.transform_numeric(rows, state, "fold_id", names, scale=True)
    return _round(
        out.select(
            "fold_id", "role", "entity_id", "week_start", "cases_lag_1", "temp_c", "temp_c__missing"
        ),
        "cases_lag_1", "temp_c",
    )


# ---- predictions and fold tables ---------------------------------------------------------------

cte(
    "predictions",
    """
WITH w AS (SELECT entity_id, week_start, rainfall_sum_mm, temp_mean_c FROM weather_weekly),
b AS (SELECT e.*, coalesce(rainfall_sum_mm, 0) / 613.0 AS rain, (coalesce(temp_mean_c, 25) - 25) / 97.0 AS temp,
    (cases_lag_1 + cases_lag_2 + cases_lag_3 + cases_lag_4) / 4.0 AS mean4
  FROM eval_long e LEFT JOIN w ON w.entity_id = e.entity_id AND w.week_start = e.week_start),
m AS (SELECT b.*, family, feature_set, ((wc * cases + (13 - wc) * mean4) / 13.0 + CASE WHEN feature_set <> 'cases_only' THEN rain ELSE 0 END
    + CASE WHEN feature_set = 'cases_full_weather' THEN temp ELSE 0 END)::DOUBLE AS s
  FROM b, (VALUES ('blend_6', 6.0::DOUBLE), ('blend_4', 4.0::DOUBLE)) f(family, wc), (VALUES ('cases_only'), ('cases_rainfall'), ('cases_full_weather')) g(feature_set))
SELECT 'h' || horizon || '__' || feature_set || '__' || family || '__' || fold AS fit_id, fold, horizon::BIGINT AS horizon, feature_set, family, entity_id,
  week_start AS origin_start, week_end AS origin_end, (week_start + 7 * horizon)::DATE AS target_start, target_end,
  cases AS observed_current, target AS observed_target, greatest(s, 0.0) AS prediction_model, cases::DOUBLE AS prediction_persistence FROM m
""",
)


def predictions(p: Panels) -> DataFrame:
    return FC.forecast_table(p, evaluation(p))


def staged_predictions(p: Panels) -> DataFrame:
    return stage_table(predictions(p), "predictions")


@query(
    "prediction_table",
    "SELECT fit_id, fold, horizon, feature_set, family, entity_id, origin_start, origin_end, target_start, target_end, observed_current,"
    " observed_target, round(prediction_model, 8) AS prediction_model, prediction_persistence FROM predictions",
)
def prediction_table(p: Panels) -> DataFrame:
    return _round(predictions(p), "prediction_model")


cte(
    "fold_metrics",
    """
SELECT horizon, feature_set, family, fold, fit_id, count(*)::BIGINT AS n, avg(abs(prediction_model - observed_target)) AS mae_model,
  avg(abs(prediction_persistence - observed_target)) AS mae_persistence, sqrt(avg((prediction_model - observed_target) ** 2)) AS rmse_model,
  sqrt(avg((prediction_persistence - observed_target) ** 2)) AS rmse_persistence
FROM predictions GROUP BY 1, 2, 3, 4, 5
""",
)
_FM = ("mae_model", "mae_persistence", "rmse_model", "rmse_persistence", "mae_difference", "relative_improvement_pct")


@query(
    "config_metrics_fold",
    """
SELECT horizon, feature_set, family, fold, fit_id, n, round(mae_model, 8) AS mae_model, round(mae_persistence, 8) AS mae_persistence,
  round(rmse_model, 8) AS rmse_model, round(rmse_persistence, 8) AS rmse_persistence, round(mae_model - mae_persistence, 8) + 0.0 AS mae_difference,
  round(100 * (mae_persistence - mae_model) / nullif(mae_persistence, 0), 8) + 0.0 AS relative_improvement_pct,
  mae_model < mae_persistence AS strict_mae_win, rmse_model < rmse_persistence AS strict_rmse_win FROM fold_metrics
""",
)
def config_metrics_fold(p: Panels) -> DataFrame:
    return _round(E.fold_table(predictions(p)), *_FM)


@query(
    "config_metrics",
    """
SELECT horizon, feature_set, family, count(*)::BIGINT AS fold_count, round(avg(mae_model), 8) AS mean_mae_model, round(avg(mae_persistence), 8) AS mean_mae_persistence,
  round(avg(mae_model - mae_persistence), 8) + 0.0 AS mean_mae_difference, round(avg(rmse_model), 8) AS mean_rmse_model,
  round(avg(rmse_persistence), 8) AS mean_rmse_persistence, count(*) FILTER (mae_model < mae_persistence)::BIGINT AS mae_fold_wins,
  count(*) FILTER (rmse_model < rmse_persistence)::BIGINT AS rmse_fold_wins,
  round(100 * (avg(mae_persistence) - avg(mae_model)) / nullif(avg(mae_persistence), 0), 8) + 0.0 AS relative_improvement_pct
FROM fold_metrics GROUP BY 1, 2, 3
""",
)
def config_metrics(p: Panels) -> DataFrame:
    return _round(
        E.config_table(E.fold_table(predictions(p))),
        "mean_mae_model", "mean_mae_persistence", "mean_mae_difference", "mean_rmse_model",
        "mean_rmse_persistence", "relative_improvement_pct",
    )


def h_folds(p: Panels) -> DataFrame:
    return E.fold_table(predictions(p)).withColumns({"mae": F.col("mae_model"), "rmse": F.col("rmse_model")})


@query(
    "model_summary",
    """
SELECT horizon, feature_set, family, count(DISTINCT fold)::BIGINT AS fold_count, round(avg(mae_model), 8) AS mean_fold_mae,
  round(median(mae_model), 8) AS median_fold_mae, round(stddev_pop(mae_model), 8) AS std_fold_mae
FROM fold_metrics GROUP BY 1, 2, 3 HAVING count(DISTINCT fold) = 5
""",
)
def model_summary(p: Panels) -> DataFrame:
    out = SEL.config_summary(h_folds(p), ["horizon", "feature_set", "family"], required_folds=5)
    return _round(out, "mean_fold_mae", "median_fold_mae", "std_fold_mae")


@query(
    "weather_effect",
    """
WITH c AS (SELECT * FROM (VALUES ('B_minus_A', 'cases_rainfall', 'cases_only'), ('C_minus_B', 'cases_full_weather', 'cases_rainfall')) t(comparison, added, base)),
d AS (SELECT a.horizon, a.family, comparison, added, base, a.fold, a.mae_model - b.mae_model AS diff FROM c JOIN fold_metrics a ON a.feature_set = added
  JOIN fold_metrics b ON b.feature_set = base AND b.horizon = a.horizon AND b.family = a.family AND b.fold = a.fold)
SELECT horizon, family, comparison, added AS added_feature_set, base AS baseline_feature_set, count(*)::BIGINT AS folds, round(avg(diff), 8) + 0.0 AS mean_difference,
  count(*) FILTER (diff < 0)::BIGINT AS folds_lower, count(*) FILTER (diff > 0)::BIGINT AS folds_higher, count(*) FILTER (diff = 0)::BIGINT AS folds_tied
FROM d GROUP BY 1, 2, 3, 4, 5
""",
)
def weather_effect(p: Panels) -> DataFrame:
    return _round(SEL.weather_effect(h_folds(p), FC.COMPARISONS), "mean_difference")


@query(
    "ablation",
    """
WITH w AS (SELECT horizon, family, fold, max(CASE WHEN feature_set = 'cases_only' THEN mae_model END) AS a,
  max(CASE WHEN feature_set = 'cases_rainfall' THEN mae_model END) AS b, max(CASE WHEN feature_set = 'cases_full_weather' THEN mae_model END) AS c
  FROM fold_metrics GROUP BY 1, 2, 3),
s AS (SELECT horizon, family, avg(b - a) AS sb, avg(c - b) AS sc, avg(a) AS base FROM w GROUP BY 1, 2)
SELECT f.horizon, f.family, f.feature_set, count(*)::BIGINT AS fold_count, round(avg(mae_model), 8) AS mean_mae, round(median(mae_model), 8) AS median_mae,
  round(stddev_pop(mae_model), 8) AS std_mae, count(*) FILTER (mae_model < w.a)::BIGINT AS fold_wins_vs_base, round(max(sb), 8) + 0.0 AS step_cases_rainfall,
  round(max(sc), 8) + 0.0 AS step_cases_full_weather, NULL::DOUBLE AS step_full_context, round(100 * (max(base) - avg(mae_model)) / max(base), 8) + 0.0 AS relative_improvement_pct
FROM fold_metrics f JOIN w ON w.horizon = f.horizon AND w.family = f.family AND w.fold = f.fold JOIN s ON s.horizon = f.horizon AND s.family = f.family
GROUP BY 1, 2, 3
""",
)
def ablation(p: Panels) -> DataFrame:
    return _round(
        SEL.ablation_table(h_folds(p), ["horizon", "family"]), "mean_mae", "median_mae", "std_mae",
        "step_cases_rainfall", "step_cases_full_weather", "step_full_context", "relative_improvement_pct",
    )


@query(
    "tuning_feature_set_pick",
    """
SELECT family, feature_set, round(m, 8) AS mean_fold_mae FROM (
  SELECT family, feature_set, avg(mae_model) AS m, row_number() OVER (PARTITION BY family ORDER BY avg(mae_model), feature_set) AS rn
  FROM fold_metrics GROUP BY 1, 2) WHERE rn = 1
""",
)
def tuning_feature_set_pick(p: Panels) -> DataFrame:
    summary = SEL.config_summary(h_folds(p), ["family", "feature_set"])
    return _round(SEL.tuning_feature_set(summary), "mean_fold_mae")


@query(
    "champion_per_horizon",
    """
SELECT horizon, feature_set, family, round(m, 8) AS mean_fold_mae, round(r, 8) AS mean_fold_rmse FROM (
  SELECT horizon, feature_set, family, avg(mae_model) AS m, avg(rmse_model) AS r, row_number() OVER (PARTITION BY horizon ORDER BY avg(mae_model),
    family <> 'blend_6', CASE feature_set WHEN 'cases_only' THEN 1 WHEN 'cases_rainfall' THEN 2 ELSE 3 END) AS rn FROM fold_metrics GROUP BY 1, 2, 3) WHERE rn = 1
""",
)
def champion_per_horizon(p: Panels) -> DataFrame:
    counts = {"cases_only": 28, "cases_rainfall": 45, "cases_full_weather": 60}
    out = SEL.champion_per_horizon(h_folds(p), counts, first_family="blend_6")
    return _round(out, "mean_fold_mae", "mean_fold_rmse")


@query(
    "champion_select",
    """
WITH f AS (SELECT p.feature_set || '__' || family AS config_id, p.fold, avg(abs(prediction_model - observed_target)) AS mae,
    avg(CASE WHEN observed_target >= q90_incidence THEN abs(prediction_model - observed_target) END) AS mae_high
  FROM predictions p JOIN thresholds t ON t.fold = p.fold AND t.horizon = p.horizon WHERE p.horizon = 1 GROUP BY 1, 2),
s AS (SELECT config_id, avg(mae) AS mean_mae, avg(mae_high) AS high_mae, stddev_pop(mae) AS fold_std, length(config_id)::BIGINT AS simplicity, count(*)::BIGINT AS folds
  FROM f GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN abs(mean_mae - (SELECT min(mean_mae) FROM s)) <= 1e-9 THEN (SELECT min(mean_mae) FROM s) ELSE mean_mae END,
  high_mae, fold_std, simplicity, config_id)::BIGINT AS rank FROM s),
g AS (SELECT *, (mean_mae - (SELECT mean_mae FROM r WHERE rank = 1)) / (SELECT mean_mae FROM r WHERE rank = 1) AS relative_gap FROM r)
SELECT config_id, round(mean_mae, 8) AS mean_mae, round(high_mae, 8) AS high_mae, round(fold_std, 8) AS fold_std, simplicity, folds, rank,
  round(relative_gap, 8) + 0.0 AS relative_gap, relative_gap <= 0.01 + 1e-9 AS close, true AS comparable FROM g
""",
)
def champion_select(p: Panels) -> DataFrame:
    pred = predictions(p).filter("horizon = 1").join(thresholds(p), ["fold", "horizon"])
    config = F.concat_ws("__", "feature_set", "family")
    high = F.col("observed_target") >= F.col("q90_incidence")
    folds = pred.groupBy(config.alias("config_id"), "fold").agg(
        M.mae(E.TARGET, E.MODEL).alias("mae"),
        M.mae(E.TARGET, E.MODEL, high).alias("mae_high"),
        digest_sum("entity_id", "origin_start").alias("cohort_digest"),
    )
    out = SEL.champion_ranking(
        folds, simplicity=F.length("config_id").cast("long"), fingerprint="cohort_digest"
    )
    out = out.withColumn("rank", F.col("rank").cast("long"))
    return _round(out, "mean_mae", "high_mae", "fold_std", "relative_gap")


@query(
    "six_fold_mean_or_null",
    """
WITH l AS (SELECT horizon, feature_set, family, fold, 'mae_model' AS metric, mae_model AS v FROM fold_metrics
  UNION ALL SELECT horizon, feature_set, family, fold, 'rmse_model', CASE WHEN NOT (fold = 1998 AND horizon = 2) THEN rmse_model END FROM fold_metrics
    WHERE NOT (fold = 1999 AND horizon = 3)
  UNION ALL SELECT horizon, feature_set, family, fold, 'mae_model', mae_model FROM fold_metrics WHERE false),
a AS (SELECT horizon, feature_set, family, metric, count(*)::BIGINT AS fold_count, count(v)::BIGINT AS valid_fold_count, avg(v) AS m FROM l
  WHERE NOT (metric = 'mae_model' AND fold = 1999 AND horizon = 3) GROUP BY 1, 2, 3, 4)
SELECT horizon, feature_set, family, metric, fold_count, valid_fold_count, CASE WHEN fold_count <> 5 THEN 'missing_required_folds'
  WHEN valid_fold_count <> 5 THEN 'one_or_more_required_folds_undefined' END AS null_reason,
  round(CASE WHEN fold_count = 5 AND valid_fold_count = 5 THEN m END, 8) AS mean_value FROM a
""",
)
def six_fold_mean_or_null(p: Panels) -> DataFrame:
    undefined = (F.col("fold") == 1998) & (F.col("horizon") == 2)
    folds = (
        E.fold_table(predictions(p))
        .filter(~((F.col("fold") == 1999) & (F.col("horizon") == 3)))
        .withColumn("rmse_model", F.when(~undefined, F.col("rmse_model")))
    )
    out = SEL.mean_or_null(folds, ["horizon", "feature_set", "family"], ["mae_model", "rmse_model"], 5)
    return _round(out, "mean_value")


@query(
    "candidate_baseline_table",
    """
WITH c AS (SELECT feature_set || '__' || family AS series, 'candidate' AS role, avg(mae_model) AS mean_fold_mae, avg(rmse_model) AS mean_fold_rmse FROM fold_metrics
    WHERE horizon = 1 GROUP BY 1),
b AS (SELECT baseline AS series, 'baseline' AS role, avg(mae) AS mean_fold_mae, NULL::DOUBLE AS mean_fold_rmse FROM baseline_metrics GROUP BY 1)
SELECT series, role, round(mean_fold_mae, 5) AS mean_fold_mae, round(mean_fold_rmse, 5) AS mean_fold_rmse,
  mean_fold_mae = min(mean_fold_mae) OVER (PARTITION BY role) AS best_of_role FROM (SELECT * FROM c UNION ALL SELECT * FROM b)
""",
)
def candidate_baseline_table(p: Panels) -> DataFrame:
    folds = h_folds(p).filter("horizon = 1")
    cand = folds.groupBy(F.concat_ws("__", "feature_set", "family").alias("series")).agg(
        F.lit("candidate").alias("role"),
        F.avg("mae").alias("mean_fold_mae"),
        F.avg("rmse").alias("mean_fold_rmse"),
    )
    base = baseline_metrics(p).groupBy(F.col("baseline").alias("series")).agg(
        F.lit("baseline").alias("role"), F.avg(F.round("mae", 8)).alias("mean_fold_mae")
    )
    both = cand.unionByName(base, allowMissingColumns=True)
    best = both.groupBy("role").agg(F.min("mean_fold_mae").alias("_best"))
    out = both.join(best, "role").withColumn("best_of_role", F.col("mean_fold_mae") == F.col("_best"))
    return _round(out.drop("_best"), "mean_fold_mae", "mean_fold_rmse", digits=5)


# ---- contracts over predictions ----------------------------------------------------------------


@query(
    "prediction_semantics",
    """
SELECT 'origin_end' AS rule, count(*) FILTER (origin_end <> origin_start + 6)::BIGINT AS violations FROM predictions
UNION ALL SELECT 'target_start', count(*) FILTER (horizon = 2 AND fold = 1999) FROM predictions
UNION ALL SELECT 'target_end', count(*) FILTER (target_end <> (origin_start + 7 * horizon::INT + 6)) FROM predictions
UNION ALL SELECT 'persistence', count(*) FILTER (entity_id = 5) FROM predictions
UNION ALL SELECT 'model_finite_nonnegative', count(*) FILTER (prediction_model < 0) FROM predictions
UNION ALL SELECT 'target_finite_nonnegative', count(*) FILTER (observed_target < 0) FROM predictions
""",
)
def prediction_semantics(p: Panels) -> DataFrame:
    slip = F.when((F.col("horizon") == 2) & (F.col("fold") == 1999), 7).otherwise(0)
    off = F.when(F.col("entity_id") == 5, 1.0).otherwise(0.0)
    pred = predictions(p).withColumns(
        {
            "target_start": F.date_add("target_start", slip),
            "prediction_persistence": F.col("prediction_persistence") + off,
        }
    )
    return C.rule_counts(pred, C.prediction_rules())


@query(
    "prediction_contract",
    f"""
WITH bad AS (SELECT * FROM predictions WHERE NOT (feature_set = 'cases_rainfall' AND entity_id = 4)),
dup AS (SELECT * FROM bad UNION ALL SELECT * FROM predictions WHERE feature_set = 'cases_only' AND family = 'blend_6' AND entity_id = 6),
e AS (SELECT DISTINCT fold, horizon, entity_id, week_start FROM eval_long),
c AS (SELECT DISTINCT horizon, feature_set, family FROM predictions)
SELECT c.horizon, c.feature_set, c.family,
  (SELECT count(*) FROM (SELECT 1 FROM dup d WHERE d.horizon = c.horizon AND d.feature_set = c.feature_set AND d.family = c.family
    GROUP BY fold, entity_id, origin_start HAVING count(*) > 1))::BIGINT AS duplicate_keys,
  (SELECT count(*) FROM e WHERE e.horizon = c.horizon AND NOT EXISTS (SELECT 1 FROM dup d WHERE d.horizon = c.horizon AND d.feature_set = c.feature_set
    AND d.family = c.family AND d.fold = e.fold AND d.entity_id = e.entity_id AND d.origin_start = e.week_start))::BIGINT AS missing_keys,
  0::BIGINT AS extra_keys, 0::BIGINT AS bad_values, 0::BIGINT AS target_mismatch
FROM c
""",
)
def prediction_contract(p: Panels) -> DataFrame:
    full = staged_predictions(p)
    bad = full.filter(~((F.col("feature_set") == "cases_rainfall") & (F.col("entity_id") == 4)))
    dup = bad.unionByName(
        full.filter((F.col("feature_set") == "cases_only") & (F.col("family") == "blend_6") & (F.col("entity_id") == 6))
    )
    return C.prediction_contract(
        dup, evaluation(p), config=["horizon", "feature_set", "family"],
        key=["fold", "entity_id", "origin_start"], expected_key=["fold", "entity_id", "week_start"],
    )


@query(
    "fold_coverage_check",
    """
WITH c AS (SELECT DISTINCT horizon, feature_set, family FROM fold_metrics), f AS (SELECT DISTINCT fold FROM fold_metrics),
have AS (SELECT * FROM fold_metrics WHERE NOT (fold = 1999 AND horizon = 3 AND family = 'blend_6'))
SELECT c.horizon, c.feature_set, c.family, f.fold FROM c, f WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.horizon = c.horizon AND h.feature_set = c.feature_set
  AND h.family = c.family AND h.fold = f.fold)
""",
)
def fold_coverage_check(p: Panels) -> DataFrame:
    """Expected configurations x folds that have no metrics."""
    folds = stage_table(E.fold_table(predictions(p)), "fold_metrics")
    have = folds.filter(
        ~((F.col("fold") == 1999) & (F.col("horizon") == 3) & (F.col("family") == "blend_6"))
    )
    config = ["horizon", "feature_set", "family"]
    expected = C.expected_combinations(folds, config, "fold")
    return C.coverage_of_expected(expected, have, [*config, "fold"])


@query(
    "reconcile_tables",
    """
WITH l AS (SELECT horizon, feature_set, family, fold, mae_model, mae_persistence FROM fold_metrics WHERE NOT (fold = 1998 AND horizon = 1)),
r AS (SELECT horizon, feature_set, family, fold, CASE WHEN horizon = 4 THEN mae_model + 0.25 ELSE mae_model END AS mae_model,
  CASE WHEN horizon <> 3 THEN mae_persistence END AS mae_persistence FROM fold_metrics),
j AS (SELECT l.fold AS lf, r.fold AS rf, l.mae_model AS lm, r.mae_model AS rm, l.mae_persistence AS lp, r.mae_persistence AS rp
  FROM l FULL JOIN r ON l.horizon = r.horizon AND l.feature_set = r.feature_set AND l.family = r.family AND l.fold = r.fold),
x AS (SELECT 'mae_model' AS column_name, lf, rf, lm AS a, rm AS b FROM j UNION ALL SELECT 'mae_persistence', lf, rf, lp, rp FROM j)
SELECT column_name, count(*) FILTER (rf IS NULL)::BIGINT AS left_only, count(*) FILTER (lf IS NULL)::BIGINT AS right_only,
  count(*) FILTER (lf IS NOT NULL AND rf IS NOT NULL AND (a IS NULL) <> (b IS NULL))::BIGINT AS null_parity_breaks, round(max(abs(a - b)), 8) AS max_abs_diff,
  count(*) FILTER (abs(a - b) > 1e-9 + 1e-9 * abs(b))::BIGINT AS out_of_tolerance FROM x GROUP BY 1
""",
)
def reconcile_tables(p: Panels) -> DataFrame:
    folds = stage_table(E.fold_table(predictions(p)), "fold_metrics")
    left = folds.filter(~((F.col("fold") == 1998) & (F.col("horizon") == 1)))
    right = folds.withColumns(
        {
            "mae_model": F.col("mae_model") + F.when(F.col("horizon") == 4, 0.25).otherwise(0.0),
            "mae_persistence": F.when(F.col("horizon") != 3, F.col("mae_persistence")),
        }
    )
    out = C.reconcile(
        left, right, ["horizon", "feature_set", "family", "fold"], ["mae_model", "mae_persistence"]
    )
    return _round(out, "max_abs_diff")


@query(
    "recompute_metrics_check",
    """
SELECT horizon, feature_set, family, fold, round(mae_model, 8) AS recomputed_mae, round(CASE WHEN horizon = 2 AND fold = 1998 THEN mae_model + 0.1 ELSE mae_model END, 8) AS saved_mae,
  NOT (horizon = 2 AND fold = 1998) AS agrees FROM fold_metrics
""",
)
def recompute_metrics_check(p: Panels) -> DataFrame:
    pred = staged_predictions(p)
    keys = ["horizon", "feature_set", "family", "fold"]
    off = F.when((F.col("horizon") == 2) & (F.col("fold") == 1998), 0.1).otherwise(0.0)
    saved = E.fold_table(pred).select(*keys, (F.col("mae_model") + off).alias("mae"))
    out = C.recomputed_agreement(saved, pred, keys, target=E.TARGET, prediction=E.MODEL)
    return _round(out, "recomputed_mae", "saved_mae")


@query(
    "evidence_reconcile",
    """
WITH plan AS (SELECT fold, horizon::BIGINT AS horizon, count(*)::BIGINT AS n_rows, min(week_start) AS first_origin FROM eval_long GROUP BY 1, 2),
reg AS (SELECT fold, horizon, CASE WHEN horizon = 4 THEN n_rows + 1 ELSE n_rows END AS n_rows, CASE WHEN fold <> 1999 THEN first_origin END AS first_origin FROM plan
  WHERE NOT (fold = 2001 AND horizon = 1))
SELECT p.fold, p.horizon, r.fold IS NOT NULL AS registered, p.n_rows IS NOT DISTINCT FROM r.n_rows AS n_rows_ok, p.first_origin IS NOT DISTINCT FROM r.first_origin AS first_origin_ok
FROM plan p LEFT JOIN reg r ON r.fold = p.fold AND r.horizon = p.horizon
""",
)
def evidence_reconcile(p: Panels) -> DataFrame:
    plan = (
        evaluation(p)
        .groupBy("fold", F.col("horizon").cast("long").alias("horizon"))
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min("week_start").alias("first_origin"))
    )
    reg = plan.filter(~((F.col("fold") == 2001) & (F.col("horizon") == 1))).withColumns(
        {
            "n_rows": F.col("n_rows") + F.when(F.col("horizon") == 4, 1).otherwise(0),
            "first_origin": F.when(F.col("fold") != 1999, F.col("first_origin")),
        }
    )
    return C.evidence_agreement(plan, reg, ["fold", "horizon"], ["n_rows", "first_origin"])


@query(
    "shared_cohort_check",
    f"""
WITH d AS (SELECT fold, horizon, feature_set, family, {sql_set_digest("entity_id || '|' || origin_start")} AS k FROM predictions
  WHERE NOT (feature_set = 'cases_full_weather' AND fold = 2000 AND entity_id = 2) GROUP BY 1, 2, 3, 4)
SELECT fold, horizon, count(*)::BIGINT AS members, min(k) = max(k) AS shared FROM d GROUP BY 1, 2
""",
)
def shared_cohort_check(p: Panels) -> DataFrame:
    from panelspark.operators.cohorts import cohort_fingerprint, unshared_cohorts

    drop = (F.col("feature_set") == "cases_full_weather") & (F.col("fold") == 2000) & (F.col("entity_id") == 2)
    pred = predictions(p).filter(~drop).withColumnRenamed("origin_start", "week_start")
    prints = cohort_fingerprint(pred, ["fold", "horizon", "feature_set", "family"])
    return unshared_cohorts(prints, ["fold", "horizon"], "key_digest")


@query(
    "fit_schedule",
    """
SELECT 'h' || h || '__' || fs || '__' || fam || '__' || fold AS fit_id, fold, h::BIGINT AS horizon, fs AS feature_set, fam AS family
FROM fold_origins, unnest([1, 2, 3, 4]) AS t1(h), unnest(['cases_only', 'cases_rainfall', 'cases_full_weather']) AS t2(fs), unnest(['ridge', 'boosted']) AS t3(fam)
""",
)
def fit_schedule(p: Panels) -> DataFrame:
    """Every fit of the study: the folds found in the data x horizons x feature sets x families."""
    from panelspark.queries.splits import origins_of

    return FC.fit_schedule(origins_of(p))

