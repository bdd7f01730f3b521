"""Spines, lags, rolling windows, trends, targets and row quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.columns import count_where, rounded
from panelspark.operators import calendar, features
from panelspark.operators.metrics import metric_columns
from panelspark.queries.base import query
from panelspark.sources.panels import Panels


def _r(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: rounded(c) for c in cols})


def _long(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


@query("week_spine", "SELECT entity_id, week_start, week_end FROM spine")
def week_spine(p: Panels) -> DataFrame:
    return p.spine


@query(
    "off_anchor_weeks",
    """
SELECT s.entity_id, s.start_day AS week_start, s.value FROM offset_obs s
WHERE ((s.start_day - (SELECT min(week_start) FROM weekly_obs)) % 7) <> 0
""",
)
def off_anchor_weeks(p: Panels) -> DataFrame:
    moved = p.offset_obs.select("entity_id", F.col("start").alias("week_start"), "value")
    return calendar.off_grid(moved, p.weekly_obs)


@query(
    "master_join",
    """
SELECT entity_id, week_start, week_end, entity_name, group_name, population_reference,
       round(area_km2, 4) AS area_km2, cases, round(rainfall_sum_mm, 6) AS rainfall_sum_mm,
       round(temp_mean_c, 6) AS temp_mean_c, weather_quality_flag
FROM master_panel
""",
)
def master_join(p: Panels) -> DataFrame:
    m = p.master.select(
        "entity_id", "week_start", "week_end", "entity_name", "group_name",
        "population_reference", rounded("area_km2", 4).alias("area_km2"), "cases",
        "rainfall_sum_mm", "temp_mean_c", "weather_quality_flag",
    )
    return _r(m, "rainfall_sum_mm", "temp_mean_c")


@query(
    "gap_fill_rows",
    """
SELECT s.entity_id, s.week_start, o.cases, coalesce(o.case_status, 'missing') AS case_status,
       coalesce(o.source_document, 'generated calendar row') AS source_document
FROM spine s LEFT JOIN labelled_obs o ON o.entity_id = s.entity_id AND o.week_start = s.week_start
""",
)
def gap_fill_rows(p: Panels) -> DataFrame:
    joined = p.spine.select("entity_id", "week_start").join(
        p.labelled_obs.drop("week_end", "year", "week"), ["entity_id", "week_start"], "left"
    )
    return calendar.fill_gap_rows(joined).select(
        "entity_id", "week_start", "cases", "case_status", "source_document"
    )


@query(
    "lag_features",
    """
SELECT entity_id, week_start, cases,
  lag(cases, 1) OVER e AS cases_lag_1, lag(cases, 2) OVER e AS cases_lag_2,
  lag(cases, 3) OVER e AS cases_lag_3, lag(cases, 4) OVER e AS cases_lag_4,
  lag(cases, 6) OVER e AS cases_lag_6, lag(cases, 8) OVER e AS cases_lag_8,
  lag(rainfall_sum_mm, 1) OVER e AS rainfall_lag_1, lag(rainfall_sum_mm, 2) OVER e AS rainfall_lag_2,
  lag(rainfall_sum_mm, 3) OVER e AS rainfall_lag_3, lag(rainfall_sum_mm, 4) OVER e AS rainfall_lag_4,
  lag(rainfall_sum_mm, 6) OVER e AS rainfall_lag_6, lag(rainfall_sum_mm, 8) OVER e AS rainfall_lag_8,
  round(lag(temp_mean_c, 1) OVER e, 6) AS temp_mean_lag_1,
  round(lag(temp_mean_c, 2) OVER e, 6) AS temp_mean_lag_2,
  round(lag(temp_mean_c, 4) OVER e, 6) AS temp_mean_lag_4,
  round(lag(humidity_mean_pct, 1) OVER e, 6) AS humidity_lag_1,
  round(lag(humidity_mean_pct, 2) OVER e, 6) AS humidity_lag_2,
  round(lag(humidity_mean_pct, 4) OVER e, 6) AS humidity_lag_4
FROM master_panel WINDOW e AS (PARTITION BY entity_id ORDER BY week_start)
""",
)
def lag_features(p: Panels) -> DataFrame:
    lags = features.lag_columns()
    out = p.master.withColumns(lags).select("entity_id", "week_start", "cases", *lags)
    return _r(out, *[c for c in lags if c.startswith(("temp", "humidity"))])


@query(
    "exact_date_lag",
    """
SELECT o.entity_id, o.week_start, o.value, a.value AS cases_lag_1, b.value AS cases_lag_4,
       c.value AS cases_lag_52
FROM weekly_obs o
LEFT JOIN weekly_obs a ON a.entity_id = o.entity_id AND a.week_start = o.week_start - 7
LEFT JOIN weekly_obs b ON b.entity_id = o.entity_id AND b.week_start = o.week_start - 28
LEFT JOIN weekly_obs c ON c.entity_id = o.entity_id AND c.week_start = o.week_start - 364
""",
)
def exact_date_lag(p: Panels) -> DataFrame:
    return features.exact_date_shift(
        p.weekly_obs, "value", {"cases_lag_1": 1, "cases_lag_4": 4, "cases_lag_52": 52}
    )


def _rolling_sql() -> str:
    fn = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "sum": "sum"}
    cols = []
    for r in features.ROLLING:
        for n in r.weeks:
            frame = (
                f"OVER (PARTITION BY entity_id ORDER BY week_start "
                f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
            )
            cols.append(
                f"round(CASE WHEN count({r.source}) {frame} = {n} "
                f"THEN {fn[r.stat]}({r.source}) {frame} END::DOUBLE, 6) AS {r.prefix}_{r.stat}_{n}"
            )
    return f"SELECT entity_id, week_start, {', '.join(cols)} FROM master_panel"


@query("rolling_features", _rolling_sql())
def rolling_features(p: Panels) -> DataFrame:
    roll = features.rolling_columns()
    out = p.master.withColumns(roll).select("entity_id", "week_start", *roll)
    return _r(out, *roll)


@query(
    "trend_features",
    """
SELECT entity_id, week_start, (value - l1)::BIGINT AS cases_change_1w,
  (value - l2)::BIGINT AS cases_change_2w,
  round((value - l1)::DOUBLE / nullif(l1, 0), 6) AS cases_pct_change_1w,
  round((value - l4)::DOUBLE / nullif(l4, 0), 6) AS cases_pct_change_4w,
  round(ln(1 + value), 6) AS log1p_cases
FROM (SELECT *, lag(value, 1) OVER e AS l1, lag(value, 2) OVER e AS l2, lag(value, 4) OVER e AS l4
      FROM obs_panel WINDOW e AS (PARTITION BY entity_id ORDER BY week_start))
""",
)
def trend_features(p: Panels) -> DataFrame:
    t = features.trend_columns("cases")
    out = p.obs_panel.withColumnRenamed("value", "cases").withColumns(t)
    return _r(
        out.select("entity_id", "week_start", *t),
        "cases_pct_change_1w", "cases_pct_change_4w", "log1p_cases",
    )


@query(
    "rolling_slope",
    """
SELECT a.entity_id, a.week_start,
  round(CASE WHEN count(b.value) = 4
    THEN regr_slope(b.value, (b.week_start - a.week_start) / 7.0) END, 6) + 0.0 AS cases_slope_4w
FROM spine a LEFT JOIN weekly_obs b
  ON b.entity_id = a.entity_id AND b.week_start BETWEEN a.week_start - 21 AND a.week_start
GROUP BY 1, 2
""",
)
def rolling_slope(p: Panels) -> DataFrame:
    out = p.obs_panel.select(
        "entity_id", "week_start", features.slope_column("value").alias("cases_slope_4w")
    )
    return _r(out, "cases_slope_4w")


@query(
    "seasonality_features",
    """
SELECT s.entity_id, s.week_start, month(s.week_start)::BIGINT AS month,
  quarter(s.week_start)::BIGINT AS quarter, o.week AS week_of_year,
  round(sin(2 * pi() * o.week / 52.1775), 6) AS week_sin,
  round(cos(2 * pi() * o.week / 52.1775), 6) AS week_cos,
  round(sin(2 * pi() * month(s.week_start) / 12), 6) + 0.0 AS month_sin,
  round(cos(2 * pi() * month(s.week_start) / 12), 6) + 0.0 AS month_cos
FROM spine s LEFT JOIN labelled_obs o ON o.entity_id = s.entity_id AND o.week_start = s.week_start
""",
)
def seasonality_features(p: Panels) -> DataFrame:
    joined = p.spine.join(
        p.labelled_obs.select("entity_id", "week_start", "week"), ["entity_id", "week_start"], "left"
    )
    s = features.seasonality_columns(label="week")
    out = joined.withColumns(s).select("entity_id", "week_start", *s)
    return _r(_long(out, "month", "quarter"), "week_sin", "week_cos", "month_sin", "month_cos")


@query(
    "future_targets",
    """
SELECT entity_id, week_start, lead(cases, 1) OVER e AS cases_next_week,
  lead(cases, 2) OVER e AS cases_next_2w, lead(cases, 4) OVER e AS cases_next_4w,
  round(100000.0 * lead(cases, 1) OVER e / nullif(population_reference, 0), 6)
    AS incidence_next_week_per_100k
FROM master_panel WINDOW e AS (PARTITION BY entity_id ORDER BY week_start)
""",
)
def future_targets(p: Panels) -> DataFrame:
    base = p.obs_panel.withColumnRenamed("value", "cases").join(p.population, "entity_id", "left")
    t = features.target_columns("cases", population="population_reference")
    return _r(
        base.select("entity_id", "week_start", *[c.alias(n) for n, c in t.items()]),
        "incidence_next_week_per_100k",
    )


@query(
    "incidence_rate",
    """
SELECT entity_id, week_start, cases,
  round(100000.0 * cases / nullif(population_reference, 0), 6) AS incidence_per_100k
FROM master_panel
""",
)
def incidence_rate(p: Panels) -> DataFrame:
    base = p.obs_panel.withColumnRenamed("value", "cases").join(p.population, "entity_id", "left")
    return base.select(
        "entity_id", "week_start", "cases",
        rounded(features.per_100k("cases", "population_reference")).alias("incidence_per_100k"),
    )


@query(
    "row_quality",
    """
SELECT entity_id, week_start, case_missing_flag, weather_missing_flag, case_history_missing_flag,
       row_quality_flag, is_trainable FROM model_panel
""",
)
def row_quality(p: Panels) -> DataFrame:
    return p.model_panel_plan.select(
        "entity_id", "week_start", "case_missing_flag", "weather_missing_flag",
        "case_history_missing_flag", "row_quality_flag", "is_trainable",
    )


@query(
    "continuity",
    """
SELECT entity_id, week_start, (week_start - prev)::BIGINT AS days_since_previous_observation,
  coalesce(week_start - prev = 7, false) AS is_consecutive_week
FROM (SELECT *, max(CASE WHEN value IS NOT NULL THEN week_start END) OVER (
        PARTITION BY entity_id ORDER BY week_start
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM obs_panel)
""",
)
def continuity(p: Panels) -> DataFrame:
    c = features.continuity_columns("value")
    return p.obs_panel.select("entity_id", "week_start", *[v.alias(n) for n, v in c.items()])


@query(
    "per_entity_gapfill",
    """
WITH own AS (SELECT entity_id, min(week_start) AS lo, max(week_start) AS hi FROM weekly_obs
             GROUP BY 1),
cal AS (SELECT entity_id, unnest(generate_series(lo, hi, INTERVAL 7 DAY))::DATE AS week_start
        FROM own),
f AS (SELECT c.entity_id, c.week_start, o.value, o.entity_id IS NOT NULL AS original,
        lag(o.value, 1) OVER e AS cases_lag_1, lag(o.value, 2) OVER e AS cases_lag_2,
        CASE WHEN count(o.value) OVER w4 = 4 THEN avg(o.value) OVER w4 END AS m4
      FROM cal c LEFT JOIN weekly_obs o ON o.entity_id = c.entity_id AND o.week_start = c.week_start
      WINDOW e AS (PARTITION BY c.entity_id ORDER BY c.week_start),
        w4 AS (PARTITION BY c.entity_id ORDER BY c.week_start ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT entity_id, week_start, value AS cases, cases_lag_1, cases_lag_2,
       round(m4, 6) AS cases_roll_mean_4 FROM f WHERE original
""",
)
def per_entity_gapfill(p: Panels) -> DataFrame:
    obs = p.weekly_obs.withColumnRenamed("value", "cases").withColumn("original", F.lit(True))
    full = calendar.entity_spine(p.weekly_obs).join(obs, ["entity_id", "week_start"], "left")
    feats = {
        **features.lag_columns({"cases_lag": ("cases", (1, 2))}),
        **features.rolling_columns([features.Rolling("cases_roll", "cases", "mean", (4,))]),
    }
    out = full.withColumns(feats).filter("original")
    return _r(out.select("entity_id", "week_start", "cases", *feats), "cases_roll_mean_4")


@query(
    "direct_horizon_targets",
    """
SELECT o.entity_id, o.week_start, o.value AS cases, a.value AS target_h1, b.value AS target_h2,
       c.value AS target_h3, d.value AS target_h4
FROM weekly_obs o
LEFT JOIN weekly_obs a ON a.entity_id = o.entity_id AND a.week_start = o.week_start + 7
LEFT JOIN weekly_obs b ON b.entity_id = o.entity_id AND b.week_start = o.week_start + 14
LEFT JOIN weekly_obs c ON c.entity_id = o.entity_id AND c.week_start = o.week_start + 21
LEFT JOIN weekly_obs d ON d.entity_id = o.entity_id AND d.week_start = o.week_start + 28
""",
)
def direct_horizon_targets(p: Panels) -> DataFrame:
    obs = p.weekly_obs.withColumnRenamed("value", "cases")
    return features.exact_date_shift(
        obs, "cases", {f"target_h{h}": -h for h in features.HORIZONS}
    )


ELIGIBLE_SQL = " AND ".join(
    f"{c} >= 0"
    for c in (
        "cases", "cases_lag_1", "cases_lag_2", "cases_lag_3", "cases_lag_4",
        "target_h1", "target_h2", "target_h3", "target_h4",
    )
)


@query(
    "eligible_cohort",
    f"""
SELECT entity_id, week_start, cases, target_h1, target_h2, target_h3, target_h4 FROM origins
WHERE {ELIGIBLE_SQL} AND week_start + 7 * 4 + 6 < DATE '2000-01-01'
""",
)
def eligible_cohort(p: Panels) -> DataFrame:
    inside = features.target_end("week_start", 4) < F.lit("2000-01-01").cast("date")
    return p.origins.filter(features.eligible() & inside).select(
        "entity_id", "week_start", "cases", *[f"target_h{h}" for h in features.HORIZONS]
    )


AUDITED = ("cases_lag_1", "cases_lag_8", "cases_roll_mean_4", "cases_change_2w", "log1p_cases")


@query(
    "causal_feature_audit",
    """
WITH full_f AS (
  SELECT entity_id, week_start, value, lag(value, 1) OVER e AS l1, lag(value, 8) OVER e AS l8,
    CASE WHEN count(value) OVER w = 4 THEN avg(value) OVER w END AS m4,
    value - lag(value, 2) OVER e AS c2, ln(1 + value) AS lg
  FROM obs_panel WINDOW e AS (PARTITION BY entity_id ORDER BY week_start),
    w AS (PARTITION BY entity_id ORDER BY week_start ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
cut_f AS (
  SELECT entity_id, week_start, value, lag(value, 1) OVER e AS l1, lag(value, 8) OVER e AS l8,
    CASE WHEN count(value) OVER w = 4 THEN avg(value) OVER w END AS m4,
    value - lag(value, 2) OVER e AS c2, ln(1 + value) AS lg
  FROM (SELECT * FROM obs_panel WHERE week_end <= DATE '1999-06-30')
  WINDOW e AS (PARTITION BY entity_id ORDER BY week_start),
    w AS (PARTITION BY entity_id ORDER BY week_start ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
j AS (SELECT a.*, b.entity_id AS hit, b.l1 AS bl1, b.l8 AS bl8, b.m4 AS bm4, b.c2 AS bc2, b.lg AS blg
      FROM cut_f a LEFT JOIN full_f b ON a.entity_id = b.entity_id AND a.week_start = b.week_start),
s AS (SELECT count(*)::BIGINT AS rows_compared, count(*) FILTER (hit IS NULL)::BIGINT AS rows_unmatched,
  count(*) FILTER (l1 IS DISTINCT FROM bl1)::BIGINT AS d1, count(*) FILTER (l8 IS DISTINCT FROM bl8)::BIGINT AS d2,
  count(*) FILTER (m4 IS DISTINCT FROM bm4)::BIGINT AS d3, count(*) FILTER (c2 IS DISTINCT FROM bc2)::BIGINT AS d4,
  count(*) FILTER (lg IS DISTINCT FROM blg)::BIGINT AS d5 FROM j)
SELECT rows_compared, rows_unmatched, 'cases_lag_1' AS feature_name, d1 AS rows_different FROM s
UNION ALL SELECT rows_compared, rows_unmatched, 'cases_lag_8', d2 FROM s
UNION ALL SELECT rows_compared, rows_unmatched, 'cases_roll_mean_4', d3 FROM s
UNION ALL SELECT rows_compared, rows_unmatched, 'cases_change_2w', d4 FROM s
UNION ALL SELECT rows_compared, rows_unmatched, 'log1p_cases', d5 FROM s
""",
)
def causal_feature_audit(p: Panels) -> DataFrame:
    def build(panel: DataFrame) -> DataFrame:
        return panel.withColumns(
            {
                **features.lag_columns({"cases_lag": ("cases", (1, 8))}),
                **features.rolling_columns(
                    [features.Rolling("cases_roll", "cases", "mean", (4,))]
                ),
                **features.trend_columns("cases"),
            }
        )

    panel = p.obs_panel.withColumnRenamed("value", "cases")
    prefix = panel.filter(F.col("week_end") <= F.lit("1999-06-30").cast("date"))
    return features.causal_audit(build(panel), build(prefix), AUDITED)


@query(
    "feature_table_profile",
    """
SELECT year(week_start)::BIGINT AS year, count(*)::BIGINT AS n_rows, count(cases)::BIGINT AS observed,
  count(rainfall_sum_mm)::BIGINT AS rain_weeks, count(cases_next_week)::BIGINT AS with_target,
  count(*) FILTER (is_trainable)::BIGINT AS trainable
FROM model_panel GROUP BY 1
""",
)
def feature_table_profile(p: Panels) -> DataFrame:
    """Year profile of the complete feature table."""
    return p.feature_panel.groupBy(F.year("week_start").cast("long").alias("year")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("cases").alias("observed"),
        F.count("rainfall_sum_mm").alias("rain_weeks"),
        F.count("cases_next_week").alias("with_target"),
        count_where(F.col("is_trainable")).alias("trainable"),
    )


@query(
    "entity_persistence_metrics",
    """
SELECT entity_id, count(*)::BIGINT AS n, round(avg(abs(e)), 6) AS mae,
  round(sqrt(avg(e * e)), 6) AS rmse,
  round(CASE WHEN count(*) >= 2 AND var_pop(y) > 0 THEN 1 - sum(e * e) / (var_pop(y) * count(*)) END, 6) AS r2,
  round(avg(2 * (CASE WHEN y > 0 THEN y * ln(y / greatest(p, 1e-12)) ELSE 0 END - y + greatest(p, 1e-12))), 6)
    AS poisson_deviance,
  round(avg(e), 6) + 0.0 AS bias
FROM (SELECT entity_id, target_h1::DOUBLE AS y, cases::DOUBLE AS p, (cases - target_h1)::DOUBLE AS e
      FROM origins WHERE cases IS NOT NULL AND target_h1 IS NOT NULL)
GROUP BY 1
""",
)
def entity_persistence_metrics(p: Panels) -> DataFrame:
    """Spine, next-week target, persistence forecast and its metrics per entity."""
    scored = p.origins.filter(F.col("cases").isNotNull() & F.col("target_h1").isNotNull())
    out = scored.groupBy("entity_id").agg(
        *[c.alias(n) for n, c in metric_columns("target_h1", "cases").items()]
    )
    return _r(out, "mae", "rmse", "r2", "poisson_deviance", "bias")
