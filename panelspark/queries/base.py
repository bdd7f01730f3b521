"""Query registry and the shared common table expressions of the SQL checks."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelspark.sources.panels import Panels

QueryFn = Callable[[Panels], DataFrame]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def _needs(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_0-9]+", sql))
    return [n for n in CTES if n in words]


def with_ctes(sql: str) -> str:
    """Prefix a statement with the shared expressions it names, dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in _needs(CTES[name]):
            if dep != name:
                visit(dep)
        order.append(name)

    for name in _needs(sql):
        visit(name)
    if not order:
        return sql.strip()
    body = ",\n".join(f"{n} AS (\n{CTES[n]}\n)" for n in order)
    text = sql.strip()
    if text.upper().startswith("WITH "):
        return f"WITH {body},\n{text[5:]}"
    return f"WITH {body}\n{text}"


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Panels(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn

    return register


# ---- shared expressions ----------------------------------------------------------------------

SAT = "({d}::DATE - ((dayofweek({d}) + 1) % 7)::INT)::DATE"


def saturday(expr: str) -> str:
    return SAT.format(d=expr)


cte(
    "weekly_obs",
    f"""
SELECT c_nationkey AS entity_id, {saturday("o_orderdate")} AS week_start, count(*)::BIGINT AS value
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
""",
)
cte(
    "week_list",
    """
SELECT unnest(generate_series(min(week_start), max(week_start), INTERVAL 7 DAY))::DATE AS week_start
FROM weekly_obs
""",
)
cte(
    "spine",
    """
SELECT n_nationkey AS entity_id, week_start, (week_start + 6)::DATE AS week_end
FROM nation CROSS JOIN week_list
""",
)
cte(
    "obs_panel",
    """
SELECT s.entity_id, s.week_start, s.week_end, o.value AS value
FROM spine s LEFT JOIN weekly_obs o ON s.entity_id = o.entity_id AND s.week_start = o.week_start
""",
)
cte(
    "multi_source",
    f"""
SELECT c_nationkey AS entity_id, {saturday("o_orderdate")} AS week_start,
       o_orderpriority AS source, count(*)::BIGINT AS value
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3
""",
)
cte(
    "components",
    f"""
SELECT c_nationkey AS entity_id, {saturday("o_orderdate")} AS week_start,
       c_mktsegment AS component, count(*)::BIGINT AS value
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3
""",
)
cte(
    "status_totals",
    f"""
SELECT {saturday("o_orderdate")} AS week_start, o_orderstatus, count(*)::BIGINT AS value
FROM orders GROUP BY 1, 2
""",
)
cte(
    "offset_obs",
    """
SELECT c_nationkey AS entity_id, date_trunc('week', o_orderdate)::DATE AS start_day,
       (date_trunc('week', o_orderdate)::DATE + 6)::DATE AS end_day, count(*)::BIGINT AS value
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3
""",
)
cte(
    "labelled_obs",
    """
SELECT entity_id, week_start, (week_start + 6)::DATE AS week_end,
       year((week_start + 3)::DATE)::BIGINT AS year, weekofyear(week_start)::BIGINT AS week,
       value AS cases, 'observed' AS case_status,
       'report_' || strftime(week_start, '%Y%m%d') AS source_document
FROM weekly_obs
""",
)
cte(
    "rain_daily",
    """
SELECT s_nationkey AS entity_id, l_shipdate::DATE AS day, sum(l_quantity) AS rainfall_mm,
       100.0 * least(1.0, count(DISTINCT l_suppkey) / 2.0)::DOUBLE AS spatial_coverage_pct,
       count(DISTINCT l_suppkey)::BIGINT AS grid_cells
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag <> 'R' GROUP BY 1, 2
""",
)
cte(
    "climate_daily",
    """
SELECT s_nationkey AS entity_id, l_shipdate::DATE AS day,
       avg(20 + 100 * l_discount) AS temp_mean_c, min(20 + 100 * l_discount) AS temp_min_c,
       max(20 + 100 * l_discount) AS temp_max_c, avg(60 + 100 * l_tax) AS humidity_mean_pct,
       100.0 * least(1.0, count(DISTINCT l_suppkey) / 2.0)::DOUBLE AS spatial_coverage_pct,
       count(DISTINCT l_suppkey)::BIGINT AS grid_cells
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber <= 4 GROUP BY 1, 2
""",
)
cte(
    "daily_both",
    """
SELECT coalesce(r.entity_id, c.entity_id) AS entity_id, coalesce(r.day, c.day) AS day,
       r.rainfall_mm, c.temp_mean_c, c.temp_min_c, c.temp_max_c, c.humidity_mean_pct,
       r.spatial_coverage_pct AS spatial_coverage_pct_rain, r.grid_cells AS grid_cells_rain,
       c.spatial_coverage_pct AS spatial_coverage_pct_climate, c.grid_cells AS grid_cells_climate
FROM rain_daily r FULL JOIN climate_daily c ON r.entity_id = c.entity_id AND r.day = c.day
""",
)


def weekly_weather_sql(min_temporal: float, min_spatial: float) -> str:
    return f"""
SELECT x.*, CASE WHEN f = '' THEN 'ok' ELSE f END AS weather_quality_flag FROM (
  SELECT y.*, concat_ws(';',
    CASE WHEN weather_temporal_coverage_pct < {min_temporal} THEN 'low_temporal_coverage' END,
    CASE WHEN weather_spatial_coverage_pct < {min_spatial} THEN 'low_spatial_coverage' END,
    CASE WHEN rainfall_sum_mm IS NULL THEN 'rain_missing' END,
    CASE WHEN temp_mean_c IS NULL THEN 'climate_missing' END) AS f
  FROM (
    SELECT s.entity_id, s.week_start, s.week_end,
      sum(rainfall_mm) AS rainfall_sum_mm, avg(rainfall_mm) AS rainfall_mean_daily_mm,
      max(rainfall_mm) AS rainfall_max_daily_mm,
      sum(CASE WHEN rainfall_mm >= 1 THEN 1 WHEN rainfall_mm < 1 THEN 0 END)::BIGINT AS rain_days_1mm,
      sum(CASE WHEN rainfall_mm >= 10 THEN 1 WHEN rainfall_mm < 10 THEN 0 END)::BIGINT AS rain_days_10mm,
      avg(temp_mean_c) AS temp_mean_c, min(temp_min_c) AS temp_min_c, max(temp_max_c) AS temp_max_c,
      avg(humidity_mean_pct) AS humidity_mean_pct,
      7::BIGINT AS weather_expected_days,
      count(CASE WHEN rainfall_mm IS NOT NULL AND temp_mean_c IS NOT NULL THEN 1 END)::BIGINT
        AS weather_available_days,
      100.0::DOUBLE * count(CASE WHEN rainfall_mm IS NOT NULL AND temp_mean_c IS NOT NULL THEN 1 END) / 7
        AS weather_temporal_coverage_pct,
      greatest(coalesce(max(grid_cells_rain), 0), coalesce(max(grid_cells_climate), 0))::BIGINT
        AS weather_grid_cells,
      least(min(spatial_coverage_pct_rain), min(spatial_coverage_pct_climate))
        AS weather_spatial_coverage_pct
    FROM spine s LEFT JOIN daily_both d
      ON d.entity_id = s.entity_id AND d.day BETWEEN s.week_start AND s.week_end
    GROUP BY 1, 2, 3) y) x
"""


cte("weather_weekly", weekly_weather_sql(40.0, 50.0))
cte(
    "hourly",
    """
SELECT event_type AS node, date_trunc('hour', ts) AS hour, avg(value) AS temp,
       (sum(user_id) % 101)::BIGINT AS rh
FROM events GROUP BY 1, 2
""",
)
cte(
    "boxes",
    """
SELECT n_nationkey AS entity_id, 80.0::DOUBLE + (n_nationkey % 5) * 0.4::DOUBLE AS min_lon,
       6.0::DOUBLE + (n_nationkey // 5) * 0.4::DOUBLE AS min_lat,
       80.0::DOUBLE + (n_nationkey % 5) * 0.4::DOUBLE + 0.37::DOUBLE AS max_lon,
       6.0::DOUBLE + (n_nationkey // 5) * 0.4::DOUBLE + 0.37::DOUBLE AS max_lat
FROM nation
""",
)
# WGS84: a = 6378137, e^2 = 0.00669437999014133; standard parallel 30 degrees
_E2 = "0.00669437999014133::DOUBLE"
_E = f"sqrt({_E2})"


def _q(lat: str) -> str:
    s = f"sin(radians({lat}))"
    return (
        f"(1 - {_E2}) * ({s} / (1 - {_E2} * {s} * {s})"
        f" - (1 / (2 * {_E})) * ln((1 - {_E} * {s}) / (1 + {_E} * {s})))"
    )


_K0 = f"(cos(radians(30)) / sqrt(1 - {_E2} * sin(radians(30)) * sin(radians(30))))"


def px(lon: str) -> str:
    return f"(radians({lon}) * 6378137.0::DOUBLE * {_K0})"


def py(lat: str) -> str:
    return f"({_q(lat)} * 6378137.0::DOUBLE / (2 * {_K0}))"


cte(
    "box_area",
    f"""
SELECT entity_id,
  ({px("max_lon")} - {px("min_lon")}) * ({py("max_lat")} - {py("min_lat")}) / 1e6 AS area_km2,
  (min_lon + max_lon) / 2 AS centroid_lon FROM boxes
""",
)
cte(
    "population",
    """
SELECT c_nationkey AS entity_id, count(*)::BIGINT AS population_reference
FROM customer WHERE c_nationkey <> 7 GROUP BY 1
""",
)
cte(
    "reference_dim",
    """
SELECT b.entity_id, n_name AS entity_name, r_name AS group_name, population_reference, area_km2,
       population_reference / area_km2 AS population_density_per_km2
FROM box_area b JOIN nation ON n_nationkey = b.entity_id
LEFT JOIN region ON r_regionkey = n_regionkey
LEFT JOIN population p ON p.entity_id = b.entity_id
""",
)
cte(
    "master_panel",
    """
SELECT s.entity_id, s.week_start, s.week_end, o.value AS cases,
       w.* EXCLUDE (entity_id, week_start, week_end, f, weather_quality_flag),
       upper(w.weather_quality_flag) AS weather_quality_flag,
       r.entity_name, r.group_name, r.population_reference, r.area_km2
FROM spine s
LEFT JOIN weekly_obs o ON o.entity_id = s.entity_id AND o.week_start = s.week_start
LEFT JOIN weather_weekly w ON w.entity_id = s.entity_id AND w.week_start = s.week_start
LEFT JOIN reference_dim r ON r.entity_id = s.entity_id
""",
)
cte(
    "model_panel",
    """
SELECT z.*, n_issues = 0 AND cases IS NOT NULL AND cases_next_week IS NOT NULL AS is_trainable,
  CASE WHEN n_issues = 0 THEN 'OK' WHEN n_issues > 1 THEN 'MULTIPLE_ISSUES'
       WHEN case_history_missing_flag THEN 'MISSING_CASE_HISTORY'
       WHEN weather_missing_flag THEN 'MISSING_WEATHER'
       WHEN low_flag THEN 'LOW_WEATHER_COVERAGE' ELSE 'MISSING_POPULATION' END AS row_quality_flag
FROM (
  SELECT y.*, case_history_missing_flag::INT + weather_missing_flag::INT + low_flag::INT
      + (population_reference IS NULL)::INT AS n_issues
  FROM (
    SELECT x.*, cases IS NULL AS case_missing_flag,
      (rainfall_sum_mm IS NULL OR temp_mean_c IS NULL OR humidity_mean_pct IS NULL) AS weather_missing_flag,
      (cases_lag_1 IS NULL OR cases_lag_2 IS NULL OR cases_lag_3 IS NULL OR cases_lag_4 IS NULL)
        AS case_history_missing_flag,
      (coalesce(weather_temporal_coverage_pct, -1) < 40 OR coalesce(weather_spatial_coverage_pct, -1) < 50
        OR coalesce(weather_quality_flag, 'UNKNOWN') <> 'OK') AS low_flag
    FROM (
      SELECT m.*, lag(cases, 1) OVER e AS cases_lag_1, lag(cases, 2) OVER e AS cases_lag_2,
        lag(cases, 3) OVER e AS cases_lag_3, lag(cases, 4) OVER e AS cases_lag_4,
        lead(cases, 1) OVER e AS cases_next_week, lead(cases, 2) OVER e AS cases_next_2w,
        lead(cases, 4) OVER e AS cases_next_4w,
        lead(cases, 1) OVER e AS target_h1, lead(cases, 2) OVER e AS target_h2,
        lead(cases, 3) OVER e AS target_h3, lead(cases, 4) OVER e AS target_h4
      FROM master_panel m WINDOW e AS (PARTITION BY entity_id ORDER BY week_start)) x) y) z
""",
)
cte(
    "origins",
    """
SELECT entity_id, week_start, week_end, value AS cases,
  lag(value, 1) OVER e AS cases_lag_1, lag(value, 2) OVER e AS cases_lag_2,
  lag(value, 3) OVER e AS cases_lag_3, lag(value, 4) OVER e AS cases_lag_4,
  lead(value, 1) OVER e AS target_h1, lead(value, 2) OVER e AS target_h2,
  lead(value, 3) OVER e AS target_h3, lead(value, 4) OVER e AS target_h4
FROM obs_panel WINDOW e AS (PARTITION BY entity_id ORDER BY week_start)
""",
)
