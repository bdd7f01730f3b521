"""Data-quality reports and feature metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.columns import present, rounded
from panelspark.operators import quality as Q
from panelspark.operators import registry as REG
from panelspark.queries.base import cte, query
from panelspark.sources.panels import MIN_SPATIAL_PCT, MIN_TEMPORAL_PCT, Panels


def _round(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: rounded(c, digits) for c in cols})


def flags():
    return Q.reason_flags(min_temporal_pct=MIN_TEMPORAL_PCT, min_spatial_pct=MIN_SPATIAL_PCT)


_ORDER_COLS = (
    ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
    ("o_totalprice", "double"), ("o_orderpriority", "string"),
)
_LABEL_COLS = (("doc_id", "bigint"), ("quality", "int"), ("toxic", "int"))


def _schema_sql(table: str, cols) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, '{t}' AS dtype, count(*)::BIGINT AS n_rows,"
        f" (count(*) - count({c}))::BIGINT AS null_rows, count(*) > count({c}) AS has_nulls FROM {table}"
        for c, t in cols
    )


@query(
    "schema_report",
    _schema_sql("orders", _ORDER_COLS)
    + " UNION ALL "
    + _schema_sql("labels", _LABEL_COLS)
    + " UNION ALL SELECT 'weekly', 'entity_id', 'int', count(*)::BIGINT, 0, false FROM obs_panel"
    + " UNION ALL SELECT 'weekly', 'value', 'bigint', count(*)::BIGINT, (count(*) - count(value))::BIGINT, count(*) > count(value) FROM obs_panel",
)
def schema_report(p: Panels) -> DataFrame:
    return Q.schema_report(
        {
            "orders": p.table("orders").select(*[c for c, _ in _ORDER_COLS]),
            "labels": p.table("labels").select(*[F.col(c).cast(t).alias(c) for c, t in _LABEL_COLS]),
            "weekly": p.obs_panel.select("entity_id", "value"),
        }
    )


_PROFILE = (
    "cases", "cases_lag_1", "cases_lag_4", "cases_next_week", "rainfall_sum_mm", "temp_mean_c",
    "humidity_mean_pct", "population_reference", "target_h4",
)
cte(
    "profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*)::BIGINT AS n_rows, (count(*) - count({c}))::BIGINT AS missing_rows,"
        f" 100.0::DOUBLE * (count(*) - count({c})) / count(*) AS missing_pct FROM model_panel"
        for c in _PROFILE
    ),
)


@query(
    "missingness_report",
    "SELECT column_name, n_rows, missing_rows, round(missing_pct, 6) AS missing_pct FROM profile",
)
def missingness_report(p: Panels) -> DataFrame:
    return _round(REG.column_profile(p.model_panel_plan, _PROFILE), "missing_pct")


@query(
    "entity_coverage_report",
    """
WITH r AS (SELECT entity_id, count(*)::BIGINT AS report_weeks, count(value)::BIGINT AS observed_weeks FROM weekly_obs GROUP BY 1),
w AS (SELECT entity_id, count(*)::BIGINT AS weather_weeks, round(min(weather_temporal_coverage_pct), 6) AS min_temporal_pct,
  min(weather_spatial_coverage_pct) AS min_spatial_pct FROM weather_weekly GROUP BY 1),
m AS (SELECT entity_id, count(*)::BIGINT AS panel_rows, count(*) FILTER (is_trainable)::BIGINT AS trainable_rows FROM model_panel GROUP BY 1)
SELECT n_nationkey AS entity_id, coalesce(report_weeks, 0) AS report_weeks, coalesce(observed_weeks, 0) AS observed_weeks,
  coalesce(weather_weeks, 0) AS weather_weeks, min_temporal_pct, min_spatial_pct, coalesce(panel_rows, 0) AS panel_rows, coalesce(trainable_rows, 0) AS trainable_rows
FROM nation LEFT JOIN r ON r.entity_id = n_nationkey LEFT JOIN w ON w.entity_id = n_nationkey LEFT JOIN m ON m.entity_id = n_nationkey
""",
)
def entity_coverage_report(p: Panels) -> DataFrame:
    out = Q.entity_coverage(p.entities, p.weekly_obs, p.weather_weekly, p.model_panel_plan)
    return _round(out, "min_temporal_pct")


def _registry_values(names) -> str:
    rows = ", ".join(
        f"('{n}', '{g}', {str(f).lower()}, {str(t).lower()})"
        for n, g, f, t, _ in REG.registry_rows(names)
    )
    return f"(VALUES {rows}) r(feature_name, feature_group, uses_future_information, eligible_for_training)"


_NAMES = (*_PROFILE, "entity_id", "area_km2", "wind_ms", "cases_next_season")


def registry(p: Panels) -> DataFrame:
    return REG.feature_registry(p.spark, _NAMES)


@query(
    "column_dictionary",
    f"""
SELECT column_name, missing_rows, coalesce(eligible_for_training, false) AS eligible_for_training, coalesce(uses_future_information, false) AS uses_future_information,
  CASE WHEN column_name = 'cases_next_week' THEN 'target: value of the next week' WHEN column_name LIKE 'cases\\_lag\\_%' ESCAPE '\\' THEN 'value of an earlier week'
    WHEN column_name LIKE 'rainfall%' THEN 'rainfall aggregate' WHEN column_name LIKE 'temp%' THEN 'temperature aggregate'
    WHEN column_name LIKE 'humidity%' THEN 'humidity aggregate' ELSE 'panel column' END AS meaning
FROM profile LEFT JOIN {_registry_values(_NAMES)} ON feature_name = column_name
""",
)
def column_dictionary(p: Panels) -> DataFrame:
    return Q.column_dictionary(REG.column_profile(p.model_panel_plan, _PROFILE), registry(p))


@query(
    "feature_registry",
    f"""
SELECT feature_name, feature_group, uses_future_information, eligible_for_training, n_rows - missing_rows AS observed_rows
FROM {_registry_values(_NAMES)} LEFT JOIN profile ON column_name = feature_name
""",
)
def feature_registry(p: Panels) -> DataFrame:
    """Registry rows with the observed rows of each column; unknown columns are not trainable."""
    profile = REG.column_profile(p.model_panel_plan, _PROFILE).withColumnRenamed(
        "column_name", "feature_name"
    )
    return registry(p).drop("lag_weeks").join(profile, "feature_name", "left").select(
        "feature_name", "feature_group", "uses_future_information", "eligible_for_training",
        (F.col("n_rows") - F.col("missing_rows")).alias("observed_rows"),
    )


_SEGMENT_FEATURES = (
    "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'cases_next_week' WHEN 'BUILDING' THEN 'wind_ms'"
    " WHEN 'FURNITURE' THEN 'population_reference' WHEN 'HOUSEHOLD' THEN 'cases_lag_1' ELSE 'area_km2' END"
)


def requested(p: Panels) -> DataFrame:
    """Feature requests read from a table: one per customer segment."""
    seg = F.col("c_mktsegment")
    name = (
        F.when(seg == "AUTOMOBILE", "cases_next_week")
        .when(seg == "BUILDING", "wind_speed")
        .when(seg == "FURNITURE", "population_reference")
        .when(seg == "HOUSEHOLD", "cases_lag_1")
        .otherwise("area_km2")
    )
    asked = p.table("customer").select(name.alias("feature_name"), "c_nationkey")
    return asked.groupBy("feature_name", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "feature_request_check",
    f"""
WITH a AS (SELECT c_nationkey, replace({_SEGMENT_FEATURES}, 'wind_ms', 'wind_speed') AS feature_name FROM customer),
q AS (SELECT feature_name, count(DISTINCT c_nationkey) AS copies FROM a GROUP BY 1)
SELECT feature_name, CASE WHEN feature_name = 'wind_speed' THEN 'unknown' WHEN feature_name = 'cases_next_week' THEN 'future'
  WHEN feature_name = 'population_reference' THEN 'forbidden' WHEN copies > 1 THEN 'duplicated' END AS problem FROM q
""",
)
def feature_request_check(p: Panels) -> DataFrame:
    return REG.requested_feature_problems(requested(p).select("feature_name"), registry(p))


@query(
    "registry_contract",
    """
SELECT * FROM (VALUES ('cases', 'duplicate_name'), ('cases_next_week', 'future_information_trainable'), ('cases_next_week', 'target_trainable'),
  ('wind_ms', 'unknown_group_trainable')) t(feature_name, problem) WHERE (SELECT count(*) FROM model_panel) > 0
""",
)
def registry_contract(p: Panels) -> DataFrame:
    """A registry for the panel's columns with injected faults; the faults come back as rows."""
    reg = REG.feature_registry(p.spark, [*p.model_panel_plan.columns, "wind_ms"])
    faulty = reg.withColumn(
        "eligible_for_training",
        F.col("eligible_for_training") | F.col("feature_name").isin("cases_next_week", "wind_ms"),
    )
    twice = faulty.unionByName(faulty.filter("feature_name = 'cases'"))
    seen = REG.column_profile(p.model_panel_plan, ["cases"]).filter("n_rows > 0").select("n_rows")
    return REG.registry_problems(twice).withColumn("_n", seen.scalar()).filter("_n > 0").drop("_n")


@query(
    "feature_set_resolve",
    f"""
WITH r AS (SELECT * FROM {_registry_values(_NAMES)}),
e AS (SELECT * FROM r WHERE (eligible_for_training AND NOT uses_future_information) OR feature_name IN ('entity_id', 'area_km2')),
s AS (SELECT unnest(['cases_only', 'cases_rainfall', 'cases_full_weather', 'full_context']) AS feature_set)
SELECT feature_set, feature_name, n_rows - missing_rows AS observed_rows FROM s, e LEFT JOIN profile ON column_name = feature_name
WHERE feature_group IN ('epidemiology', 'seasonality') OR feature_name = 'entity_id'
  OR (feature_set <> 'cases_only' AND (feature_name LIKE 'rainfall%' OR feature_name LIKE 'rain_days%'))
  OR (feature_set IN ('cases_full_weather', 'full_context') AND feature_group = 'weather') OR (feature_set = 'full_context' AND feature_name = 'area_km2')
""",
)
def feature_set_resolve(p: Panels) -> DataFrame:
    profile = REG.column_profile(p.model_panel_plan, _PROFILE).select(
        F.col("column_name").alias("feature_name"),
        (F.col("n_rows") - F.col("missing_rows")).alias("observed_rows"),
    )
    sets = REG.feature_set_table(registry(p)).drop("feature_group")
    return sets.join(profile, "feature_name", "left").select("feature_set", "feature_name", "observed_rows")


@query(
    "config_grid",
    f"""
WITH r AS (SELECT * FROM {_registry_values(_NAMES)}),
f AS (SELECT column_name, feature_group, n_rows - missing_rows AS seen FROM profile JOIN r ON feature_name = column_name
  WHERE eligible_for_training AND NOT uses_future_information),
s AS (SELECT fs AS feature_set, count(*)::BIGINT AS features, sum(seen)::BIGINT AS observed_cells FROM f, unnest(['cases_only', 'cases_rainfall', 'cases_full_weather']) t(fs)
  WHERE feature_group IN ('epidemiology', 'seasonality') OR (fs <> 'cases_only' AND column_name LIKE 'rainfall%')
    OR (fs = 'cases_full_weather' AND feature_group = 'weather') GROUP BY 1)
SELECT m || '__' || feature_set AS config_id, m AS model, feature_set, features, observed_cells
FROM s, unnest(['ridge', 'poisson', 'random_forest', 'boosted', 'boosted_poisson']) t2(m)
""",
)
def config_grid(p: Panels) -> DataFrame:
    """Screen configurations: model families x feature sets with the observed cells behind each."""
    profile = REG.column_profile(p.model_panel_plan, _PROFILE).select(
        F.col("column_name").alias("feature_name"),
        (F.col("n_rows") - F.col("missing_rows")).alias("seen"),
    )
    sets = REG.feature_set_table(registry(p)).filter("feature_set <> 'full_context'")
    sized = sets.join(profile, "feature_name").groupBy("feature_set").agg(
        F.count(F.lit(1)).alias("features"), F.sum("seen").alias("observed_cells")
    )
    from panelspark.operators.models import DEFAULTS

    return sized.withColumn("model", F.explode(F.array(*[F.lit(m) for m in DEFAULTS]))).select(
        F.concat_ws("__", "model", "feature_set").alias("config_id"), "model", "feature_set",
        "features", "observed_cells",
    )


_TRANSFORMED = (
    "cases_lag_1", "cases_lag_1__missing", "rainfall_sum_mm__missing", "temp_mean_c",
    "precip_index", "week_flag", "cases_next_week", "population_reference", "area_km2",
)


def transformed(p: Panels) -> DataFrame:
    """Transformed names: fixed numeric ones and one indicator per entity of the panel."""
    hot = p.weekly_obs.select(
        F.concat(F.lit("entity_id__"), F.col("entity_id").cast("string")).alias("feature")
    ).distinct()
    numeric = p.weekly_obs.select(
        F.explode(F.array(*[F.lit(t) for t in _TRANSFORMED])).alias("feature")
    ).distinct()
    return hot.unionByName(numeric)


cte(
    "transformed",
    "SELECT DISTINCT 'entity_id__' || entity_id AS feature FROM weekly_obs UNION ALL SELECT unnest(["
    + ", ".join(f"'{t}'" for t in _TRANSFORMED)
    + "])",
)
cte(
    "transformed_meta",
    f"""
WITH t AS (SELECT feature, regexp_replace(feature, '__.*$', '') AS raw_feature, CASE WHEN feature LIKE '%\\_\\_missing' ESCAPE '\\' THEN 'missing_indicator'
  WHEN feature LIKE 'entity\\_id\\_\\_%' ESCAPE '\\' THEN 'entity_onehot' ELSE 'raw' END AS derived_type FROM transformed)
SELECT feature, raw_feature, derived_type, coalesce(feature_group, CASE raw_feature WHEN 'precip_index' THEN 'weather' WHEN 'week_flag' THEN 'seasonality'
  WHEN 'unknown' THEN 'unknown' END) AS feature_group, coalesce(uses_future_information, false) AS uses_future_information
FROM t LEFT JOIN {_registry_values(_NAMES)} ON feature_name = raw_feature
""",
)


@query("importance_metadata", "SELECT * FROM transformed_meta")
def importance_metadata(p: Panels) -> DataFrame:
    return REG.transformed_metadata(transformed(p), registry(p)).select(
        "feature", "raw_feature", "derived_type", "feature_group", "uses_future_information"
    )


@query(
    "leakage_audit",
    """
SELECT feature, raw_feature, raw_feature IN ('cases_next_week', 'population_reference') AS suspicious, raw_feature IN ('entity_id', 'area_km2') AS authorized_exception,
  CASE WHEN raw_feature IN ('cases_next_week', 'population_reference') THEN 'review_required' ELSE 'ok' END AS status FROM transformed_meta
""",
)
def leakage_audit(p: Panels) -> DataFrame:
    return REG.leakage_audit(REG.transformed_metadata(transformed(p), registry(p)))


@query(
    "training_view",
    """
SELECT entity_id, cases, cases_lag_1, cases_lag_2, cases_lag_3, cases_lag_4, round(rainfall_sum_mm, 6) AS rainfall_sum_mm, round(temp_mean_c, 6) AS temp_mean_c,
  round(humidity_mean_pct, 6) AS humidity_mean_pct, cases_next_week, is_trainable FROM model_panel WHERE is_trainable
""",
)
def training_view(p: Panels) -> DataFrame:
    """Trainable rows with the eligible columns and the target."""
    panel = p.model_panel_plan
    names = REG.feature_set_columns(panel.columns, "cases_full_weather")
    view = panel.filter("is_trainable").select(*names, "cases_next_week", "is_trainable")
    return _round(view, "rainfall_sum_mm", "temp_mean_c", "humidity_mean_pct")


@query(
    "modeling_matrix",
    """
SELECT entity_id, week_start, week_end, cases, cases_lag_1, cases_lag_2, cases_lag_3, cases_lag_4, round(rainfall_sum_mm, 6) AS rainfall_sum_mm, cases_next_week AS y
FROM model_panel WHERE is_trainable AND cases_next_week IS NOT NULL
""",
)
def modeling_matrix(p: Panels) -> DataFrame:
    """Features, target and row identity of one feature set."""
    panel = p.model_panel_plan
    x = [c for c in REG.feature_set_columns(panel.columns, "cases_rainfall") if c != "entity_id"]
    rows = panel.filter(F.col("is_trainable") & present("cases_next_week")).select(
        "entity_id", "week_start", "week_end", *x, F.col("cases_next_week").alias("y")
    )
    return _round(rows, "rainfall_sum_mm")


@query(
    "review_sample",
    "SELECT entity_id, week_start, value FROM obs_panel ORDER BY week_start, entity_id LIMIT 20",
)
def review_sample(p: Panels) -> DataFrame:
    return p.obs_panel.select("entity_id", "week_start", "value").orderBy("week_start", "entity_id").limit(20)


@query(
    "missing_weeks",
    """
WITH g AS (SELECT entity_id, week_start FROM obs_panel WHERE value IS NULL)
SELECT n_nationkey AS entity_id, count(g.week_start)::BIGINT AS missing_weeks, coalesce(string_agg(g.week_start::VARCHAR, ',' ORDER BY g.week_start), '') AS missing_week_starts
FROM nation LEFT JOIN g ON g.entity_id = n_nationkey GROUP BY 1
""",
)
def missing_weeks(p: Panels) -> DataFrame:
    return Q.missing_weeks(p.spine, p.weekly_obs, p.entities)


_WX = ("rainfall_sum_mm", "temp_mean_c", "temp_min_c", "temp_max_c", "humidity_mean_pct")


@query(
    "weather_summary",
    " UNION ALL ".join(
        f"SELECT '{v}' AS variable, count({v})::BIGINT AS non_null_rows, round(min({v}), 6) AS min_value, round(max({v}), 6) AS max_value FROM weather_weekly"
        for v in _WX
    ),
)
def weather_summary(p: Panels) -> DataFrame:
    return _round(Q.weather_ranges(p.weather_weekly, _WX), "min_value", "max_value")


@query(
    "weather_monthly",
    " UNION ALL ".join(
        f"SELECT month(week_start)::BIGINT AS month, '{v}' AS variable, round(avg({v}), 6) AS mean_value, round(min({v}), 6) AS min_value,"
        f" round(max({v}), 6) AS max_value FROM weather_weekly GROUP BY 1"
        for v in _WX
    ),
)
def weather_monthly(p: Panels) -> DataFrame:
    return _round(Q.weather_by_month(p.weather_weekly, _WX), "mean_value", "min_value", "max_value")


@query(
    "quality_overview",
    """
SELECT 'panel_rows' AS item, count(*)::VARCHAR AS value FROM model_panel
UNION ALL SELECT 'panel_entities', count(DISTINCT entity_id)::VARCHAR FROM model_panel
UNION ALL SELECT 'trainable_rows', (count(*) FILTER (is_trainable))::VARCHAR FROM model_panel
UNION ALL SELECT 'first_week', min(week_start)::VARCHAR FROM model_panel
UNION ALL SELECT 'last_week', max(week_start)::VARCHAR FROM model_panel
UNION ALL SELECT 'report_rows', count(*)::VARCHAR FROM multi_source
UNION ALL SELECT 'duplicate_report_keys', (count(*) - count(DISTINCT (entity_id, week_start)))::VARCHAR FROM multi_source
UNION ALL SELECT 'quality:' || row_quality_flag, count(*)::VARCHAR FROM model_panel GROUP BY row_quality_flag
""",
)
def quality_overview(p: Panels) -> DataFrame:
    return Q.overview(p.model_panel, p.multi_source)


@query(
    "availability_by_year_and_entity",
    """
WITH s AS (SELECT entity_id, year(week_start)::BIGINT AS year, is_trainable, cases IS NOT NULL AS reports,
  (rainfall_sum_mm IS NOT NULL AND temp_mean_c IS NOT NULL AND humidity_mean_pct IS NOT NULL) AS weather FROM model_panel),
l AS (SELECT entity_id, year, is_trainable, 'reports' AS series, reports AS ok FROM s UNION ALL SELECT entity_id, year, is_trainable, 'weather', weather FROM s)
SELECT year, entity_id, series, count(*)::BIGINT AS n_rows, count(*) FILTER (is_trainable)::BIGINT AS trainable_rows, count(*) FILTER (ok)::BIGINT AS available,
  round(100.0::DOUBLE * count(*) FILTER (ok) / count(*), 2) AS coverage_pct FROM l GROUP BY GROUPING SETS ((year, series), (entity_id, series))
""",
)
def availability_by_year_and_entity(p: Panels) -> DataFrame:
    weather = present("rainfall_sum_mm") & present("temp_mean_c") & present("humidity_mean_pct")
    return Q.availability(p.model_panel_plan, {"reports": present("cases"), "weather": weather})


cte(
    "thin_panel",
    """
SELECT s.entity_id, s.week_start, m.value AS cases FROM spine s LEFT JOIN (
  SELECT entity_id, week_start, max(value) AS value FROM multi_source WHERE value >= 3 GROUP BY 1, 2) m
  ON m.entity_id = s.entity_id AND m.week_start = s.week_start
""",
)


@query(
    "missing_whole_weeks",
    """
WITH m AS (SELECT week_start FROM thin_panel GROUP BY 1 HAVING count(cases) = 0),
r AS (SELECT week_start, week_start - (7 * row_number() OVER (ORDER BY week_start))::INT AS g FROM m),
y AS (SELECT year(week_start)::VARCHAR AS y, count(*) AS n FROM m GROUP BY 1 HAVING count(*) >= 4)
SELECT (SELECT count(*) FROM m)::BIGINT AS missing_whole_weeks, (SELECT coalesce(max(n), 0) FROM (SELECT g, count(*) AS n FROM r GROUP BY 1))::BIGINT AS longest_missing_run_weeks,
  coalesce((SELECT string_agg(y || ':' || n, ',' ORDER BY y || ':' || n) FROM y), '') AS years_with_major_gaps
""",
)
def missing_whole_weeks(p: Panels) -> DataFrame:
    """Weeks in which no source of any entity reports three or more."""
    large = p.multi_source.filter("value >= 3").groupBy("entity_id", "week_start").agg(
        F.max("value").alias("cases")
    )
    return Q.missing_week_stats(p.spine.join(large, ["entity_id", "week_start"], "left"))


_REASON_SQL = """CASE WHEN cases IS NULL THEN 'missing_current_cases' WHEN cases_next_week IS NULL THEN 'missing_target_next_week'
  WHEN case_history_missing_flag THEN 'insufficient_case_history' WHEN weather_missing_flag THEN 'missing_weather' WHEN low_flag THEN 'low_weather_coverage'
  WHEN population_reference IS NULL THEN 'missing_population' ELSE 'other_not_trainable' END"""


@query(
    "untrainable_primary_reason",
    f"""
WITH b AS (SELECT year(week_start)::BIGINT AS year, {_REASON_SQL} AS reason FROM model_panel WHERE NOT is_trainable),
y AS (SELECT DISTINCT year FROM b UNION ALL SELECT NULL),
r AS (SELECT unnest([{", ".join(f"'{r}'" for r in Q.REASONS)}]) AS reason)
SELECT y.year, r.reason, (SELECT count(*) FROM b WHERE b.reason = r.reason AND (y.year IS NULL OR b.year = y.year))::BIGINT AS n_rows FROM y, r
""",
)
def untrainable_primary_reason(p: Panels) -> DataFrame:
    return Q.untrainable_reasons(p.model_panel_plan, flags())


@query(
    "untrainable_overlapping_flags",
    """
WITH b AS (SELECT * FROM model_panel WHERE NOT is_trainable)
SELECT 'missing_current_cases' AS flag, count(*) FILTER (cases IS NULL)::BIGINT AS n_rows FROM b
UNION ALL SELECT 'missing_target_next_week', count(*) FILTER (cases_next_week IS NULL) FROM b
UNION ALL SELECT 'insufficient_case_history', count(*) FILTER (case_history_missing_flag) FROM b
UNION ALL SELECT 'missing_weather', count(*) FILTER (weather_missing_flag) FROM b
UNION ALL SELECT 'low_weather_coverage', count(*) FILTER (low_flag) FROM b
UNION ALL SELECT 'missing_population', count(*) FILTER (population_reference IS NULL OR row_quality_flag = 'MISSING_POPULATION') FROM b
""",
)
def untrainable_overlapping_flags(p: Panels) -> DataFrame:
    return Q.overlapping_flags(p.model_panel_plan, flags())


@query(
    "target_availability",
    """
SELECT 'cases_next_week' AS target, count(cases_next_week)::BIGINT AS available FROM model_panel
UNION ALL SELECT 'cases_next_2w', count(cases_next_2w) FROM model_panel UNION ALL SELECT 'cases_next_4w', count(cases_next_4w) FROM model_panel
""",
)
def target_availability(p: Panels) -> DataFrame:
    return Q.target_availability(
        p.model_panel_plan, ["cases_next_week", "cases_next_2w", "cases_next_4w"]
    )


@query(
    "panel_summary",
    """
SELECT min(week_start) AS first_week, max(week_start) AS last_week, min(CASE WHEN cases IS NOT NULL THEN week_start END) AS first_observed_week,
  max(CASE WHEN cases IS NOT NULL THEN week_start END) AS last_observed_week, count(DISTINCT entity_id)::BIGINT AS entities, count(*)::BIGINT AS panel_rows,
  count(cases)::BIGINT AS observed_rows, count(*) FILTER (is_trainable)::BIGINT AS trainable_rows, round(100.0::DOUBLE * count(cases) / count(*), 2) AS observed_pct,
  round(100.0::DOUBLE * count(*) FILTER (rainfall_sum_mm IS NOT NULL AND temp_mean_c IS NOT NULL AND humidity_mean_pct IS NOT NULL) / count(*), 2) AS weather_pct,
  count(cases_next_week)::BIGINT AS cases_next_week_rows, count(cases_next_2w)::BIGINT AS cases_next_2w_rows, count(cases_next_4w)::BIGINT AS cases_next_4w_rows
FROM model_panel
""",
)
def panel_summary(p: Panels) -> DataFrame:
    return Q.panel_summary(p.model_panel_plan)
