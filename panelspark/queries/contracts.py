"""Contracts and integrity checks over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.columns import digest_int, plus_days
from panelspark.operators import contracts as C
from panelspark.operators import normalize, weather
from panelspark.queries.base import cte, query
from panelspark.sources.panels import Panels


def sql_set_digest(expr: str) -> str:
    """SQL of ``columns.set_digest``."""
    halves = [f"sum(('0x' || substr(md5({expr}), {at}, 16))::UBIGINT)::VARCHAR" for at in (1, 17)]
    return " || ':' || ".join(halves)


def sql_digest(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 8))::BIGINT"


CUSTOMER_CONTRACT = C.TableContract(
    "customer",
    ("c_name", "c_region"),
    {
        "c_custkey": C.ColumnRule("integer", nullable=False, minimum=0),
        "c_acctbal": C.ColumnRule("float", nullable=False, minimum=0, maximum=9000),
        "c_mktsegment": C.ColumnRule(
            "enum", allowed=("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")
        ),
        "c_name": C.ColumnRule("string", nullable=False),
        "c_since": C.ColumnRule("date"),
        "c_domestic": C.ColumnRule("boolean"),
        "c_flag": C.ColumnRule("boolean", nullable=False),
        "c_region": C.ColumnRule("string"),
    },
)


@query(
    "schema_contract",
    """
SELECT 'c_custkey' AS column_name, 'null' AS rule, count(*) FILTER (c_custkey IS NULL)::BIGINT AS violations FROM customer
UNION ALL SELECT 'c_custkey', 'not_numeric', 0
UNION ALL SELECT 'c_custkey', 'not_finite', 0
UNION ALL SELECT 'c_custkey', 'not_integral', 0
UNION ALL SELECT 'c_custkey', 'below_min', count(*) FILTER (c_custkey < 0) FROM customer
UNION ALL SELECT 'c_acctbal', 'null', count(*) FILTER (c_acctbal IS NULL) FROM customer
UNION ALL SELECT 'c_acctbal', 'not_numeric', 0
UNION ALL SELECT 'c_acctbal', 'not_finite', count(*) FILTER (isnan(c_acctbal) OR isinf(c_acctbal)) FROM customer
UNION ALL SELECT 'c_acctbal', 'below_min', count(*) FILTER (c_acctbal < 0) FROM customer
UNION ALL SELECT 'c_acctbal', 'above_max', count(*) FILTER (c_acctbal > 9000) FROM customer
UNION ALL SELECT 'c_mktsegment', 'not_allowed', count(*) FILTER (c_mktsegment NOT IN
  ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD')) FROM customer
UNION ALL SELECT 'c_name', 'null', count(*) FILTER (c_name IS NULL) FROM customer
UNION ALL SELECT 'c_name', 'not_string', 0
UNION ALL SELECT 'c_domestic', 'not_boolean', 0
UNION ALL SELECT 'c_flag', 'null', count(*) FILTER (c_nationkey % 3 = 0) FROM customer
UNION ALL SELECT 'c_flag', 'not_boolean', count(*) FILTER (c_nationkey % 3 <> 0) FROM customer
UNION ALL SELECT 'c_region', 'not_string', count(*) FILTER (c_nationkey IS NOT NULL) FROM customer
UNION ALL SELECT 'c_name+c_region', 'repeated_key',
  (SELECT count(*) FROM customer) - (SELECT count(*) FROM (SELECT DISTINCT substr(c_name, 1, 16), c_nationkey FROM customer))
UNION ALL SELECT 'c_since', 'missing_column', 1
""",
)
def schema_contract(p: Panels) -> DataFrame:
    """Customers under shortened names, with a nullable boolean, digits for booleans and numbers for texts."""
    nation = F.col("c_nationkey")
    rows = p.table("customer").withColumns(
        {
            "c_name": F.substring("c_name", 1, 16),
            "c_domestic": F.when(nation % 2 == 0, nation < 10),
            "c_flag": F.when(nation % 3 != 0, nation % 2),
            "c_region": nation,
        }
    )
    return C.check_schema(rows, CUSTOMER_CONTRACT)


cte(
    "date_texts",
    """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN ' ' || o_orderdate::DATE || ' '
  WHEN 1 THEN o_orderdate::DATE || ' 10:30:00' WHEN 2 THEN o_orderdate::DATE::VARCHAR
  WHEN 3 THEN year(o_orderdate) || '-13-01' ELSE NULL END AS day_text FROM orders
""",
)


def date_texts(p: Panels) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey") % 5
    text = (
        F.when(k == 0, F.concat(F.lit(" "), day, F.lit(" ")))
        .when(k == 1, F.concat(day, F.lit(" 10:30:00")))
        .when(k == 2, day)
        .when(k == 3, F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-13-01")))
    )
    return p.table("orders").select("o_orderkey", text.alias("day_text"))


@query(
    "strict_date",
    """
SELECT o_orderkey, CASE WHEN regexp_matches(trim(day_text), '^\\d{4}-\\d{2}-\\d{2}$')
    THEN try_cast(trim(day_text) AS DATE) END AS day,
  day_text IS NOT NULL AND (NOT regexp_matches(trim(day_text), '^\\d{4}-\\d{2}-\\d{2}$')
    OR try_cast(trim(day_text) AS DATE) IS NULL) AS is_violation
FROM date_texts
""",
)
def strict_date(p: Panels) -> DataFrame:
    day = C.strict_date("day_text")
    return date_texts(p).select(
        "o_orderkey", day.alias("day"),
        (F.col("day_text").isNotNull() & day.isNull()).alias("is_violation"),
    )


@query(
    "unique_key",
    "SELECT entity_id, week_start, count(*)::BIGINT AS n_rows FROM multi_source"
    " GROUP BY 1, 2 HAVING count(*) > 1",
)
def unique_key(p: Panels) -> DataFrame:
    return C.duplicate_keys(p.multi_source, ["entity_id", "week_start"])


@query(
    "week_interval_check",
    """
SELECT entity_id, week_start, week_end FROM (
  SELECT entity_id, week_start, CASE WHEN value % 5 = 0 THEN week_start + 7 ELSE week_start + 6 END AS week_end
  FROM weekly_obs) WHERE week_end - week_start <> 6
""",
)
def week_interval_check(p: Panels) -> DataFrame:
    extra = F.when(F.col("value") % 5 == 0, 7).otherwise(6)
    rows = p.weekly_obs.select(
        "entity_id", "week_start", plus_days("week_start", extra).alias("week_end")
    )
    return C.bad_week_intervals(rows)


@query(
    "dimension_check",
    """
WITH seen AS (SELECT DISTINCT CASE WHEN c_custkey % 50 = 0 THEN 25 ELSE c_nationkey END AS entity_id,
    'NATION_' || CASE WHEN c_custkey % 37 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS entity_name
  FROM customer)
SELECT s.entity_id, s.entity_name, n_name AS expected_name,
  CASE WHEN n_name IS NULL THEN 'unknown_id' ELSE 'name_mismatch' END AS problem
FROM seen s LEFT JOIN nation ON n_nationkey = entity_id
WHERE n_name IS NULL OR n_name <> s.entity_name
""",
)
def dimension_check(p: Panels) -> DataFrame:
    k, nk = F.col("c_custkey"), F.col("c_nationkey")
    rows = p.table("customer").select(
        F.when(k % 50 == 0, 25).otherwise(nk).alias("entity_id"),
        F.concat(
            F.lit("NATION_"), F.when(k % 37 == 0, (nk + 1) % 25).otherwise(nk).cast("string")
        ).alias("entity_name"),
    )
    dim = p.table("nation").select(
        F.col("n_nationkey").alias("entity_id"), F.col("n_name").alias("entity_name")
    )
    return C.dimension_violations(rows, dim, key="entity_id", name="entity_name")


cte(
    "claimed_status",
    f"""
SELECT entity_id, week_start, value, CASE {sql_digest("entity_id || '|' || week_start")} % 3
  WHEN 0 THEN 'missing' WHEN 1 THEN 'observed' ELSE 'imputed' END AS case_status FROM obs_panel
""",
)


def claimed_status(p: Panels) -> DataFrame:
    d = digest_int("entity_id", "week_start") % 3
    return p.obs_panel.select(
        "entity_id", "week_start", "value",
        F.when(d == 0, "missing").when(d == 1, "observed").otherwise("imputed").alias("case_status"),
    )


@query(
    "status_value_check",
    """
SELECT entity_id, week_start, value, case_status FROM claimed_status
WHERE (case_status = 'missing' AND value IS NOT NULL) OR (case_status <> 'missing' AND value IS NULL)
""",
)
def status_value_check(p: Panels) -> DataFrame:
    return C.status_value_violations(claimed_status(p), status="case_status", value="value")


@query(
    "quality_token_normalize",
    """
WITH raw AS (SELECT entity_id, week_start, CASE week_start - DATE '1994-12-31' WHEN 7 THEN ' ; '
    ELSE replace(weather_quality_flag, ';', ' ; ')
      || CASE WHEN entity_id = 3 THEN ';Sensor_Drift' ELSE '' END END AS flag FROM weather_weekly),
t AS (SELECT *, list_filter(list_transform(string_split(flag, ';'), lambda x: lower(trim(x))), lambda x: x <> '') AS tokens
      FROM raw)
SELECT entity_id, week_start,
  CASE WHEN len(tokens) = 0 THEN NULL WHEN tokens = ['ok'] THEN 'OK'
    WHEN entity_id <> 3 THEN upper(array_to_string(tokens, ';')) END AS quality_flag,
  CASE WHEN tokens = ['ok'] THEN '' ELSE array_to_string(list_filter(tokens, lambda x: x NOT IN ('low_temporal_coverage',
    'low_spatial_coverage', 'rain_missing', 'climate_missing', 'low_weather_coverage')), ',') END AS unknown_tokens
FROM t
""",
)
def quality_token_normalize(p: Panels) -> DataFrame:
    noisy = F.concat(
        F.regexp_replace("weather_quality_flag", ";", " ; "),
        F.when(F.col("entity_id") == 3, ";Sensor_Drift").otherwise(""),
    )
    empty = F.datediff("week_start", F.lit("1994-12-31").cast("date")) == 7
    rows = p.weather_weekly.select(
        "entity_id", "week_start", F.when(empty, " ; ").otherwise(noisy).alias("flag")
    )
    return rows.select(
        "entity_id", "week_start",
        C.normalize_quality_tokens("flag").alias("quality_flag"),
        F.array_join(C.unknown_quality_tokens("flag"), ",").alias("unknown_tokens"),
    )


@query(
    "off_grid_keys",
    """
SELECT DISTINCT o.entity_id, o.start_day AS week_start FROM offset_obs o
WHERE NOT EXISTS (SELECT 1 FROM spine s WHERE s.entity_id = o.entity_id AND s.week_start = o.start_day)
""",
)
def off_grid_keys(p: Panels) -> DataFrame:
    moved = p.offset_obs.select("entity_id", F.col("start").alias("week_start"))
    return C.missing_keys(moved, p.spine, ["entity_id", "week_start"])


@query(
    "label_conflicts",
    """
SELECT week_start, count(*)::BIGINT AS n_labels FROM (
  SELECT DISTINCT week_start, year, CASE WHEN entity_id = 3 AND cases > 1 THEN week + 1 ELSE week END AS week
  FROM labelled_obs) GROUP BY 1 HAVING count(*) > 1
""",
)
def label_conflicts(p: Panels) -> DataFrame:
    wrong = (F.col("entity_id") == 3) & (F.col("cases") > 1)
    rows = p.labelled_obs.withColumn("week", F.when(wrong, F.col("week") + 1).otherwise(F.col("week")))
    return C.label_conflicts(rows, "week_start", ["year", "week"])


@query(
    "grid_step_check",
    """
SELECT entity_id, week_start, step_days, step_days % 7 <> 0 AS off_grid FROM (
  SELECT entity_id, week_start, (week_start - lag(week_start) OVER (PARTITION BY entity_id ORDER BY week_start))::BIGINT
    AS step_days FROM weekly_obs) WHERE step_days <> 7
""",
)
def grid_step_check(p: Panels) -> DataFrame:
    return C.bad_grid_steps(p.weekly_obs).withColumn("off_grid", F.col("step_days") % 7 != 0)


_BAD = "entity_id || '|' || week_start"


@query(
    "target_alignment",
    f"""
SELECT 'cases_next_week' AS column_name, count(*) FILTER (stored IS DISTINCT FROM truth)::BIGINT AS violations FROM (
  SELECT a.target_h1 + CASE WHEN {sql_digest("a.entity_id || '|' || a.week_start")} % 97 = 0 THEN 1 ELSE 0 END AS stored, b.value AS truth
  FROM origins a LEFT JOIN obs_panel b ON b.entity_id = a.entity_id AND b.week_start = a.week_start + 7)
""",
)
def target_alignment(p: Panels) -> DataFrame:
    slip = F.when(digest_int("entity_id", "week_start") % 97 == 0, 1).otherwise(0)
    rows = p.origins.withColumn("cases_next_week", F.col("target_h1") + slip)
    return C.misaligned(rows, "cases", {"cases_next_week": -1})


@query(
    "lag_alignment",
    f"""
WITH s AS (SELECT a.*, {sql_digest("a.entity_id || '|' || a.week_start")} % 97 = 0 AS slip FROM origins a)
SELECT 'cases_lag_1' AS column_name, count(*) FILTER ((a.cases_lag_1 + slip::INT) IS DISTINCT FROM b.value)::BIGINT AS violations
FROM s a LEFT JOIN obs_panel b ON b.entity_id = a.entity_id AND b.week_start = a.week_start - 7
UNION ALL
SELECT 'cases_lag_2', count(*) FILTER (a.cases_lag_2 IS DISTINCT FROM b.value)
FROM s a LEFT JOIN obs_panel b ON b.entity_id = a.entity_id AND b.week_start = a.week_start - 14
UNION ALL
SELECT 'cases_lag_4', count(*) FILTER (a.cases_lag_4 IS DISTINCT FROM b.value)
FROM s a LEFT JOIN obs_panel b ON b.entity_id = a.entity_id AND b.week_start = a.week_start - 28
""",
)
def lag_alignment(p: Panels) -> DataFrame:
    slip = F.when(digest_int("entity_id", "week_start") % 97 == 0, 1).otherwise(0)
    rows = p.origins.withColumn("cases_lag_1", F.col("cases_lag_1") + slip)
    return C.misaligned(rows, "cases", {"cases_lag_1": 1, "cases_lag_2": 2, "cases_lag_4": 4})


@query(
    "weather_coverage_check",
    """
WITH w AS (SELECT entity_id, weather_temporal_coverage_pct AS cov, NULL::DOUBLE AS wind_ms,
  CASE WHEN entity_id <> 3 THEN rainfall_sum_mm END AS rain FROM weather_weekly)
SELECT 'all_rows_low' AS rule, NULL::BIGINT AS entity_id WHERE (SELECT count(*) FROM w WHERE cov >= 100.5) = 0
UNION ALL SELECT 'variable_all_null:rain', NULL WHERE (SELECT count(rain) FROM w) = 0
UNION ALL SELECT 'variable_all_null:wind_ms', NULL WHERE (SELECT count(wind_ms) FROM w) = 0
UNION ALL SELECT 'entity_all_null', entity_id::BIGINT FROM w GROUP BY entity_id HAVING count(rain) = 0 AND count(wind_ms) = 0
""",
)
def weather_coverage_check(p: Panels) -> DataFrame:
    rows = p.weather_weekly.select(
        "entity_id", "weather_temporal_coverage_pct",
        F.lit(None).cast("double").alias("wind_ms"),
        F.when(F.col("entity_id") != 3, F.col("rainfall_sum_mm")).alias("rain"),
    )
    return C.weather_coverage_violations(
        rows, variables=["rain", "wind_ms"], coverage="weather_temporal_coverage_pct", threshold=100.5
    )


@query(
    "control_total_check",
    f"""
WITH rep AS (SELECT week_start, (sum(value) + CASE WHEN {sql_digest("week_start::VARCHAR")} % 9 = 0 THEN 1 ELSE 0 END)::BIGINT
    AS reported FROM weekly_obs GROUP BY 1),
parts AS (SELECT week_start, component, sum(value)::BIGINT AS v FROM components GROUP BY 1, 2),
s AS (SELECT week_start, sum(v)::BIGINT AS sum_of_parts, count(*)::BIGINT AS n_parts FROM parts GROUP BY 1)
SELECT r.week_start, reported, sum_of_parts, n_parts, CASE WHEN coalesce(n_parts, 0) <> 5 THEN 'incomplete'
  WHEN sum_of_parts <> reported THEN 'mismatch' ELSE 'ok' END AS status
FROM rep r LEFT JOIN s ON s.week_start = r.week_start
""",
)
def control_total_check(p: Panels) -> DataFrame:
    off = F.when(digest_int("week_start") % 9 == 0, 1).otherwise(0)
    reported = p.weekly_obs.groupBy("week_start").agg(F.sum("value").alias("t")).select(
        "week_start", (F.col("t") + off).alias("reported")
    )
    parts = p.components.groupBy("week_start", "component").agg(F.sum("value").alias("v"))
    return C.control_totals(
        parts, reported, group=["week_start"], value="v", total="reported", expected_parts=5
    )


@query(
    "baseline_guard",
    f"""
WITH b AS (SELECT entity_id, week_start, value FROM weekly_obs WHERE week_start < DATE '2000-01-01'),
c AS (SELECT entity_id, week_start, CASE WHEN d % 50 = 1 THEN value + 1 ELSE value END AS value
      FROM (SELECT *, {sql_digest(_BAD)} AS d FROM weekly_obs) WHERE d % 50 <> 0)
SELECT coalesce(b.entity_id, c.entity_id) AS entity_id, coalesce(b.week_start, c.week_start) AS week_start,
  b.value AS b_value, c.value AS c_value,
  CASE WHEN c.entity_id IS NULL THEN 'deleted' WHEN b.entity_id IS NULL AND year(c.week_start) = 2000 THEN 'review'
    WHEN b.entity_id IS NULL THEN 'added' ELSE 'changed' END AS change
FROM b FULL JOIN c ON b.entity_id = c.entity_id AND b.week_start = c.week_start
WHERE b.entity_id IS NULL OR c.entity_id IS NULL OR b.value IS DISTINCT FROM c.value
""",
)
def baseline_guard(p: Panels) -> DataFrame:
    keys = ["entity_id", "week_start"]
    d = digest_int("entity_id", "week_start") % 50
    base = p.weekly_obs.filter(F.col("week_start") < F.lit("2000-01-01").cast("date"))
    cand = p.weekly_obs.filter(d != 0).withColumn(
        "value", F.when(d == 1, F.col("value") + 1).otherwise(F.col("value"))
    )
    return C.guard_baseline(base, cand, keys, ["value"], review=F.year("week_start") == 2000)


@query(
    "date_cutoff_audit",
    """
WITH t AS (SELECT 'order_day' AS column_name, o_orderdate::DATE::VARCHAR AS v FROM orders
  UNION ALL SELECT 'day_text', trim(day_text) FROM date_texts),
q AS (SELECT column_name, v, try_cast(substr(v, 1, 10) AS DATE) AS d FROM t)
SELECT column_name, min(d) AS min_date, max(d) AS max_date,
  count(*) FILTER (d >= DATE '2000-01-01')::BIGINT AS rows_at_or_after,
  count(*) FILTER (v IS NOT NULL AND d IS NULL)::BIGINT AS unparseable FROM q GROUP BY 1
""",
)
def date_cutoff_audit(p: Panels) -> DataFrame:
    days = p.table("orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("order_day")
    )
    texts = date_texts(p).select(F.col("o_orderkey").alias("k"), F.trim("day_text").alias("day_text"))
    both = days.join(texts, F.col("o_orderkey") == F.col("k"))
    return C.date_cutoff_audit(both, ["order_day", "day_text"], "2000-01-01")


@query(
    "daily_grid_gaps",
    """
WITH b AS (SELECT min(day) AS lo, max(day) AS hi FROM rain_daily),
g AS (SELECT n_nationkey AS entity_id, d::DATE AS day FROM nation, b, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS t(d))
SELECT g.entity_id, count(*)::BIGINT AS n_missing, min(g.day) AS first_missing, max(g.day) AS last_missing
FROM g LEFT JOIN rain_daily r ON r.entity_id = g.entity_id AND r.day = g.day WHERE r.entity_id IS NULL GROUP BY 1
""",
)
def daily_grid_gaps(p: Panels) -> DataFrame:
    bounds = p.rain_daily.agg(F.struct(F.min("day").alias("lo"), F.max("day").alias("hi"))).scalar()
    # the scalar is read once per entity, before the days are spread
    entities = p.entities.withColumn("_b", bounds)
    gaps = C.daily_grid_gaps(p.rain_daily, entities, F.col("_b"))
    return gaps.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n_missing"),
        F.min("day").alias("first_missing"),
        F.max("day").alias("last_missing"),
    )


@query(
    "hourly_completeness",
    """
WITH h AS (SELECT event_type AS node, date_trunc('hour', ts) AS hour, count(*)::BIGINT AS n,
    count(CASE WHEN value <= 100 THEN 1 END)::BIGINT AS ok, count(CASE WHEN value > 100 THEN 1 END)::BIGINT AS bad
  FROM events GROUP BY 1, 2)
SELECT node, hour::DATE AS day, count(*)::BIGINT AS distinct_hours, sum(n)::BIGINT AS rows,
  sum(n)::BIGINT AS complete_rows, sum(bad)::BIGINT AS humidity_out_of_range
FROM h GROUP BY 1, 2 HAVING count(*) <> 24 OR sum(n) <> 24 OR sum(bad) > 0
""",
)
def hourly_completeness(p: Panels) -> DataFrame:
    readings = p.table("events").select(
        F.col("event_type").alias("node"), F.col("ts").alias("hour"),
        F.col("value").alias("temp"), F.col("value").alias("rh"),
    )
    return weather.hourly_completeness(readings)


@query(
    "feature_input_check",
    """
WITH c AS (SELECT CASE WHEN c_custkey % 40 = 0 THEN NULL ELSE c_nationkey END AS entity_id,
  CASE WHEN c_custkey % 10 = 0 THEN 'inf'::DOUBLE ELSE c_acctbal END AS balance,
  CASE WHEN c_custkey % 15 = 0 THEN 'nan'::DOUBLE WHEN c_custkey % 16 = 0 THEN NULL ELSE c_acctbal END AS score FROM customer)
SELECT 'entity_id:null' AS rule, count(*) FILTER (entity_id IS NULL)::BIGINT AS violations FROM c
UNION ALL SELECT 'entity_id:unknown', count(*) FILTER (entity_id >= 20) FROM c
UNION ALL SELECT 'balance:not_finite', count(*) FILTER (isinf(balance)) FROM c
UNION ALL SELECT 'score:not_finite', count(*) FILTER (isnan(score)) FROM c
""",
)
def feature_input_check(p: Panels) -> DataFrame:
    k = F.col("c_custkey")
    rows = p.table("customer").select(
        F.when(k % 40 != 0, F.col("c_nationkey")).alias("entity_id"),
        F.when(k % 10 == 0, float("inf")).otherwise(F.col("c_acctbal")).alias("balance"),
        F.when(k % 15 == 0, float("nan")).when(k % 16 != 0, F.col("c_acctbal")).alias("score"),
    )
    levels = p.entities.filter("entity_id < 20")
    return C.feature_input_violations(
        rows, numeric=["balance", "score"], category="entity_id", levels=levels
    )


@query(
    "provenance_crosscheck",
    """
WITH prov AS (SELECT entity_id, week_start, string_agg(value::VARCHAR, '|' ORDER BY component) AS component_values,
    sum(value)::BIGINT AS total FROM components GROUP BY 1, 2)
SELECT o.entity_id, o.week_start, o.value, component_values, total AS component_total, o.value = total AS agrees
FROM weekly_obs o JOIN prov p ON p.entity_id = o.entity_id AND p.week_start = o.week_start
""",
)
def provenance_crosscheck(p: Panels) -> DataFrame:
    segments = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    keys = ["entity_id", "week_start"]
    prov = normalize.component_provenance(p.components, keys, expected=segments)
    joined = p.weekly_obs.join(prov.select(*keys, "component_values"), keys, "inner")
    total = F.aggregate(
        F.split("component_values", r"\|"),
        F.lit(0).cast("long"),
        lambda acc, v: acc + F.coalesce(v.try_cast("long"), F.lit(0)),
    )
    return joined.withColumn("component_total", total).withColumn(
        "agrees", F.col("value") == F.col("component_total")
    )


@query(
    "finite_nonnegative",
    """
SELECT 'c_acctbal' AS column_name, count(*) FILTER (c_acctbal < 0)::BIGINT AS violations FROM customer
UNION ALL SELECT 'c_custkey', count(*) FILTER (c_custkey < 0) FROM customer
""",
)
def finite_nonnegative(p: Panels) -> DataFrame:
    return C.not_finite_nonnegative(
        p.table("customer"), ["c_acctbal", "c_custkey"], allow_null=False
    )


@query(
    "panel_observations_check",
    """
SELECT 'empty_table' AS rule, CASE WHEN (SELECT count(*) FROM weekly_obs) = 0 THEN 1 ELSE 0 END::BIGINT AS violations
UNION ALL SELECT 'duplicate_key', (SELECT count(*) FROM (SELECT 1 FROM multi_source GROUP BY entity_id, week_start HAVING count(*) > 1))
UNION ALL SELECT 'bad_interval', 0
UNION ALL SELECT 'null_entity', (SELECT count(*) FROM multi_source WHERE entity_id IS NULL)
UNION ALL SELECT 'past_cutoff', (SELECT count(*) FROM multi_source WHERE week_start + 6 >= DATE '2001-01-01')
UNION ALL SELECT 'not_finite_nonnegative', (SELECT count(*) FROM multi_source WHERE value < 0)
""",
)
def panel_observations_check(p: Panels) -> DataFrame:
    rows = p.multi_source.withColumn("week_end", plus_days("week_start", 6))
    return C.panel_contract(
        rows, entity="entity_id", start="week_start", end="week_end", value="value", cutoff="2001-01-01"
    )
