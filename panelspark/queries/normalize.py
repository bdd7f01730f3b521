"""Source normalisation, conflicts, quarantine and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions import text as X
from panelspark.functions.columns import digest_int, plus_days
from panelspark.operators import normalize as N
from panelspark.queries.base import cte, query
from panelspark.queries.contracts import sql_digest
from panelspark.session import stage_table
from panelspark.sources.panels import Panels

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
KEYS = ["entity_id", "week_start"]

cte(
    "printed_names",
    """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '  nation_' || c_nationkey || ' '
  WHEN 1 THEN 'NATION-' || c_nationkey WHEN 2 THEN 'Nation   ' || c_nationkey
  ELSE 'Province ' || c_nationkey END AS printed FROM customer
""",
)
cte(
    "alias_dim",
    """
SELECT DISTINCT entity_id, lower(trim(regexp_replace(replace(trim(a), '-', ' '), '\\s+', ' ', 'g'))) AS alias_key FROM (
  SELECT n_nationkey AS entity_id, unnest([n_name, replace(n_name, '_', '-'), 'No ' || (n_nationkey % 20)]) AS a FROM nation)
""",
)


def printed_names(p: Panels) -> DataFrame:
    k, n = F.col("c_custkey") % 4, F.col("c_nationkey").cast("string")
    printed = (
        F.when(k == 0, F.concat(F.lit("  nation_"), n, F.lit(" ")))
        .when(k == 1, F.concat(F.lit("NATION-"), n))
        .when(k == 2, F.concat(F.lit("Nation   "), n))
        .otherwise(F.concat(F.lit("Province "), n))
    )
    return p.table("customer").select("c_custkey", printed.alias("printed"))


def alias_dim(p: Panels) -> DataFrame:
    name = F.col("n_name")
    short = F.concat(F.lit("No "), (F.col("n_nationkey") % 20).cast("string"))
    named = p.table("nation").select(
        F.col("n_nationkey").alias("entity_id"),
        F.array(name, F.regexp_replace(name, "_", "-"), short).alias("aliases"),
    )
    return N.alias_dimension(named, entity="entity_id", aliases="aliases")


@query(
    "alias_resolve",
    """
SELECT c_custkey, k AS alias_key, entity_id FROM (
  SELECT c_custkey, lower(trim(regexp_replace(replace(trim(printed), '-', ' '), '\\s+', ' ', 'g'))) AS k FROM printed_names)
LEFT JOIN (SELECT * FROM alias_dim WHERE alias_key LIKE 'nation%') d ON d.alias_key = k
""",
)
def alias_resolve(p: Panels) -> DataFrame:
    dim = alias_dim(p).filter(F.col("alias_key").startswith("nation"))
    return N.resolve_aliases(printed_names(p), dim, name="printed").select(
        "c_custkey", "alias_key", "entity_id"
    )


@query(
    "alias_dimension",
    """
SELECT alias_key, count(*)::BIGINT AS n_entities, min(entity_id) AS first_entity, max(entity_id) AS last_entity
FROM alias_dim GROUP BY 1 HAVING count(*) > 1
""",
)
def alias_dimension(p: Panels) -> DataFrame:
    return N.alias_conflicts(alias_dim(p), entity="entity_id")


cte(
    "components_masked",
    f"""
SELECT entity_id, week_start, component, CASE WHEN {sql_digest("entity_id || '|' || week_start || '|' || component")} % 13 <> 0
  THEN value END AS value FROM components
""",
)


def components_masked(p: Panels) -> DataFrame:
    hit = digest_int("entity_id", "week_start", "component") % 13 != 0
    return p.components.withColumn("value", F.when(hit, F.col("value")))


@query(
    "component_rollup",
    """
SELECT entity_id, week_start, count(component)::BIGINT AS n_present, count(value)::BIGINT AS n_observed,
  CASE WHEN count(component) = 5 AND count(value) = 5 THEN sum(value)::BIGINT END AS value,
  CASE WHEN count(component) = 5 AND count(value) = 5 THEN 'observed' ELSE 'missing' END AS case_status
FROM components_masked GROUP BY 1, 2
""",
)
def component_rollup(p: Panels) -> DataFrame:
    return N.component_rollup(components_masked(p), KEYS, expected=len(SEGMENTS))


@query(
    "component_provenance",
    """
WITH g AS (SELECT entity_id, week_start, string_agg(component, '|' ORDER BY component) AS component_names,
    string_agg(coalesce(value::VARCHAR, ''), '|' ORDER BY component) AS component_values,
    list(component) AS c, list(component) FILTER (value IS NOT NULL) AS o FROM components_masked GROUP BY 1, 2),
x AS (SELECT *, list_filter(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], lambda s: NOT list_contains(c, s)) AS absent,
    list_filter(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'],
      lambda s: list_contains(c, s) AND NOT coalesce(list_contains(o, s), false)) AS unobs FROM g)
SELECT entity_id, week_start, component_names, component_values,
  CASE WHEN len(absent) = 0 AND len(unobs) = 0 THEN 'complete' ELSE 'incomplete' END AS completeness,
  concat_ws('; ', CASE WHEN len(absent) > 0 THEN 'missing expected components: ' || array_to_string(absent, ', ') END,
    CASE WHEN len(unobs) > 0 THEN 'components not observed/non-null: ' || array_to_string(unobs, ', ') END) AS integrity_issue
FROM x
""",
)
def component_provenance(p: Panels) -> DataFrame:
    return N.component_provenance(components_masked(p), KEYS, expected=SEGMENTS)


@query(
    "exact_dedupe",
    "SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority, year(o_orderdate)::BIGINT AS year FROM orders",
)
def exact_dedupe(p: Panels) -> DataFrame:
    return (
        p.table("orders")
        .select(
            "o_custkey", "o_orderstatus", "o_orderpriority",
            F.year("o_orderdate").cast("long").alias("year"),
        )
        .dropDuplicates()
    )


cte(
    "reports",
    f"""
SELECT entity_id, week_start, source, CASE WHEN {sql_digest("entity_id || '|' || week_start || '|' || source")} % 4 <> 0 THEN value END AS value,
  CASE WHEN {sql_digest("entity_id || '|' || week_start || '|' || source")} % 4 <> 0 THEN 'observed' ELSE 'missing' END AS case_status
FROM multi_source
""",
)


def reports(p: Panels) -> DataFrame:
    seen = digest_int("entity_id", "week_start", "source") % 4 != 0
    return p.multi_source.select(
        "entity_id", "week_start", "source",
        F.when(seen, F.col("value")).alias("value"),
        F.when(seen, "observed").otherwise("missing").alias("case_status"),
    )


@query(
    "conflict_resolve",
    """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, week_start ORDER BY source) AS any_rank,
    row_number() OVER (PARTITION BY entity_id, week_start ORDER BY value IS NULL, source) AS obs_rank FROM reports),
k AS (SELECT entity_id, week_start, count(DISTINCT value) AS n FROM reports GROUP BY 1, 2)
SELECT r.entity_id, r.week_start, n > 1 AS is_conflict, r.source,
  CASE WHEN n <= 1 THEN r.value END AS value, CASE WHEN n > 1 THEN 'missing' ELSE r.case_status END AS case_status
FROM r JOIN k ON k.entity_id = r.entity_id AND k.week_start = r.week_start
WHERE (n = 1 AND obs_rank = 1) OR (n <> 1 AND any_rank = 1)
""",
)
def conflict_resolve(p: Panels) -> DataFrame:
    return N.resolve_conflicts(
        reports(p), KEYS, value="value", status="case_status", order=["source"]
    )


@query(
    "conflict_pairs",
    """
WITH o AS (SELECT *, first_value(source) OVER w AS s0, first_value(value) OVER w AS v0 FROM reports
  WHERE value IS NOT NULL WINDOW w AS (PARTITION BY entity_id, week_start ORDER BY source))
SELECT entity_id, week_start, CASE WHEN swap THEN source ELSE s0 END AS source_a, CASE WHEN swap THEN value ELSE v0 END AS value_a,
  CASE WHEN swap THEN s0 ELSE source END AS source_b, CASE WHEN swap THEN v0 ELSE value END AS value_b,
  'unresolved_official_conflict' AS resolution
FROM (SELECT *, source < s0 OR (source = s0 AND value::VARCHAR < v0::VARCHAR) AS swap FROM o WHERE value <> v0)
""",
)
def conflict_pairs(p: Panels) -> DataFrame:
    return N.conflict_pairs(reports(p), KEYS, source="source", value="value", order=["source"])


@query(
    "group_quarantine",
    """
WITH v AS (SELECT week_start, max(CASE WHEN value >= 4 THEN 1 ELSE 0 END) AS bad,
    min(CASE WHEN value >= 4 THEN 'implausible ' || source END) AS quarantine_reason FROM reports GROUP BY 1)
SELECT r.*, v.quarantine_reason, v.bad = 1 AS quarantined FROM reports r JOIN v ON v.week_start = r.week_start
""",
)
def group_quarantine(p: Panels) -> DataFrame:
    bad = F.coalesce(F.col("value") >= 4, F.lit(False))
    reason = F.concat(F.lit("implausible "), F.col("source"))
    return N.quarantine_groups(reports(p), ["week_start"], bad, reason)


cte(
    "issue_messages",
    """
SELECT week_start, o_orderstatus, value, CASE value % 6
  WHEN 0 THEN 'National reconciliation failed: COMPONENT sum ' || value || ' != national ' || (value + 3)
  WHEN 1 THEN 'printed PERIOD could not be read' WHEN 2 THEN 'cumulative column is ambiguous'
  WHEN 3 THEN 'Duplicate source components for area ' || o_orderstatus
  WHEN 4 THEN 'layout is unsupported' ELSE 'disk on fire' END AS text
FROM status_totals
""",
)


def issue_messages(p: Panels) -> DataFrame:
    v, t = F.col("value"), F.col("value").cast("string")
    text = (
        F.when(
            v % 6 == 0,
            F.concat(
                F.lit("National reconciliation failed: COMPONENT sum "), t,
                F.lit(" != national "), (v + 3).cast("string"),
            ),
        )
        .when(v % 6 == 1, "printed PERIOD could not be read")
        .when(v % 6 == 2, "cumulative column is ambiguous")
        .when(v % 6 == 3, F.concat(F.lit("Duplicate source components for area "), "o_orderstatus"))
        .when(v % 6 == 4, "layout is unsupported")
        .otherwise("disk on fire")
    )
    return p.status_totals.select("week_start", "o_orderstatus", "value", text.alias("text"))


@query(
    "quarantine_reason",
    """
SELECT week_start, o_orderstatus, CASE value % 6 WHEN 0 THEN 'SOURCE_CONFLICT' WHEN 1 THEN 'REPORTING_PERIOD_AMBIGUITY'
    WHEN 2 THEN 'CUMULATIVE_WEEKLY_AMBIGUITY' WHEN 3 THEN 'DISTRICT_TABLE_INCOMPLETE' WHEN 4 THEN 'PARSER_ERROR'
    ELSE 'UNKNOWN' END AS error_reason,
  CASE WHEN lower(text) LIKE '%duplicate%' OR lower(text) LIKE '%revision%' THEN 'DUPLICATE_OR_REVISION'
    WHEN lower(text) LIKE '%conflict%' OR lower(text) LIKE '%reconciliation%' THEN 'SOURCE_CONFLICT'
    WHEN value % 6 = 1 THEN 'REPORTING_PERIOD_AMBIGUITY' WHEN value % 6 = 2 THEN 'CUMULATIVE_WEEKLY_AMBIGUITY'
    WHEN value % 6 = 4 THEN 'PARSER_ERROR' ELSE 'UNKNOWN' END AS normalization_reason
FROM issue_messages
""",
)
def quarantine_reason(p: Panels) -> DataFrame:
    return issue_messages(p).select(
        "week_start", "o_orderstatus", N.error_reason("text").alias("error_reason"),
        N.normalization_reason("text").alias("normalization_reason"),
    )


@query(
    "message_conflict_extract",
    """
SELECT week_start, o_orderstatus, nullif(regexp_extract(text, 'sum (\\d+) != national (\\d+)', 2), '')::BIGINT AS value_a,
  nullif(regexp_extract(text, 'sum (\\d+) != national (\\d+)', 1), '')::BIGINT AS value_b
FROM issue_messages WHERE text LIKE '%reconciliation%'
""",
)
def message_conflict_extract(p: Panels) -> DataFrame:
    nums = N.mismatch_numbers("text")
    return (
        issue_messages(p)
        .select("week_start", "o_orderstatus", *[c.alias(n) for n, c in nums.items()])
        .filter(F.col("value_a").isNotNull())
    )


cte(
    "mixed_weeks",
    """
SELECT entity_id, week_start AS start_day, value FROM weekly_obs WHERE entity_id % 4 <> 0
UNION ALL SELECT entity_id, start_day, value FROM offset_obs WHERE entity_id % 4 = 0
""",
)


def mixed_weeks(p: Panels) -> DataFrame:
    sat = p.weekly_obs.filter("entity_id % 4 <> 0").withColumnRenamed("week_start", "start_day")
    mon = p.offset_obs.filter("entity_id % 4 = 0").select(
        "entity_id", F.col("start").alias("start_day"), "value"
    )
    return sat.unionByName(mon)


@query(
    "dominant_weekday_filter",
    """
WITH d AS (SELECT isodow(start_day) AS wd, count(*) AS n FROM mixed_weeks GROUP BY 1 ORDER BY n DESC, wd LIMIT 1)
SELECT entity_id, start_day, value, isodow(start_day) <> (SELECT wd FROM d) AS off_anchor FROM mixed_weeks
""",
)
def dominant_weekday_filter(p: Panels) -> DataFrame:
    return N.split_by_weekday(mixed_weeks(p), "start_day")


@query(
    "coverage_by_year_source",
    """
SELECT year, (count(DISTINCT week_start) * count(DISTINCT entity_id))::BIGINT AS expected, count(cases)::BIGINT AS observed,
  (count(DISTINCT week_start) * count(DISTINCT entity_id) - count(cases))::BIGINT AS missing,
  round(100.0::DOUBLE * count(cases) / (count(DISTINCT week_start) * count(DISTINCT entity_id)), 2) AS coverage_pct
FROM labelled_obs GROUP BY 1
""",
)
def coverage_by_year_source(p: Panels) -> DataFrame:
    return N.coverage_by_year(
        p.labelled_obs, year="year", entity="entity_id", week="week_start", value="cases"
    )


cte(
    "overlap_pairs",
    """
SELECT a.entity_id, a.week_start AS a_start, a.week_start + 6 AS a_end, a.value AS a_value, b.start_day AS b_start,
  b.end_day AS b_end, b.value AS b_value, greatest(a.week_start, b.start_day) AS overlap_start,
  least(a.week_start + 6, b.end_day) AS overlap_end,
  (least(a.week_start + 6, b.end_day) - greatest(a.week_start, b.start_day) + 1)::BIGINT AS overlap_days,
  a.week_start = b.start_day AND a.week_start + 6 = b.end_day AS exact_interval
FROM weekly_obs a JOIN (
  SELECT entity_id, start_day, end_day, value FROM offset_obs WHERE entity_id % 5 <> 0
  UNION ALL SELECT entity_id, week_start, week_start + 6, value + 1 FROM weekly_obs WHERE entity_id % 5 = 0) b
  ON a.entity_id = b.entity_id AND a.week_start <= b.end_day AND a.week_start + 6 >= b.start_day
""",
)


def overlap_pairs(p: Panels) -> DataFrame:
    """The weekly tables are staged: the join reads each side for its length classes and for its rows."""
    sat = stage_table(
        p.weekly_obs.select(
            "entity_id", F.col("week_start").alias("start"), plus_days("week_start", 6).alias("end"), "value"
        ),
        "weekly_intervals",
    )
    other = stage_table(p.offset_obs.filter("entity_id % 5 <> 0"), "offset_intervals").unionByName(
        sat.filter("entity_id % 5 = 0").withColumn("value", F.col("value") + 1)
    )
    return N.overlap_join(sat, other)


@query(
    "interval_overlap_join",
    "SELECT entity_id, a_start, a_end::DATE AS a_end, a_value, b_start, b_end::DATE AS b_end, b_value,"
    " overlap_start, overlap_end::DATE AS overlap_end, overlap_days, exact_interval FROM overlap_pairs",
)
def interval_overlap_join(p: Panels) -> DataFrame:
    return overlap_pairs(p)


@query(
    "comparison_summary",
    """
SELECT CASE WHEN exact_interval THEN 'exact_interval' ELSE 'not_comparable_interval' END AS reason, count(*)::BIGINT AS pairs,
  count(DISTINCT b_start)::BIGINT AS periods, sum(overlap_days)::BIGINT AS overlap_days,
  count(*) FILTER (a_value = b_value)::BIGINT AS equal_values FROM overlap_pairs GROUP BY 1
""",
)
def comparison_summary(p: Panels) -> DataFrame:
    return N.comparison_summary(
        overlap_pairs(p), exact="exact_interval", period="b_start", left="a_value", right="b_value"
    )


@query(
    "conflict_union_dedupe",
    """
WITH pairs AS (SELECT week_start, value AS value_a, 'accepted_cross_source' AS conflict_type, source FROM reports WHERE value >= 2),
msg AS (SELECT week_start, value AS value_a, 'within_report_national' AS conflict_type, NULL::VARCHAR AS source
        FROM issue_messages WHERE value % 6 = 0),
u AS (SELECT * FROM pairs UNION ALL SELECT * FROM msg)
SELECT conflict_type, week_start, value_a, min(source) AS source FROM u GROUP BY 1, 2, 3
""",
)
def conflict_union_dedupe(p: Panels) -> DataFrame:
    pairs = reports(p).filter("value >= 2").select(
        F.lit("accepted_cross_source").alias("conflict_type"), "week_start",
        F.col("value").alias("value_a"), "source",
    )
    msg = issue_messages(p).filter(F.col("value") % 6 == 0).select(
        F.lit("within_report_national").alias("conflict_type"), "week_start",
        F.col("value").alias("value_a"),
    )
    return N.union_dedupe(pairs, msg, ["conflict_type", "week_start", "value_a"], order=["source"])


cte(
    "first_weeks",
    """
SELECT year, entity_id, coalesce(value, 0) AS weekly, coalesce(value, 0) + CASE WHEN year % 3 = 0 AND entity_id = 4 THEN 1 ELSE 0 END AS cumulative,
  reported, total FROM (
  SELECT year(s.week_start)::BIGINT AS year, s.entity_id, s.value, row_number() OVER (PARTITION BY s.entity_id, year(s.week_start) ORDER BY s.week_start) AS rn,
    sum(coalesce(value, 0)) OVER (PARTITION BY s.week_start)::BIGINT AS total,
    (sum(coalesce(value, 0)) OVER (PARTITION BY s.week_start) + year(s.week_start) % 2)::BIGINT AS reported
  FROM obs_panel s) WHERE rn = 1
""",
)


def first_weeks(p: Panels) -> DataFrame:
    """First week of each year: weekly and cumulative counts with printed and cumulative totals."""
    panel = p.obs_panel.withColumn("year", F.year("week_start").cast("long"))
    firsts = panel.groupBy("year").agg(F.min("week_start").alias("week_start"))
    rows = panel.join(firsts, ["year", "week_start"]).withColumn(
        "weekly", F.coalesce("value", F.lit(0))
    )
    totals = rows.groupBy("year").agg(F.sum("weekly").alias("total"))
    odd = F.when((F.col("year") % 3 == 0) & (F.col("entity_id") == 4), 1).otherwise(0)
    return (
        rows.join(totals, "year")
        .withColumn("cumulative", F.col("weekly") + odd)
        .withColumn("reported", F.col("total") + F.col("year") % 2)
        .select("year", "entity_id", "weekly", "cumulative", "reported", "total")
    )


@query(
    "first_week_corroboration",
    """
SELECT year, count(*)::BIGINT AS n_rows, sum(weekly)::BIGINT AS calculated, max(reported) AS reported, max(total) AS cumulative_total
FROM first_weeks GROUP BY 1
HAVING count(*) = 25 AND bool_and(weekly = cumulative) AND sum(weekly) = max(total) AND max(reported) <> sum(weekly)
""",
)
def first_week_corroboration(p: Panels) -> DataFrame:
    return N.first_period_corroboration(
        first_weeks(p), ["year"], current="weekly", cumulative="cumulative", reported="reported",
        total="total", expected_rows=25,
    )


@query(
    "corroboration_warnings",
    """
WITH ok AS (SELECT year, sum(weekly)::BIGINT AS calculated FROM first_weeks GROUP BY 1
  HAVING count(*) = 25 AND bool_and(weekly = cumulative) AND sum(weekly) = max(total) AND max(reported) <> sum(weekly))
SELECT f.year, 'accepted_first_week_corroboration' AS warning_type, max(f.reported) AS raw_reported, max(ok.calculated) AS calculated,
  max(f.total) AS corroborating_total, max(ok.calculated) AS chosen_value, count(*)::BIGINT AS quality_rows
FROM first_weeks f JOIN ok ON ok.year = f.year GROUP BY 1
""",
)
def corroboration_warnings(p: Panels) -> DataFrame:
    accepted = N.first_period_corroboration(
        first_weeks(p), ["year"], current="weekly", cumulative="cumulative", reported="reported",
        total="total", expected_rows=25,
    ).select("year", "calculated")
    quality = first_weeks(p).join(accepted, "year")
    return N.corroboration_warnings(
        quality, ["year"], reported="reported", calculated="calculated", corroborating="total"
    )


@query(
    "issue_summary",
    """
WITH c AS (SELECT (SELECT count(*) FROM reports WHERE value >= 2) AS a, (SELECT count(*) FROM issue_messages WHERE value % 6 = 0) AS b)
SELECT a::BIGINT AS accepted_cross_source, b::BIGINT AS within_report_national, (a + b)::BIGINT AS total_issues,
  CASE WHEN b > 0 THEN 'unresolved_or_quarantined_conflicts_present' ELSE 'no_unresolved_or_quarantined_conflicts_reported' END AS status
FROM c
""",
)
def issue_summary(p: Panels) -> DataFrame:
    kinds = (
        reports(p).filter("value >= 2").select(F.lit("accepted_cross_source").alias("conflict_type"))
    ).unionByName(
        issue_messages(p)
        .filter(F.col("value") % 6 == 0)
        .select(F.lit("within_report_national").alias("conflict_type"))
    )
    return N.issue_summary(kinds)


@query(
    "requested_coverage",
    """
WITH weeks AS (SELECT d::DATE AS week_start FROM unnest(generate_series(DATE '1996-01-06', DATE '2001-12-29', INTERVAL 7 DAY)) AS t(d)),
e AS (SELECT n_nationkey AS entity_id, week_start FROM nation, weeks)
SELECT year(e.week_start)::BIGINT AS year, count(*)::BIGINT AS expected_rows, count(o.value)::BIGINT AS observed_reports,
  round(100.0::DOUBLE * count(o.value) / count(*), 2) AS report_coverage_pct,
  count(CASE WHEN w.rainfall_sum_mm IS NOT NULL AND w.temp_mean_c IS NOT NULL THEN 1 END)::BIGINT AS observed_weather,
  round(100.0::DOUBLE * count(CASE WHEN w.rainfall_sum_mm IS NOT NULL AND w.temp_mean_c IS NOT NULL THEN 1 END) / count(*), 2) AS weather_coverage_pct,
  CASE WHEN count(o.value) = count(*) AND count(CASE WHEN w.rainfall_sum_mm IS NOT NULL AND w.temp_mean_c IS NOT NULL THEN 1 END) = count(*)
    THEN 'complete' ELSE 'partial_boundary_or_gaps' END AS status
FROM e LEFT JOIN weekly_obs o ON o.entity_id = e.entity_id AND o.week_start = e.week_start
LEFT JOIN weather_weekly w ON w.entity_id = e.entity_id AND w.week_start = e.week_start
GROUP BY 1
""",
)
def requested_coverage(p: Panels) -> DataFrame:
    wx = p.weather_weekly.select(
        *KEYS,
        (F.col("rainfall_sum_mm").isNotNull() & F.col("temp_mean_c").isNotNull()).alias("has_weather"),
    )
    return N.requested_coverage(
        p.entities, p.weekly_obs, wx, first="1996-01-06", last="2001-12-29",
        value="value", available="has_weather",
    )


cte(
    "report_issues",
    """
SELECT DISTINCT 'archive' AS source, 'https://reports.example/' || strftime(week_start, '%Y%m%d') AS url,
  year(week_start)::BIGINT AS issue_year, weekofyear(week_start)::BIGINT AS issue_week FROM weekly_obs
""",
)


@query(
    "issue_window_filter",
    """
SELECT source, url, issue_year, issue_week FROM report_issues
WHERE issue_year BETWEEN 1997 AND 1999 OR (issue_year = 2000 AND issue_week BETWEEN 1 AND 2)
""",
)
def issue_window_filter(p: Panels) -> DataFrame:
    issues = p.weekly_obs.select(
        F.lit("archive").alias("source"),
        F.concat(F.lit("https://reports.example/"), F.date_format("week_start", "yyyyMMdd")).alias("url"),
        F.year("week_start").cast("long").alias("issue_year"),
        F.weekofyear("week_start").cast("long").alias("issue_week"),
    )
    wanted = N.wanted_issues(issues, start_year=1997, end_year=1999)
    return wanted.dropDuplicates(["source", "url"]).orderBy("issue_year", "issue_week", "url")


@query(
    "zero_report_rule",
    """
WITH r AS (SELECT entity_id, week_start, coalesce(value, 0) AS v, CASE WHEN entity_id % 3 = 0 THEN 0 WHEN entity_id % 3 = 1 THEN 90 END AS pct FROM obs_panel)
SELECT entity_id, week_start, CASE WHEN NOT (v = 0 AND coalesce(pct = 0, false)) THEN v END AS value,
  CASE WHEN v = 0 AND pct = 0 THEN 'missing' ELSE 'observed' END AS case_status,
  CASE WHEN v = 0 AND pct = 0 THEN 'zero_with_zero_returns' WHEN pct IS NULL THEN 'quality_unavailable' END AS completeness_flag
FROM r
""",
)
def zero_report_rule(p: Panels) -> DataFrame:
    k = F.col("entity_id") % 3
    rows = p.obs_panel.select(
        *KEYS, F.coalesce("value", F.lit(0)).alias("v"), F.when(k == 0, 0).when(k == 1, 90).alias("pct")
    )
    rule = N.unobserved_reports("v", "pct")
    return rows.select(*KEYS, *[c.alias(n) for n, c in rule.items()])


cte(
    "printed_periods",
    """
SELECT entity_id, week_start, printed_year, issue_year, day(week_start) || 'th ' ||
  CASE WHEN month(week_start) <> month(week_start + 6) OR entity_id % 2 = 0 THEN monthname(week_start) || ' ' ELSE '' END
  || CASE WHEN entity_id % 3 = 0 THEN '–' ELSE '-' END || ' ' || day(week_start + 6) || 'th ' || monthname(week_start + 6) || ' '
  || printed_year || ' (' || weekofyear(week_start) || 'th Week)' AS text
FROM (SELECT *, CASE WHEN entity_id % 4 = 0 AND month(week_start + 6) = 1 THEN year(week_start + 6) - 1 ELSE year(week_start + 6) END AS printed_year,
        CASE WHEN entity_id % 5 <> 0 THEN year(week_start + 13) END AS issue_year FROM weekly_obs)
""",
)


def printed_periods(p: Panels) -> DataFrame:
    e, start, end = F.col("entity_id"), F.col("week_start"), plus_days("week_start", 6)
    printed = F.when((e % 4 == 0) & (F.month(end) == 1), F.year(end) - 1).otherwise(F.year(end))
    issue = F.when(e % 5 != 0, F.year(plus_days("week_start", 13)))
    show_month = (F.month(start) != F.month(end)) | (e % 2 == 0)
    text = F.concat(
        F.dayofmonth(start).cast("string"), F.lit("th "),
        F.when(show_month, F.concat(F.date_format(start, "MMMM"), F.lit(" "))).otherwise(""),
        F.when(e % 3 == 0, "–").otherwise("-"), F.lit(" "),
        F.dayofmonth(end).cast("string"), F.lit("th "), F.date_format(end, "MMMM"), F.lit(" "),
        printed.cast("string"), F.lit(" ("), F.weekofyear(start).cast("string"), F.lit("th Week)"),
    )
    return p.weekly_obs.select(
        *KEYS, printed.alias("printed_year"), issue.alias("issue_year"), text.alias("text")
    )


@query(
    "period_infer",
    """
WITH c AS (SELECT p.*, y, make_date(y, month(week_start + 6), day(week_start + 6)) AS e,
    CASE WHEN issue_year = printed_year + 1 AND month(week_start + 6) = 1
      AND (month(week_start) = 12 OR NOT (month(week_start) <> month(week_start + 6) OR entity_id % 2 = 0)) THEN issue_year ELSE printed_year END AS anchor
  FROM printed_periods p, unnest(generate_series(printed_year - 2, printed_year + 3)) AS t(y)
  WHERE (abs(y - printed_year) <= 1 OR abs(y - issue_year) <= 1)
    AND NOT (month(week_start + 6) = 2 AND day(week_start + 6) = 29 AND y % 4 <> 0)),
f AS (SELECT *, row_number() OVER (PARTITION BY entity_id, week_start ORDER BY abs(y - anchor), abs(y - printed_year), y) AS rn FROM c
      WHERE day(e - 6) = day(week_start) AND month(e - 6) = month(week_start))
SELECT entity_id, week_start, (e - 6)::DATE AS period_start, e AS period_end, printed_year::BIGINT AS source_year,
  weekofyear(week_start)::BIGINT AS source_week FROM f WHERE rn = 1
""",
)
def period_infer(p: Panels) -> DataFrame:
    parts = X.printed_period("text")
    parsed = printed_periods(p).withColumns(parts)
    end = X.infer_period_end(
        start_day="start_day", start_month="start_month", end_day="end_day", end_month="end_month",
        printed_year="source_year", issue_year="issue_year",
    )
    return (
        parsed.withColumn("period_end", end)
        .withColumn("period_start", F.date_sub("period_end", 6))
        .select(
            *KEYS, "period_start", "period_end", F.col("source_year").cast("long").alias("source_year"),
            F.col("source_week").cast("long").alias("source_week"),
        )
    )


@query(
    "source_calendar",
    """
WITH anchors AS (SELECT year AS source_year, min(week_start) AS anchor FROM labelled_obs WHERE week <= 2 GROUP BY 1),
o AS (SELECT DISTINCT year AS source_year, week + CASE WHEN week = 30 THEN 1 ELSE 0 END AS source_week, week_start FROM labelled_obs)
SELECT o.source_year, source_week, week_start, (anchor + (7 * (source_week - 1))::INT)::DATE AS expected_start,
  week_start IS DISTINCT FROM (anchor + (7 * (source_week - 1))::INT)::DATE AS mismatch,
  source_year || '-W' || lpad(source_week::VARCHAR, 2, '0') AS year_week
FROM o LEFT JOIN anchors a USING (source_year)
""",
)
def source_calendar(p: Panels) -> DataFrame:
    labels = p.labelled_obs.select(
        F.col("year").alias("source_year"), F.col("week").alias("w"), "week_start"
    ).distinct()
    anchors = labels.filter("w <= 2").groupBy("source_year").agg(F.min("week_start").alias("anchor"))
    rows = labels.select(
        "source_year", (F.col("w") + F.when(F.col("w") == 30, 1).otherwise(0)).alias("source_week"), "week_start"
    )
    out = N.source_calendar(rows, anchors)
    return out.select(
        "source_year", "source_week", "week_start", "expected_start",
        (~F.col("week_start").eqNullSafe(F.col("expected_start"))).alias("mismatch"),
        X.year_week_label("source_year", "source_week").alias("year_week"),
    )


cte(
    "document_index",
    """
SELECT 'report_' || strftime(s.week_start, '%Y%m%d') AS document, s.week_start, count(o.value)::BIGINT AS observed_rows,
  count(*) FILTER (WHERE o.value IS NOT NULL OR (s.entity_id + month(s.week_start)) % 5 <> 0)::BIGINT AS n_rows,
  max(CASE WHEN o.value >= 6 THEN 1 ELSE 0 END) AS failed
FROM spine s LEFT JOIN weekly_obs o ON o.entity_id = s.entity_id AND o.week_start = s.week_start GROUP BY 1, 2
""",
)


def document_index(p: Panels) -> DataFrame:
    """One document a week; some leave out entities without cases, so their number of rows differs."""
    printed = F.col("value").isNotNull() | ((F.col("entity_id") + F.month("week_start")) % 5 != 0)
    return p.obs_panel.groupBy("week_start").agg(
        F.count("value").alias("observed_rows"),
        F.count_if(printed).alias("n_rows"),
        F.max(F.when(F.col("value") >= 6, 1).otherwise(0)).alias("failed"),
    ).select(
        F.concat(F.lit("report_"), F.date_format("week_start", "yyyyMMdd")).alias("document"),
        "week_start", "observed_rows", "n_rows", "failed",
    )


_STATUS_SQL = """CASE WHEN failed = 1 THEN 'quarantined'
  WHEN week_start BETWEEN DATE '1996-01-06' AND DATE '2000-12-30' THEN 'parsed' ELSE 'excluded_outside_cohort' END"""


@query(
    "cohort_status",
    f"SELECT document, week_start, observed_rows, {_STATUS_SQL} AS status,"
    f" CASE WHEN {_STATUS_SQL} = 'parsed' THEN n_rows ELSE 0 END::BIGINT AS accepted_rows FROM document_index",
)
def cohort_status(p: Panels) -> DataFrame:
    out = N.cohort_status(
        document_index(p), date="week_start", failed="failed", first="1996-01-06", last="2000-12-30",
        rows="n_rows",
    )
    return out.drop("failed", "n_rows")


@query(
    "quarantine_report",
    f"""
SELECT {_STATUS_SQL} AS status, CASE WHEN failed = 1 THEN 'SOURCE_CONFLICT' END AS reason, count(*)::BIGINT AS documents,
  sum(observed_rows)::BIGINT AS observed_rows, min(document) AS first_document FROM document_index GROUP BY 1, 2
""",
)
def quarantine_report(p: Panels) -> DataFrame:
    out = N.cohort_status(
        document_index(p), date="week_start", failed="failed", first="1996-01-06", last="2000-12-30"
    )
    return N.quarantine_summary(
        out.withColumn("reason", F.when(F.col("failed") == 1, "SOURCE_CONFLICT")),
        status="status", reason="reason", document="document", observed="observed_rows",
    )


cte(
    "printed_cells",
    """
SELECT entity_id, week_start, component, value, k, CASE k WHEN 0 THEN ' Nil ' WHEN 1 THEN value || '*'
  WHEN 2 THEN '1,' || lpad(value::VARCHAR, 3, '0') WHEN 3 THEN '-' WHEN 4 THEN '  ' WHEN 5 THEN value || '.5' WHEN 6 THEN '-' || value
  WHEN 7 THEN 'NA' WHEN 8 THEN value || ' cases' ELSE ' ' || value || '  ' END AS cell
FROM (SELECT *, (value + entity_id + day(week_start)) % 11 AS k FROM components)
""",
)


def printed_cells(p: Panels) -> DataFrame:
    """Counts as they are printed: nil, footnotes, separators, dashes, blanks, fractions, signs and words."""
    v, k = F.col("value").cast("string"), F.col("k")
    cell = (
        F.when(k == 0, " Nil ")
        .when(k == 1, F.concat(v, F.lit("*")))
        .when(k == 2, F.concat(F.lit("1,"), F.lpad(v, 3, "0")))
        .when(k == 3, "-")
        .when(k == 4, "  ")
        .when(k == 5, F.concat(v, F.lit(".5")))
        .when(k == 6, F.concat(F.lit("-"), v))
        .when(k == 7, "NA")
        .when(k == 8, F.concat(v, F.lit(" cases")))
        .otherwise(F.concat(F.lit(" "), v, F.lit("  ")))
    )
    kind = (F.col("value") + F.col("entity_id") + F.dayofmonth("week_start")) % 11
    return p.components.withColumn("k", kind).withColumn("cell", cell)


@query(
    "cell_text_parse",
    """
SELECT entity_id, week_start, component,
  CASE WHEN k = 0 THEN 0 WHEN k = 2 THEN 1000 + value WHEN k IN (1, 9, 10) THEN value END::BIGINT AS parsed,
  CASE WHEN k = 0 THEN 0 WHEN k = 2 THEN 1000 + value WHEN k = 5 THEN 10 * value + 5
    WHEN k IN (1, 6, 8, 9, 10) THEN value END::BIGINT AS digits,
  k = 1 AS revised, CASE WHEN k = 4 THEN 'blank' WHEN k IN (3, 5, 6, 7, 8) THEN 'not_numeric' END AS problem
FROM printed_cells
""",
)
def cell_text_parse(p: Panels) -> DataFrame:
    return printed_cells(p).select(
        *KEYS, "component", X.strict_count("cell").alias("parsed"),
        X.printed_count("cell").alias("digits"),
        X.revision_mark("cell").alias("revised"), X.cell_problem("cell").alias("problem"),
    )


@query(
    "wide_to_long_components",
    """
SELECT entity_id, week_start, component, CASE WHEN value % 4 <> 3 THEN value END AS value,
  week_start >= DATE '2001-01-06' AS revised, CASE WHEN value % 4 = 3 THEN 'not_numeric' END AS problem FROM components
""",
)
def wide_to_long_components(p: Panels) -> DataFrame:
    """Wide printed tables (one column per component) back to long rows."""
    wide = p.components.groupBy(*KEYS).pivot("component", list(SEGMENTS)).agg(F.max("value"))
    star = F.when(F.col("week_start") >= F.lit("2001-01-06").cast("date"), "*").otherwise("")
    half = lambda s: F.when(F.col(s) % 4 == 3, ".5").otherwise("")
    printed = wide.select(
        *KEYS, *[F.concat(F.col(s).cast("string"), half(s), star).alias(s) for s in SEGMENTS]
    )
    # a component that printed nothing has no cell
    return N.wide_to_long(printed, KEYS, SEGMENTS).filter("problem IS DISTINCT FROM 'blank'")


@query(
    "component_name_check",
    """
SELECT component, count(*)::BIGINT AS n_rows, CASE WHEN component = 'Sub total' THEN 'unexpected' ELSE 'expected' END AS status FROM (
  SELECT CASE WHEN component = 'MACHINERY' THEN 'Sub total' ELSE component END AS component FROM components) GROUP BY 1
UNION ALL SELECT 'MACHINERY', 0, 'missing'
""",
)
def component_name_check(p: Panels) -> DataFrame:
    c, v = F.col("component"), F.col("value")
    name = F.when(c == "MACHINERY", "Sub  total").otherwise(c)
    marks = F.when(v % 3 == 0, " *").when(v % 3 == 1, "**").otherwise("")
    return N.component_names(
        p.components.select(F.concat(name, marks).alias("printed")), "printed", SEGMENTS
    )


@query(
    "observation_year_filter",
    "SELECT entity_id, week_start, value FROM weekly_obs WHERE year(week_start) BETWEEN 1997 AND 1999",
)
def observation_year_filter(p: Panels) -> DataFrame:
    return p.weekly_obs.filter(F.year("week_start").between(1997, 1999)).orderBy(*reversed(KEYS))


