"""Readiness, holdout, folds and direct-horizon cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.columns import digest_int, plus_days, rounded
from panelspark.operators import cohorts as K
from panelspark.operators import splits as S

from panelspark.queries.base import cte, query
from panelspark.queries.contracts import sql_digest, sql_set_digest
from panelspark.sources.panels import Panels

POLICY = S.SplitPolicy(
    min_rows=100, min_entities=20, candidate_years=(2000, 2001), preferred_year=2000, excluded_year=None
)
HOLDOUT = 2000
FOLD_YEARS = (1997, 1998, 1999, 2000, 2001)
BOUNDARY = "2001-07-01"


def locked_start(p: Panels):
    return S.year_start(p.spine, HOLDOUT)


def folds(p: Panels) -> DataFrame:
    return S.expanding_folds(p.model_panel, POLICY, locked_start=locked_start(p))


cte(
    "gap_runs",
    """
SELECT entity_id, week_start, week_start - (7 * row_number() OVER (PARTITION BY entity_id ORDER BY week_start))::INT AS grp
FROM model_panel WHERE NOT is_trainable
""",
)
cte(
    "year_gap_runs",
    """
SELECT entity_id, year(week_start)::BIGINT AS year, week_start,
  week_start - (7 * row_number() OVER (PARTITION BY entity_id, year(week_start) ORDER BY week_start))::INT AS grp
FROM model_panel WHERE NOT is_trainable
""",
)
cte(
    "year_gaps",
    """
SELECT year, max(n)::BIGINT AS gap FROM (SELECT entity_id, year, grp, count(*) AS n FROM year_gap_runs GROUP BY 1, 2, 3) GROUP BY 1
""",
)
_YEAR_METRICS = """
SELECT m.*, g.gap AS longest_trainable_gap_weeks FROM (
  SELECT year(week_start)::BIGINT AS year, count(*)::BIGINT AS complete_rows, count(*) FILTER (is_trainable)::BIGINT AS trainable_rows,
    count(cases_next_week)::BIGINT AS target_available_rows, round(100.0::DOUBLE * count(cases_next_week) / count(*), 2) AS target_coverage_pct,
    count(DISTINCT entity_id)::BIGINT AS entities, count(DISTINCT entity_id) FILTER (is_trainable)::BIGINT AS trainable_entities,
    min(week_start) AS span_start, max(week_end) AS span_end,
    round(100.0::DOUBLE * count(*) FILTER (case_missing_flag) / count(*), 2) AS case_missing_pct,
    round(100.0::DOUBLE * count(*) FILTER (weather_missing_flag) / count(*), 2) AS weather_missing_pct,
    {high}::BIGINT AS high_incidence_rows
  FROM model_panel {join} GROUP BY 1) m LEFT JOIN year_gaps g ON g.year = m.year
"""


@query("year_metrics", _YEAR_METRICS.format(high="0", join=""))
def year_metrics(p: Panels) -> DataFrame:
    return S.year_metrics(p.model_panel, POLICY)


@query(
    "longest_gap",
    """
SELECT n_nationkey AS entity_id, coalesce(gap, 0)::BIGINT AS longest_trainable_gap_weeks
FROM nation LEFT JOIN (SELECT entity_id, max(n) AS gap FROM (
  SELECT entity_id, grp, count(*) AS n FROM gap_runs GROUP BY 1, 2) GROUP BY 1) ON entity_id = n_nationkey
""",
)
def longest_gap(p: Panels) -> DataFrame:
    return S.trainable_gaps(p.model_panel, POLICY)


@query(
    "readiness_by_entity",
    """
SELECT m.entity_id, count(*)::BIGINT AS complete_rows, count(*) FILTER (is_trainable)::BIGINT AS trainable_rows,
  count(cases_next_week)::BIGINT AS target_available_rows, coalesce(max(gap), 0)::BIGINT AS longest_trainable_gap_weeks
FROM model_panel m LEFT JOIN (SELECT entity_id, max(n) AS gap FROM (
  SELECT entity_id, grp, count(*) AS n FROM gap_runs GROUP BY 1, 2) GROUP BY 1) g ON g.entity_id = m.entity_id
GROUP BY 1
""",
)
def readiness_by_entity(p: Panels) -> DataFrame:
    return S.readiness_by_entity(p.model_panel, POLICY)


@query(
    "readiness_summary",
    """
SELECT count(*)::BIGINT AS n_rows, count(DISTINCT entity_id)::BIGINT AS entities, min(week_start) AS date_start, max(week_end) AS date_end,
  count(*) = count(DISTINCT (entity_id, week_start)) AS unique_keys,
  quantile_cont(CASE WHEN year(week_start) < 1999 THEN target_h1 END::DOUBLE, 0.9) AS high_threshold FROM origins
""",
)
def readiness_summary(p: Panels) -> DataFrame:
    panel = p.origins.withColumn("cases_next_week", F.col("target_h1"))
    return S.readiness_summary(panel, POLICY, before_year=1999)


@query(
    "holdout_select",
    """
WITH starts AS (SELECT year(week_start)::BIGINT AS year, min(week_start) AS s FROM model_panel WHERE year(week_start) IN (2000, 2001) GROUP BY 1),
thr AS (SELECT s.year AS ty, quantile_cont(cases_next_week::DOUBLE, 0.9) AS high_threshold FROM starts s JOIN model_panel m ON m.week_end + 7 < s.s
  WHERE cases_next_week IS NOT NULL GROUP BY 1),
ym AS ("""
    + _YEAR_METRICS.format(
        high="count(*) FILTER (cases_next_week >= high_threshold)",
        join="JOIN thr ON ty = year(week_start)",
    )
    + """),
a AS (SELECT ym.*, high_threshold, coalesce(nullif(concat_ws('; ',
    CASE WHEN trainable_rows < 100 THEN 'trainable rows ' || trainable_rows || ' < 100' END,
    CASE WHEN trainable_entities < 20 THEN 'entities ' || trainable_entities || ' < 20' END,
    CASE WHEN target_coverage_pct < 60 THEN 'target coverage ' || target_coverage_pct || '% < 60.0%' END), ''), 'accepted') AS rejection_reason
  FROM ym JOIN thr ON ty = year)
SELECT *, rejection_reason = 'accepted' AS adequate, year = (SELECT coalesce(max(CASE WHEN year = 2000 THEN year END), max(year)) FROM a
  WHERE rejection_reason = 'accepted') AS selected FROM a
""",
)
def holdout_select(p: Panels) -> DataFrame:
    return S.holdout_audit(p.model_panel, POLICY)


cte(
    "locked",
    "SELECT min(week_start) AS locked_start, max(week_end) AS locked_end FROM spine WHERE year(week_start) = 2000",
)
cte(
    "fold_table",
    """
WITH dev AS (SELECT m.*, year(week_start)::BIGINT AS year, locked_start FROM model_panel m, locked WHERE week_start < locked_start),
v AS (SELECT year, count(*) FILTER (is_trainable)::BIGINT AS rows_validation, count(DISTINCT entity_id) FILTER (is_trainable)::BIGINT AS entities_validation,
  round(100.0::DOUBLE * count(cases_next_week) / count(*), 2) AS target_coverage_pct, min(week_start) AS validation_start, max(week_end) AS validation_end
  FROM dev WHERE week_end + 7 < locked_start GROUP BY 1),
t AS (SELECT v.year, min(d.week_start) AS train_start, max(d.week_end) AS train_end, count(*)::BIGINT AS rows_train,
  count(DISTINCT d.entity_id)::BIGINT AS entities_train
  FROM v JOIN dev d ON d.year < v.year AND d.week_end + 14 < v.validation_start AND d.is_trainable GROUP BY 1),
y AS (SELECT DISTINCT year FROM dev),
j AS (SELECT y.year, (SELECT count(*) FROM y z WHERE z.year < y.year)::INT AS prior_years, v.* EXCLUDE (year), t.* EXCLUDE (year)
  FROM y LEFT JOIN v ON v.year = y.year LEFT JOIN t ON t.year = y.year)
SELECT *, CASE WHEN prior_years < 4 THEN 'fewer than four prior training years'
  WHEN rows_validation IS NULL THEN 'no scored rows'
  ELSE coalesce(nullif(concat_ws('; ', CASE WHEN rows_validation < 100 THEN 'eligible validation rows ' || rows_validation || ' < 100' END,
    CASE WHEN entities_validation < 20 THEN 'entities ' || entities_validation || ' < 20' END,
    CASE WHEN target_coverage_pct < 60 THEN 'target coverage ' || target_coverage_pct || '% < 60.0%' END), ''),
    CASE WHEN rows_train IS NULL THEN 'embargo leaves no eligible training rows' END) END AS rejection_reason
FROM j
""",
)
cte("folds_ok", "SELECT 'val_' || year AS fold_id, * FROM fold_table WHERE rejection_reason IS NULL")

_FOLD_COLS = (
    "train_start", "train_end", "validation_start", "validation_end", "rows_train", "entities_train",
    "rows_validation", "entities_validation", "target_coverage_pct",
)


@query(
    "expanding_folds",
    "SELECT year, prior_years::BIGINT AS prior_years, rejection_reason, CASE WHEN rejection_reason IS NULL THEN 'val_' || year END AS fold_id, "
    + ", ".join(f"CASE WHEN rejection_reason IS NULL THEN {c} END AS {c}" for c in _FOLD_COLS)
    + """, CASE WHEN rejection_reason IS NULL THEN train_end + 7 END::DATE AS train_target_end_max,
  CASE WHEN rejection_reason IS NULL THEN train_end + 14 END::DATE AS train_embargo_end_max,
  CASE WHEN rejection_reason IS NULL THEN validation_end + 7 END::DATE AS validation_target_end_max FROM fold_table""",
)
def expanding_folds(p: Panels) -> DataFrame:
    return folds(p).withColumn("prior_years", F.col("prior_years").cast("long"))


cte(
    "fold_rows",
    """
SELECT f.fold_id, CASE WHEN m.week_end <= f.train_end THEN 'train' ELSE 'validation' END AS role, m.*
FROM folds_ok f, locked l, model_panel m
WHERE m.is_trainable AND (
  (m.week_start >= f.train_start AND m.week_end <= f.train_end AND m.week_end + 7 < f.validation_start)
  OR (m.week_start >= f.validation_start AND m.week_end <= f.validation_end AND m.week_end + 7 < l.locked_start))
""",
)


def fold_rows_df(p: Panels) -> DataFrame:
    return S.fold_rows(p.model_panel, folds(p), POLICY, locked_start=locked_start(p))


@query("fold_rows", "SELECT fold_id, role, entity_id, week_start, cases, cases_next_week FROM fold_rows")
def fold_rows(p: Panels) -> DataFrame:
    return fold_rows_df(p).select(
        "fold_id", "role", "entity_id", "week_start", "cases", "cases_next_week"
    )


@query(
    "fold_count_check",
    """
SELECT f.fold_id, r.role, CASE WHEN r.role = 'train' THEN f.rows_train ELSE f.rows_validation END AS expected_rows,
  count(*)::BIGINT AS actual_rows, count(*) = CASE WHEN r.role = 'train' THEN max(f.rows_train) ELSE max(f.rows_validation) END AS agrees,
  count(*) FILTER (r.week_start >= locked_start)::BIGINT AS locked_rows
FROM fold_rows r JOIN folds_ok f ON f.fold_id = r.fold_id, locked GROUP BY 1, 2, 3
""",
)
def fold_count_check(p: Panels) -> DataFrame:
    return S.fold_count_check(fold_rows_df(p), folds(p), locked_start=locked_start(p))


@query(
    "holdout_rows",
    """
WITH t AS (SELECT m.* FROM model_panel m, locked WHERE is_trainable AND week_end + 14 < locked_start),
h AS (SELECT * FROM model_panel WHERE is_trainable AND year(week_start) = 2000)
SELECT 'train' AS role, count(*)::BIGINT AS n_rows, count(DISTINCT entity_id)::BIGINT AS entities, min(week_start) AS first_origin,
  max(week_start) AS last_origin, max(week_end + 7)::DATE AS max_target_end, quantile_cont(cases_next_week::DOUBLE, 0.9) AS q90,
  quantile_cont(cases_next_week::DOUBLE, 0.95) AS q95 FROM t
UNION ALL SELECT 'holdout', count(*), count(DISTINCT entity_id), min(week_start), max(week_start), max(week_end + 7)::DATE, NULL, NULL FROM h
""",
)
def holdout_rows(p: Panels) -> DataFrame:
    train = S.holdout_training_rows(p.model_panel, POLICY, locked_start=locked_start(p))
    test = S.holdout_rows(p.model_panel, POLICY, HOLDOUT)
    return S.holdout_summary(train, test, POLICY)


@query(
    "label_available_cutoff",
    "SELECT entity_id, week_start, cases, target_h2 FROM origins WHERE week_start + 7 * 2 + 6 <= DATE '1999-06-30'",
)
def label_available_cutoff(p: Panels) -> DataFrame:
    return K.label_available(p.origins, horizon=2, cutoff="1999-06-30").select(
        "entity_id", "week_start", "cases", "target_h2"
    )


_LAGS_OK = " AND ".join(f"{c} >= 0" for c in ("cases", "cases_lag_1", "cases_lag_2", "cases_lag_3", "cases_lag_4"))
cte(
    "long_targets",
    f"""
SELECT entity_id, week_start, week_end, cases, cases_lag_1, cases_lag_2, cases_lag_3, cases_lag_4, h::INT AS horizon, t AS target,
  (week_start + 7 * h::INT + 6)::DATE AS target_end
FROM (SELECT *, unnest([1, 2, 3, 4]) AS h, unnest([target_h1, target_h2, target_h3, target_h4]) AS t FROM origins WHERE {_LAGS_OK})
WHERE t >= 0
""",
)
cte(
    "eval_cohort",
    f"""
SELECT *, year(week_start)::BIGINT AS fold FROM origins
WHERE {_LAGS_OK} AND target_h1 >= 0 AND target_h2 >= 0 AND target_h3 >= 0 AND target_h4 >= 0
  AND year(week_start) IN {FOLD_YEARS}
""",
)
cte("fold_origins", "SELECT fold, min(week_start) AS first_origin FROM eval_cohort GROUP BY 1")
cte(
    "train_cohort",
    f"""
SELECT f.fold, l.* FROM long_targets l JOIN fold_origins f ON l.target_end + 7 < f.first_origin
WHERE l.target_end < DATE '{BOUNDARY}' AND l.week_end < DATE '{BOUNDARY}'
""",
)
cte(
    "eval_long",
    """
SELECT fold, entity_id, week_start, week_end, cases, cases_lag_1, cases_lag_2, cases_lag_3, cases_lag_4, h::INT AS horizon, t AS target,
  (week_start + 7 * h::INT + 6)::DATE AS target_end
FROM (SELECT *, unnest([1, 2, 3, 4]) AS h, unnest([target_h1, target_h2, target_h3, target_h4]) AS t FROM eval_cohort)
""",
)


def origins_of(p: Panels) -> DataFrame:
    return K.fold_origins(p.origin_table, FOLD_YEARS)


def training_from(p: Panels) -> DataFrame:
    return K.training_from(K.long_targets(p.origin_table), origins_of(p), boundary=BOUNDARY)


def training(p: Panels) -> DataFrame:
    return K.training_rows(K.long_targets(p.origin_table), origins_of(p), boundary=BOUNDARY)


def evaluation(p: Panels) -> DataFrame:
    return K.long_targets(K.evaluation_rows(p.origin_table, FOLD_YEARS))


@query(
    "horizon_training_rows",
    """
SELECT fold, horizon::BIGINT AS horizon, count(*)::BIGINT AS n_rows, min(week_start) AS first_origin, max(target_end) AS last_target_end,
  sum(target)::BIGINT AS target_total FROM train_cohort GROUP BY 1, 2
""",
)
def horizon_training_rows(p: Panels) -> DataFrame:
    counts = (
        training_from(p)
        .groupBy("first_fold", F.col("horizon").cast("long").alias("horizon"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("week_start").alias("lo"),
            F.max("target_end").alias("hi"),
            F.sum("target").alias("t"),
        )
    )
    return K.expand_folds(counts, origins_of(p)).groupBy("fold", "horizon").agg(
        F.sum("n").alias("n_rows"),
        F.min("lo").alias("first_origin"),
        F.max("hi").alias("last_target_end"),
        F.sum("t").alias("target_total"),
    )


_AVAIL = """
SELECT entity_id, week_start, cases IS NOT NULL AS observed,
  (cases_lag_1 IS NOT NULL AND cases_lag_2 IS NOT NULL AND cases_lag_3 IS NOT NULL AND cases_lag_4 IS NOT NULL) AS history_available,
  target_h1 IS NOT NULL AS target_h1_available, target_h2 IS NOT NULL AS target_h2_available,
  target_h3 IS NOT NULL AS target_h3_available, target_h4 IS NOT NULL AS target_h4_available,
  (target_h1 IS NOT NULL AND target_h2 IS NOT NULL AND target_h3 IS NOT NULL AND target_h4 IS NOT NULL) AS all_targets_available,
  (cases IS NOT NULL AND cases_lag_1 IS NOT NULL AND cases_lag_2 IS NOT NULL AND cases_lag_3 IS NOT NULL AND cases_lag_4 IS NOT NULL
   AND target_h1 IS NOT NULL AND target_h2 IS NOT NULL AND target_h3 IS NOT NULL AND target_h4 IS NOT NULL) AS common_cohort
FROM origins
"""
cte("availability", _AVAIL)


@query("horizon_availability", "SELECT * FROM availability")
def horizon_availability(p: Panels) -> DataFrame:
    return K.horizon_availability(p.origins)


@query(
    "coverage_summary",
    """
WITH l AS (
  SELECT 'h1' AS cohort, entity_id, week_start FROM availability WHERE observed AND history_available AND target_h1_available
  UNION ALL SELECT 'h2', entity_id, week_start FROM availability WHERE observed AND history_available AND target_h2_available
  UNION ALL SELECT 'h3', entity_id, week_start FROM availability WHERE observed AND history_available AND target_h3_available
  UNION ALL SELECT 'h4', entity_id, week_start FROM availability WHERE observed AND history_available AND target_h4_available
  UNION ALL SELECT 'common', entity_id, week_start FROM availability WHERE common_cohort)
SELECT cohort, count(*)::BIGINT AS n_rows, count(DISTINCT entity_id)::BIGINT AS entities, count(DISTINCT week_start)::BIGINT AS weeks,
  min(week_start) AS first_week, max(week_start) AS last_week FROM l GROUP BY 1
""",
)
def coverage_summary(p: Panels) -> DataFrame:
    return K.availability_summary(K.horizon_availability(p.origins))


_KEY = "entity_id || '|' || week_start"


@query(
    "cohort_fingerprint",
    f"""
SELECT fold, horizon::BIGINT AS horizon, count(*)::BIGINT AS row_count, {sql_set_digest(_KEY)} AS key_digest,
  {sql_set_digest(_KEY + " || '|' || target")} AS target_digest,
  {sql_set_digest(_KEY + " || '|' || cases || '|' || cases_lag_1 || '|' || cases_lag_2")} AS value_digest
FROM eval_long GROUP BY 1, 2
""",
)
def cohort_fingerprint(p: Panels) -> DataFrame:
    prints = K.cohort_fingerprint(
        evaluation(p), ["fold", "horizon"], target="target",
        values=["cases", "cases_lag_1", "cases_lag_2"],
    )
    return prints.withColumn("horizon", F.col("horizon").cast("long"))


cte(
    "thresholds",
    """
SELECT fold, horizon, count(*)::BIGINT AS n_train, quantile_cont(target::DOUBLE, 0.9) AS q90_incidence,
  quantile_cont(target::DOUBLE, 0.95) AS q95_incidence, quantile_cont(abs(target - cases)::DOUBLE, 0.25) AS stable_abs_delta_q25,
  quantile_cont(CASE WHEN target > cases THEN target - cases END::DOUBLE, 0.9) AS large_up_q90,
  quantile_cont(CASE WHEN target < cases THEN cases - target END::DOUBLE, 0.9) AS large_down_abs_q90,
  count(*) FILTER (target > cases)::BIGINT AS n_up, count(*) FILTER (target < cases)::BIGINT AS n_down,
  count(*) FILTER (target = cases)::BIGINT AS n_stable
FROM train_cohort GROUP BY 1, 2
""",
)


def thresholds(p: Panels) -> DataFrame:
    return K.threshold_binding(training_from(p), origins_of(p))


_Q = ("q90_incidence", "q95_incidence", "stable_abs_delta_q25", "large_up_q90", "large_down_abs_q90")


@query(
    "threshold_binding",
    "SELECT fold, horizon::BIGINT AS horizon, n_train, "
    + ", ".join(f"round({q}, 6) AS {q}" for q in _Q)
    + ", n_up, n_down, n_stable FROM thresholds",
)
def threshold_binding(p: Panels) -> DataFrame:
    return thresholds(p).withColumns(
        {"horizon": F.col("horizon").cast("long"), **{q: rounded(q) for q in _Q}}
    )


@query(
    "key_subset_select",
    f"""
WITH k AS (SELECT entity_id, CASE WHEN {sql_digest(_KEY)} % 40 = 0 THEN week_start + 1 ELSE week_start END::DATE AS week_start
  FROM eval_cohort WHERE fold >= 1999)
SELECT k.entity_id, k.week_start, o.cases, CASE WHEN o.entity_id IS NULL THEN 'missing'
  WHEN k.week_start < DATE '2000-01-01' THEN 'before_boundary' END AS problem
FROM k LEFT JOIN origins o ON o.entity_id = k.entity_id AND o.week_start = k.week_start
""",
)
def key_subset_select(p: Panels) -> DataFrame:
    late = K.evaluation_rows(p.origins, FOLD_YEARS).filter("fold >= 1999")
    moved = F.when(
        digest_int("entity_id", "week_start") % 40 == 0, plus_days("week_start", 1)
    ).otherwise(F.col("week_start"))
    keys = late.select("entity_id", moved.alias("week_start"))
    return K.select_keys(
        p.origins.select("entity_id", "week_start", "cases"), keys, boundary="2000-01-01"
    )


@query(
    "embargo_disjoint_check",
    """
WITH e AS (SELECT fold, horizon, min(week_start) AS first_origin FROM eval_long GROUP BY 1, 2),
t AS (SELECT fold, horizon, count(*)::BIGINT AS n_train, max(target_end) AS last_end FROM train_cohort GROUP BY 1, 2),
s AS (SELECT t.fold, t.horizon, count(*)::BIGINT AS shared FROM train_cohort t JOIN eval_long e ON e.fold = t.fold AND e.horizon = t.horizon
  AND e.entity_id = t.entity_id AND e.week_start = t.week_start GROUP BY 1, 2)
SELECT e.fold, e.horizon::BIGINT AS horizon, coalesce(n_train, 0) AS n_train, coalesce(shared, 0) AS shared_keys,
  coalesce(last_end + 7 >= first_origin, false) AS embargo_broken
FROM e LEFT JOIN t ON t.fold = e.fold AND t.horizon = e.horizon LEFT JOIN s ON s.fold = e.fold AND s.horizon = e.horizon
""",
)
def embargo_disjoint_check(p: Panels) -> DataFrame:
    out = K.embargo_violations(training(p), evaluation(p), ["fold", "horizon"])
    return out.withColumn("horizon", F.col("horizon").cast("long"))


@query(
    "interval_bounds",
    """
SELECT fold, horizon::BIGINT AS horizon, train_start, train_end, train_target_end, eval_start, eval_end, eval_target_end,
  (train_target_end + 7)::DATE AS embargo_limit
FROM (SELECT fold, horizon, min(week_start) AS train_start, max(week_start) AS train_end, max(target_end) AS train_target_end
      FROM train_cohort GROUP BY 1, 2) t
JOIN (SELECT fold, horizon, min(week_start) AS eval_start, max(week_start) AS eval_end, max(target_end) AS eval_target_end
      FROM eval_long GROUP BY 1, 2) e USING (fold, horizon)
""",
)
def interval_bounds(p: Panels) -> DataFrame:
    out = K.interval_bounds(training(p), evaluation(p), ["fold", "horizon"])
    return out.withColumn("horizon", F.col("horizon").cast("long"))


@query(
    "feature_missingness",
    """
WITH m AS (SELECT year(week_start)::BIGINT AS year,
  (cases IS NULL)::BIGINT + (cases_lag_1 IS NULL)::BIGINT + (cases_lag_4 IS NULL)::BIGINT AS a,
  (rainfall_sum_mm IS NULL)::BIGINT AS r, (temp_mean_c IS NULL)::BIGINT + (humidity_mean_pct IS NULL)::BIGINT AS t FROM model_panel),
l AS (SELECT year, 'cases_only' AS feature_set, a AS n, 3 AS w FROM m UNION ALL SELECT year, 'cases_rainfall', a + r, 4 FROM m
  UNION ALL SELECT year, 'cases_full_weather', a + r + t, 6 FROM m)
SELECT feature_set, year, count(*)::BIGINT AS n_rows, max(w)::BIGINT AS features, sum(n)::BIGINT AS missing_cells,
  count(*) FILTER (n > 0)::BIGINT AS rows_with_missing FROM l GROUP BY 1, 2
""",
)
def feature_missingness(p: Panels) -> DataFrame:
    a = ["cases", "cases_lag_1", "cases_lag_4"]
    b = [*a, "rainfall_sum_mm"]
    return K.feature_missingness(
        p.model_panel_plan,
        {"cases_only": a, "cases_rainfall": b, "cases_full_weather": [*b, "temp_mean_c", "humidity_mean_pct"]},
    )


