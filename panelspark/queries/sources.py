"""Scans, documents, manifests and sinks. File-based inputs are written below the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.columns import plus_days
from panelspark.operators import errors as E
from panelspark.operators import metrics as M
from panelspark.operators.contracts import coverage_of_expected
from panelspark.queries.base import cte, query
from panelspark.queries.evaluation import _round, predictions, staged_predictions
from panelspark.queries.splits import thresholds
from panelspark.sources import documents as D
from panelspark.sources import sinks
from panelspark.sources import tables as S
from panelspark.sources.panels import Panels


@query(
    "scan_projected_cutoff",
    "SELECT o_orderkey, o_custkey, o_orderdate::DATE AS order_day FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'",
)
def scan_projected_cutoff(p: Panels) -> DataFrame:
    df = S.scan_before_cutoff(
        p.spark, p.path("orders"), ["o_orderkey", "o_custkey", "o_orderdate"], "o_orderdate", "1999-01-01"
    )
    return df.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("order_day"))


_OBS_SCHEMA = T.StructType(
    [
        T.StructField("entity_id", T.IntegerType()),
        T.StructField("week_start", T.DateType()),
        T.StructField("value", T.LongType()),
    ]
)


@query(
    "scan_by_suffix",
    "SELECT entity_id, week_start, value, 'csv' AS origin FROM weekly_obs WHERE entity_id < 12"
    " UNION ALL SELECT entity_id, week_start, value, 'parquet' FROM weekly_obs WHERE entity_id >= 12",
)
def scan_by_suffix(p: Panels) -> DataFrame:
    base = sinks.scratch_path(p.spark, "by-suffix")
    p.weekly_obs.filter("entity_id < 12").write.option("header", True).csv(f"{base}/obs.csv")
    p.weekly_obs.filter("entity_id >= 12").write.parquet(f"{base}/obs.parquet")
    read = lambda suffix: S.scan_by_suffix(
        p.spark, f"{base}/obs.{suffix}", _OBS_SCHEMA, required=["entity_id", "week_start"]
    ).withColumn("origin", F.lit(suffix))
    return read("csv").unionByName(read("parquet"))


@query(
    "scan_union_identity",
    """
SELECT fit_id, count(*)::BIGINT AS n_rows, count(*) FILTER (NOT (horizon = 2 AND fold = 1998))::BIGINT AS matching_rows FROM predictions GROUP BY 1
""",
)
def scan_union_identity(p: Panels) -> DataFrame:
    """One folder per fit, read back in one scan; rows are matched with the registry of fits."""
    pred = staged_predictions(p)
    base = sinks.scratch_path(p.spark, "fits")
    keep = ["fit_id", "horizon", "feature_set", "family", "fold", "entity_id", "origin_start"]
    (
        pred.select(*keep)
        .withColumn("fit", F.col("fit_id"))
        .repartition("fit", "entity_id")
        .write.partitionBy("fit")
        .parquet(base)
    )
    slip = (F.col("horizon") == 2) & (F.col("fold") == 1998)
    registry = (
        pred.select("fit_id", "horizon", "feature_set", "family", "fold")
        .distinct()
        .withColumn("fold", F.when(slip, F.col("fold") + 1).otherwise(F.col("fold")))
        .withColumnRenamed("fit_id", "fit_key")
    )
    written = pred.select(*keep).schema
    rows = p.spark.read.schema(written).parquet(base).withColumn("fit_key", S.file_key("fit"))
    checked = S.scan_with_identity(
        rows, registry, "fit_key", ["horizon", "feature_set", "family", "fold"]
    )
    return checked.groupBy(F.col("fit_key").alias("fit_id")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(F.col("identity_ok"), 1).otherwise(0)).alias("matching_rows"),
    )


_Q = ("q90_incidence", "q95_incidence", "stable_abs_delta_q25", "large_up_q90", "large_down_abs_q90")


@query(
    "scan_threshold_docs",
    "SELECT fold, horizon::BIGINT AS horizon, " + ", ".join(f"round({q}, 6) AS {q}" for q in _Q) + " FROM thresholds",
)
def scan_threshold_docs(p: Panels) -> DataFrame:
    """Threshold documents written per fold, read back with a declared schema."""
    base = sinks.scratch_path(p.spark, "thresholds")
    thresholds(p).withColumn("part", F.col("fold")).write.partitionBy("part").json(base)
    schema = T.StructType(
        [T.StructField("fold", T.LongType()), T.StructField("horizon", T.LongType())]
        + [T.StructField(q, T.DoubleType()) for q in _Q]
    )
    docs = D.read_json_documents(p.spark, base, schema)
    return _round(docs.select("fold", "horizon", *_Q), *_Q, digits=6)


@query(
    "json_hourly_explode",
    "SELECT node, strftime(hour, '%Y-%m-%d %H:%M') AS hour, round(temp, 6) AS temp, rh::DOUBLE AS rh FROM hourly",
)
def json_hourly_explode(p: Panels) -> DataFrame:
    """Hourly payloads per node and day (24 hours each), parsed back to node-hours."""
    ordered = F.array_sort(F.collect_list(F.struct("hour", "temp", "rh")))
    payload = (
        p.hourly.groupBy("node", F.to_date("hour").alias("day"))
        .agg(ordered.alias("h"))
        .select(
            F.to_json(
                F.struct(
                    "node",
                    F.struct(
                        F.transform("h", lambda x: F.date_format(x["hour"], "yyyy-MM-dd'T'HH:mm")).alias("time"),
                        F.transform("h", lambda x: x["temp"]).alias("temperature"),
                        F.transform("h", lambda x: x["rh"].cast("double")).alias("humidity"),
                    ).alias("hourly"),
                )
            ).alias("payload"),
            (F.dayofmonth("day") % 2).alias("odd"),
        )
    )
    mixed = payload.select(
        F.when(F.col("odd") == 1, F.concat(F.lit("["), "payload", F.lit("]")))
        .otherwise(F.col("payload"))
        .alias("payload")
    )
    rows = D.explode_hourly(mixed)
    text = rows.withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm"))
    return _round(text.select("node", "hour", "temp", "rh"), "temp", digits=6)


cte(
    "archive_pages",
    """
SELECT page_id, url, html || '<a class="x" href="/files/vol_' || (30 + page_id % 25) || '_no_' || (1 + page_id % 60) || '.PDF"><b>Report</b>  Vol. '
  || (30 + page_id % 25) || ' No. ' || (1 + page_id % 60) || '</a><a href="/files/vol_40_no_7.pdf"></a>' AS html FROM pages
""",
)


def archive_pages(p: Panels) -> DataFrame:
    """The raw pages with report links appended."""
    k = F.col("page_id")
    vol, no = (k % 25 + 30).cast("string"), (k % 60 + 1).cast("string")
    link = F.concat(
        F.lit('<a class="x" href="/files/vol_'), vol, F.lit("_no_"), no,
        F.lit('.PDF"><b>Report</b>  Vol. '), vol, F.lit(" No. "), no,
        F.lit('</a><a href="/files/vol_40_no_7.pdf"></a>'),
    )
    return p.table("pages").select("page_id", "url", F.concat("html", link).alias("html"))


@query(
    "html_link_discovery",
    """
WITH a AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS origin, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href="([^"]*)"[^>]*>.*?</a>', 1)) AS href,
    unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href="[^"]*"[^>]*>(.*?)</a>', 1)) AS body,
    unnest(range(len(regexp_extract_all(html, '(?is)<a\\s[^>]*?href="([^"]*)"[^>]*>.*?</a>', 1)))) AS pos FROM archive_pages),
n AS (SELECT page_id, pos, CASE WHEN href LIKE 'http%' THEN href ELSE origin || CASE WHEN href LIKE '/%' THEN href ELSE '/' || href END END AS url, href,
    trim(regexp_replace(regexp_replace(body, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS body FROM a),
t AS (SELECT page_id, pos, url, CASE WHEN body <> '' THEN body ELSE string_split(href, '/')[-1] END AS title FROM n WHERE lower(url) LIKE '%.pdf%'),
v AS (SELECT *, try_cast(regexp_extract(title || ' ' || url, '(?i)vol[_\\s.-]*(\\d+)', 1) AS INT) AS volume,
  try_cast(regexp_extract(title || ' ' || url, '(?:no|No)[_\\s.-]*(\\d{1,2})', 1) AS INT) AS no FROM t)
SELECT url, title, volume::BIGINT AS volume, (volume + 1973)::BIGINT AS issue_year, CASE WHEN no BETWEEN 1 AND 53 THEN no END::BIGINT AS issue_week FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id, pos) AS rn FROM v WHERE volume + 1973 BETWEEN 2010 AND 2025) WHERE rn = 1
""",
)
def html_link_discovery(p: Panels) -> DataFrame:
    links = D.discover_links(archive_pages(p), start_year=2010, end_year=2025)
    return links.select(
        "url", "title", *[F.col(c).cast("long").alias(c) for c in ("volume", "issue_year", "issue_week")]
    )


cte(
    "report_texts",
    """
SELECT week_start AS doc_id, string_agg(CASE WHEN entity_id % 5 = 0 THEN '  ' ELSE '' END || 'NATION_' || entity_id || ' ' || value || ' ' || (value * 10 + 3) || ' ' || (50 + entity_id),
  chr(10) ORDER BY entity_id) || chr(10) || 'Total 12 40' AS text FROM weekly_obs GROUP BY 1
""",
)


def report_texts(p: Panels) -> DataFrame:
    """One printed report per week: a line per entity (bounded by the entities) and a footer."""
    e, v = F.col("entity_id"), F.col("value")
    line = F.concat(
        F.when(e % 5 == 0, "  ").otherwise(""), F.lit("NATION_"), e.cast("string"), F.lit(" "),
        v.cast("string"), F.lit(" "), (v * 10 + 3).cast("string"), F.lit(" "), (e + 50).cast("string"),
    )
    lines = p.weekly_obs.select("week_start", F.struct("entity_id", line.alias("t")).alias("s"))
    docs = lines.groupBy(F.col("week_start").alias("doc_id")).agg(
        F.array_sort(F.collect_list("s")).alias("l")
    )
    text = F.concat(F.array_join(F.transform("l", lambda s: s["t"]), "\n"), F.lit("\nTotal 12 40"))
    return docs.select("doc_id", text.alias("text"))


@query(
    "text_table_extract",
    """
SELECT week_start AS doc_id, 'NATION_' || entity_id AS region, value AS current, value * 10 + 3 AS cumulative, (50 + entity_id)::BIGINT AS returns_pct FROM weekly_obs
""",
)
def text_table_extract(p: Panels) -> DataFrame:
    regions = p.table("nation").select(F.col("n_name").alias("region"))
    return D.table_lines(report_texts(p), regions).select(
        "doc_id", "region", "current", "cumulative", "returns_pct"
    )


@query(
    "file_manifest",
    """
SELECT 'entity_id=' || entity_id AS folder, sum(length(week_start || ',' || value) + 1)::BIGINT AS size_bytes, 64::BIGINT AS digest_length
FROM weekly_obs GROUP BY 1
""",
)
def file_manifest(p: Panels) -> DataFrame:
    """Manifest of text reports written per entity."""
    base = sinks.scratch_path(p.spark, "manifest")
    p.weekly_obs.select(
        F.concat_ws(",", "week_start", "value").alias("line"), "entity_id"
    ).write.partitionBy("entity_id").text(base)
    files = S.file_manifest(p.spark, base, glob="*.txt")
    return files.groupBy(F.substring_index("rel_path", "/", 1).alias("folder")).agg(
        F.sum("size_bytes").alias("size_bytes"),
        F.max(F.length("sha256")).cast("long").alias("digest_length"),
    )


@query(
    "manifest_verify",
    """
SELECT CASE entity_id % 5 WHEN 0 THEN 'hash_mismatch' WHEN 1 THEN 'size_mismatch' WHEN 2 THEN 'missing' WHEN 3 THEN 'extra' ELSE 'ok' END AS status,
  count(*)::BIGINT AS folders FROM (SELECT DISTINCT entity_id FROM weekly_obs) GROUP BY 1
""",
)
def manifest_verify(p: Panels) -> DataFrame:
    """Files on disk against a manifest with wrong hashes, sizes, missing and extra entries."""
    base = sinks.scratch_path(p.spark, "verify")
    p.weekly_obs.select(
        F.concat_ws(",", "week_start", "value").alias("line"), "entity_id"
    ).repartition("entity_id").write.partitionBy("entity_id").text(base)
    files = S.file_manifest(p.spark, base, glob="*.txt")
    k = F.regexp_extract("rel_path", r"entity_id=(\d+)", 1).cast("int") % 5
    recorded = files.filter(k != 3).select(
        F.when(k == 2, F.concat("rel_path", F.lit(".old"))).otherwise(F.col("rel_path")).alias("rel_path"),
        (F.col("size_bytes") + F.when(k == 1, 1).otherwise(0)).alias("size_bytes"),
        F.when(k == 0, F.lit("0" * 64)).otherwise(F.col("sha256")).alias("sha256"),
    )
    actual = files.filter(k != 2)
    checked = S.verify_manifest(recorded, actual)
    folder = F.regexp_extract("rel_path", r"(entity_id=\d+)", 1)
    per = checked.groupBy("status", folder.alias("folder")).agg(F.lit(1).alias("one"))
    return per.groupBy("status").agg(F.count(F.lit(1)).alias("folders"))


cte(
    "cached_sources",
    """
SELECT s_suppkey AS source_id, min_lon - 0.5 * (s_suppkey % 3) AS min_lon, min_lat - 0.5 * (s_suppkey % 3) AS min_lat, max_lon + 0.5 * (s_suppkey % 4) AS max_lon,
  max_lat + 0.5 * (s_suppkey % 4) AS max_lat, lo AS start_day, hi AS end_day, (hi - (s_suppkey % 30)::INT)::DATE AS retrieved_at, md5(s_suppkey::VARCHAR) AS sha256
FROM supplier JOIN boxes ON entity_id = s_nationkey JOIN (SELECT l_suppkey, min(l_shipdate)::DATE AS lo, max(l_shipdate)::DATE AS hi FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey
""",
)


@query(
    "latest_covering_source",
    """
WITH r AS (SELECT entity_id AS request_id, min_lon, min_lat, max_lon, max_lat, DATE '1995-03-01' AS a, DATE '2001-05-01' AS b FROM boxes),
c AS (SELECT r.request_id, s.source_id, row_number() OVER (PARTITION BY r.request_id ORDER BY retrieved_at DESC, sha256 DESC) AS rn, count(*) OVER (PARTITION BY r.request_id) AS n
  FROM r JOIN cached_sources s ON s.min_lon <= r.min_lon + 1e-9 AND s.max_lon >= r.max_lon - 1e-9 AND s.min_lat <= r.min_lat + 1e-9 AND s.max_lat >= r.max_lat - 1e-9
    AND s.start_day <= r.a AND s.end_day >= r.b)
SELECT request_id, source_id, n::BIGINT AS n_covering FROM c WHERE rn = 1
""",
)
def latest_covering_source(p: Panels) -> DataFrame:
    spans = (
        p.table("lineitem")
        .groupBy("l_suppkey")
        .agg(F.min(F.to_date("l_shipdate")).alias("start_day"), F.max(F.to_date("l_shipdate")).alias("end_day"))
    )
    k = F.col("s_suppkey")
    sources = (
        p.table("supplier")
        .join(p.boxes, F.col("entity_id") == F.col("s_nationkey"))
        .join(spans, F.col("l_suppkey") == k)
        .select(
            k.alias("source_id"),
            (F.col("min_lon") - (k % 3) * 0.5).alias("min_lon"),
            (F.col("min_lat") - (k % 3) * 0.5).alias("min_lat"),
            (F.col("max_lon") + (k % 4) * 0.5).alias("max_lon"),
            (F.col("max_lat") + (k % 4) * 0.5).alias("max_lat"),
            "start_day",
            "end_day",
            plus_days("end_day", -(k % 30)).alias("retrieved_at"),
            F.md5(k.cast("string")).alias("sha256"),
        )
    )
    requests = p.boxes.withColumnRenamed("entity_id", "request_id").withColumns(
        {"start_day": F.lit("1995-03-01").cast("date"), "end_day": F.lit("2001-05-01").cast("date")}
    )
    return D.latest_covering(requests, sources)


@query(
    "sink_parquet_by_year",
    "SELECT year(week_start)::BIGINT AS year, count(*)::BIGINT AS n_rows, sum(value)::BIGINT AS total, min(week_start) AS first_week FROM weekly_obs GROUP BY 1",
)
def sink_parquet_by_year(p: Panels) -> DataFrame:
    path = sinks.scratch_path(p.spark, "by-year")
    sinks.write_by_year(p.weekly_obs, path, date_col="week_start", sort=["entity_id", "week_start"])
    back = p.spark.read.parquet(path)
    return back.groupBy(F.col("year").cast("long").alias("year")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("value").alias("total"), F.min("week_start").alias("first_week")
    )


@query(
    "upsert_by_key",
    """
SELECT entity_id, week_start, value, 'old' AS batch FROM weekly_obs WHERE week_start < DATE '2000-01-01' AND NOT (week_start >= DATE '1999-01-01' AND value >= 2)
UNION ALL SELECT entity_id, week_start, value + 100, 'new' FROM weekly_obs WHERE week_start >= DATE '1999-01-01' AND value >= 2
""",
)
def upsert_by_key(p: Panels) -> DataFrame:
    day = lambda d: F.lit(d).cast("date")
    old = p.weekly_obs.filter(F.col("week_start") < day("2000-01-01")).withColumn("batch", F.lit("old"))
    new = (
        p.weekly_obs.filter((F.col("week_start") >= day("1999-01-01")) & (F.col("value") >= 2))
        .withColumn("value", F.col("value") + 100)
        .withColumn("batch", F.lit("new"))
    )
    return sinks.checked_upsert(old, new, ["entity_id", "week_start"])


_DOC_METRICS = ("mae", "rmse", "r2")


def documents(p: Panels) -> DataFrame:
    """One nested metric document per fit, as JSON text."""
    pred = predictions(p)
    series = {"model": E.MODEL, "persistence": E.PERSIST}
    aggs = []
    for tag, col in series.items():
        cols = M.metric_columns(E.TARGET, col)
        for m in _DOC_METRICS:
            aggs.append(cols[m].alias(f"{tag}_{m}"))
    wide = pred.groupBy("fit_id", "horizon", "feature_set", "family", "fold").agg(
        F.count(F.lit(1)).alias("n"), *aggs
    )
    hide = (F.col("fold") == 1998) & (F.col("horizon") == 2)

    def cell(tag: str, m: str):
        value = F.when(~(hide & F.lit(m == "r2")), F.col(f"{tag}_{m}"))
        return F.struct(
            value.alias("value"), F.when(value.isNull(), "undefined_for_cohort").alias("reason")
        ).alias(m)

    doc = F.to_json(
        F.struct(*[F.struct(*[cell(t, m) for m in _DOC_METRICS]).alias(t) for t in series])
    )
    return wide.select("fit_id", "horizon", "feature_set", "family", "fold", "n", doc.alias("document"))


_DOC_SQL = ", ".join(
    f"round({expr}, 8) + 0.0 AS {t}_{m}, CASE WHEN {expr} IS NULL THEN 'undefined_for_cohort' END AS {t}_{m}_reason"
    for t, c in (("model", "prediction_model"), ("persistence", "prediction_persistence"))
    for m, expr in (
        ("mae", f"avg(abs({c} - observed_target))"),
        ("rmse", f"sqrt(avg(({c} - observed_target) ** 2))"),
        (
            "r2",
            f"CASE WHEN NOT (fold = 1998 AND horizon = 2) AND var_pop(observed_target) > 0 THEN"
            f" 1 - sum(({c} - observed_target) ** 2) / (var_pop(observed_target) * count(*)) END",
        ),
    )
)


@query("scan_metric_docs", f"SELECT fit_id, {_DOC_SQL} FROM predictions GROUP BY fit_id, fold, horizon")
def scan_metric_docs(p: Panels) -> DataFrame:
    rows = D.metric_document_rows(
        documents(p), "document", ["model", "persistence"], _DOC_METRICS, "fit_id"
    )
    return _round(rows, *[f"{t}_{m}" for t in ("model", "persistence") for m in _DOC_METRICS])


@query(
    "final_metric_table",
    """
WITH f AS (SELECT fit_id, horizon, feature_set, family, fold, count(*)::BIGINT AS evaluation_count, avg(abs(prediction_model - observed_target)) AS m,
    avg(abs(prediction_persistence - observed_target)) AS q FROM predictions WHERE fold = 2001 GROUP BY 1, 2, 3, 4, 5),
c AS (SELECT horizon, feature_set, family, row_number() OVER (PARTITION BY horizon ORDER BY avg(mae_model), family <> 'blend_6', feature_set) AS rn FROM fold_metrics
  WHERE fold < 2001 GROUP BY 1, 2, 3)
SELECT f.fit_id, f.horizon, f.feature_set, f.family, evaluation_count, round(m, 8) AS mae_model, round(q, 8) AS mae_persistence, round(m - q, 8) + 0.0 AS mae_difference,
  c.rn = 1 AS preselected_champion, f.feature_set = 'cases_only' AND f.family = 'blend_6' AS fixed_reference
FROM f JOIN c ON c.horizon = f.horizon AND c.feature_set = f.feature_set AND c.family = f.family
""",
)
def final_metric_table(p: Panels) -> DataFrame:
    """Final fits with metrics read from their documents and flags from the earlier folds."""
    docs = documents(p)
    final = docs.filter("fold = 2001").select("fit_id", "horizon", "feature_set", "family", "n", "document")
    metrics = D.metric_document_rows(final, "document", ["model", "persistence"], ["mae"], "fit_id")
    dev = D.metric_document_rows(
        docs.filter("fold < 2001"), "document", ["model"], ["mae"], "horizon", "feature_set", "family", "fold"
    )
    out = E.final_table(
        final.drop("document").join(metrics, "fit_id"), dev.withColumnRenamed("model_mae", "mae"), reference="blend_6"
    )
    return _round(out, "mae_model", "mae_persistence", "mae_difference")


@query(
    "source_gap_index",
    """
WITH b AS (SELECT min(day) AS lo, max(day) AS hi FROM rain_daily),
g AS (SELECT n_nationkey AS entity_id, d::DATE AS day FROM nation, b, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS t(d))
SELECT g.entity_id, year(g.day)::BIGINT AS year, count(*)::BIGINT AS expected, count(r.day)::BIGINT AS available, (count(*) - count(r.day))::BIGINT AS missing,
  min(CASE WHEN r.day IS NULL THEN g.day END) AS first_missing
FROM g LEFT JOIN rain_daily r ON r.entity_id = g.entity_id AND r.day = g.day GROUP BY 1, 2
""",
)
def source_gap_index(p: Panels) -> DataFrame:
    bounds = p.rain_daily.agg(F.struct(F.min("day").alias("lo"), F.max("day").alias("hi"))).scalar()
    grid = p.entities.withColumn("_b", bounds).select(
        "entity_id", F.explode(F.sequence("_b.lo", "_b.hi", F.expr("interval 1 day"))).alias("day")
    )
    return S.gap_index(grid, p.rain_daily.select("entity_id", "day"), ["entity_id"], "day")


@query(
    "source_gap_list",
    """
WITH b AS (SELECT min(day) AS lo, max(day) AS hi FROM rain_daily),
g AS (SELECT n_nationkey AS entity_id, d::DATE AS day FROM nation, b, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS t(d))
SELECT g.entity_id, g.day FROM g WHERE NOT EXISTS (SELECT 1 FROM rain_daily r WHERE r.entity_id = g.entity_id AND r.day = g.day)
""",
)
def source_gap_list(p: Panels) -> DataFrame:
    bounds = p.rain_daily.agg(F.struct(F.min("day").alias("lo"), F.max("day").alias("hi"))).scalar()
    grid = p.entities.withColumn("_b", bounds).select(
        "entity_id", F.explode(F.sequence("_b.lo", "_b.hi", F.expr("interval 1 day"))).alias("day")
    )
    return coverage_of_expected(grid, p.rain_daily, ["entity_id", "day"])


cte(
    "source_records",
    f"""
SELECT s_suppkey, CASE s_suppkey % 3
  WHEN 0 THEN '{{"source_name":"S' || s_suppkey || '","request_url":"http://h/q","request_params":{{"a":"x y","b":"' || s_nationkey || '"}},"sha256":"' || md5(s_name) || '","byte_length":' || (s_suppkey * 7) || '}}'
  WHEN 1 THEN '{{"source":"S' || s_suppkey || '","upstream_url":"http://u/' || s_nationkey || '","request_url":"http://h/q","content_length":' || s_suppkey || ',"license":"L"}}'
  ELSE '{{"source_name":"S' || s_suppkey || '","source":"other","request_url":"http://h/only","retrieved_at":"2020-01-01","licenses":"M","license":"L"}}' END AS record
FROM supplier
""",
)


def source_records(p: Panels) -> DataFrame:
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    kind = F.col("s_suppkey") % 3
    record = (
        F.when(
            kind == 0,
            F.concat(
                F.lit('{"source_name":"S'), k,
                F.lit('","request_url":"http://h/q","request_params":{"a":"x y","b":"'), n,
                F.lit('"},"sha256":"'), F.md5("s_name"), F.lit('","byte_length":'),
                (F.col("s_suppkey") * 7).cast("string"), F.lit("}"),
            ),
        )
        .when(
            kind == 1,
            F.concat(
                F.lit('{"source":"S'), k, F.lit('","upstream_url":"http://u/'), n,
                F.lit('","request_url":"http://h/q","content_length":'), k, F.lit(',"license":"L"}'),
            ),
        )
        .otherwise(
            F.concat(
                F.lit('{"source_name":"S'), k,
                F.lit('","source":"other","request_url":"http://h/only","retrieved_at":"2020-01-01","licenses":"M","license":"L"}'),
            )
        )
    )
    return p.table("supplier").select("s_suppkey", record.alias("record"))


@query(
    "source_inventory",
    """
SELECT s_suppkey, 'S' || s_suppkey AS source_name, CASE s_suppkey % 3 WHEN 0 THEN 'http://h/q?a=x+y&b=' || s_nationkey WHEN 1 THEN 'http://u/' || s_nationkey ELSE 'http://h/only' END AS source_url,
  CASE WHEN s_suppkey % 3 = 0 THEN md5(s_name) END AS sha256, CASE s_suppkey % 3 WHEN 0 THEN s_suppkey * 7 WHEN 1 THEN s_suppkey END AS size_bytes,
  CASE WHEN s_suppkey % 3 = 2 THEN '2020-01-01' END AS retrieved_at, CASE s_suppkey % 3 WHEN 1 THEN 'L' WHEN 2 THEN 'M' END AS licenses FROM supplier
""",
)
def source_inventory(p: Panels) -> DataFrame:
    return D.inventory_records(source_records(p), "record")


