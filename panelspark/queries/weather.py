"""Grids, area weights, zonal means and weekly weather."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.columns import digest_int, rounded
from panelspark.operators import calendar, geo, weather
from panelspark.queries.base import cte, px, py, query, weekly_weather_sql
from panelspark.sources.panels import Panels

RES = 0.25

cte(
    "touched",
    f"""
SELECT b.*, r AS cell_row, c AS cell_col FROM boxes b,
  unnest(generate_series(floor((min_lat - 0.125) / {RES})::BIGINT, ceil((max_lat + 0.125) / {RES})::BIGINT)) AS t1(r),
  unnest(generate_series(floor((min_lon - 0.125) / {RES})::BIGINT, ceil((max_lon + 0.125) / {RES})::BIGINT)) AS t2(c)
""",
)
_W, _E = f"greatest(min_lon, cell_col * {RES}::DOUBLE - 0.125)", f"least(max_lon, cell_col * {RES}::DOUBLE + 0.125)"
_S, _N = f"greatest(min_lat, cell_row * {RES}::DOUBLE - 0.125)", f"least(max_lat, cell_row * {RES}::DOUBLE + 0.125)"
cte(
    "area_weights",
    f"""
SELECT entity_id, cell_id, lat, lon, a AS intersection_area_m2, t AS entity_area_m2, a / t AS weight FROM (
  SELECT entity_id, printf('%.4f,%.4f', cell_row * {RES}::DOUBLE, cell_col * {RES}::DOUBLE) AS cell_id,
    cell_row * {RES}::DOUBLE AS lat, cell_col * {RES}::DOUBLE AS lon,
    ({px(_E)} - {px(_W)}) * ({py(_N)} - {py(_S)}) AS a,
    ({px("max_lon")} - {px("min_lon")}) * ({py("max_lat")} - {py("min_lat")}) AS t
  FROM touched WHERE {_E} > {_W} AND {_N} > {_S})
WHERE a > 0
""",
)
cte(
    "cell_daily",
    """
SELECT cell_id, day, CASE WHEN ('0x' || substr(md5(cell_id || '|' || day), 1, 8))::BIGINT % 11 = 0
    THEN -9999.0::DOUBLE ELSE v END AS value
FROM (SELECT w.cell_id, r.day, max(r.rainfall_mm) AS v
      FROM rain_daily r JOIN area_weights w ON w.entity_id = r.entity_id GROUP BY 1, 2)
""",
)


def box_weights(p: Panels) -> DataFrame:
    return geo.box_area_weights(p.boxes, RES)


def cell_daily(p: Panels) -> DataFrame:
    """Daily cell values: the rain of the areas a cell touches, with some nodata cells."""
    w = box_weights(p).select("entity_id", "cell_id")
    merged = (
        p.rain_daily.select("entity_id", "day", "rainfall_mm")
        .join(w, "entity_id")
        .groupBy("cell_id", "day")
        .agg(F.max("rainfall_mm").alias("v"))
    )
    dead = digest_int("cell_id", "day") % 11 == 0
    return merged.select(
        "cell_id", "day", F.when(dead, weather.NODATA).otherwise(F.col("v")).alias("value")
    )


@query(
    "native_grid",
    f"""
SELECT printf('%.4f,%.4f', r * {RES}::DOUBLE, c * {RES}::DOUBLE) AS cell_id, r AS cell_row, c AS cell_col,
  r * {RES}::DOUBLE AS lat, c * {RES}::DOUBLE AS lon
FROM (SELECT min(min_lon) AS x0, min(min_lat) AS y0, max(max_lon) AS x1, max(max_lat) AS y1 FROM boxes) b,
  unnest(generate_series(floor((y0 - 0.125) / {RES})::BIGINT, ceil((y1 + 0.125) / {RES})::BIGINT)) AS t1(r),
  unnest(generate_series(floor((x0 - 0.125) / {RES})::BIGINT, ceil((x1 + 0.125) / {RES})::BIGINT)) AS t2(c)
""",
)
def native_grid(p: Panels) -> DataFrame:
    return geo.native_grid(geo.overall_bounds(p.boxes), RES)


@query(
    "area_weights",
    """
SELECT entity_id, cell_id, lat, lon, round(intersection_area_m2 / 1e6, 4) AS intersection_km2,
       round(weight, 6) AS weight FROM area_weights
""",
)
def area_weights(p: Panels) -> DataFrame:
    return box_weights(p).select(
        "entity_id", "cell_id", "lat", "lon",
        rounded(F.col("intersection_area_m2") / 1e6, 4).alias("intersection_km2"),
        rounded("weight").alias("weight"),
    )


@query(
    "ring_area_weights",
    """
SELECT entity_id, cell_id, round(weight, 6) AS weight FROM area_weights
""",
)
def ring_area_weights(p: Panels) -> DataFrame:
    """The general polygon path on the same areas given as vertex rings."""
    w = geo.ring_area_weights(p.rings, RES)
    return w.select("entity_id", "cell_id", rounded("weight").alias("weight"))


@query(
    "polygon_area_centroid",
    f"""
SELECT a.entity_id, round(a.area_km2, 4) AS area_km2, round(a.centroid_lon, 6) AS centroid_lon,
  round({py("b.min_lat")} / 2 + {py("b.max_lat")} / 2, 1) AS centroid_y
FROM box_area a JOIN boxes b ON a.entity_id = b.entity_id
""",
)
def polygon_area_centroid(p: Panels) -> DataFrame:
    c = geo.ring_area_centroid(p.rings)
    return c.select(
        "entity_id",
        rounded("area_km2", 4).alias("area_km2"),
        rounded("centroid_lon").alias("centroid_lon"),
        rounded(geo.project_y(F.col("centroid_lat")), 1).alias("centroid_y"),
    )


cte(
    "part_boxes",
    """
SELECT entity_id, sign, min_lon + (max_lon - min_lon) * x0 AS min_lon, min_lat + (max_lat - min_lat) * y0 AS min_lat,
  min_lon + (max_lon - min_lon) * x1 AS max_lon, min_lat + (max_lat - min_lat) * y1 AS max_lat
FROM boxes, (VALUES (1, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE), (-1, 1 / 3.0::DOUBLE, 1 / 3.0::DOUBLE, 2 / 3.0::DOUBLE, 2 / 3.0::DOUBLE),
  (1, 1.5::DOUBLE, 0.25::DOUBLE, 1.75::DOUBLE, 0.5::DOUBLE)) AS t(sign, x0, y0, x1, y1)
""",
)
cte(
    "part_areas",
    f"""
SELECT entity_id, sum(sign * a) AS area, sum(sign * a * (min_lon + max_lon) / 2) / sum(sign * a) AS centroid_lon,
  sum(sign * a * ({py("min_lat")} + {py("max_lat")}) / 2) / sum(sign * a) AS centroid_y
FROM (SELECT *, ({px("max_lon")} - {px("min_lon")}) * ({py("max_lat")} - {py("min_lat")}) AS a FROM part_boxes) GROUP BY 1
""",
)


@query(
    "multipart_area_weights",
    f"""
WITH t AS (SELECT b.*, r AS cell_row, c AS cell_col FROM part_boxes b,
  unnest(generate_series(floor((min_lat - 0.125) / {RES})::BIGINT, ceil((max_lat + 0.125) / {RES})::BIGINT)) AS t1(r),
  unnest(generate_series(floor((min_lon - 0.125) / {RES})::BIGINT, ceil((max_lon + 0.125) / {RES})::BIGINT)) AS t2(c)),
g AS (SELECT entity_id, cell_row, cell_col, sum(sign * ({px(_E)} - {px(_W)}) * ({py(_N)} - {py(_S)})) AS a FROM t WHERE {_E} > {_W} AND {_N} > {_S} GROUP BY 1, 2, 3)
SELECT entity_id, printf('%.4f,%.4f', cell_row * {RES}::DOUBLE, cell_col * {RES}::DOUBLE) AS cell_id, round(a / 1e6, 4) AS intersection_km2, round(a / area, 6) AS weight
FROM g JOIN part_areas USING (entity_id) WHERE a > 1
""",
)
def multipart_area_weights(p: Panels) -> DataFrame:
    """Areas of several rings with a hole and an island."""
    w = geo.ring_area_weights(p.part_rings, RES)
    return w.select("entity_id", "cell_id", rounded(F.col("intersection_area_m2") / 1e6, 4).alias("intersection_km2"), rounded("weight").alias("weight"))


@query(
    "multipart_area_centroid",
    "SELECT entity_id, round(area / 1e6, 4) AS area_km2, round(centroid_lon, 6) AS centroid_lon, round(centroid_y, 1) AS centroid_y FROM part_areas",
)
def multipart_area_centroid(p: Panels) -> DataFrame:
    c = geo.ring_area_centroid(p.part_rings)
    return c.select(
        "entity_id",
        rounded("area_km2", 4).alias("area_km2"),
        rounded("centroid_lon").alias("centroid_lon"),
        rounded(geo.project_y(F.col("centroid_lat")), 1).alias("centroid_y"),
    )


@query(
    "nodata_mask",
    """
SELECT year(day)::BIGINT AS year, count(*)::BIGINT AS cells, count(CASE WHEN value <> -9999 THEN 1 END)::BIGINT AS valid,
  count(CASE WHEN value < 0 AND value <> -9999 THEN 1 END)::BIGINT AS invalid_negative,
  round(sum(CASE WHEN value <> -9999 THEN value END), 4) AS total
FROM cell_daily GROUP BY 1
""",
)
def nodata_mask(p: Panels) -> DataFrame:
    masked = cell_daily(p).withColumn("value", weather.mask_nodata("value"))
    return masked.groupBy(F.year("day").cast("long").alias("year")).agg(
        F.count(F.lit(1)).alias("cells"),
        F.count("value").alias("valid"),
        F.count(F.when(F.col("value") < 0, 1)).alias("invalid_negative"),
        rounded(F.sum("value"), 4).alias("total"),
    )


def nations(p: Panels) -> DataFrame:
    return p.table("nation").select(F.col("n_nationkey").alias("entity_id"))


@query(
    "zonal_rainfall",
    """
SELECT entity_id, day,
  round(sum(CASE WHEN value <> -9999 THEN value * weight END)
    / nullif(sum(CASE WHEN value <> -9999 THEN weight ELSE 0 END), 0), 6) AS rainfall_mm,
  round(least(100.0, greatest(0.0, 100 * sum(CASE WHEN value <> -9999 THEN weight ELSE 0 END))), 6)
    AS spatial_coverage_pct,
  count(*)::BIGINT AS grid_cells
FROM area_weights w JOIN cell_daily c ON c.cell_id = w.cell_id GROUP BY 1, 2
UNION ALL
SELECT n_nationkey, day, NULL, 0, 0 FROM nation CROSS JOIN (SELECT DISTINCT day FROM cell_daily) d
WHERE NOT EXISTS (SELECT 1 FROM area_weights w JOIN cell_daily c ON c.cell_id = w.cell_id
  WHERE w.entity_id = n_nationkey AND c.day = d.day)
""",
)
def zonal_rainfall(p: Panels) -> DataFrame:
    cells = cell_daily(p).withColumn("rainfall_mm", weather.mask_nodata("value"))
    z = weather.zonal_mean(box_weights(p), cells, ["rainfall_mm"], entities=nations(p))
    return z.select(
        "entity_id", "day", rounded("rainfall_mm").alias("rainfall_mm"),
        rounded("spatial_coverage_pct").alias("spatial_coverage_pct"), "grid_cells",
    )


@query(
    "zonal_climate",
    """
WITH g AS (SELECT cell_id, day, CASE WHEN value <> -9999 THEN 20 + value / 100 END AS t,
    CASE WHEN value > 0 AND value < 200 THEN value / 4 END AS h FROM cell_daily),
j AS (SELECT w.entity_id, g.day, g.t, g.h, w.weight, (t IS NOT NULL AND h IS NOT NULL) AS ok
      FROM area_weights w JOIN g ON g.cell_id = w.cell_id)
SELECT entity_id, day, round(sum(CASE WHEN ok THEN t * weight END) / nullif(sum(CASE WHEN ok THEN weight ELSE 0 END), 0), 6) AS temp_mean_c,
  round(sum(CASE WHEN ok THEN h * weight END) / nullif(sum(CASE WHEN ok THEN weight ELSE 0 END), 0), 6) AS humidity_mean_pct,
  round(least(100.0, 100 * sum(CASE WHEN ok THEN weight ELSE 0 END)), 6) AS spatial_coverage_pct,
  count(*)::BIGINT AS grid_cells
FROM j GROUP BY 1, 2
UNION ALL
SELECT n_nationkey, day, NULL, NULL, 0, 0 FROM nation CROSS JOIN (SELECT DISTINCT day FROM cell_daily) d
WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.entity_id = n_nationkey AND j.day = d.day)
""",
)
def zonal_climate(p: Panels) -> DataFrame:
    v = weather.mask_nodata("value")
    cells = cell_daily(p).select(
        "cell_id", "day",
        (v / 100.0 + 20.0).alias("temp_mean_c"),
        F.when((F.col("value") > 0) & (F.col("value") < 200), F.col("value") / 4.0).alias(
            "humidity_mean_pct"
        ),
    )
    z = weather.zonal_mean(box_weights(p), cells, ["temp_mean_c", "humidity_mean_pct"], entities=nations(p))
    return z.select(
        "entity_id", "day", "grid_cells",
        *[rounded(c).alias(c) for c in ("temp_mean_c", "humidity_mean_pct", "spatial_coverage_pct")],
    )


@query(
    "hourly_to_daily",
    """
SELECT node, hour::DATE AS day, round(avg(temp), 9) AS temp_mean_c, round(min(temp), 6) AS temp_min_c,
  round(max(temp), 6) AS temp_max_c, round(avg(rh), 6) AS humidity_mean_pct, count(*)::BIGINT AS valid_hours
FROM hourly GROUP BY 1, 2
""",
)
def hourly_to_daily(p: Panels) -> DataFrame:
    d = weather.hourly_to_daily(p.hourly)
    return d.withColumns(
        {
            "temp_mean_c": rounded("temp_mean_c", 9),
            **{c: rounded(c) for c in ("temp_min_c", "temp_max_c", "humidity_mean_pct")},
        }
    )


@query(
    "climate_scalars",
    """
WITH d AS (SELECT entity_id, day, temp_mean_c AS t, temp_mean_c - humidity_mean_pct / 30 AS dew FROM climate_daily)
SELECT entity_id, day, round(t + 273.15 - 273.15, 6) AS temp_c,
  round(least(100.0, greatest(0.0, 100 * exp(17.625 * dew / (243.04 + dew)) / exp(17.625 * t / (243.04 + t)))), 6) AS humidity_pct
FROM d
""",
)
def climate_scalars(p: Panels) -> DataFrame:
    t = F.col("temp_mean_c")
    dew = t - F.col("humidity_mean_pct") / 30.0
    return p.climate_daily.select(
        "entity_id", "day",
        rounded(weather.kelvin_to_celsius(t + 273.15)).alias("temp_c"),
        rounded(weather.relative_humidity(t, dew)).alias("humidity_pct"),
    )


_WEEKLY_COLS = (
    "rainfall_sum_mm", "rainfall_mean_daily_mm", "rainfall_max_daily_mm", "temp_mean_c",
    "temp_min_c", "temp_max_c", "humidity_mean_pct", "weather_temporal_coverage_pct",
    "weather_spatial_coverage_pct",
)


@query(
    "weekly_weather",
    "SELECT entity_id, week_start, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in _WEEKLY_COLS)
    + ", rain_days_1mm, rain_days_10mm, weather_expected_days, weather_available_days,"
    " weather_grid_cells, weather_quality_flag FROM ("
    + weekly_weather_sql(85.0, 90.0)
    + ")",
)
def weekly_weather(p: Panels) -> DataFrame:
    w = weather.weekly_weather(p.spine, p.rain_daily, p.climate_daily)
    return w.select(
        "entity_id", "week_start", *[rounded(c).alias(c) for c in _WEEKLY_COLS], "rain_days_1mm",
        "rain_days_10mm", "weather_expected_days", "weather_available_days", "weather_grid_cells",
        "weather_quality_flag",
    )


@query(
    "daily_keep_last",
    """
SELECT entity_id, day, l_orderkey, l_linenumber, round(l_quantity, 2) AS quantity FROM (
  SELECT s_nationkey AS entity_id, l_shipdate::DATE AS day, l_orderkey, l_linenumber, l_quantity,
    row_number() OVER (PARTITION BY s_nationkey, l_shipdate::DATE
      ORDER BY l_orderkey DESC, l_linenumber DESC, l_quantity DESC, l_partkey DESC) AS rn
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) WHERE rn = 1
""",
)
def daily_keep_last(p: Panels) -> DataFrame:
    rows = (
        p.table("lineitem")
        .join(p.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("s_nationkey").alias("entity_id"), F.to_date("l_shipdate").alias("day"),
            "l_orderkey", "l_linenumber", "l_quantity", "l_partkey",
        )
    )
    last = weather.keep_last(
        rows, ["entity_id", "day"], ["l_orderkey", "l_linenumber", "l_quantity", "l_partkey"]
    )
    return last.select(
        "entity_id", "day", "l_orderkey", "l_linenumber", rounded("l_quantity", 2).alias("quantity")
    )


@query(
    "daily_outer_merge",
    """
SELECT entity_id, day, round(rainfall_mm, 6) AS rainfall_mm, round(temp_mean_c, 6) AS temp_mean_c,
  spatial_coverage_pct_rain, grid_cells_rain, spatial_coverage_pct_climate, grid_cells_climate FROM daily_both
""",
)
def daily_outer_merge(p: Panels) -> DataFrame:
    d = weather.daily_outer_merge(p.rain_daily, p.climate_daily)
    return d.select(
        "entity_id", "day", rounded("rainfall_mm").alias("rainfall_mm"),
        rounded("temp_mean_c").alias("temp_mean_c"), "spatial_coverage_pct_rain", "grid_cells_rain",
        "spatial_coverage_pct_climate", "grid_cells_climate",
    )


@query(
    "year_chunks",
    """
SELECT entity_id, y AS year, greatest(lo, make_date(y, 1, 1)) AS chunk_start,
  CASE WHEN y = 2000 AND hi >= DATE '2001-01-05' THEN DATE '2001-01-05' ELSE least(hi, make_date(y, 12, 31)) END AS chunk_end
FROM (SELECT entity_id, min(day) AS lo, max(day) AS hi FROM rain_daily GROUP BY 1),
  unnest(generate_series(year(lo), year(hi))) AS t(y)
""",
)
def year_chunks(p: Panels) -> DataFrame:
    bounds = p.rain_daily.groupBy("entity_id").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    return (
        calendar.year_chunks(bounds, tail=(2000, "2001-01-05"))
        .withColumn("year", F.col("year").cast("long"))
        .select("entity_id", "year", "chunk_start", "chunk_end")
    )


@query(
    "bbox_cell_window",
    """
WITH cells AS (
  SELECT r AS cell_row, c AS cell_col, count(*)::BIGINT AS n FROM (
    SELECT (c_custkey % 60)::BIGINT AS r, ((c_custkey // 60) % 80)::BIGINT AS c FROM customer) GROUP BY 1, 2),
b AS (SELECT min(min_lon) AS x0, min(min_lat) AS y0, max(max_lon) AS x1, max(max_lat) AS y1 FROM boxes)
SELECT cell_row, cell_col, n FROM cells, b
WHERE cell_row >= greatest(0, floor((10.0 - y1) / 0.1)) AND cell_row < least(60, ceil((10.0 - y0) / 0.1))
  AND cell_col >= greatest(0, floor((x0 - 79.0) / 0.1)) AND cell_col < least(80, ceil((x1 - 79.0) / 0.1))
""",
)
def bbox_cell_window(p: Panels) -> DataFrame:
    k = F.col("c_custkey")
    cells = (
        p.table("customer")
        .select((k % 60).alias("cell_row"), (F.floor(k / 60) % 80).alias("cell_col"))
        .groupBy("cell_row", "cell_col")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    bounds = geo.overall_bounds(p.boxes)
    scalar = bounds.select(F.struct(*bounds.columns)).scalar()
    return geo.cell_window(
        cells, origin_lon=79.0, origin_lat=10.0, resolution=0.1, bounds=scalar, n_rows=60, n_cols=80
    )


@query(
    "acquisition_rollup",
    """
SELECT entity_id, CASE WHEN bool_and(have >= need) THEN 'complete' ELSE 'partial' END AS status,
  count(*)::BIGINT AS chunks, sum(need)::BIGINT AS expected_days, sum(have)::BIGINT AS available_days
FROM (SELECT entity_id, year(day) AS y, count(*) AS have,
        (max(day) - min(day) + 1) AS need FROM rain_daily GROUP BY 1, 2) GROUP BY 1
""",
)
def acquisition_rollup(p: Panels) -> DataFrame:
    chunks = p.rain_daily.groupBy("entity_id", F.year("day").alias("y")).agg(
        F.count(F.lit(1)).alias("available_days"),
        (F.datediff(F.max("day"), F.min("day")) + 1).alias("expected_days"),
    )
    done = F.when(F.col("available_days") >= F.col("expected_days"), "complete").otherwise("partial")
    return weather.rollup_status(
        chunks.withColumn("chunk_status", done),
        status="chunk_status",
        totals=["expected_days", "available_days"],
        by=["entity_id"],
    )


@query(
    "grid_nodes_fingerprint",
    """
SELECT n_cells, count(*)::BIGINT AS days, min(day) AS first_day FROM (
  SELECT day, count(*)::BIGINT AS n_cells,
    sum(('0x' || substr(md5(cell_id), 1, 8))::BIGINT)::BIGINT AS fingerprint
  FROM cell_daily GROUP BY 1) GROUP BY n_cells, fingerprint
""",
)
def grid_nodes_fingerprint(p: Panels) -> DataFrame:
    """Grids in use per day; more than one row per grid means the grid changed between days."""
    per_day = geo.grid_fingerprints(cell_daily(p), day="day", cell="cell_id")
    return (
        per_day.groupBy("n_cells", "fingerprint")
        .agg(F.count(F.lit(1)).alias("days"), F.min("day").alias("first_day"))
        .drop("fingerprint")
    )


@query(
    "reference_build",
    """
SELECT entity_id, entity_name, group_name, population_reference, round(area_km2, 4) AS area_km2,
  round(population_density_per_km2, 6) AS population_density_per_km2 FROM reference_dim
""",
)
def reference_build(p: Panels) -> DataFrame:
    return p.reference.select(
        "entity_id", "entity_name", "group_name", "population_reference",
        rounded("area_km2", 4).alias("area_km2"),
        rounded("population_density_per_km2").alias("population_density_per_km2"),
    )
