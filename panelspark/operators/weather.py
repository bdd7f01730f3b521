"""Hourly -> daily -> weekly weather, zonal means and joint coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.columns import all_of, as_col, clamp, count_where, finite, present, week_start

# Fixed values.
NODATA = -9999.0
MAGNUS_A = 17.625
MAGNUS_B = 243.04
CLIMATE_VARS = ("temp_mean_c", "temp_min_c", "temp_max_c", "humidity_mean_pct")
HOURS_PER_DAY = 24


def kelvin_to_celsius(k: str | Column) -> Column:
    return as_col(k) - 273.15


def relative_humidity(temp_c: str | Column, dewpoint_c: str | Column) -> Column:
    """Magnus relative humidity in percent, held to 0..100."""

    def vapour(t: Column) -> Column:
        return F.exp(F.lit(MAGNUS_A) * t / (F.lit(MAGNUS_B) + t))

    return clamp(vapour(as_col(dewpoint_c)) / vapour(as_col(temp_c)) * 100.0, 0.0, 100.0)


def mask_nodata(value: str | Column, nodata: float = NODATA) -> Column:
    v = as_col(value)
    return F.when(v != nodata, v)


def zonal_mean(
    weights: DataFrame,
    cells: DataFrame,
    values: Sequence[str],
    *,
    entity: str = "entity_id",
    cell: str = "cell_id",
    day: str = "day",
    entities: DataFrame | None = None,
) -> DataFrame:
    """Area-weighted daily mean per entity over cells that have all ``values``.

    The weights are renormalised over the valid cells; coverage is the valid weight in percent.
    Partial sums are combined map-side, so a large entity never gathers its cells in one task.
    With ``entities`` every one of them has a row for each day that occurs in ``cells``: null values, no
    coverage and 0 cells where none of its cells reports. ``weights_out_of_range`` checks the weights.
    """
    ok = all_of(present(v) for v in values)
    valid_weight = F.sum(F.when(ok, F.col("weight")).otherwise(0.0))
    joined = cells.join(weights.select(entity, cell, "weight"), cell, "inner")
    out = (
        joined.groupBy(entity, day)
        .agg(
            valid_weight.alias("_vw"),
            *[F.sum(F.when(ok, F.col(v) * F.col("weight"))).alias(f"_s_{v}") for v in values],
            F.count(F.lit(1)).alias("grid_cells"),
        )
        .select(
            entity,
            day,
            *[F.when(F.col("_vw") > 0, F.col(f"_s_{v}") / F.col("_vw")).alias(v) for v in values],
            clamp(F.col("_vw") * 100.0, 0.0, 100.0).alias("spatial_coverage_pct"),
            "grid_cells",
        )
    )
    if entities is None:
        return out
    # the days fit one row: their number is that of a calendar
    days = cells.filter(F.col(day).isNotNull()).agg(F.collect_set(day).alias("_days")).scalar()
    grid = entities.select(entity).distinct().select(entity, F.explode(days).alias(day))
    return grid.join(out, [entity, day], "left").fillna({"spatial_coverage_pct": 0.0, "grid_cells": 0})


def weights_out_of_range(
    weights: DataFrame, *, entity: str = "entity_id", cell: str = "cell_id", tolerance: float = 1e-9
) -> DataFrame:
    """Entities whose weights can give no share of an area: a weight that is missing, not finite or outside
    0..1, a cell listed twice, or a sum above 1. A coverage of 170 % would otherwise be held to 100 %."""
    w = F.col("weight")
    bad = ~finite(w) | (w < -tolerance) | (w > 1 + tolerance)
    # one row per cell first, so the number of cells is a plain count
    per_cell = weights.groupBy(entity, cell).agg(
        F.sum("weight").alias("_w"),
        F.count(F.lit(1)).alias("_n"),
        count_where(F.coalesce(bad, F.lit(True))).alias("_bad"),
    )
    return (
        per_cell.groupBy(entity)
        .agg(
            F.sum("_w").alias("weight_sum"),
            F.sum("_bad").alias("bad_weights"),
            count_where(F.col("_n") > 1).alias("repeated_cells"),
        )
        .filter(
            (F.col("bad_weights") > 0)
            | (F.col("repeated_cells") > 0)
            | (F.col("weight_sum") > 1 + tolerance)
        )
    )


def hourly_to_daily(
    hourly: DataFrame, *, node: str = "node", ts: str = "hour", temp: str = "temp", rh: str = "rh"
) -> DataFrame:
    """Daily mean/min/max temperature and mean humidity per node with its hour count."""
    return (
        hourly.groupBy(node, F.to_date(ts).alias("day"))
        .agg(
            F.avg(temp).alias("temp_mean_c"),
            F.min(temp).alias("temp_min_c"),
            F.max(temp).alias("temp_max_c"),
            F.avg(rh).alias("humidity_mean_pct"),
            count_where(present(temp) & present(rh)).alias("valid_hours"),
        )
    )


def hourly_completeness(
    hourly: DataFrame, *, node: str = "node", ts: str = "hour", temp: str = "temp", rh: str = "rh"
) -> DataFrame:
    """Node-days that are not 24 distinct local hours with both values, humidity in 0..100."""
    # one row per (node, hour) first: the distinct count below then is a plain count
    per_hour = hourly.groupBy(node, F.date_trunc("hour", ts).alias("_h")).agg(
        F.count(F.lit(1)).alias("_rows"),
        count_where(present(temp) & present(rh)).alias("_ok"),
        count_where((F.col(rh) < 0) | (F.col(rh) > 100)).alias("_bad"),
    )
    return (
        per_hour.groupBy(node, F.to_date("_h").alias("day"))
        .agg(
            F.count(F.lit(1)).alias("distinct_hours"),
            F.sum("_rows").alias("rows"),
            F.sum("_ok").alias("complete_rows"),
            F.sum("_bad").alias("humidity_out_of_range"),
        )
        .filter(
            (F.col("distinct_hours") != HOURS_PER_DAY)
            | (F.col("complete_rows") != HOURS_PER_DAY)
            | (F.col("rows") != HOURS_PER_DAY)
            | (F.col("humidity_out_of_range") > 0)
        )
    )


def keep_last(df: DataFrame, keys: Sequence[str], sequence: Sequence[str]) -> DataFrame:
    """Last row per key by an explicit sequence; a partial aggregate, not a window over copies."""
    payload = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*payload), F.struct(*sequence)).alias("_r"))
        .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in payload])
    )


def daily_outer_merge(
    rain: DataFrame, climate: DataFrame, *, entity: str = "entity_id", day: str = "day"
) -> DataFrame:
    r = rain.select(
        entity,
        day,
        "rainfall_mm",
        F.col("spatial_coverage_pct").alias("spatial_coverage_pct_rain"),
        F.col("grid_cells").alias("grid_cells_rain"),
    )
    c = climate.select(
        entity,
        day,
        *CLIMATE_VARS,
        F.col("spatial_coverage_pct").alias("spatial_coverage_pct_climate"),
        F.col("grid_cells").alias("grid_cells_climate"),
    )
    return r.join(c, [entity, day], "full_outer")


def weekly_weather(
    spine: DataFrame,
    rain: DataFrame,
    climate: DataFrame,
    *,
    entity: str = "entity_id",
    day: str = "day",
    week_of: Column | None = None,
    min_temporal_pct: float = 85.0,
    min_spatial_pct: float = 90.0,
) -> DataFrame:
    """Weekly weather per spine row with coverage percentages and quality flags.

    A day counts as available only when rain and all climate variables are present. Days map to
    weeks by arithmetic, so the interval lookup is one equi-join after a partial aggregation.
    """
    daily = daily_outer_merge(rain, climate, entity=entity, day=day)
    rain_ok = present("rainfall_mm")
    climate_ok = all_of(present(v) for v in CLIMATE_VARS)
    on_rain = lambda c: F.when(rain_ok, F.col(c))
    on_climate = lambda c: F.when(climate_ok, F.col(c))
    weekly = daily.groupBy(entity, (week_of or week_start(day)).alias("week_start")).agg(
        F.sum(on_rain("rainfall_mm")).alias("rainfall_sum_mm"),
        F.avg(on_rain("rainfall_mm")).alias("rainfall_mean_daily_mm"),
        F.max(on_rain("rainfall_mm")).alias("rainfall_max_daily_mm"),
        F.sum(F.when(rain_ok, (F.col("rainfall_mm") >= 1.0).cast("long"))).alias("rain_days_1mm"),
        F.sum(F.when(rain_ok, (F.col("rainfall_mm") >= 10.0).cast("long"))).alias("rain_days_10mm"),
        F.avg(on_climate("temp_mean_c")).alias("temp_mean_c"),
        F.min(on_climate("temp_min_c")).alias("temp_min_c"),
        F.max(on_climate("temp_max_c")).alias("temp_max_c"),
        F.avg(on_climate("humidity_mean_pct")).alias("humidity_mean_pct"),
        count_where(rain_ok).alias("_rain_days"),
        count_where(climate_ok).alias("_climate_days"),
        count_where(rain_ok & climate_ok).alias("_days"),
        F.max("grid_cells_rain").alias("_cells_r"),
        F.max("grid_cells_climate").alias("_cells_c"),
        F.least(
            F.min(on_rain("spatial_coverage_pct_rain")),
            F.min(on_climate("spatial_coverage_pct_climate")),
        ).alias("weather_spatial_coverage_pct"),
    )
    expected = F.datediff("week_end", "week_start") + 1
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    temporal = F.col("weather_available_days") * 100.0 / F.col("weather_expected_days")
    # Flag names and their order.
    flags = F.concat_ws(
        ";",
        F.when(F.col("weather_temporal_coverage_pct") < min_temporal_pct, "low_temporal_coverage"),
        F.when(F.col("weather_spatial_coverage_pct") < min_spatial_pct, "low_spatial_coverage"),
        F.when(zero("_rain_days") == 0, "rain_missing"),
        F.when(zero("_climate_days") == 0, "climate_missing"),
    )
    return (
        spine.join(weekly, [entity, "week_start"], "left")
        .withColumn("weather_expected_days", expected.cast("long"))
        .withColumn("weather_available_days", zero("_days").cast("long"))
        .withColumn("weather_temporal_coverage_pct", temporal)
        .withColumn(
            "weather_grid_cells",
            F.greatest(zero("_cells_r"), zero("_cells_c")).cast("long"),
        )
        .withColumn("weather_quality_flag", F.when(flags == "", "ok").otherwise(flags))
        .drop("_rain_days", "_climate_days", "_days", "_cells_r", "_cells_c")
    )


def rollup_status(
    df: DataFrame, *, status: str, totals: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Overall status and totals of per-chunk acquisition records."""
    return df.groupBy(*by).agg(
        F.when(F.bool_and(F.col(status) == "complete"), "complete")
        .otherwise("partial")
        .alias("status"),
        F.count(F.lit(1)).alias("chunks"),
        *[F.sum(c).cast("long").alias(c) for c in totals],
    )
