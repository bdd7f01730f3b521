"""Panel tables derived from the star-schema tables.

Nations stand for areas, order counts for weekly reports, line items for daily weather. Counts are
pre-aggregated on the foreign key before the dimension join, so a hot customer or supplier reaches
the shuffle as at most one row per week or day.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.columns import plus_days, week_start
from panelspark.operators import calendar, features, weather
from panelspark.operators.contracts import normalize_quality_tokens
from panelspark.session import stage_table
from panelspark.sources.tables import table

# Parameters of the derived panels.
BOX_ORIGIN = (80.0, 6.0)
BOX_PITCH = 0.4
BOX_SIDE = 0.37
MIN_TEMPORAL_PCT = 40.0
MIN_SPATIAL_PCT = 50.0
NO_POPULATION_ENTITY = 7
UNRETURNED = "R"
CLIMATE_LINES = 4


class Panels:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    # ---- reports -------------------------------------------------------------------------

    def counts_by(self, *extra: str, week: Column | None = None) -> DataFrame:
        """Orders per (entity, week) and any extra order or customer columns."""
        orders, customer = self.table("orders"), self.table("customer")
        from_orders = [c for c in extra if c in orders.columns]
        from_customer = [c for c in extra if c not in orders.columns]
        wk = week if week is not None else week_start("o_orderdate")
        per_customer = orders.groupBy("o_custkey", wk.alias("week_start"), *from_orders).agg(
            F.count(F.lit(1)).alias("n")
        )
        dim = customer.select("c_custkey", "c_nationkey", *from_customer)
        return (
            per_customer.join(dim, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(F.col("c_nationkey").alias("entity_id"), "week_start", *extra)
            .agg(F.sum("n").alias("value"))
        )

    @cached_property
    def weekly_obs(self) -> DataFrame:
        return self.counts_by()

    @cached_property
    def entities(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").alias("entity_id"))

    @cached_property
    def spine(self) -> DataFrame:
        return calendar.week_spine(self.entities, self.weekly_obs)

    @cached_property
    def obs_panel(self) -> DataFrame:
        """Spine with the observed value (null in gaps)."""
        return self.spine.join(self.weekly_obs, ["entity_id", "week_start"], "left")

    @cached_property
    def multi_source(self) -> DataFrame:
        return self.counts_by("o_orderpriority").withColumnRenamed("o_orderpriority", "source")

    @cached_property
    def components(self) -> DataFrame:
        return self.counts_by("c_mktsegment").withColumnRenamed("c_mktsegment", "component")

    @cached_property
    def status_totals(self) -> DataFrame:
        """Weekly totals of the whole country by order status."""
        return (
            self.table("orders")
            .groupBy(week_start("o_orderdate").alias("week_start"), "o_orderstatus")
            .agg(F.count(F.lit(1)).alias("value"))
        )

    @cached_property
    def offset_obs(self) -> DataFrame:
        """The same reports on Monday weeks."""
        d = F.col("o_orderdate")
        monday = F.date_sub(d.cast("date"), F.weekday(d))
        return self.counts_by(week=monday).select(
            "entity_id",
            F.col("week_start").alias("start"),
            plus_days("week_start", 6).alias("end"),
            "value",
        )

    @cached_property
    def labelled_obs(self) -> DataFrame:
        """Weekly observations with the label and source columns of a report table."""
        iso_thursday = F.date_add("week_start", 3)
        return self.weekly_obs.select(
            "entity_id",
            "week_start",
            plus_days("week_start", 6).alias("week_end"),
            F.year(iso_thursday).cast("long").alias("year"),
            F.weekofyear("week_start").cast("long").alias("week"),
            F.col("value").alias("cases"),
            F.lit("observed").alias("case_status"),
            F.concat(F.lit("report_"), F.date_format("week_start", "yyyyMMdd")).alias(
                "source_document"
            ),
        )

    # ---- weather -------------------------------------------------------------------------

    @cached_property
    def rain_daily(self) -> DataFrame:
        per_supplier = (
            self.table("lineitem")
            .filter(F.col("l_returnflag") != UNRETURNED)
            .groupBy("l_suppkey", F.to_date("l_shipdate").alias("day"))
            .agg(F.sum("l_quantity").alias("q"))
        )
        return (
            per_supplier.join(self._supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy(F.col("s_nationkey").alias("entity_id"), "day")
            .agg(
                F.sum("q").alias("rainfall_mm"),
                (F.least(F.lit(1.0), F.count(F.lit(1)) / 2.0) * 100.0).alias(
                    "spatial_coverage_pct"
                ),
                F.count(F.lit(1)).alias("grid_cells"),
            )
        )

    @cached_property
    def _supplier(self) -> DataFrame:
        return self.table("supplier").select("s_suppkey", "s_nationkey")

    @cached_property
    def climate_daily(self) -> DataFrame:
        temp = F.lit(20.0) + F.col("l_discount") * 100.0
        hum = F.lit(60.0) + F.col("l_tax") * 100.0
        per_supplier = (
            self.table("lineitem")
            .filter(F.col("l_linenumber") <= CLIMATE_LINES)
            .groupBy("l_suppkey", F.to_date("l_shipdate").alias("day"))
            .agg(
                F.sum(temp).alias("st"),
                F.min(temp).alias("nt"),
                F.max(temp).alias("xt"),
                F.sum(hum).alias("sh"),
                F.count(F.lit(1)).alias("n"),
            )
        )
        return (
            per_supplier.join(self._supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy(F.col("s_nationkey").alias("entity_id"), "day")
            .agg(
                (F.sum("st") / F.sum("n")).alias("temp_mean_c"),
                F.min("nt").alias("temp_min_c"),
                F.max("xt").alias("temp_max_c"),
                (F.sum("sh") / F.sum("n")).alias("humidity_mean_pct"),
                (F.least(F.lit(1.0), F.count(F.lit(1)) / 2.0) * 100.0).alias(
                    "spatial_coverage_pct"
                ),
                F.count(F.lit(1)).alias("grid_cells"),
            )
        )

    @cached_property
    def daily_weather(self) -> DataFrame:
        """:attr:`rain_daily` and :attr:`climate_daily` side by side, from one pass over the line items."""
        temp = F.lit(20.0) + F.col("l_discount") * 100.0
        hum = F.lit(60.0) + F.col("l_tax") * 100.0
        rain, climate = F.col("l_returnflag") != UNRETURNED, F.col("l_linenumber") <= CLIMATE_LINES
        per_supplier = (
            self.table("lineitem")
            .filter(rain | climate)
            .groupBy("l_suppkey", F.to_date("l_shipdate").alias("day"))
            .agg(
                F.sum(F.when(rain, F.col("l_quantity"))).alias("q"),
                F.count(F.when(rain, 1)).alias("rains"),
                F.sum(F.when(climate, temp)).alias("st"),
                F.min(F.when(climate, temp)).alias("nt"),
                F.max(F.when(climate, temp)).alias("xt"),
                F.sum(F.when(climate, hum)).alias("sh"),
                F.count(F.when(climate, 1)).alias("n"),
            )
        )
        return (
            per_supplier.join(self._supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy(F.col("s_nationkey").alias("entity_id"), "day")
            .agg(
                F.sum("q").alias("rainfall_mm"),
                F.count(F.when(F.col("rains") > 0, 1)).alias("rain_cells"),
                (F.sum("st") / F.nullif(F.sum("n"), F.lit(0))).alias("temp_mean_c"),
                F.min("nt").alias("temp_min_c"),
                F.max("xt").alias("temp_max_c"),
                (F.sum("sh") / F.nullif(F.sum("n"), F.lit(0))).alias("humidity_mean_pct"),
                F.count(F.when(F.col("n") > 0, 1)).alias("climate_cells"),
            )
        )

    def stage_sources(self) -> None:
        """Writes weekly reports and daily weather, so that all panels of this object read orders and line items once."""
        daily = stage_table(self.daily_weather, "daily_weather")

        def cells(count: str, *values: str) -> DataFrame:
            coverage = F.least(F.lit(1.0), F.col(count) / 2.0) * 100.0
            kept = daily.filter(F.col(count) > 0)
            return kept.select("entity_id", "day", *values, coverage.alias("spatial_coverage_pct"), F.col(count).alias("grid_cells"))

        self.rain_daily = cells("rain_cells", "rainfall_mm")
        self.climate_daily = cells("climate_cells", "temp_mean_c", "temp_min_c", "temp_max_c", "humidity_mean_pct")
        self.weekly_obs = stage_table(self.weekly_obs, "weekly_obs")

    @cached_property
    def weather_weekly(self) -> DataFrame:
        return weather.weekly_weather(
            self.spine,
            self.rain_daily,
            self.climate_daily,
            min_temporal_pct=MIN_TEMPORAL_PCT,
            min_spatial_pct=MIN_SPATIAL_PCT,
        )

    @cached_property
    def hourly(self) -> DataFrame:
        """Hourly readings per node: mean event value as temperature, a bounded mix as humidity."""
        return (
            self.table("events")
            .groupBy(F.col("event_type").alias("node"), F.date_trunc("hour", "ts").alias("hour"))
            .agg(F.avg("value").alias("temp"), F.pmod(F.sum("user_id"), F.lit(101)).alias("rh"))
        )

    # ---- geography -----------------------------------------------------------------------

    @cached_property
    def boxes(self) -> DataFrame:
        k = F.col("n_nationkey")
        lon = F.lit(BOX_ORIGIN[0]) + (k % 5) * BOX_PITCH
        lat = F.lit(BOX_ORIGIN[1]) + F.floor(k / 5) * BOX_PITCH
        return self.table("nation").select(
            k.alias("entity_id"),
            lon.alias("min_lon"),
            lat.alias("min_lat"),
            (lon + BOX_SIDE).alias("max_lon"),
            (lat + BOX_SIDE).alias("max_lat"),
        )

    @cached_property
    def rings(self) -> DataFrame:
        """Closed five-vertex ring per entity as an array of (lon, lat)."""
        corner = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
        return self.boxes.select(
            "entity_id",
            F.array(
                corner("min_lon", "min_lat"),
                corner("max_lon", "min_lat"),
                corner("max_lon", "max_lat"),
                corner("min_lon", "max_lat"),
                corner("min_lon", "min_lat"),
            ).alias("ring"),
        )

    @cached_property
    def part_boxes(self) -> DataFrame:
        """Three boxes per entity: its area, a hole of a third of each side in the middle, and an island beyond."""
        w, h = F.col("max_lon") - F.col("min_lon"), F.col("max_lat") - F.col("min_lat")
        parts = ((False, 0.0, 0.0, 1.0, 1.0), (True, 1 / 3, 1 / 3, 2 / 3, 2 / 3), (False, 1.5, 0.25, 1.75, 0.5))
        return self.boxes.select(
            "entity_id",
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.lit(hole).alias("hole"),
                            (F.col("min_lon") + w * x0).alias("min_lon"),
                            (F.col("min_lat") + h * y0).alias("min_lat"),
                            (F.col("min_lon") + w * x1).alias("max_lon"),
                            (F.col("min_lat") + h * y1).alias("max_lat"),
                        )
                        for hole, x0, y0, x1, y1 in parts
                    ]
                )
            ).alias("_b"),
        ).select("entity_id", "_b.*")

    @cached_property
    def part_rings(self) -> DataFrame:
        """The rings of :attr:`part_boxes`, open and clockwise."""
        corner = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
        ring = [corner("min_lon", "min_lat"), corner("min_lon", "max_lat"), corner("max_lon", "max_lat"), corner("max_lon", "min_lat")]
        return self.part_boxes.select("entity_id", "hole", F.array(*ring).alias("ring"))

    @cached_property
    def population(self) -> DataFrame:
        per_nation = (
            self.table("customer")
            .groupBy(F.col("c_nationkey").alias("entity_id"))
            .agg(F.count(F.lit(1)).alias("population_reference"))
        )
        return per_nation.filter(F.col("entity_id") != NO_POPULATION_ENTITY)

    @cached_property
    def reference(self) -> DataFrame:
        from panelspark.operators.geo import build_reference, ring_area_centroid

        names = self.table("nation").select(
            F.col("n_nationkey").alias("entity_id"), F.col("n_name").alias("entity_name"), "n_regionkey"
        )
        groups = self.table("region").select(
            F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("group_name")
        )
        return build_reference(
            names.join(ring_area_centroid(self.rings), "entity_id"),
            self.population,
            groups,
            group_key="n_regionkey",
        )

    # ---- feature tables ------------------------------------------------------------------

    @cached_property
    def master(self) -> DataFrame:
        """Spine with reports, weather and reference columns."""
        wx = self.weather_weekly.withColumn(
            "weather_quality_flag", normalize_quality_tokens("weather_quality_flag")
        ).drop("week_end")
        obs = self.weekly_obs.withColumnRenamed("value", "cases")
        ref = self.reference.select(
            "entity_id", "entity_name", "group_name", "population_reference", "area_km2"
        )
        keys = ["entity_id", "week_start"]
        return (
            self.spine.join(obs, keys, "left").join(wx, keys, "left").join(ref, "entity_id", "left")
        )

    @cached_property
    def feature_panel(self) -> DataFrame:
        table_ = features.feature_table(self.master, population="population_reference")
        return table_.withColumn(
            "incidence_per_100k", features.per_100k("cases", "population_reference")
        ).withColumns(
            features.quality_columns(
                min_temporal_pct=MIN_TEMPORAL_PCT, min_spatial_pct=MIN_SPATIAL_PCT
            )
        )

    @cached_property
    def study_panel(self) -> DataFrame:
        """All features with the direct targets of every horizon, as a staged table.

        It is as small as a calendar, but folds, horizons and features multiply its rows, so it is dealt to all cores.
        """
        self.stage_sources()
        panel = self.feature_panel.withColumns(features.direct_targets(over=features.entity_weeks()))
        return stage_table(panel.repartition(self.spark.sparkContext.defaultParallelism), "study_panel")

    @cached_property
    def model_panel(self) -> DataFrame:
        """The model panel as a staged table, for work that reads it more than once."""
        return stage_table(self.model_panel_plan, "model_panel")

    @cached_property
    def model_panel_plan(self) -> DataFrame:
        """The columns the temporal stages read: value, lags, direct targets, weather, quality."""
        over = features.entity_weeks()
        keys = ["entity_id", "week_start"]
        obs = self.weekly_obs.withColumnRenamed("value", "cases")
        wx = self.weather_weekly.select(
            *keys,
            "rainfall_sum_mm",
            "temp_mean_c",
            "humidity_mean_pct",
            "weather_temporal_coverage_pct",
            "weather_spatial_coverage_pct",
            normalize_quality_tokens("weather_quality_flag").alias("weather_quality_flag"),
        )
        base = (
            self.spine.join(obs, keys, "left")
            .join(wx, keys, "left")
            .join(self.population, "entity_id", "left")
        )
        base = base.withColumns(
            {
                **features.lag_columns({"cases_lag": ("cases", (1, 2, 3, 4))}, over),
                **features.target_columns(over=over),
                **features.direct_targets(over=over),
            }
        )
        return base.withColumns(
            features.quality_columns(
                min_temporal_pct=MIN_TEMPORAL_PCT, min_spatial_pct=MIN_SPATIAL_PCT
            )
        )

    @cached_property
    def origin_table(self) -> DataFrame:
        """The origin panel as a staged table."""
        return stage_table(self.origins, "origins")

    @cached_property
    def origins(self) -> DataFrame:
        """Weather-free panel with lags and direct targets, for cohorts and baselines."""
        over = features.entity_weeks()
        return (
            self.obs_panel.withColumnRenamed("value", "cases")
            .withColumns(
                {
                    **features.lag_columns({"cases_lag": ("cases", (1, 2, 3, 4))}, over),
                    **features.direct_targets(over=over),
                }
            )
        )
