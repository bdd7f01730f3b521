"""Coverage and data-quality reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.columns import count_where, present
from panelspark.functions.runs import run_lengths
from panelspark.operators.features import low_weather
from panelspark.operators.registry import column_meaning, column_profile

ENTITY, WEEK = "entity_id", "week_start"


def schema_report(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Per table and column: type, rows, null rows, nullable; one pass per table."""
    out: DataFrame | None = None
    for name, df in frames.items():
        kinds = F.create_map(*[F.lit(x) for c, t in df.dtypes for x in (c, t)])
        part = column_profile(df).select(
            F.lit(name).alias("table_name"),
            "column_name",
            kinds[F.col("column_name")].alias("dtype"),
            "n_rows",
            F.col("missing_rows").alias("null_rows"),
            (F.col("missing_rows") > 0).alias("has_nulls"),
        )
        out = part if out is None else out.unionByName(part)
    assert out is not None
    return out


def entity_coverage(
    entities: DataFrame, reports: DataFrame, weather: DataFrame, panel: DataFrame
) -> DataFrame:
    """Per entity, zeros kept: reports, observed weeks, weather weeks, least coverage, trainable."""
    r = reports.groupBy(ENTITY).agg(
        F.count(F.lit(1)).alias("report_weeks"), F.count("value").alias("observed_weeks")
    )
    w = weather.groupBy(ENTITY).agg(
        F.count(F.lit(1)).alias("weather_weeks"),
        F.min("weather_temporal_coverage_pct").alias("min_temporal_pct"),
        F.min("weather_spatial_coverage_pct").alias("min_spatial_pct"),
    )
    m = panel.groupBy(ENTITY).agg(
        F.count(F.lit(1)).alias("panel_rows"),
        count_where(F.col("is_trainable")).alias("trainable_rows"),
    )
    out = entities.select(ENTITY).join(r, ENTITY, "left").join(w, ENTITY, "left").join(m, ENTITY, "left")
    counts = ("report_weeks", "observed_weeks", "weather_weeks", "panel_rows", "trainable_rows")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})


def column_dictionary(profile: DataFrame, registry: DataFrame) -> DataFrame:
    """Eligibility and meaning of each column, from the registry or by name rules."""
    reg = registry.select(
        F.col("feature_name").alias("column_name"),
        "feature_group",
        "eligible_for_training",
        "uses_future_information",
    )
    return profile.join(reg, "column_name", "left").select(
        "column_name",
        "missing_rows",
        F.coalesce("eligible_for_training", F.lit(False)).alias("eligible_for_training"),
        F.coalesce("uses_future_information", F.lit(False)).alias("uses_future_information"),
        column_meaning("column_name").alias("meaning"),
    )


def missing_weeks(spine: DataFrame, reports: DataFrame, entities: DataFrame) -> DataFrame:
    """Per entity: number and ordered list of spine weeks without a report.

    A list is bounded by the weeks of the calendar.
    """
    gaps = spine.select(ENTITY, WEEK).join(reports.select(ENTITY, WEEK), [ENTITY, WEEK], "left_anti")
    lists = gaps.groupBy(ENTITY).agg(
        F.count(F.lit(1)).alias("missing_weeks"), F.array_sort(F.collect_list(WEEK)).alias("_w")
    )
    return entities.select(ENTITY).join(lists, ENTITY, "left").select(
        ENTITY,
        F.coalesce("missing_weeks", F.lit(0)).alias("missing_weeks"),
        F.coalesce(
            F.array_join(F.transform("_w", lambda d: d.cast("string")), ","), F.lit("")
        ).alias("missing_week_starts"),
    )


def weather_ranges(weather: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Observed rows and range per variable, in one pass."""
    wide = weather.agg(
        *[
            F.struct(
                F.lit(v).alias("variable"),
                F.count(v).alias("non_null_rows"),
                F.min(v).alias("min_value"),
                F.max(v).alias("max_value"),
            ).alias(v)
            for v in variables
        ]
    )
    return wide.select(F.explode(F.array(*variables)).alias("_v")).select("_v.*")


def weather_by_month(weather: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Mean, least and greatest value per month and variable, and low-coverage rows."""
    cells = F.array(
        *[F.struct(F.lit(v).alias("variable"), F.col(v).alias("value")) for v in variables]
    )
    long = weather.select(F.month(WEEK).cast("long").alias("month"), F.explode(cells).alias("_c"))
    return long.groupBy("month", F.col("_c.variable").alias("variable")).agg(
        F.avg("_c.value").alias("mean_value"),
        F.min("_c.value").alias("min_value"),
        F.max("_c.value").alias("max_value"),
    )


def overview(panel: DataFrame, reports: DataFrame) -> DataFrame:
    """Row counts, date range and duplicate counts as (item, value) text rows."""
    per_entity = panel.groupBy(ENTITY).agg(
        F.count(F.lit(1)).alias("n"),
        count_where(F.col("is_trainable")).alias("t"),
        F.min(WEEK).alias("lo"),
        F.max(WEEK).alias("hi"),
    )
    text = lambda c: c.cast("string")
    p = per_entity.agg(
        text(F.sum("n")).alias("panel_rows"),
        text(F.count(F.lit(1))).alias("panel_entities"),
        text(F.sum("t")).alias("trainable_rows"),
        text(F.min("lo")).alias("first_week"),
        text(F.max("hi")).alias("last_week"),
    )
    keys = reports.groupBy(ENTITY, WEEK).agg(F.count(F.lit(1)).alias("n"))
    r = keys.agg(
        text(F.sum("n")).alias("report_rows"),
        text(F.sum(F.col("n") - 1)).alias("duplicate_report_keys"),
    )
    quality = panel.groupBy(
        F.concat(F.lit("quality:"), F.coalesce("row_quality_flag", F.lit("UNKNOWN"))).alias("item")
    ).agg(text(F.count(F.lit(1))).alias("value"))
    return (
        p.unpivot([], p.columns, "item", "value")
        .unionByName(r.unpivot([], r.columns, "item", "value"))
        .unionByName(quality)
    )


def availability(panel: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Rows, available rows and percent by year and by entity for each named condition.

    One grouping-sets aggregation replaces a pass per grouping.
    """
    rows = panel.select(
        ENTITY,
        F.year(WEEK).cast("long").alias("year"),
        F.col("is_trainable"),
        *[c.alias(n) for n, c in columns.items()],
    )
    sets = rows.groupingSets([["year"], [ENTITY]], "year", ENTITY).agg(
        F.count(F.lit(1)).alias("n_rows"),
        count_where(F.col("is_trainable")).alias("trainable_rows"),
        *[count_where(F.col(n)).alias(n) for n in columns],
    )
    long = sets.unpivot(
        ["year", ENTITY, "n_rows", "trainable_rows"], list(columns), "series", "available"
    )
    return long.withColumn(
        "coverage_pct", F.round(F.col("available") * 100.0 / F.col("n_rows"), 2)
    )


def missing_whole_weeks(panel: DataFrame, value: str = "cases") -> DataFrame:
    """Weeks in which no entity has an observation."""
    return (
        panel.groupBy(WEEK).agg(F.count(value).alias("_n")).filter("_n = 0").select(WEEK)
    )


def missing_week_stats(panel: DataFrame, value: str = "cases", *, major: int = 4) -> DataFrame:
    """Number of empty weeks, longest run of them, years with at least ``major`` of them."""
    empty = missing_whole_weeks(panel, value)
    runs = run_lengths(empty.withColumn("_g", F.lit(0)), ["_g"], WEEK)
    years = (
        empty.groupBy(F.year(WEEK).cast("string").alias("y"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= major)
    )
    text = years.agg(
        F.array_join(
            F.array_sort(F.collect_list(F.concat_ws(":", "y", F.col("n").cast("string")))), ","
        )
    ).scalar()
    return runs.agg(
        F.coalesce(F.sum("run_length"), F.lit(0)).alias("missing_whole_weeks"),
        F.coalesce(F.max("run_length"), F.lit(0)).alias("longest_missing_run_weeks"),
    ).withColumn("years_with_major_gaps", text)


# Reasons in order of precedence.
REASONS = (
    "missing_current_cases",
    "missing_target_next_week",
    "insufficient_case_history",
    "missing_weather",
    "low_weather_coverage",
    "missing_population",
    "other_not_trainable",
)


def reason_flags(*, min_temporal_pct: float, min_spatial_pct: float) -> dict[str, Column]:
    """Non-exclusive conditions behind the reasons."""
    return {
        "missing_current_cases": ~present("cases"),
        "missing_target_next_week": ~present("cases_next_week"),
        "insufficient_case_history": F.coalesce("case_history_missing_flag", F.lit(False)),
        "missing_weather": F.coalesce("weather_missing_flag", F.lit(False)),
        "low_weather_coverage": low_weather(
            min_temporal_pct=min_temporal_pct, min_spatial_pct=min_spatial_pct
        ),
        "missing_population": ~present("population_reference")
        | (F.col("row_quality_flag") == "MISSING_POPULATION"),
    }


def primary_reason(flags: Mapping[str, Column]) -> Column:
    out: Column | None = None
    for name in REASONS[:-1]:
        out = F.when(flags[name], name) if out is None else out.when(flags[name], name)
    assert out is not None
    return out.otherwise(REASONS[-1])


def untrainable_reasons(panel: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """Rows per first matching reason, by year and overall (null year), zeros kept."""
    bad = panel.filter(~F.coalesce("is_trainable", F.lit(False))).select(
        F.year(WEEK).cast("long").alias("year"), primary_reason(flags).alias("reason")
    )
    wide = bad.rollup("year").agg(
        *[count_where(F.col("reason") == r).alias(r) for r in REASONS],
        F.grouping("year").alias("_total"),
    )
    return wide.unpivot(["year"], list(REASONS), "reason", "n_rows")


def overlapping_flags(panel: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """Untrainable rows per condition; a row counts under each that holds."""
    bad = panel.filter(~F.coalesce("is_trainable", F.lit(False)))
    counted = bad.agg(*[count_where(c).alias(n) for n, c in flags.items()])
    return counted.unpivot([], list(flags), "flag", "n_rows")


def target_availability(panel: DataFrame, targets: Sequence[str]) -> DataFrame:
    counted = panel.agg(*[F.count(t).alias(t) for t in targets])
    return counted.unpivot([], list(targets), "target", "available")


def panel_summary(panel: DataFrame) -> DataFrame:
    """One row of ranges, counts and coverage."""
    weather = present("rainfall_sum_mm") & present("temp_mean_c") & present("humidity_mean_pct")
    per = panel.groupBy(ENTITY).agg(
        F.min(WEEK).alias("lo"),
        F.max(WEEK).alias("hi"),
        F.min(F.when(present("cases"), F.col(WEEK))).alias("olo"),
        F.max(F.when(present("cases"), F.col(WEEK))).alias("ohi"),
        F.count(F.lit(1)).alias("n"),
        F.count("cases").alias("o"),
        count_where(F.col("is_trainable")).alias("t"),
        count_where(weather).alias("w"),
        *[F.count(c).alias(c) for c in ("cases_next_week", "cases_next_2w", "cases_next_4w")],
    )
    pct = lambda c: F.round(F.sum(c) * 100.0 / F.sum("n"), 2)
    return per.agg(
        F.min("lo").alias("first_week"),
        F.max("hi").alias("last_week"),
        F.min("olo").alias("first_observed_week"),
        F.max("ohi").alias("last_observed_week"),
        F.count(F.lit(1)).alias("entities"),
        F.sum("n").alias("panel_rows"),
        F.sum("o").alias("observed_rows"),
        F.sum("t").alias("trainable_rows"),
        pct("o").alias("observed_pct"),
        pct("w").alias("weather_pct"),
        *[F.sum(c).alias(f"{c}_rows") for c in ("cases_next_week", "cases_next_2w", "cases_next_4w")],
    )
