"""Feature metadata: definitions, fail-closed lookup, feature sets, leakage audit.

Metadata tables have one row per column of a schema, so they are small by construction; what is
read from the data (profiles) is joined to them.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.columns import present
from panelspark.operators.features import LAGS, ROLLING

# Feature groups and their members.
GROUPS: dict[str, tuple[str, ...]] = {
    "identifier": ("entity_id", "entity_name", "week_start", "week_end", "year", "week", "year_week"),
    "seasonality": (
        "month", "quarter", "week_of_year", "week_sin", "week_cos", "month_sin", "month_cos",
    ),
    "epidemiology": (
        "cases", "cases_change_1w", "cases_change_2w", "cases_pct_change_1w", "cases_pct_change_4w",
        "log1p_cases", "cases_slope_4w",
    ),
    "weather": (
        "rainfall_sum_mm", "rainfall_mean_daily_mm", "rainfall_max_daily_mm", "rain_days_1mm",
        "rain_days_10mm", "temp_mean_c", "temp_min_c", "temp_max_c", "humidity_mean_pct",
    ),
    "quality": (
        "case_status", "weather_expected_days", "weather_available_days",
        "weather_temporal_coverage_pct", "weather_grid_cells", "weather_spatial_coverage_pct",
        "weather_quality_flag", "case_missing_flag", "weather_missing_flag",
        "case_history_missing_flag", "row_quality_flag", "is_trainable",
        "days_since_previous_observation", "is_consecutive_week",
    ),
    "metadata": (
        "source_name", "source_document", "source_url", "source_retrieved_at", "parser_version",
        "rain_source", "rain_source_version", "climate_source", "climate_source_version",
    ),
    "reference": (
        "group_name", "population_reference", "population_reference_year", "population_method",
        "population_density_per_km2", "area_km2", "centroid_lat", "centroid_lon",
        "incidence_per_100k",
    ),
    "target": (
        "cases_next_week", "cases_next_2w", "cases_next_4w", "incidence_next_week_per_100k",
        "target_h1", "target_h2", "target_h3", "target_h4",
    ),
}
TRAINABLE_GROUPS = ("seasonality", "epidemiology", "weather")
MODELING_EXCEPTIONS = ("entity_id", "area_km2")
FORBIDDEN_CONTEXT = (
    "population_reference", "population_reference_year", "population_method",
    "population_density_per_km2", "incidence_per_100k", "centroid_lat", "centroid_lon", "group_name",
)
FEATURE_SETS = ("cases_only", "cases_rainfall", "cases_full_weather", "full_context")
FUTURE_PATTERN = r"(?i)next|future|actual_next"
SUSPICIOUS_PATTERN = r"(?i)next|future|target"

SCHEMA = (
    "feature_name string, feature_group string, uses_future_information boolean, "
    "eligible_for_training boolean, lag_weeks string"
)


def definitions() -> dict[str, tuple[str, str]]:
    """Feature name -> (group, lag weeks); lag and rolling names follow from their rules."""
    out = {name: (group, "") for group, names in GROUPS.items() for name in names}
    for prefix, (_, weeks) in LAGS.items():
        group = "epidemiology" if prefix.startswith("cases") else "weather"
        out.update({f"{prefix}_{k}": (group, str(k)) for k in weeks})
    for r in ROLLING:
        group = "epidemiology" if r.prefix.startswith("cases") else "weather"
        out.update({f"{r.prefix}_{r.stat}_{n}": (group, "") for n in r.weeks})
    return out


def registry_rows(columns: Iterable[str]) -> list[tuple[str, str, bool, bool, str]]:
    known = definitions()
    rows = []
    for name in columns:
        lowered = name.lower()
        future_like = "next" in lowered or "future" in lowered
        if name in known:
            group, lag = known[name]
            rows.append((name, group, group == "target", group in TRAINABLE_GROUPS, lag))
        else:
            group = "unknown_future" if future_like else "unknown"
            rows.append((name, group, future_like, False, ""))
    return rows


def feature_registry(spark: SparkSession, columns: Iterable[str]) -> DataFrame:
    """One metadata row per column; columns without a definition are not trainable."""
    return spark.createDataFrame(registry_rows(columns), SCHEMA)


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows and missing rows per column from a single pass."""
    names = list(columns or df.columns)
    kinds = dict(df.dtypes)

    def observed(c: str) -> Column:
        if kinds[c] in ("double", "float"):
            return F.count(F.when(present(c), 1))
        return F.count(F.col(c))

    counted = df.agg(F.count(F.lit(1)).alias("_n"), *[observed(c).alias(c) for c in names])
    long = counted.unpivot(["_n"], names, "column_name", "_seen")
    pct = F.when(F.col("_n") > 0, (F.col("_n") - F.col("_seen")) * 100.0 / F.col("_n"))
    return long.select(
        "column_name",
        F.col("_n").alias("n_rows"),
        (F.col("_n") - F.col("_seen")).alias("missing_rows"),
        F.coalesce(pct, F.lit(0.0)).alias("missing_pct"),
    )


def registry_problems(registry: DataFrame) -> DataFrame:
    """Duplicate names, future information marked trainable, trainable columns of unknown groups."""
    counts = registry.groupBy("feature_name").agg(F.count(F.lit(1)).alias("_copies"))
    known = list(GROUPS)
    problem = F.filter(
        F.array(
            F.when(F.col("_copies") > 1, "duplicate_name"),
            F.when(F.col("eligible_for_training").isNull(), "flag_not_boolean"),
            F.when(
                F.col("eligible_for_training") & F.col("uses_future_information"),
                "future_information_trainable",
            ),
            F.when(
                F.col("eligible_for_training") & (F.col("feature_group") == "target"),
                "target_trainable",
            ),
            F.when(
                F.col("eligible_for_training") & ~F.col("feature_group").isin(*known),
                "unknown_group_trainable",
            ),
        ),
        lambda x: x.isNotNull(),
    )
    return (
        registry.join(counts, "feature_name")
        .select("feature_name", F.explode(problem).alias("problem"))
        .distinct()
    )


def requested_feature_problems(requested: DataFrame, registry: DataFrame) -> DataFrame:
    """Requested features that are unknown, future, forbidden, ineligible or asked for twice."""
    counts = requested.groupBy("feature_name").agg(F.count(F.lit(1)).alias("_copies"))
    joined = counts.join(registry, "feature_name", "left")
    name = F.col("feature_name")
    problem = (
        F.when(F.col("feature_group").isNull(), "unknown")
        .when(F.col("uses_future_information"), "future")
        .when(name.isin(*FORBIDDEN_CONTEXT), "forbidden")
        .when(~F.col("eligible_for_training") & ~name.isin(*MODELING_EXCEPTIONS), "ineligible")
        .when(F.col("_copies") > 1, "duplicated")
    )
    return joined.select("feature_name", problem.alias("problem")).filter(
        F.col("problem").isNotNull()
    )


def in_feature_set(feature_set: str) -> Column:
    """Membership of a registry row in one of the four nested feature sets."""
    name, group = F.col("feature_name"), F.col("feature_group")
    eligible = (F.col("eligible_for_training") & ~F.col("uses_future_information")) | name.isin(
        *MODELING_EXCEPTIONS
    )
    member = group.isin("epidemiology", "seasonality") | (name == "entity_id")
    if feature_set != "cases_only":
        member = member | name.startswith("rainfall_") | name.startswith("rain_days_")
    if feature_set in ("cases_full_weather", "full_context"):
        member = member | (group == "weather")
    if feature_set == "full_context":
        member = member | (name == "area_km2")
    return eligible & member


def feature_set_table(registry: DataFrame) -> DataFrame:
    """(feature_set, feature_name) rows of all feature sets."""
    sets = F.array_compact(
        F.array(*[F.when(in_feature_set(s), F.lit(s)) for s in FEATURE_SETS])
    )
    return registry.select(F.explode(sets).alias("feature_set"), "feature_name", "feature_group")


def feature_set_columns(columns: Iterable[str], feature_set: str) -> list[str]:
    """Column names of a feature set in schema order, decided from metadata alone."""
    out = []
    for name, group, future, trainable, _ in registry_rows(columns):
        ok = (trainable and not future) or name in MODELING_EXCEPTIONS
        member = group in ("epidemiology", "seasonality") or name == "entity_id"
        if feature_set != "cases_only":
            member = member or name.startswith(("rainfall_", "rain_days_"))
        if feature_set in ("cases_full_weather", "full_context"):
            member = member or group == "weather"
        if feature_set == "full_context":
            member = member or name == "area_km2"
        if ok and member:
            out.append(name)
    return out


def column_meaning(name: str | Column) -> Column:
    """Description of a column by name rules."""
    c = F.col(name) if isinstance(name, str) else name
    return (
        F.when(c == "cases_next_week", "target: value of the next week")
        .when(c.startswith("cases_lag_"), "value of an earlier week")
        .when(c.startswith("rainfall"), "rainfall aggregate")
        .when(c.startswith("temp"), "temperature aggregate")
        .when(c.startswith("humidity"), "humidity aggregate")
        .otherwise("panel column")
    )


def transformed_metadata(features: DataFrame, registry: DataFrame) -> DataFrame:
    """Raw feature, derived type and group of transformed feature names."""
    f = F.col("feature")
    raw = (
        F.when(f.endswith("__missing"), F.regexp_extract(f, "^(.*)__missing$", 1))
        .when(f.contains("__"), F.regexp_extract(f, "^(.*?)__", 1))
        .otherwise(f)
    )
    derived = (
        F.when(f.endswith("__missing"), "missing_indicator")
        .when(f.startswith("entity_id__"), "entity_onehot")
        .when(f.contains("__"), "onehot")
        .otherwise("raw")
    )
    named = features.select("*", raw.alias("raw_feature"), derived.alias("derived_type"))
    reg = registry.select(
        F.col("feature_name").alias("raw_feature"), "feature_group", "uses_future_information"
    )
    return named.join(reg, "raw_feature", "left").withColumns(
        {
            "feature_group": F.coalesce("feature_group", fallback_group("raw_feature")),
            "uses_future_information": F.coalesce("uses_future_information", F.lit(False)),
        }
    )


def fallback_group(raw: str) -> Column:
    """Group of a feature without a registry row, by its name."""
    n = F.lower(raw)
    return (
        F.when(n.startswith("entity_id"), "identifier")
        .when(n.contains("case"), "epidemiology")
        .when(n.rlike("rain|precip|temp|humidity|weather"), "weather")
        .when(n.rlike("week|month|season|sin|cos"), "seasonality")
        .when(n == "area_km2", "reference")
        .when(n.contains("population"), "population")
        .otherwise("unknown")
    )


def leakage_audit(metadata: DataFrame) -> DataFrame:
    """Suspicious raw features against the authorised exceptions."""
    raw = F.col("raw_feature")
    suspicious = (
        raw.rlike(SUSPICIOUS_PATTERN)
        | raw.isin(*FORBIDDEN_CONTEXT)
        | raw.isin(*GROUPS["target"])
    )
    allowed = raw.isin(*MODELING_EXCEPTIONS)
    return metadata.select(
        "feature",
        "raw_feature",
        suspicious.alias("suspicious"),
        allowed.alias("authorized_exception"),
        F.when(suspicious & ~allowed, "review_required").otherwise("ok").alias("status"),
    )
