"""Panel features: lags, full-support rolling windows, trends, seasonality, targets, quality.

All windows run over a calendar-complete panel with one row per (entity, week), so a window holds
at most one row per calendar week whatever the volume behind an entity was.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelspark.functions.columns import all_of, any_of, finite_nonnegative, flag, plus_days, present, ratio

ENTITY = "entity_id"
WEEK = "week_start"

# Feature names and offsets.
LAGS: dict[str, tuple[str, tuple[int, ...]]] = {
    "cases_lag": ("cases", (1, 2, 3, 4, 6, 8)),
    "rainfall_lag": ("rainfall_sum_mm", (1, 2, 3, 4, 6, 8)),
    "temp_mean_lag": ("temp_mean_c", (1, 2, 4)),
    "humidity_lag": ("humidity_mean_pct", (1, 2, 4)),
}
WEEKS_PER_YEAR = 52.1775
HORIZONS = (1, 2, 3, 4)


@dataclass(frozen=True)
class Rolling:
    prefix: str
    source: str
    stat: str
    weeks: tuple[int, ...]


# Rolling features.
ROLLING = (
    Rolling("cases_roll", "cases", "mean", (2, 4, 8)),
    Rolling("cases_roll", "cases", "std", (4, 8)),
    Rolling("cases_roll", "cases", "min", (4,)),
    Rolling("cases_roll", "cases", "max", (4,)),
    Rolling("rainfall_roll", "rainfall_sum_mm", "sum", (2, 4, 8)),
    Rolling("rainfall_roll", "rainfall_sum_mm", "mean", (4,)),
    Rolling("rainfall_roll", "rainfall_sum_mm", "max", (4,)),
    Rolling("rain_days_roll", "rain_days_1mm", "sum", (4,)),
    Rolling("temp_roll", "temp_mean_c", "mean", (2, 4)),
    Rolling("temp_roll", "temp_mean_c", "std", (4,)),
    Rolling("humidity_roll", "humidity_mean_pct", "mean", (2, 4)),
)
STATS = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
}


def entity_weeks(entity: str = ENTITY, week: str = WEEK) -> WindowSpec:
    return Window.partitionBy(entity).orderBy(week)


def lag_columns(
    spec: Mapping[str, tuple[str, Sequence[int]]] = LAGS, over: WindowSpec | None = None
) -> dict[str, Column]:
    over = over or entity_weeks()
    return {
        f"{prefix}_{k}": F.lag(source, k).over(over)
        for prefix, (source, weeks) in spec.items()
        for k in weeks
    }


def rolling_columns(
    spec: Iterable[Rolling] = ROLLING, over: WindowSpec | None = None
) -> dict[str, Column]:
    """Rolling statistics that are null unless the window is full of observed values."""
    over = over or entity_weeks()
    out: dict[str, Column] = {}
    for r in spec:
        for n in r.weeks:
            frame = over.rowsBetween(-(n - 1), 0)
            full = F.count(r.source).over(frame) == n
            out[f"{r.prefix}_{r.stat}_{n}"] = F.when(full, STATS[r.stat](r.source).over(frame))
    return out


def trend_columns(value: str = "cases", over: WindowSpec | None = None) -> dict[str, Column]:
    over = over or entity_weeks()
    v = F.col(value)
    back = {k: F.lag(value, k).over(over) for k in (1, 2, 3, 4)}
    return {
        f"{value}_change_1w": v - back[1],
        f"{value}_change_2w": v - back[2],
        f"{value}_pct_change_1w": ratio(v - back[1], back[1]),
        f"{value}_pct_change_4w": ratio(v - back[4], back[4]),
        f"log1p_{value}": F.log1p(v),
    }


def slope_column(value: str = "cases", weeks: int = 4, over: WindowSpec | None = None) -> Column:
    """Least-squares slope of the last ``weeks`` values on 0..weeks-1, null if one is missing."""
    over = over or entity_weeks()
    centre = (weeks - 1) / 2
    spread = sum((i - centre) ** 2 for i in range(weeks))
    terms = [
        (F.col(value) if k == 0 else F.lag(value, k).over(over)) * F.lit((weeks - 1 - k) - centre)
        for k in range(weeks)
    ]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total / F.lit(spread)


def seasonality_columns(week: str = WEEK, label: str | None = None) -> dict[str, Column]:
    """Month, quarter and cyclic week/month terms.

    With a source week label, its gaps stay null; the ISO week is used only without a label.
    """
    wk = F.col(label) if label else F.weekofyear(week)
    month = F.month(week)
    angle = F.lit(2 * math.pi) * wk / F.lit(WEEKS_PER_YEAR)
    month_angle = F.lit(2 * math.pi) * month / F.lit(12.0)
    return {
        "month": month,
        "quarter": F.quarter(week),
        "week_of_year": wk,
        "week_sin": F.sin(angle),
        "week_cos": F.cos(angle),
        "month_sin": F.sin(month_angle),
        "month_cos": F.cos(month_angle),
    }


def target_columns(
    value: str = "cases", over: WindowSpec | None = None, population: str | None = None
) -> dict[str, Column]:
    """Value at +1, +2 and +4 weeks on a gap-free spine, and the rate of the first."""
    over = over or entity_weeks()
    ahead = {k: F.lead(value, k).over(over) for k in (1, 2, 4)}
    out = {
        f"{value}_next_week": ahead[1],
        f"{value}_next_2w": ahead[2],
        f"{value}_next_4w": ahead[4],
    }
    if population:
        out["incidence_next_week_per_100k"] = per_100k(ahead[1], population)
    return out


def direct_targets(
    value: str = "cases", horizons: Sequence[int] = HORIZONS, over: WindowSpec | None = None
) -> dict[str, Column]:
    over = over or entity_weeks()
    return {f"target_h{h}": F.lead(value, h).over(over) for h in horizons}


def per_100k(value: str | Column, population: str | Column) -> Column:
    return ratio(value, population) * 100_000.0


def date_window(entity: str = ENTITY, week: str = WEEK, extra: Sequence[str] = ()) -> WindowSpec:
    """Window whose range frames are measured in days, for panels that may have gaps.

    The weekday is part of the partition, so a frame only meets dates whole weeks away.
    """
    day = F.unix_date(F.col(week))
    return Window.partitionBy(*extra, entity, F.pmod(day, F.lit(7))).orderBy(day)


def exact_date_shift(
    df: DataFrame,
    value: str,
    shifts: Mapping[str, int],
    *,
    entity: str = ENTITY,
    week: str = WEEK,
) -> DataFrame:
    """Values a number of weeks away by calendar date, on a panel that may have gaps.

    A frame of one exact date per shift answers all of them in a single shuffle and sort, without
    copying rows and without a join. A positive shift looks back.
    """
    w = date_window(entity, week)
    return df.withColumns(
        {n: F.max(value).over(w.rangeBetween(-7 * k, -7 * k)) for n, k in shifts.items()}
    )


def continuity_columns(value: str = "cases", over: WindowSpec | None = None) -> dict[str, Column]:
    """Days since the previous observed week, and whether that was exactly one week."""
    over = over or entity_weeks()
    seen = F.when(present(value), F.col(WEEK))
    before = F.last(seen, ignorenulls=True).over(
        over.rowsBetween(Window.unboundedPreceding, -1)
    )
    days = F.datediff(F.col(WEEK), before)
    return {
        "days_since_previous_observation": days.cast("long"),
        "is_consecutive_week": F.coalesce(days == 7, F.lit(False)),
    }


def quality_columns(
    *,
    min_temporal_pct: float = 85.0,
    min_spatial_pct: float = 90.0,
    value: str = "cases",
    target: str = "cases_next_week",
    population: str = "population_reference",
    required_lags: Sequence[int] = (1, 2, 3, 4),
) -> dict[str, Column]:
    """Missing flags, the single quality class of a row and whether it can be trained on."""
    case_missing = ~present(value)
    weather_missing = any_of(
        ~present(c) for c in ("rainfall_sum_mm", "temp_mean_c", "humidity_mean_pct")
    )
    history_missing = any_of(~present(f"{value}_lag_{k}") for k in required_lags)
    low = low_weather(min_temporal_pct=min_temporal_pct, min_spatial_pct=min_spatial_pct)
    no_population = ~present(population)
    issues = flag(history_missing) + flag(weather_missing) + flag(low) + flag(no_population)
    # Class names.
    row_class = (
        F.when(issues == 0, "OK")
        .when(issues > 1, "MULTIPLE_ISSUES")
        .when(history_missing, "MISSING_CASE_HISTORY")
        .when(weather_missing, "MISSING_WEATHER")
        .when(low, "LOW_WEATHER_COVERAGE")
        .otherwise("MISSING_POPULATION")
    )
    return {
        "case_missing_flag": case_missing,
        "weather_missing_flag": weather_missing,
        "case_history_missing_flag": history_missing,
        "row_quality_flag": row_class,
        "is_trainable": present(target) & present(value) & (issues == 0),
    }


def low_weather(*, min_temporal_pct: float = 85.0, min_spatial_pct: float = 90.0) -> Column:
    under = lambda c, limit: F.coalesce(F.col(c), F.lit(-1.0)) < limit
    return (
        under("weather_temporal_coverage_pct", min_temporal_pct)
        | under("weather_spatial_coverage_pct", min_spatial_pct)
        | (F.coalesce(F.col("weather_quality_flag"), F.lit("UNKNOWN")) != "OK")
    )


def feature_table(master: DataFrame, *, population: str | None = None) -> DataFrame:
    """Every panel feature in one shuffle and one sort on (entity, week)."""
    over = entity_weeks()
    return master.withColumns(
        {
            **continuity_columns(over=over),
            **lag_columns(over=over),
            **rolling_columns(over=over),
            **trend_columns(over=over),
            "cases_slope_4w": slope_column(over=over),
            **seasonality_columns(label="week" if "week" in master.columns else None),
            **target_columns(over=over, population=population),
        }
    )


def eligible(
    *, value: str = "cases", lags: Sequence[int] = (1, 2, 3, 4), horizons: Sequence[int] = HORIZONS
) -> Column:
    """Current value, recent lags and all horizon targets finite and not negative."""
    names = [value, *[f"{value}_lag_{k}" for k in lags], *[f"target_h{h}" for h in horizons]]
    return all_of(finite_nonnegative(n) for n in names)


def target_end(week: str | Column, horizon: int | Column) -> Column:
    """Last day of the week ``horizon`` weeks after an origin week."""
    if isinstance(horizon, int):
        return plus_days(week, 7 * horizon + 6)
    return plus_days(week, horizon * 7 + 6)


def causal_audit(
    stored: DataFrame, recomputed: DataFrame, columns: Sequence[str], *, tolerance: float = 1e-9
) -> DataFrame:
    """Per feature: rows compared, rows whose recomputed value differs, rows without a partner."""
    left = recomputed.select(ENTITY, WEEK, *[F.col(c).cast("double").alias(f"l_{c}") for c in columns])
    right = stored.select(
        ENTITY, WEEK, F.lit(1).alias("_hit"), *[F.col(c).cast("double").alias(f"r_{c}") for c in columns]
    )
    joined = left.join(right, [ENTITY, WEEK], "left")

    def differs(c: str) -> Column:
        lo, r = F.col(f"l_{c}"), F.col(f"r_{c}")
        return (lo.isNull() != r.isNull()) | F.coalesce(F.abs(lo - r) > tolerance, F.lit(False))

    counts = joined.agg(
        F.count(F.lit(1)).alias("rows_compared"),
        F.sum(flag(F.col("_hit").isNull())).cast("long").alias("rows_unmatched"),
        *[F.sum(flag(differs(c))).cast("long").alias(c) for c in columns],
    )
    return counts.unpivot(
        ["rows_compared", "rows_unmatched"], list(columns), "feature_name", "rows_different"
    )
