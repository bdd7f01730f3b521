"""Exact-history baselines. A missing week makes a baseline unavailable, never approximate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.columns import count_where, finite, present
from panelspark.operators.features import date_window

ENTITY, WEEK = "entity_id", "week_start"

# Names, look-back weeks from the forecast origin, order.
LAST_WEEK = "naive_last_week"
MEAN_4W = "naive_4w_mean"
MEAN_8W = "naive_8w_mean"
SEASONAL_52W = "seasonal_52w"
SEASONAL_MEAN = "entity_seasonal_mean"
BASELINES = (LAST_WEEK, MEAN_4W, MEAN_8W, SEASONAL_52W, SEASONAL_MEAN)
SEASONAL_OFFSET = 51


def history_baselines(
    origins: DataFrame, history: DataFrame, *, value: str = "cases"
) -> DataFrame:
    """Last week, exact 4- and 8-week means and the value 52 weeks before the target.

    History and origins share one date-framed window per entity: a single shuffle answers all four
    baselines, and the origins carry their own columns through it, so nothing is joined back. A
    window holds at most a calendar of history and the origins of one entity.
    """
    events = history.filter(present(value)).select(
        ENTITY, WEEK, F.col(value).cast("double").alias("_v"), F.lit(False).alias("_asked")
    )
    asked = origins.withColumns({"_v": F.lit(None).cast("double"), "_asked": F.lit(True)})
    w = date_window(ENTITY, WEEK)

    def mean(n: int) -> Column:
        frame = w.rangeBetween(-7 * (n - 1), 0)
        return F.when(F.count("_v").over(frame) == n, F.avg("_v").over(frame))

    at = lambda k: F.max("_v").over(w.rangeBetween(-7 * k, -7 * k))
    answered = asked.unionByName(events, allowMissingColumns=True).withColumns(
        {LAST_WEEK: at(0), MEAN_4W: mean(4), MEAN_8W: mean(8), SEASONAL_52W: at(SEASONAL_OFFSET)}
    )
    return answered.filter("_asked").drop("_asked", "_v")


def seasonal_mean(
    training: DataFrame,
    origins: DataFrame,
    *,
    value: str = "cases",
    by: Sequence[str] = (),
    horizon: int = 1,
) -> DataFrame:
    """Training mean of the entity in the ISO week of the target date, up to the origin.

    Instead of an inequality join, training rows and origins share one ordered window per
    (entity, ISO week); it holds one row per year and origin, and the running mean answers each.
    """
    events = training.filter(present(value)).select(
        *by,
        ENTITY,
        WEEK,
        F.weekofyear(WEEK).alias("_season"),
        F.lit(False).alias("_asked"),
        F.col(value).cast("double").alias("_v"),
    )
    asked = origins.withColumns(
        {
            "_season": F.weekofyear(F.date_add(WEEK, 7 * horizon)),
            "_asked": F.lit(True),
            "_v": F.lit(None).cast("double"),
        }
    )
    w = (
        Window.partitionBy(*by, ENTITY, "_season")
        .orderBy(WEEK, "_asked")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        asked.unionByName(events, allowMissingColumns=True)
        .withColumn(SEASONAL_MEAN, F.avg("_v").over(w))
        .filter("_asked")
        .drop("_season", "_asked", "_v")
    )


def baseline_table(
    training: DataFrame, origins: DataFrame, history: DataFrame, *, by: Sequence[str] = ()
) -> DataFrame:
    """All baselines side by side, aligned to the origins."""
    return seasonal_mean(training, history_baselines(origins, history), by=by)


def long_baselines(wide: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per origin and baseline."""
    cells = F.array(
        *[F.struct(F.lit(b).alias("baseline"), F.col(b).alias("prediction")) for b in BASELINES]
    )
    return wide.select(*keep, F.explode(cells).alias("_c")).select(*keep, "_c.*")


def baseline_coverage(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    available = count_where(finite("prediction"))
    total = F.count(F.lit(1))
    return long.groupBy(*by, "baseline").agg(
        available.alias("available"), total.alias("total"), (available / total).alias("coverage")
    )
