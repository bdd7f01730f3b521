"""Gaps and islands on a date grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def label_runs(
    df: DataFrame, keys: Sequence[str], date_col: str, *, step_days: int = 7, out: str = "run_id"
) -> DataFrame:
    """Number the maximal runs of consecutive dates inside each key.

    The rows of a key must have distinct dates, so a window holds at most one row per grid date.
    """
    w = Window.partitionBy(*keys).orderBy(date_col)
    step = F.datediff(F.col(date_col), F.lag(date_col).over(w))
    starts = F.when(step == step_days, 0).otherwise(1)
    return (
        df.withColumn("_starts", starts)
        .withColumn(out, F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("_starts")
    )


def run_lengths(
    df: DataFrame, keys: Sequence[str], date_col: str, *, step_days: int = 7
) -> DataFrame:
    """One row per run: its first and last date and its number of dates."""
    return (
        label_runs(df, keys, date_col, step_days=step_days)
        .groupBy(*keys, "run_id")
        .agg(
            F.min(date_col).alias("run_start"),
            F.max(date_col).alias("run_end"),
            F.count(F.lit(1)).alias("run_length"),
        )
    )
