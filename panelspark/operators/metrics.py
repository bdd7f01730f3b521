"""Forecast metrics as aggregate expressions, so any grouping gets them in one pass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.functions.columns import as_col

# Fixed value: floor of a prediction inside the deviance logarithm.
DEVIANCE_FLOOR = 1e-12


def clip_nonnegative(prediction: str | Column) -> Column:
    return F.greatest(as_col(prediction).cast("double"), F.lit(0.0))


def error(target: str | Column, prediction: str | Column) -> Column:
    return as_col(prediction).cast("double") - as_col(target).cast("double")


def mae(target: str | Column, prediction: str | Column, where: Column | None = None) -> Column:
    return F.avg(_masked(F.abs(error(target, prediction)), where))


def rmse(target: str | Column, prediction: str | Column, where: Column | None = None) -> Column:
    e = error(target, prediction)
    return F.sqrt(F.avg(_masked(e * e, where)))


def bias(target: str | Column, prediction: str | Column, where: Column | None = None) -> Column:
    return F.avg(_masked(error(target, prediction), where))


def under_rate(
    target: str | Column, prediction: str | Column, where: Column | None = None
) -> Column:
    below = (error(target, prediction) < 0).cast("double")
    return F.avg(_masked(below, where))


def r2(target: str | Column, prediction: str | Column) -> Column:
    """Null for fewer than two rows or a constant target."""
    y = as_col(target).cast("double")
    e = error(target, prediction)
    spread = F.var_pop(y) * F.count(y)
    return F.when((F.count(y) >= 2) & (spread > 0), F.lit(1.0) - F.sum(e * e) / spread)


def poisson_deviance(target: str | Column, prediction: str | Column) -> Column:
    y = as_col(target).cast("double")
    p = F.greatest(as_col(prediction).cast("double"), F.lit(DEVIANCE_FLOOR))
    log_part = F.when(y > 0, y * F.log(y / p)).otherwise(0.0)
    return F.avg((log_part - y + p) * 2.0)


def metric_columns(
    target: str, prediction: str, threshold: str | None = None
) -> dict[str, Column]:
    """n, MAE, RMSE, R2, Poisson deviance, bias; with a threshold also the MAE at or above it."""
    out = {
        "n": F.count(as_col(prediction)),
        "mae": mae(target, prediction),
        "rmse": rmse(target, prediction),
        "r2": r2(target, prediction),
        "poisson_deviance": poisson_deviance(target, prediction),
        "bias": bias(target, prediction),
    }
    if threshold:
        out["mae_top_decile"] = mae(target, prediction, as_col(target) >= as_col(threshold))
    return out


def high_incidence_columns(
    target: str, prediction: str, thresholds: dict[str, str]
) -> dict[str, Column]:
    """MAE, RMSE, bias and under-prediction rate at or above each threshold column.

    Keys are suffixes such as ``top_10pct``. An empty subset gives null, never zero.
    """
    out: dict[str, Column] = {}
    for suffix, column in thresholds.items():
        where = as_col(target) >= as_col(column)
        out[f"mae_{suffix}"] = mae(target, prediction, where)
        out[f"rmse_{suffix}"] = rmse(target, prediction, where)
        out[f"bias_{suffix}"] = bias(target, prediction, where)
        out[f"underprediction_rate_{suffix}"] = under_rate(target, prediction, where)
    return out


def _masked(value: Column, where: Column | None) -> Column:
    return value if where is None else F.when(where, value)
