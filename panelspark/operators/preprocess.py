"""Fold-local preprocessing: medians, missing indicators, one-hot levels, scaling.

The fitted state is a small table (one row per fold and feature), so fitting is one aggregation
for all folds and applying it is a join with calendar- and schema-sized rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.columns import present
from panelspark.functions.quantiles import exact_quantiles


def long_features(df: DataFrame, keys: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
            for c in numeric
        ]
    )
    return df.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*")


def fit_numeric(training: DataFrame, fold: str, numeric: Sequence[str]) -> DataFrame:
    """Per fold and feature: present rows, median, and mean / population std after imputation.

    A feature without any training value is marked dropped.
    """
    long = long_features(training, [fold], numeric)
    medians = exact_quantiles(long, [fold, "feature"], "value", {"median": 0.5})
    v = F.when(present("value"), F.col("value"))
    sums = long.groupBy(fold, "feature").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(v).alias("n_present"),
        F.avg(v).alias("_mean"),
        F.var_pop(v).alias("_var"),
    )
    state = sums.join(medians, [fold, "feature"], "left")
    share = F.col("n_present") / F.col("n_rows")
    mean = F.col("_mean") * share + F.col("median") * (F.lit(1.0) - share)
    spread = (
        share * (F.col("_var") + F.pow(F.col("_mean") - mean, 2))
        + (F.lit(1.0) - share) * F.pow(F.col("median") - mean, 2)
    )
    std = F.sqrt(spread)
    return state.select(
        fold,
        "feature",
        "n_rows",
        "n_present",
        (F.col("n_present") == 0).alias("dropped"),
        "median",
        mean.alias("mean"),
        F.when(std > 0, std).when(std.isNotNull(), F.lit(1.0)).alias("scale"),
    )


def fit_levels(training: DataFrame, fold: str, category: str) -> DataFrame:
    """Distinct non-null levels per fold."""
    return (
        training.select(fold, F.col(category).cast("string").alias("level"))
        .filter(F.col("level").isNotNull())
        .distinct()
    )


def state_map(state: DataFrame, fold: str) -> DataFrame:
    """One row per fold with maps feature -> median, mean, scale; dropped features are absent."""
    kept = state.filter(~F.col("dropped"))
    as_map = lambda c: F.map_from_entries(F.collect_list(F.struct("feature", c)))
    return kept.groupBy(fold).agg(
        as_map("median").alias("_median"), as_map("mean").alias("_mean"), as_map("scale").alias("_scale")
    )


def transform_numeric(
    df: DataFrame, state: DataFrame, fold: str, numeric: Sequence[str], *, scale: bool
) -> DataFrame:
    """Impute with the fold's medians, add indicators and optionally standardise.

    The state table has one row per fold, so the join side is bounded by the number of folds.
    """
    out = df.join(state_map(state, fold), fold)
    columns: dict[str, Column] = {}
    for c in numeric:
        seen = present(c)
        kept = F.col("_median")[c].isNotNull()
        value = F.when(seen, F.col(c).cast("double")).otherwise(F.col("_median")[c])
        if scale:
            value = (value - F.col("_mean")[c]) / F.col("_scale")[c]
        columns[c] = F.when(kept, value)
        columns[f"{c}__missing"] = F.when(kept, (~seen).cast("double"))
    return out.withColumns(columns).drop("_median", "_mean", "_scale")


def transform_fold(
    df: DataFrame, state: Mapping[str, Mapping[str, float]], *, scale: bool
) -> DataFrame:
    """As :func:`transform_numeric` for the rows of one fold.

    The state of one fold (a few numbers per column of the schema) enters as literals, so applying
    it is a projection: no join, and nothing is refitted when an iterative fit scans the rows again.
    """
    columns: dict[str, Column] = {}
    for name, s in state.items():
        seen = present(name)
        value = F.when(seen, F.col(name).cast("double")).otherwise(F.lit(float(s["median"])))
        if scale:
            value = (value - F.lit(float(s["mean"]))) / F.lit(float(s["scale"]))
        columns[name] = value
        columns[f"{name}__missing"] = (~seen).cast("double")
    return df.withColumns(columns)


def one_hot(df: DataFrame, category: str, levels: Sequence[str]) -> Mapping[str, Column]:
    """Indicator per level; an unseen or null value gives all zeros."""
    text = F.col(category).cast("string")
    return {
        f"{category}__{lv}": F.coalesce((text == lv).cast("double"), F.lit(0.0)) for lv in levels
    }
