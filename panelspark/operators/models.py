"""Spark ML fits per fold. Each fit is a distributed job; the driver only loops over fits."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (
    GBTRegressor,
    GeneralizedLinearRegression,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.columns import digest_int, finite
from panelspark.operators import metrics as M
from panelspark.operators import preprocess as P

LINEAR = ("ridge", "poisson")


@dataclass(frozen=True)
class ModelConfig:
    """One configuration of the screen."""

    config_id: str
    family: str
    features: tuple[str, ...]
    params: Mapping[str, Any] = field(default_factory=dict)
    seed: int = 42


# Default parameters of the model families.
DEFAULTS: dict[str, dict[str, Any]] = {
    "ridge": {"alpha": 1.0},
    "poisson": {"alpha": 1.0, "max_iter": 300},
    "random_forest": {"n_estimators": 128, "max_depth": 10, "min_samples_leaf": 3},
    "boosted": {"n_estimators": 100, "max_depth": 3, "learning_rate": 0.08},
    "boosted_poisson": {"n_estimators": 100, "max_depth": 3, "learning_rate": 0.08},
}
SEARCH_SPACE: dict[str, dict[str, tuple[float, float]]] = {
    "random_forest": {"n_estimators": (64, 256), "max_depth": (4, 10), "min_samples_leaf": (2, 12)},
    "boosted": {"n_estimators": (100, 400), "max_depth": (2, 6), "learning_rate": (0.02, 0.2)},
}


def fit(train: DataFrame, family: str, label: str, params: Mapping[str, Any], seed: int) -> Model:
    """Fit one family on an assembled ``features`` column.

    Spark scales the L2 penalty by the label's spread (linear) or mean (Poisson); the factors below
    make the objective that of the plain penalised regression with the given alpha.
    """
    p = {**DEFAULTS[family], **params}
    common = {"featuresCol": "features", "labelCol": label, "predictionCol": "raw_prediction"}
    if family == "ridge":
        y = train.agg(F.stddev_pop(label).alias("s"), F.count(label).alias("n")).first()
        reg = p["alpha"] * (y["s"] or 0.0) / max(y["n"], 1)
        return LinearRegression(
            **common, solver="normal", standardization=False, elasticNetParam=0.0, regParam=reg
        ).fit(train)
    if family == "poisson":
        mean = train.agg(F.avg(label).alias("m")).first()["m"] or 1.0
        return GeneralizedLinearRegression(
            **common, family="poisson", link="log", regParam=p["alpha"] / mean, maxIter=p["max_iter"]
        ).fit(train)
    if family == "random_forest":
        return RandomForestRegressor(
            **common,
            numTrees=int(p["n_estimators"]),
            maxDepth=int(p["max_depth"]),
            minInstancesPerNode=int(p["min_samples_leaf"]),
            featureSubsetStrategy="all",
            seed=seed,
        ).fit(train)
    if family in ("boosted", "boosted_poisson"):
        return GBTRegressor(
            **common,
            maxIter=int(p["n_estimators"]),
            maxDepth=int(p["max_depth"]),
            stepSize=float(p["learning_rate"]),
            seed=seed,
        ).fit(train)
    raise ValueError(f"unknown model family {family!r}")


def score(model: Model, family: str, df: DataFrame) -> DataFrame:
    """Batch predictions, clipped at zero; a prediction that is not finite becomes null."""
    raw = model.transform(df)
    value = F.expm1("raw_prediction") if family == "boosted_poisson" else F.col("raw_prediction")
    return raw.withColumn(
        "prediction", F.when(finite(value), M.clip_nonnegative(value))
    ).drop("raw_prediction", "features")


@dataclass(frozen=True)
class FittedFold:
    model: Model
    columns: tuple[str, ...]
    predictions: DataFrame


def assemble(
    rows: DataFrame, fold: str, numeric: Sequence[str], *, category: str | None, scale: bool
) -> tuple[DataFrame, list[str]]:
    """Preprocess the rows of one fold with its training state and assemble a vector.

    The state and the category levels have one row per feature or level of the schema; they are
    the only things read back to build the fixed column order.
    """
    train = rows.filter("role = 'train'")
    fitted = {
        r["feature"]: r.asDict()
        for r in P.fit_numeric(train, fold, numeric).filter(~F.col("dropped")).collect()
    }
    columns = [c for c in numeric if c in fitted]
    out = P.transform_fold(rows, {c: fitted[c] for c in columns}, scale=scale)
    names = [n for c in columns for n in (c, f"{c}__missing")]
    if category:
        levels = [
            r["level"] for r in P.fit_levels(train, fold, category).orderBy("level").toLocalIterator()
        ]
        hot = P.one_hot(out, category, levels)
        out = out.withColumns(dict(hot))
        names += list(hot)
    vector = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="error")
    return vector.transform(out), names


def fit_fold(
    rows: DataFrame, config: ModelConfig, *, label: str, fold: str = "fold_id", category: str | None = None
) -> FittedFold:
    """Preprocess, fit and score one configuration on the rows of one fold."""
    prepared, names = assemble(
        rows, fold, config.features, category=category, scale=config.family in LINEAR
    )
    target = label
    if config.family == "boosted_poisson":
        # squared error on the log scale stands in for a Poisson loss, which Spark ML trees lack
        target = "_log_label"
        prepared = prepared.withColumn(target, F.log1p(label))
    prepared = prepared.withColumn(target, F.col(target).cast("double"))
    model = fit(prepared.filter("role = 'train'"), config.family, target, config.params, config.seed)
    scored = score(model, config.family, prepared.filter("role = 'validation'"))
    return FittedFold(model, tuple(names), scored)


METRIC_SCHEMA = (
    "config_id string, family string, fold_id string, n bigint, mae double, rmse double, r2 double, "
    "poisson_deviance double, bias double"
)


def cross_validate(
    spark: SparkSession,
    rows: DataFrame,
    configs: Iterable[ModelConfig],
    *,
    label: str,
    done: DataFrame | None = None,
    category: str | None = None,
) -> DataFrame:
    """Metrics per configuration and fold; fits listed in ``done`` are skipped."""
    folds = sorted(r["fold_id"] for r in rows.select("fold_id").distinct().collect())
    plan = [(c, f) for c in configs for f in folds]
    if done is not None:
        finished = {(r["config_id"], r["fold_id"]) for r in done.select("config_id", "fold_id").collect()}
        plan = [(c, f) for c, f in plan if (c.config_id, f) not in finished]
    out = []
    for config, fold in plan:
        fitted = fit_fold(rows.filter(F.col("fold_id") == fold), config, label=label, category=category)
        m = fitted.predictions.agg(
            *[c.alias(n) for n, c in M.metric_columns(label, "prediction").items()]
        ).first()
        out.append((config.config_id, config.family, fold, *[m[k] for k in m.asDict()]))
    return spark.createDataFrame(out, METRIC_SCHEMA)


def sampled_params(spark: SparkSession, family: str, trials: int, seed: int) -> list[dict[str, Any]]:
    """Seeded draws from the family's bounded space, the same in every run."""
    space = SEARCH_SPACE[family]
    draws = spark.range(trials).select(
        "id", *[(digest_int(F.lit(seed), F.lit(k), "id") / F.lit(2.0**32)).alias(k) for k in space]
    )
    out = []
    for row in draws.orderBy("id").collect():
        params: dict[str, Any] = {}
        for name, (lo, hi) in space.items():
            value = lo + (hi - lo) * row[name]
            params[name] = value if isinstance(lo, float) else int(round(value))
        out.append(params)
    return out


def random_search(
    spark: SparkSession,
    rows: DataFrame,
    family: str,
    features: Sequence[str],
    *,
    label: str,
    trials: int,
    seed: int = 42,
) -> DataFrame:
    """Trial table ordered by the objective, the equal-weight mean of fold MAE."""
    tables = []
    for i, params in enumerate(sampled_params(spark, family, trials, seed)):
        config = ModelConfig(f"{family}__trial{i:03d}", family, tuple(features), params, seed)
        metrics = cross_validate(spark, rows, [config], label=label)
        text = ",".join(f"{k}={v}" for k, v in params.items())
        tables.append(
            metrics.groupBy("config_id", "family")
            .agg(F.avg("mae").alias("mean_fold_mae"), F.count(F.lit(1)).alias("folds"))
            .withColumn("params", F.lit(text))
        )
    return reduce(DataFrame.unionByName, tables).orderBy("mean_fold_mae", "config_id")


def coefficient_columns(feature: str = "feature", coefficient: str = "coefficient") -> dict[str, Column]:
    """Raw feature, size, sign and unit of the coefficients of transformed features."""
    name, value = F.col(feature), F.col(coefficient)
    unit = (
        F.when(name.endswith("__missing"), "binary_missing_indicator_0_or_1")
        .when(name.contains("__"), "one_hot_encoded_indicator_0_or_1")
        .otherwise("training_standard_deviations")
    )
    return {
        "raw_feature": F.regexp_replace(feature, "__.*$", ""),
        "abs_coefficient": F.abs(value),
        "sign": F.when(value >= 0, "positive").otherwise("negative"),
        "unit": unit,
    }


def tree_importance(spark: SparkSession, fitted: FittedFold) -> DataFrame:
    """Native importances of a tree ensemble."""
    values = [float(v) for v in fitted.model.featureImportances.toArray()]
    return spark.createDataFrame(
        list(zip(fitted.columns, values, strict=True)), "feature string, importance double"
    )
