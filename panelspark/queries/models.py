"""The fitted study and the tables that analyse it.

Fits have no SQL counterpart, but what they must satisfy has: rows per fit, penalised gradients that are
zero, losses that fall every round, and predictions that meet the contract.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import contracts as C
from panelspark.operators import errors as E
from panelspark.operators import importance as I
from panelspark.operators import models as ML
from panelspark.operators import resample as R
from panelspark.operators import selection as SEL
from panelspark.operators import study as ST
from panelspark.plans import forecasts as FC
from panelspark.queries.base import cte, query
from panelspark.queries.evaluation import _round, staged_rows
from panelspark.queries.splits import BOUNDARY, FOLD_YEARS, evaluation
from panelspark.session import stage_table
from panelspark.sources.panels import Panels

LABEL = "cases_next_week"
CASES = ("cases", "cases_lag_1", "cases_lag_2", "cases_lag_3", "cases_lag_4")
WEATHER = (*CASES, "rainfall_sum_mm", "temp_mean_c", "humidity_mean_pct")
CONFIG = ["horizon", "feature_set", "family"]

cte("study_sets", "SELECT unnest(['cases_only', 'cases_rainfall', 'cases_full_weather']) AS feature_set")
cte(
    "fit_sizes",
    """
SELECT fold::BIGINT AS fold, horizon::BIGINT AS horizon, feature_set, count(*)::BIGINT AS n_train FROM train_cohort, study_sets GROUP BY 1, 2, 3
""",
)


def study(p: Panels, *families: str) -> ST.Schedule:
    return FC.run_study(p, FOLD_YEARS, BOUNDARY, families or FC.FAMILIES)


def fits(p: Panels, family: str) -> DataFrame:
    return study(p, family).registry().filter(F.col("family") == family)


def predictions(p: Panels) -> DataFrame:
    return study(p).table().filter(F.col("family").isin(*FC.FAMILIES))


def _linear(p: Panels, family: str) -> DataFrame:
    """Rows of each fit and the largest entry of its penalised gradient per row, which a solution brings to zero."""
    out = fits(p, family).select("fold", "horizon", "feature_set", "n_train", F.abs("slope").alias("residual"))
    return _round(out, "residual", digits=6)


def _boosted(p: Panels, family: str) -> DataFrame:
    """Rows and rounds of each fit, and whether its training loss falls every round."""
    falls = F.forall(F.transform(F.slice("losses", 2, F.size("losses") - 1), lambda x, i: x <= F.get("losses", i) * 1.0000001), lambda ok: ok)
    return fits(p, family).select("fold", "horizon", "feature_set", "n_train", F.size("losses").cast("long").alias("rounds"), falls.alias("loss_falls"))


_ZERO = "SELECT fold, horizon, feature_set, n_train, 0.0::DOUBLE AS residual FROM fit_sizes"
_FALLS = "SELECT fold, horizon, feature_set, n_train, 100::BIGINT AS rounds, true AS loss_falls FROM fit_sizes"


@query("fit_ridge", _ZERO)
def fit_ridge(p: Panels) -> DataFrame:
    return _linear(p, "ridge")


@query("fit_poisson", _ZERO)
def fit_poisson(p: Panels) -> DataFrame:
    return _linear(p, "poisson")


@query("fit_boosted_trees", _FALLS)
def fit_boosted_trees(p: Panels) -> DataFrame:
    return _boosted(p, "boosted")


@query("fit_boosted_poisson", _FALLS)
def fit_boosted_poisson(p: Panels) -> DataFrame:
    return _boosted(p, "boosted_poisson")


def last_fold(p: Panels) -> DataFrame:
    """Rows of the latest validation fold, one table read by preprocessing and fitting."""
    rows = staged_rows(p)
    last = rows.agg(F.max("fold_id")).scalar()
    return rows.filter(F.col("fold_id") == last)


@query("fit_random_forest")
def fit_random_forest(p: Panels) -> DataFrame:
    config = ML.ModelConfig("random_forest__full", "random_forest", WEATHER)
    out = ML.fit_fold(last_fold(p), config, label=LABEL).predictions
    return _round(out.select("fold_id", "entity_id", "week_start", LABEL, "prediction"), "prediction", digits=6)


@query(
    "study_predictions",
    """
SELECT fold::BIGINT AS fold, horizon::BIGINT AS horizon, feature_set, family, count(*)::BIGINT AS n_rows, sum(target)::BIGINT AS target_total,
  sum(cases)::BIGINT AS current_total, min(week_start) AS first_origin, max(target_end) AS last_target_end, count(*)::BIGINT AS usable
FROM eval_long, study_sets, unnest(['ridge', 'boosted']) AS t(family) GROUP BY 1, 2, 3, 4
""",
)
def study_predictions(p: Panels) -> DataFrame:
    """Rows, totals and spans of the fitted predictions, with those finite and not negative."""
    usable = F.col("prediction_model").isNotNull() & (F.col("prediction_model") >= 0)
    return predictions(p).groupBy("fold", *CONFIG).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("observed_target").alias("target_total"), F.sum("observed_current").alias("current_total"),
        F.min("origin_start").alias("first_origin"), F.max("target_end").alias("last_target_end"), F.count(F.when(usable, 1)).alias("usable"),
    )


@query(
    "study_contract",
    """
SELECT horizon::BIGINT AS horizon, feature_set, family, 0::BIGINT AS duplicate_keys, 0::BIGINT AS missing_keys, 0::BIGINT AS extra_keys,
  0::BIGINT AS bad_values, 0::BIGINT AS target_mismatch
FROM (SELECT DISTINCT horizon FROM eval_long), study_sets, unnest(['ridge', 'boosted']) AS t(family)
""",
)
def study_contract(p: Panels) -> DataFrame:
    return C.prediction_contract(
        predictions(p), evaluation(p), config=CONFIG,
        key=["fold", "entity_id", "origin_start"], expected_key=["fold", "entity_id", "week_start"],
    )


@query(
    "predict_clip",
    """
SELECT entity_id, horizon::BIGINT AS horizon, count(*)::BIGINT * 6 AS n_rows, 0::BIGINT AS negative, 0::BIGINT AS not_finite FROM eval_long GROUP BY 1, 2
""",
)
def predict_clip(p: Panels) -> DataFrame:
    """Scores of the evaluation rows per entity: negative ones, which clipping rules out, and unusable ones."""
    return predictions(p).groupBy("entity_id", "horizon").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(F.col("prediction_model") < 0, 1)).alias("negative"),
        F.count(F.when(F.col("prediction_model").isNull(), 1)).alias("not_finite"),
    )


@query("coefficients_table")
def coefficients_table(p: Panels) -> DataFrame:
    """Coefficients of every ridge fit, categories included."""
    long = fits(p, "ridge").select("fold", "horizon", "feature_set", F.explode("weights").alias("feature", "coefficient"))
    out = long.filter("feature <> 'intercept'").withColumns(ML.coefficient_columns())
    return _round(out, "coefficient", "abs_coefficient", digits=6)


@query("tree_importance")
def tree_importance(p: Panels) -> DataFrame:
    """Share of the gain of every feature that splits, per boosted fit."""
    long = fits(p, "boosted").select("fold", "horizon", "feature_set", F.explode("weights").alias("feature", "importance"))
    return _round(long, "importance", digits=6)


@query("cv_evaluate")
def cv_evaluate(p: Panels) -> DataFrame:
    """Fold metrics of every fitted configuration; fits that are registered are not repeated."""
    out = E.fold_table(predictions(p))
    return _round(out, "mae_model", "mae_persistence", "rmse_model", "rmse_persistence", "mae_difference", "relative_improvement_pct", digits=6)


@query("study_config_metrics")
def study_config_metrics(p: Panels) -> DataFrame:
    out = E.config_table(E.fold_table(predictions(p)))
    return _round(
        out, "mean_mae_model", "mean_mae_persistence", "mean_mae_difference", "mean_rmse_model", "mean_rmse_persistence", "relative_improvement_pct", digits=6
    )


@query("study_champions")
def study_champions(p: Panels) -> DataFrame:
    """Best fitted configuration per horizon: mean fold MAE, ridge first, fewer features."""
    folds = E.fold_table(predictions(p)).withColumns({"mae": F.col("mae_model"), "rmse": F.col("rmse_model")})
    sizes = {r.feature_set: r.n for r in fits(p, "ridge").groupBy("feature_set").agg(F.max(F.size("weights")).alias("n")).collect()}
    return _round(SEL.champion_per_horizon(folds, sizes, first_family="ridge"), "mean_fold_mae", "mean_fold_rmse", digits=6)


@query("study_bootstrap")
def study_bootstrap(p: Panels) -> DataFrame:
    """Moving-block intervals of the fitted models against persistence."""
    weekly = stage_table(R.weekly_error_sums(predictions(p), list(E.FIT)), "weekly_errors")
    return _round(R.model_vs_persistence(weekly, list(E.FIT)), "point_estimate", "ci_low", "ci_high", digits=6)


def study_permuted(p: Panels, part: str = "all") -> DataFrame:
    return study(p).table("importance").filter(F.col("family").isin(*FC.FAMILIES) & (F.col("part") == part))


@query(
    "study_permutation_rows",
    """
SELECT fold::BIGINT AS fold, horizon::BIGINT AS horizon, feature_set, family, 3::BIGINT AS repeats, least(count(*), 200)::BIGINT AS sample_rows
FROM eval_long, study_sets, unnest(['ridge', 'boosted']) AS t(family) GROUP BY 1, 2, 3, 4
""",
)
def study_permutation_rows(p: Panels) -> DataFrame:
    """Per fit: repeats that every feature has, and rows whose values change places, in the sample."""
    per = study_permuted(p, "sample").groupBy("fold", *CONFIG, "feature").agg(F.count(F.lit(1)).alias("repeats"), F.max("n_rows").alias("n"))
    every = F.when(F.min("repeats") == F.max("repeats"), F.max("repeats"))
    return per.groupBy("fold", *CONFIG).agg(every.alias("repeats"), F.max("n").alias("sample_rows"))


@query("study_permutation_importance")
def study_permutation_importance(p: Panels) -> DataFrame:
    """Growth of the error per fit and feature when the feature is permuted in all evaluation rows, over its repeats."""
    per = study_permuted(p).groupBy("fold", *CONFIG, "feature").agg(
        F.avg("baseline_mae").alias("baseline_mae"), F.avg("mae_increase").alias("mean_increase"), F.stddev_pop("mae_increase").alias("std_increase")
    )
    return _round(per, "baseline_mae", "mean_increase", "std_increase", digits=6)


@query("study_top_importance")
def study_top_importance(p: Panels) -> DataFrame:
    """The five features per configuration whose permutation costs most, over folds and repeats."""
    means = study_permuted(p).groupBy(*CONFIG, "feature").agg(F.round(F.avg("mae_increase"), 6).alias("mean_increase"), F.count_distinct("fold").alias("folds"))
    return I.top_features(means, CONFIG, value="mean_increase", name="feature", n=5)


@query("param_search")
def param_search(p: Panels) -> DataFrame:
    out = ML.random_search(
        p.spark, staged_rows(p), "random_forest", CASES, label=LABEL, trials=2
    )
    return _round(out, "mean_fold_mae", digits=6)
