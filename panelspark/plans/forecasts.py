"""Forecast tables: fitted studies, baselines per fold, and closed-form blends whose rows SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.quantiles import exact_quantiles
from panelspark.operators import baselines as B
from panelspark.operators import errors as E
from panelspark.operators import cohorts as K
from panelspark.operators import registry as REG
from panelspark.operators import splits as S
from panelspark.operators import study as ST
from panelspark.operators.features import HORIZONS
from panelspark.operators.metrics import clip_nonnegative
from panelspark.session import shared_dir, stage_table
from panelspark.sources.panels import Panels

FEATURE_SETS = ("cases_only", "cases_rainfall", "cases_full_weather")
#: Families of the study, which are fitted, and blends of recent values, which are not.
FAMILIES = ("ridge", "boosted")
BLENDS = ("blend_6", "blend_4")
#: Evaluation rows per fold and horizon of the study's sampled importance; its importance takes all of them.
SAMPLE_ROWS = 200
COMPARISONS = (
    ("B_minus_A", "cases_rainfall", "cases_only"),
    ("C_minus_B", "cases_full_weather", "cases_rainfall"),
)


def scorers() -> dict[tuple[str, str], F.Column]:
    """Blends of the origin columns: error tables over them can be recomputed in SQL row by row."""
    mean4 = sum((F.col(f"cases_lag_{k}") for k in (2, 3, 4)), F.col("cases_lag_1")) / 4.0
    rain = F.coalesce("rainfall_sum_mm", F.lit(0.0)) / 613.0
    temp = (F.coalesce("temp_mean_c", F.lit(25.0)) - 25.0) / 97.0
    mix = lambda w: (F.col("cases") * w + mean4 * (13.0 - w)) / 13.0
    base = {"blend_6": mix(6.0), "blend_4": mix(4.0)}
    extra = {"cases_only": F.lit(0.0), "cases_rainfall": rain, "cases_full_weather": rain + temp}
    return {(fam, fs): base[fam] + extra[fs] for fam in BLENDS for fs in FEATURE_SETS}


def forecast_table(p: Panels, evaluation: DataFrame) -> DataFrame:
    """Prediction rows of every blend over the evaluation cohort."""
    wx = p.weather_weekly.select("entity_id", "week_start", "rainfall_sum_mm", "temp_mean_c")
    rows = evaluation.join(wx, ["entity_id", "week_start"], "left")
    return E.prediction_table(rows, scorers())


def fold_baselines(p: Panels, rows: DataFrame) -> DataFrame:
    """Long baseline predictions of the validation rows of every fold."""
    keep = ["fold_id", "entity_id", "week_start", "cases_next_week"]
    origins = rows.filter("role = 'validation'").select(*keep)
    history = p.obs_panel.select("entity_id", "week_start", F.col("value").alias("cases"))
    bounds = rows.filter("role = 'train'").groupBy("fold_id").agg(
        F.min("week_start").alias("_lo"), F.max("week_start").alias("_hi")
    )
    return B.long_baselines(
        B.seasonal_mean(
            observed_before(history, bounds), B.history_baselines(origins, history), by=["fold_id"]
        ),
        keep,
    )


def observed_before(history: DataFrame, bounds: DataFrame) -> DataFrame:
    """Observed history inside each fold's training dates.

    Folds are few and bounded by the years of the calendar: their bounds travel as one array.
    """
    spans = bounds.agg(F.collect_list(F.struct("fold_id", "_lo", "_hi"))).scalar()
    inside = lambda s: (F.col("week_start") >= s["_lo"]) & (F.col("week_start") <= s["_hi"])
    return (
        history.filter(F.col("cases").isNotNull())
        .withColumn("_s", spans)
        .withColumn("_s", F.explode(F.filter("_s", inside)))
        .select(F.col("_s.fold_id").alias("fold_id"), "entity_id", "week_start", "cases")
    )


def fold_thresholds(rows: DataFrame) -> DataFrame:
    """q90 and q95 of the training targets per fold."""
    return exact_quantiles(
        rows.filter("role = 'train'"),
        ["fold_id"],
        "cases_next_week",
        {"threshold90": 0.9, "threshold95": 0.95},
    )


def fold_table(p: Panels, policy: S.SplitPolicy, holdout_year: int) -> DataFrame:
    locked = S.year_start(p.spine, holdout_year)
    folds = S.expanding_folds(p.model_panel, policy, locked_start=locked)
    return S.fold_rows(p.model_panel, folds, policy, locked_start=locked)


def holdout_series(
    p: Panels, policy: S.SplitPolicy, year: int
) -> tuple[DataFrame, DataFrame]:
    """Model rows of the holdout with training thresholds, and its long baselines."""
    locked = S.year_start(p.spine, year)
    train = S.holdout_training_rows(p.model_panel, policy, locked_start=locked)
    limits = exact_quantiles(
        train, [], policy.target, {"threshold90": 0.9, "threshold95": 0.95}
    ).select(F.struct("threshold90", "threshold95"))
    score = scorers()[("blend_6", "cases_only")]
    model = (
        S.holdout_rows(p.model_panel, policy, year)
        .withColumn("_t", limits.scalar())
        .select(
            F.lit("holdout").alias("fold_id"),
            "entity_id",
            "week_start",
            F.col(policy.target).alias("target"),
            clip_nonnegative(score).alias("prediction"),
            F.col("_t.threshold90").alias("threshold90"),
            F.col("_t.threshold95").alias("threshold95"),
        )
    )
    keep = ["fold_id", "entity_id", "week_start"]
    history = p.weekly_obs.withColumnRenamed("value", "cases")
    wide = B.baseline_table(train, model.select(*keep), history)
    return model, B.long_baselines(wide, keep)


def fit_schedule(folds: DataFrame) -> DataFrame:
    """Folds x horizons x feature sets x families as map-side explodes of fixed lists."""
    lit = lambda values: F.explode(F.array(*[F.lit(v) for v in values]))
    return (
        folds.select("fold")
        .withColumn("horizon", lit(HORIZONS))
        .withColumn("feature_set", lit(FEATURE_SETS))
        .withColumn("family", lit(FAMILIES))
        .select(
            F.concat_ws(
                "__", F.concat(F.lit("h"), F.col("horizon").cast("string")), "feature_set", "family",
                F.col("fold").cast("string"),
            ).alias("fit_id"),
            "fold",
            F.col("horizon").cast("long").alias("horizon"),
            "feature_set",
            "family",
        )
    )


def run_study(p: Panels, years: tuple[int, ...], boundary: str, families: tuple[str, ...] = FAMILIES) -> ST.Schedule:
    """Fits every horizon x feature set x family x fold that the study of this panel has not fitted yet.

    The study's folder is named by a digest of the panel and the folds, so fits are found again by any
    later run over the same rows, and changed rows begin a study of their own. ``parts`` keeps it apart from
    older studies, whose importance came from a sample alone.
    """
    panel = p.study_panel
    sets = {s: REG.feature_set_columns(panel.columns, s) for s in FEATURE_SETS}
    seen = panel.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*panel.columns).cast("decimal(38,0)"))).first()
    mark = f"{seen[0]}-{seen[1]}-{'-'.join(map(str, years))}-{boundary}"
    schedule = ST.Schedule(p.spark, f"{shared_dir(p.spark).rstrip('/')}/study-parts-{mark}")
    origins = stage_table(K.fold_origins(panel, years), "fold_origins")
    folds = sorted(r.fold for r in origins.select("fold").collect())
    units = {f"{fam}-h{h}": {f"h{h}__{s}__{fam}__{f}" for s in FEATURE_SETS for f in folds} for fam in families for h in HORIZONS}
    done = schedule.done()
    if all(fits <= done for fits in units.values()):
        return schedule
    data = ST.prepare(K.training_rows(K.long_targets(panel), origins, boundary=boundary), K.long_targets(K.evaluation_rows(panel, years)), sets)

    def work(unit: str) -> tuple[dict[str, DataFrame], list[dict]]:
        family, horizon = unit.rsplit("-h", 1)
        part = data.of_horizon(int(horizon))
        fitted = ST.fit_family(part, family)
        importance = ST.permutations(fitted, part, family, {"all": None, "sample": SAMPLE_ROWS})
        tables = {"predictions": ST.predictions(fitted, part, family), "importance": importance}
        return tables, ST.fit_rows(fitted, part, family)

    schedule.run(units, work)
    return schedule
