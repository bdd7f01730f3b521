"""Year readiness, holdout choice, expanding folds and fold rows.

Fold statistics come from two calendar-sized tables (rows per week, entities per first week), so
no row is multiplied by the number of folds just to count it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.text import number_word
from panelspark.functions.columns import count_where, join_parts, plus_days, present
from panelspark.functions.quantiles import exact_quantiles
from panelspark.functions.runs import run_lengths

ENTITY, WEEK, WEEK_END = "entity_id", "week_start", "week_end"


@dataclass(frozen=True)
class SplitPolicy:
    min_training_years: int = 4
    min_rows: int = 300
    min_entities: int = 20
    min_target_coverage_pct: float = 60.0
    embargo_weeks: int = 1
    horizon_weeks: int = 1
    candidate_years: tuple[int, ...] = (2023, 2024, 2025)
    preferred_year: int = 2024
    excluded_year: int | None = 2025
    target: str = "cases_next_week"
    trainable: str = "is_trainable"


def usable(p: SplitPolicy) -> Column:
    return F.col(p.trainable) & present(p.target)


def trainable_gaps(
    panel: DataFrame, policy: SplitPolicy, by: Sequence[str] = (ENTITY,)
) -> DataFrame:
    """Longest run of weeks that cannot be trained on, per group; zero when there is none."""
    blocked = panel.filter(~F.col(policy.trainable))
    runs = run_lengths(blocked, list(by), WEEK)
    longest = runs.groupBy(*by).agg(F.max("run_length").alias("longest_trainable_gap_weeks"))
    return (
        panel.select(*by)
        .distinct()
        .join(longest, list(by), "left")
        .withColumn(
            "longest_trainable_gap_weeks", F.coalesce("longest_trainable_gap_weeks", F.lit(0))
        )
    )


def year_metrics(
    panel: DataFrame, policy: SplitPolicy, *, thresholds: DataFrame | None = None
) -> DataFrame:
    """Readiness per calendar year.

    ``thresholds`` (year, high_threshold) adds the number of high target rows. Entities are counted
    over (year, entity) sub-totals, so no distinct set is ever built.
    """
    rows = panel.withColumn("year", F.year(WEEK).cast("long"))
    high = F.lit(0).cast("long")
    if thresholds is not None:
        rows = rows.join(thresholds, "year", "left")
        high = count_where(F.col(policy.target) >= F.col("high_threshold"))
    cells = rows.groupBy("year", ENTITY).agg(
        F.count(F.lit(1)).alias("n"),
        count_where(usable(policy)).alias("t"),
        F.count(policy.target).alias("a"),
        count_where(F.col("case_missing_flag")).alias("cm"),
        count_where(F.col("weather_missing_flag")).alias("wm"),
        F.min(WEEK).alias("lo"),
        F.max(WEEK_END).alias("hi"),
        high.alias("h"),
    )
    gaps = (
        trainable_gaps(rows, policy, ("year", ENTITY))
        .groupBy("year")
        .agg(F.max("longest_trainable_gap_weeks").alias("longest_trainable_gap_weeks"))
    )
    pct = lambda c: F.round(F.sum(c) * 100.0 / F.sum("n"), 2)
    out = cells.groupBy("year").agg(
        F.sum("n").alias("complete_rows"),
        F.sum("t").alias("trainable_rows"),
        F.sum("a").alias("target_available_rows"),
        pct("a").alias("target_coverage_pct"),
        F.count(F.lit(1)).alias("entities"),
        count_where(F.col("t") > 0).alias("trainable_entities"),
        F.min("lo").alias("span_start"),
        F.max("hi").alias("span_end"),
        pct("cm").alias("case_missing_pct"),
        pct("wm").alias("weather_missing_pct"),
        F.sum("h").alias("high_incidence_rows"),
    )
    return out.join(gaps, "year", "left")


def readiness_by_entity(panel: DataFrame, policy: SplitPolicy) -> DataFrame:
    counts = panel.groupBy(ENTITY).agg(
        F.count(F.lit(1)).alias("complete_rows"),
        count_where(usable(policy)).alias("trainable_rows"),
        F.count(policy.target).alias("target_available_rows"),
    )
    return counts.join(trainable_gaps(panel, policy), ENTITY)


def prior_threshold(panel: DataFrame, policy: SplitPolicy, before_year: int, q: float) -> DataFrame:
    """Quantile of the targets of the years before ``before_year`` (one row)."""
    prior = panel.filter(F.year(WEEK) < before_year)
    return exact_quantiles(prior, [], policy.target, {"high_threshold": q})


def readiness_summary(panel: DataFrame, policy: SplitPolicy, before_year: int) -> DataFrame:
    """One row: size, span, key uniqueness and the prior high-count threshold."""
    keys = panel.groupBy(ENTITY, WEEK).agg(
        F.count(F.lit(1)).alias("n"), F.max(WEEK_END).alias("e")
    )
    per_entity = keys.groupBy(ENTITY).agg(
        F.sum("n").alias("n"), F.max("n").alias("m"), F.min(WEEK).alias("lo"), F.max("e").alias("hi")
    )
    return per_entity.agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("entities"),
        F.min("lo").alias("date_start"),
        F.max("hi").alias("date_end"),
        (F.max("m") == 1).alias("unique_keys"),
    ).withColumn(
        "high_threshold",
        prior_threshold(panel, policy, before_year, 0.9).select("high_threshold").scalar(),
    )


def _shortfalls(policy: SplitPolicy, label: str) -> Column:
    """Text of the limits a year misses, null when it is adequate."""
    num = lambda c: F.col(c).cast("string")
    low = lambda c, limit, text: F.when(
        F.col(c) < limit, F.concat(F.lit(text + " "), num(c), F.lit(f" < {limit}"))
    )
    coverage = F.when(
        F.col("target_coverage_pct") < policy.min_target_coverage_pct,
        F.concat(
            F.lit("target coverage "),
            num("target_coverage_pct"),
            F.lit(f"% < {policy.min_target_coverage_pct}%"),
        ),
    )
    return join_parts(
        [
            low("trainable_rows", policy.min_rows, label),
            low("trainable_entities", policy.min_entities, "entities"),
            coverage,
        ],
        "; ",
    )


def holdout_audit(panel: DataFrame, policy: SplitPolicy) -> DataFrame:
    """Readiness of the candidate years with thresholds from earlier targets, reasons, choice."""
    rows = panel.withColumn("_y", F.year(WEEK).cast("long"))
    starts = (
        rows.filter(F.col("_y").isin(*policy.candidate_years))
        .groupBy(F.col("_y").alias("year"))
        .agg(F.min(WEEK).alias("start"))
    )
    # a row serves every candidate that starts after its target ends: at most one copy per candidate
    years = F.array(*[F.lit(y).cast("long") for y in policy.candidate_years])
    earlier = (
        rows.filter(present(policy.target))
        .withColumn("_end", plus_days(WEEK_END, 7 * policy.horizon_weeks))
        .withColumn("year", F.explode(F.filter(years, lambda y: y >= F.year("_end"))))
        .join(starts, "year")
        .filter(F.col("_end") < F.col("start"))
    )
    thresholds = exact_quantiles(earlier, ["year"], policy.target, {"high_threshold": 0.9})
    candidates = rows.filter(F.col("_y").isin(*policy.candidate_years)).drop("_y")
    audit = year_metrics(candidates, policy, thresholds=thresholds).join(thresholds, "year", "left")
    reasons = _shortfalls(policy, "trainable rows")
    audit = audit.withColumn("rejection_reason", F.coalesce(reasons, F.lit("accepted"))).withColumn(
        "adequate", F.col("rejection_reason") == "accepted"
    )
    return audit.withColumn("selected", F.col("year") == _chosen_year(audit, policy))


def _chosen_year(audit: DataFrame, policy: SplitPolicy) -> Column:
    """Scalar: the preferred year when adequate, else the latest adequate one."""
    ok = audit.filter("adequate")
    if policy.excluded_year is not None:
        ok = ok.filter(
            (F.col("year") != policy.excluded_year) | (F.col("year") == policy.preferred_year)
        )
    best = F.max_by("year", F.struct((F.col("year") == policy.preferred_year).cast("int"), "year"))
    return ok.agg(best).scalar()


def expanding_folds(
    panel: DataFrame, policy: SplitPolicy, *, locked_start: Column
) -> DataFrame:
    """One row per year before the holdout: fold bounds and counts, or why it was rejected."""
    lead_days = 7 * policy.horizon_weeks
    gap_days = 7 * (policy.horizon_weeks + policy.embargo_weeks)
    dev = panel.withColumn("_locked", locked_start).filter(F.col(WEEK) < F.col("_locked"))
    dev = dev.withColumn("year", F.year(WEEK).cast("long"))
    # validation side: rows whose target is known before the holdout
    scored = dev.filter(plus_days(WEEK_END, lead_days) < F.col("_locked"))
    cells = scored.groupBy("year", ENTITY).agg(
        F.count(F.lit(1)).alias("n"),
        count_where(usable(policy)).alias("t"),
        F.count(policy.target).alias("a"),
        F.min(WEEK).alias("lo"),
        F.max(WEEK_END).alias("hi"),
    )
    val = cells.groupBy("year").agg(
        F.sum("t").alias("trainable_rows"),
        count_where(F.col("t") > 0).alias("trainable_entities"),
        F.round(F.sum("a") * 100.0 / F.sum("n"), 2).alias("target_coverage_pct"),
        F.min("lo").alias("validation_start"),
        F.max("hi").alias("validation_end"),
    )
    years = dev.select("year").distinct()
    # training side, calendar-sized: usable rows per week, entities by their first usable week
    good = dev.filter(usable(policy))
    per_week = good.groupBy(WEEK, WEEK_END).agg(F.count(F.lit(1)).alias("n_rows"))
    first_seen = good.groupBy(ENTITY).agg(F.min(WEEK_END).alias(WEEK_END))
    new_entities = first_seen.groupBy(WEEK_END).agg(F.count(F.lit(1)).alias("n_new"))
    weeks = per_week.join(new_entities, WEEK_END, "left").withColumn(
        "_y", F.year(WEEK).cast("long")
    )
    last_year = years.agg(F.max("year")).scalar()
    train = (
        weeks.withColumn("_last", last_year)
        .filter(F.col("_y") < F.col("_last"))
        .withColumn("year", F.explode(F.sequence(F.col("_y") + 1, F.col("_last"))))
        .join(val.select("year", "validation_start"), "year")
        .filter(plus_days(WEEK_END, gap_days) < F.col("validation_start"))
        .groupBy("year")
        .agg(
            F.min(WEEK).alias("train_start"),
            F.max(WEEK_END).alias("train_end"),
            F.sum("n_rows").alias("rows_train"),
            F.sum(F.coalesce("n_new", F.lit(0))).alias("entities_train"),
        )
    )
    prior = (
        years.withColumn("_all", years.agg(F.array_sort(F.collect_list("year"))).scalar())
        .select("year", F.size(F.filter("_all", lambda y: y < F.col("year"))).alias("prior_years"))
    )
    out = prior.join(val, "year", "left").join(train, "year", "left")
    reason = (
        F.when(
            F.col("prior_years") < policy.min_training_years,
            f"fewer than {number_word(policy.min_training_years)} prior training years",
        )
        .when(F.col("trainable_rows").isNull(), "no scored rows")
        .otherwise(
            F.coalesce(
                _shortfalls(policy, "eligible validation rows"),
                F.when(F.col("rows_train").isNull(), "embargo leaves no eligible training rows"),
            )
        )
    )
    accepted = F.col("rejection_reason").isNull()
    keep = lambda c: F.when(accepted, c)
    return (
        out.withColumn("rejection_reason", reason)
        .select(
            "year",
            keep(F.concat(F.lit("val_"), F.col("year").cast("string"))).alias("fold_id"),
            "prior_years",
            "rejection_reason",
            *[
                keep(F.col(c)).alias(c)
                for c in (
                    "train_start",
                    "train_end",
                    "validation_start",
                    "validation_end",
                    "rows_train",
                    "entities_train",
                )
            ],
            keep(plus_days("train_end", lead_days)).alias("train_target_end_max"),
            keep(plus_days("train_end", gap_days)).alias("train_embargo_end_max"),
            keep(plus_days("validation_end", lead_days)).alias("validation_target_end_max"),
            keep(F.col("trainable_rows")).alias("rows_validation"),
            keep(F.col("trainable_entities")).alias("entities_validation"),
            keep(F.col("target_coverage_pct")).alias("target_coverage_pct"),
        )
    )


def fold_rows(
    panel: DataFrame, folds: DataFrame, policy: SplitPolicy, *, locked_start: Column
) -> DataFrame:
    """Long table (fold_id, role, row) of training and validation rows.

    A row can only serve folds of its own and later years, so the fold lookup is an equi-join on
    the fold year; the date limits are applied after it.
    """
    lead_days = 7 * policy.horizon_weeks
    accepted = folds.filter(F.col("rejection_reason").isNull()).drop("rejection_reason")
    last = accepted.agg(F.max("year")).scalar()
    rows = (
        panel.filter(usable(policy))
        .withColumn("_y", F.year(WEEK).cast("long"))
        .withColumn("_last", last)
        .filter(F.col("_y") <= F.col("_last"))
        .withColumn("year", F.explode(F.sequence("_y", "_last")))
        .withColumn("_target_end", plus_days(WEEK_END, lead_days))
        .withColumn("_locked", locked_start)
    )
    joined = rows.join(accepted, "year")
    is_train = (
        (F.col(WEEK) >= F.col("train_start"))
        & (F.col(WEEK_END) <= F.col("train_end"))
        & (F.col("_target_end") <= F.col("train_target_end_max"))
        & (F.col("_target_end") < F.col("validation_start"))
    )
    is_validation = (
        (F.col(WEEK) >= F.col("validation_start"))
        & (F.col(WEEK_END) <= F.col("validation_end"))
        & (F.col("_target_end") <= F.col("validation_target_end_max"))
        & (F.col("_target_end") < F.col("_locked"))
    )
    role = F.when(is_train, "train").when(is_validation, "validation")
    return joined.select("fold_id", role.alias("role"), *panel.columns).filter(
        F.col("role").isNotNull()
    )


def holdout_training_rows(
    panel: DataFrame, policy: SplitPolicy, *, locked_start: Column
) -> DataFrame:
    """Usable rows whose target and embargo end before the holdout begins."""
    gap_days = 7 * (policy.horizon_weeks + policy.embargo_weeks)
    return (
        panel.filter(usable(policy))
        .withColumn("_locked", locked_start)
        .filter(plus_days(WEEK_END, gap_days) < F.col("_locked"))
        .drop("_locked")
    )


def holdout_rows(panel: DataFrame, policy: SplitPolicy, year: int) -> DataFrame:
    """Usable origins of the holdout year."""
    return panel.filter(usable(policy) & (F.year(WEEK) == year))


def year_start(panel: DataFrame, year: int) -> Column:
    """Scalar: first week of a calendar year present in the panel."""
    return panel.filter(F.year(WEEK) == year).agg(F.min(WEEK)).scalar()


def fold_count_check(rows: DataFrame, folds: DataFrame, *, locked_start: Column) -> DataFrame:
    """Materialised against recorded row counts per fold and role, and locked rows among them."""
    actual = (
        rows.withColumn("_locked", locked_start)
        .groupBy("fold_id", "role")
        .agg(
            F.count(F.lit(1)).alias("actual_rows"),
            count_where(F.col(WEEK) >= F.col("_locked")).alias("locked_rows"),
        )
    )
    recorded = folds.filter(F.col("rejection_reason").isNull()).select(
        "fold_id", "rows_train", "rows_validation"
    )
    expected = F.when(F.col("role") == "train", F.col("rows_train")).otherwise(
        F.col("rows_validation")
    )
    return actual.join(recorded, "fold_id").select(
        "fold_id",
        "role",
        expected.alias("expected_rows"),
        "actual_rows",
        (expected == F.col("actual_rows")).alias("agrees"),
        "locked_rows",
    )


def holdout_summary(train: DataFrame, test: DataFrame, policy: SplitPolicy) -> DataFrame:
    """Size, bounds and training thresholds of the two holdout cohorts."""

    def describe(df: DataFrame, role: str) -> DataFrame:
        per_entity = df.groupBy(ENTITY).agg(
            F.count(F.lit(1)).alias("n"),
            F.min(WEEK).alias("lo"),
            F.max(WEEK).alias("hi"),
            F.max(WEEK_END).alias("e"),
        )
        return per_entity.agg(
            F.lit(role).alias("role"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
            F.count(F.lit(1)).alias("entities"),
            F.min("lo").alias("first_origin"),
            F.max("hi").alias("last_origin"),
            plus_days(F.max("e"), 7 * policy.horizon_weeks).alias("max_target_end"),
        )

    q = exact_quantiles(train, [], policy.target, {"q90": 0.9, "q95": 0.95}).select(
        F.struct("q90", "q95")
    )
    none = F.lit(None).cast("double")
    left = describe(train, "train").withColumn("_q", q.scalar())
    left = left.select("*", F.col("_q.q90").alias("q90"), F.col("_q.q95").alias("q95")).drop("_q")
    right = describe(test, "holdout").withColumns({"q90": none, "q95": none})
    return left.unionByName(right)
