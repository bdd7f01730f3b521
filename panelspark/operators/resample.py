"""Moving-block bootstrap over weekly clusters.

Row errors are summed per (configuration, fold, week) first; the resampling then works on those
calendar-sized tables. Draws come from md5, so any engine reproduces them, and they depend only on
the calendar of a fold: all configurations share them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.columns import digest_int
from panelspark.functions.runs import label_runs
from panelspark.functions.text import number_word

# Fixed values.
SEED = 42
BLOCK_WEEKS = 4
REPS = 1000
_RUNS = "one_or_more_required_contiguous_runs_has_"


def short_run(block: int) -> str:
    return f"{_RUNS}fewer_than_{block}_origin_weeks"


def no_block(block: int) -> str:
    return f"{_RUNS}no_{number_word(block)}_week_contiguous_block"


SHORT_RUN, NO_BLOCK = short_run(BLOCK_WEEKS), no_block(BLOCK_WEEKS)


def week_positions(weeks: DataFrame, by: Sequence[str], week: str = "origin_start") -> DataFrame:
    """Run, position in the run and run length of each distinct week of a group."""
    runs = label_runs(weeks.select(*by, week).distinct(), list(by), week)
    w = Window.partitionBy(*by, "run_id").orderBy(week)
    whole = Window.partitionBy(*by, "run_id")
    return runs.withColumn("pos", F.row_number().over(w) - 1).withColumn(
        "run_length", F.count(F.lit(1)).over(whole)
    )


def support(positions: DataFrame, by: Sequence[str], *, block: int = BLOCK_WEEKS) -> DataFrame:
    """Weeks, run lengths and block counts of each group, and why it cannot be resampled."""
    runs = positions.groupBy(*by, "run_id").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.greatest(F.col("n") - (block - 1), F.lit(0))
    ordered = F.array_sort(F.collect_list(F.struct("run_id", "n", blocks.alias("b"))))
    agg = runs.groupBy(*by).agg(
        F.sum("n").alias("origin_weeks"),
        F.count(F.lit(1)).alias("n_runs"),
        F.min("n").alias("min_run_weeks"),
        F.min(blocks).alias("min_run_blocks"),
        ordered.alias("_runs"),
    )
    text = lambda f: F.array_join(F.transform("_runs", lambda r: r[f].cast("string")), ",")
    reason = F.when(F.col("min_run_weeks") < block, short_run(block)).when(
        F.col("min_run_blocks") < 1, no_block(block)
    )
    return agg.select(
        *by,
        "origin_weeks",
        "n_runs",
        text("n").alias("run_lengths"),
        text("b").alias("run_block_counts"),
        "min_run_weeks",
        "min_run_blocks",
        reason.alias("insufficient_reason"),
    )


def draw_weights(
    positions: DataFrame,
    by: Sequence[str],
    *,
    reps: int = REPS,
    block: int = BLOCK_WEEKS,
    seed: int = SEED,
    week: str = "origin_start",
) -> DataFrame:
    """How often each week is drawn in each replicate: (by, week, rep, times).

    A run of length L gets ceil(L / block) blocks; the last one is cut so that L weeks are drawn.
    The table has at most reps rows per week of a fold, whatever the data size.
    """
    runs = (
        positions.groupBy(*by, "run_id")
        .agg(F.max("run_length").alias("n"))
        .filter(F.col("n") >= block)
    )
    slots = (
        runs.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
        .withColumn("slot", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / block) - 1).cast("int"))))
        .withColumn(
            "start",
            digest_int(F.lit(seed), *[F.col(b) for b in by], "run_id", "rep", "slot")
            % (F.col("n") - (block - 1)),
        )
    )
    taken = F.sequence(
        F.lit(0), F.least(F.lit(block), F.col("n") - F.col("slot") * block).cast("int") - 1
    )
    drawn = (
        slots.withColumn("j", F.explode(taken))
        .withColumn("pos", (F.col("start") + F.col("j")).cast("int"))
        .groupBy(*by, "run_id", "rep", "pos")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    return drawn.join(positions.select(*by, "run_id", "pos", week), [*by, "run_id", "pos"]).select(
        *by, week, "rep", "times"
    )


def bootstrap_mean_of_folds(
    weekly: DataFrame,
    draws: DataFrame,
    keys: Sequence[str],
    statistic: Column,
    sums: Sequence[str],
    *,
    fold: str = "fold",
    week: str = "origin_start",
) -> DataFrame:
    """Interval of the mean over folds of a statistic of drawn weekly sums."""
    joined = weekly.join(draws, [fold, week])
    per_fold = (
        joined.groupBy(*keys, fold, "rep")
        .agg(*[F.sum(F.col(s) * F.col("times")).alias(s) for s in sums])
        .withColumn("_stat", statistic)
    )
    per_rep = per_fold.groupBy(*keys, "rep").agg(F.avg("_stat").alias("_stat"))
    return per_rep.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("reps"),
        F.percentile("_stat", 0.025).alias("ci_low"),
        F.percentile("_stat", 0.975).alias("ci_high"),
    )


def point_mean_of_folds(
    weekly: DataFrame, keys: Sequence[str], statistic: Column, sums: Sequence[str], *, fold: str = "fold"
) -> DataFrame:
    per_fold = (
        weekly.groupBy(*keys, fold)
        .agg(*[F.sum(s).alias(s) for s in sums])
        .withColumn("_stat", statistic)
    )
    return per_fold.groupBy(*keys).agg(F.avg("_stat").alias("point_estimate"))


def interval_table(
    point: DataFrame, interval: DataFrame, keys: Sequence[str], support_row: Column
) -> DataFrame:
    """Point estimate with its interval, which is null when the folds cannot be resampled."""
    out = point.join(interval, list(keys), "left").withColumn("_why", support_row)
    enough = F.col("_why").isNull()
    return (
        out.withColumn("ci_low", F.when(enough, F.col("ci_low")))
        .withColumn("ci_high", F.when(enough, F.col("ci_high")))
        .withColumnRenamed("_why", "insufficient_reason")
    )


def weekly_error_sums(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums of absolute errors per configuration, fold and origin week."""
    y = F.col("observed_target").cast("double")
    return pred.groupBy(*keys, "fold", "origin_start").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(F.abs(F.col("prediction_model") - y)).alias("model"),
        F.sum(F.abs(F.col("prediction_persistence") - y)).alias("persistence"),
    )


def model_statistic() -> Column:
    return (F.col("model") - F.col("persistence")) / F.col("n")


def worst_reason(support_table: DataFrame) -> Column:
    """Scalar: the first reason that forbids resampling, null when every fold is long enough."""
    return support_table.agg(F.min("insufficient_reason")).scalar()


def model_vs_persistence(
    weekly: DataFrame, keys: Sequence[str], *, reps: int = REPS, seed: int = SEED
) -> DataFrame:
    """Bootstrap interval of the mean-of-folds MAE difference, model minus persistence.

    Takes the table of :func:`weekly_error_sums`.
    """
    positions = week_positions(weekly, ["fold"])
    sums = ["n", "model", "persistence"]
    return interval_table(
        point_mean_of_folds(weekly, keys, model_statistic(), sums),
        bootstrap_mean_of_folds(
            weekly, draw_weights(positions, ["fold"], reps=reps, seed=seed), keys, model_statistic(), sums
        ),
        keys,
        worst_reason(support(positions, ["fold"])),
    )


def _paired_sums(
    weekly: DataFrame, comparisons: Sequence[tuple[str, str, str]], keys: Sequence[str]
) -> DataFrame:
    """Weekly sums of both sides of every comparison, side by side."""
    offers = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col("feature_set").isin(added, base),
                    F.struct(
                        F.lit(label).alias("comparison"),
                        (F.col("feature_set") == added).alias("is_added"),
                    ),
                )
                for label, added, base in comparisons
            ]
        )
    )
    side = lambda added, col: F.sum(F.when(F.col("_o.is_added") == added, F.col(col)))
    return (
        weekly.withColumn("_o", F.explode(offers))
        .groupBy(*keys, F.col("_o.comparison").alias("comparison"), "fold", "origin_start")
        .agg(
            side(True, "model").alias("added"),
            side(True, "n").alias("added_n"),
            side(False, "model").alias("base"),
            side(False, "n").alias("base_n"),
        )
    )


def added_vs_base(
    weekly: DataFrame,
    comparisons: Sequence[tuple[str, str, str]],
    *,
    reps: int = REPS,
    seed: int = SEED,
) -> DataFrame:
    """Bootstrap interval of the mean-of-folds MAE difference of two feature sets."""
    pairs = _paired_sums(weekly, comparisons, ["horizon", "family"])
    keys = ["horizon", "family", "comparison"]
    stat = F.col("added") / F.col("added_n") - F.col("base") / F.col("base_n")
    sums = ["added", "added_n", "base", "base_n"]
    positions = week_positions(weekly, ["fold"])
    return interval_table(
        point_mean_of_folds(pairs, keys, stat, sums),
        bootstrap_mean_of_folds(
            pairs, draw_weights(positions, ["fold"], reps=reps, seed=seed), keys, stat, sums
        ),
        keys,
        worst_reason(support(positions, ["fold"])),
    )


def weekly_cluster_interval(
    sums_by_week: DataFrame, keys: Sequence[str], *, reps: int = REPS, seed: int = SEED
) -> DataFrame:
    """Interval of the mean of weekly mean differences, all weeks as one series of clusters."""
    weekly = (
        sums_by_week
        .groupBy(*keys, "origin_start")
        .agg(
            (F.sum(F.col("model") - F.col("persistence")) / F.sum("n")).alias("diff"),
        )
        .withColumn("fold", F.lit(0))
        .withColumn("one", F.lit(1.0))
    )
    positions = week_positions(weekly, ["fold"])
    stat = F.col("diff") / F.col("one")
    return interval_table(
        point_mean_of_folds(weekly, keys, stat, ["diff", "one"]),
        bootstrap_mean_of_folds(
            weekly, draw_weights(positions, ["fold"], reps=reps, seed=seed), keys, stat, ["diff", "one"]
        ),
        keys,
        worst_reason(support(positions, ["fold"])),
    )
