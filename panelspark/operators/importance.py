"""Seeded samples, permutation importance and top-n feature tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.columns import all_of, digest_int
from panelspark.operators import metrics as M

SALTS = 64


def seeded_sample(
    df: DataFrame, by: Sequence[str], key: Sequence[str], *, rows: int, seed: int
) -> DataFrame:
    """Reproducible sample of up to ``rows`` rows per cohort: the smallest seeded digests.

    A first cut per (cohort, salt) keeps any one task small, the second ranks at most
    ``SALTS * rows`` rows of a cohort; the result is exactly the ``rows`` smallest.
    """
    marked = df.withColumn("_d", digest_int(F.lit(seed), *key)).withColumn(
        "_salt", F.col("_d") % SALTS
    )
    order = [F.col("_d"), *[F.col(k) for k in key]]
    first = Window.partitionBy(*by, "_salt").orderBy(*order)
    second = Window.partitionBy(*by).orderBy(*order)
    return (
        marked.withColumn("_r", F.row_number().over(first))
        .filter(F.col("_r") <= rows)
        .withColumn("_r", F.row_number().over(second))
        .filter(F.col("_r") <= rows)
        .drop("_d", "_salt", "_r")
    )


def numbered(
    df: DataFrame, by: Sequence[str], bucket: str | None, order: Sequence[str], name: str
) -> DataFrame:
    """``name`` numbers the rows of each group from 1 in the order of ``bucket``, then ``order``.

    A task orders the rows of one bucket; the buckets' counts, summed up, place them in the group.
    Without a bucket a task orders whole groups.
    """
    if bucket is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    within = Window.partitionBy(*by, bucket).orderBy(*order)
    earlier = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    keys = [*by, bucket]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"),
    )
    same = all_of(F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)
    return (
        df.withColumn(name, F.row_number().over(within))
        .join(starts, same)
        .withColumn(name, F.col(name) + F.col("_start"))
        .select(*df.columns, name)
    )


def permutation_importance(
    sample: DataFrame,
    features: Sequence[str],
    scorer: Callable[[Mapping[str, Column]], Column],
    *,
    key: Sequence[str],
    target: str,
    repeats: int,
    seed: int,
    by: Sequence[str] = (),
) -> DataFrame:
    """MAE increase per group, feature and repeat when the feature's values are permuted.

    Input is a bounded sample per group. Inside each (group, feature, repeat) the row at position i by key receives
    the value of the row at position i by seeded digest; all copies are scored in one pass.
    """
    spread = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("own"))
            for f in features
        ]
    )
    copies = (
        sample.withColumn("_f", F.explode(spread))
        .select("*", F.col("_f.feature").alias("feature"), F.col("_f.own").alias("_own"))
        .withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        .drop("_f")
    )
    group = [*by, "feature", "repeat"]
    by_key = Window.partitionBy(*group).orderBy(*key)
    draw = digest_int(F.lit(seed), "feature", "repeat", *key)
    by_draw = Window.partitionBy(*group).orderBy(draw, *key)
    placed = copies.withColumn("_pos", F.row_number().over(by_key))
    donors = copies.select(
        *group, F.row_number().over(by_draw).alias("_pos"), F.col("_own").alias("_given")
    )
    joined = placed.join(donors, [*group, "_pos"])
    swapped = {
        f: F.when(F.col("feature") == f, F.col("_given")).otherwise(F.col(f).cast("double"))
        for f in features
    }
    plain = {f: F.col(f).cast("double") for f in features}
    scored = joined.withColumn("_p", M.clip_nonnegative(scorer(swapped))).withColumn(
        "_base", M.clip_nonnegative(scorer(plain))
    )
    per = scored.groupBy(*group).agg(
        M.mae(target, "_base").alias("baseline_mae"), M.mae(target, "_p").alias("permuted_mae")
    )
    return per.withColumn("mae_increase", F.col("permuted_mae") - F.col("baseline_mae"))


def importance_means(per_repeat: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return per_repeat.groupBy(*by, "feature").agg(
        F.avg("mae_increase").alias("mean_increase"),
        F.stddev_pop("mae_increase").alias("std_increase"),
        F.count(F.lit(1)).alias("repeats"),
    )


def top_features(
    df: DataFrame, by: Sequence[str], *, value: str, name: str, n: int
) -> DataFrame:
    """The n features with the largest value per group, ties by name."""
    w = Window.partitionBy(*by).orderBy(F.desc(value), name)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
