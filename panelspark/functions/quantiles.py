"""Exact quantiles (linear interpolation) of groups of any size.

``percentile`` keeps every distinct value of a group in one aggregation buffer. That is fine for
groups bounded by a calendar, not for a cohort that holds a third of all rows. Here a bounded
sketch cuts each group into slots and exact counts tell which slots hold the wanted ranks. Slots
that are still large become groups of the next round, so what one task orders in the end is bounded
however large a group is.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.session import stage_table

SKETCH_ACCURACY = 10_000
# 5 * 5 * 5 slots: a value finds its slot with 12 comparisons, all inside generated code
FAN = 5
SLOTS = FAN**3
# most distinct values that one task orders
ORDERED = 500_000
# most rounds: a slot's number stays a long, and SLOTS**ROUNDS exceeds any number of values
ROUNDS = 8


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str | Column,
    probabilities: dict[str, float],
    *,
    accuracy: int = SKETCH_ACCURACY,
    ordered: int = ORDERED,
) -> DataFrame:
    """One row per key with one column per named probability; null values are ignored."""
    keys = list(keys)
    v = F.col(value) if isinstance(value, str) else value
    # one row per distinct value: copies of a value never pile up in a later task
    data = (
        df.select(*keys, v.cast("double").alias("_v"))
        .filter(F.col("_v").isNotNull())
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    return weighted_quantiles(
        data, keys, "_v", "_c", probabilities, accuracy=accuracy, ordered=ordered
    )


def weighted_quantiles(
    data: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str,
    probabilities: dict[str, float],
    *,
    accuracy: int = SKETCH_ACCURACY,
    ordered: int = ORDERED,
) -> DataFrame:
    """As :func:`exact_quantiles` for rows that already are (key, distinct value, count).

    The distinct values are written once. Where no group holds more than ``ordered`` of them, tasks order whole
    groups. Otherwise a round scans them twice: for the cuts, and for the counts
    that find the slot of each wanted rank. Rounds go on inside those slots until none holds more than
    ``ordered`` distinct values; a round keeps about 1/SLOTS of them, so one or two rounds are usual.
    Cuts and slots are written too: their file size is known when the next step is planned, so Spark
    joins them without shuffling the values while they are small, and shuffles when they are not.
    """
    by = list(keys) or ["_all"]
    group = [*by, "_g"]
    data = data if keys else data.withColumn("_all", F.lit(0))
    data = data.select(
        *by, F.lit(0).cast("long").alias("_g"), F.col(value).alias("_v"), F.col(weight).alias("_c")
    )
    data = stage_table(data, "distinct_values")
    whole = data.groupBy(*group).agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_d"))
    whole = stage_table(
        whole.withColumns({"_base": F.lit(0).cast("long"), "_ranks": _ranks(probabilities.values())}), "groups"
    )
    small = (whole.agg(F.max("_d")).first()[0] or 0) <= ordered
    slots, largest = whole.drop("_d") if small else None, None
    for turn in range(0 if small else ROUNDS):
        data = data if turn == 0 else stage_table(data, "distinct_values")
        cuts = _cuts(data, group, accuracy)
        if slots is None:
            cuts = cuts.withColumn("_base", F.lit(0).cast("long")).withColumn(
                "_ranks", _ranks(probabilities.values())
            )
        else:
            cuts = cuts.drop("_n").join(slots, group)
        cuts = stage_table(cuts, "cuts")
        slotted = (
            data.join(cuts.select(*group, "_cuts"), group)
            .withColumn("_slot", _step(F.lit(0), SLOTS // FAN))
            .withColumn("_slot", _step(F.col("_slot"), SLOTS // FAN**2))
            .withColumn("_slot", _step(F.col("_slot"), 1))
            .withColumn("_g", F.col("_g") * SLOTS + F.col("_slot"))
            .select(*group, "_v", "_c")
        )
        slots = stage_table(_wanted_slots(slotted, cuts, by), "slots")
        before, largest = largest, slots.agg(F.max("_d")).first()[0] or 0
        data = slotted.join(slots.select(*group), group)
        slots = slots.drop("_d")
        # a sketch that is too coarse hardly parts the values any further
        if largest <= ordered or (before is not None and largest > before // 2):
            break
    w = Window.partitionBy(*group).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ends = data.withColumn("_end", F.sum("_c").over(w)).join(slots, group)
    end = F.col("_base") + F.col("_end")
    hits = ends.withColumn(
        "_hit", F.filter("_ranks", lambda r: (r >= end - F.col("_c")) & (r < end))
    ).filter(F.size("_hit") > 0)
    # at most two values per probability
    found = hits.select(*by, "_n", "_v", F.explode("_hit").alias("_rank")).groupBy(*by).agg(
        F.max("_n").alias("_n"),
        F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"),
    )
    return found.select(*keys, *[_between(p).alias(name) for name, p in probabilities.items()])


def _position(p: float) -> Column:
    return F.lit(float(p)) * (F.col("_n") - 1)


def _ranks(probabilities: Iterable[float]) -> Column:
    """The ranks, from 0, on both sides of each probability's place."""
    around = [f(_position(p)) for p in probabilities for f in (F.floor, F.ceil)]
    return F.array_distinct(F.array(*around))


def _between(p: float) -> Column:
    """Linear interpolation between the values found at the two ranks."""
    low, high = (F.try_element_at("_at", f(_position(p))) for f in (F.floor, F.ceil))
    return low + (high - low) * (_position(p) - F.floor(_position(p)))


def _cuts(data: DataFrame, group: list[str], accuracy: int) -> DataFrame:
    """Cuts that spread a group's distinct values over slots.

    Any cuts give the same exact result, because counts decide which slot holds a rank.
    """
    steps = [i / SLOTS for i in range(SLOTS + 1)]
    return data.groupBy(*group).agg(
        F.percentile_approx("_v", steps, accuracy).alias("_cuts"), F.sum("_c").alias("_n")
    )


def _wanted_slots(slotted: DataFrame, cuts: DataFrame, by: list[str]) -> DataFrame:
    """Slots that hold wanted ranks: these ranks, the rows before the slot, and its distinct values."""
    # at most SLOTS rows per group
    per_slot = (
        slotted.groupBy(*by, "_g")
        .agg(F.sum("_c").alias("_m"), F.count(F.lit(1)).alias("_d"))
        .withColumn("_in", F.expr(f"_g div {SLOTS}"))
    )
    w = Window.partitionBy(*by, "_in").orderBy("_g").rowsBetween(Window.unboundedPreceding, 0)
    per_slot = per_slot.withColumn("_to", F.sum("_m").over(w))
    wanted = per_slot.join(
        cuts.select(*by, F.col("_g").alias("_in"), "_base", "_ranks", "_n"), [*by, "_in"]
    )
    last = F.col("_base") + F.col("_to")
    inside = F.filter("_ranks", lambda r: (r >= last - F.col("_m")) & (r < last))
    return (
        wanted.withColumn("_ranks", inside)
        .withColumn("_base", last - F.col("_m"))
        .filter(F.size("_ranks") > 0)
        .select(*by, "_g", "_base", "_ranks", "_n", "_d")
    )


def _step(base: Column, width: int) -> Column:
    """Move a slot number to the last of its FAN sub-ranges whose cut lies below the value."""
    below = [
        F.when(F.get("_cuts", base + F.lit(k * width)) < F.col("_v"), 1).otherwise(0)
        for k in range(1, FAN)
    ]
    total = below[0]
    for b in below[1:]:
        total = total + b
    return base + total * F.lit(width)
