"""Week spines and gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.columns import plus_days

STEP = "interval 7 days"


def week_bounds(obs: DataFrame, date_col: str = "week_start") -> Column:
    """Scalar struct (lo, hi) of the observed weeks."""
    return obs.agg(F.struct(F.min(date_col).alias("lo"), F.max(date_col).alias("hi"))).scalar()


def week_spine(
    entities: DataFrame, obs: DataFrame, *, entity: str = "entity_id", date_col: str = "week_start"
) -> DataFrame:
    """Every entity x every 7th day between the first and last observed week.

    The bounds are a scalar, so the spine is a map-side explode: no join and no shuffle.
    """
    return (
        entities.select(entity)
        .withColumn("_b", week_bounds(obs, date_col))
        .select(
            entity,
            F.explode(F.sequence("_b.lo", "_b.hi", F.expr(STEP))).alias(date_col),
        )
        .withColumn("week_end", plus_days(date_col, 6))
    )


def entity_spine(
    obs: DataFrame, *, entity: str = "entity_id", date_col: str = "week_start"
) -> DataFrame:
    """Calendar of each entity between its own first and last week."""
    return (
        obs.groupBy(entity)
        .agg(F.min(date_col).alias("_lo"), F.max(date_col).alias("_hi"))
        .select(entity, F.explode(F.sequence("_lo", "_hi", F.expr(STEP))).alias(date_col))
    )


def off_grid(
    obs: DataFrame, anchor: DataFrame, *, date_col: str = "week_start", anchor_col: str = "week_start"
) -> DataFrame:
    """Rows whose date is not a multiple of 7 days after the first date of ``anchor``."""
    first = anchor.agg(F.min(anchor_col)).scalar()
    return obs.filter(F.pmod(F.datediff(F.col(date_col), first), F.lit(7)) != 0)


def year_chunks(
    bounds: DataFrame, *, lo: str = "lo", hi: str = "hi", tail: tuple[int, str] | None = None
) -> DataFrame:
    """Split a date range into one range per calendar year.

    ``tail`` (year, day) lets the chunk of a year run on to a day of the next year, so that the
    last week of a range stays whole; a range that ends on that day gets no further chunk.
    """
    year = F.col("year")
    regular = F.least(F.col(hi), F.make_date(year, F.lit(12), F.lit(31)))
    out = bounds.withColumn("year", F.explode(F.sequence(F.year(lo), F.year(hi))))
    end = regular
    if tail is not None:
        last = F.lit(tail[1]).cast("date")
        end = F.when((year == tail[0]) & (F.col(hi) >= last), last).otherwise(regular)
        out = out.filter((year <= tail[0]) | (F.col(hi) != last))
    return out.withColumn(
        "chunk_start", F.greatest(F.col(lo), F.make_date(year, F.lit(1), F.lit(1)))
    ).withColumn("chunk_end", end)


# Markers of generated calendar rows.
GAP_MARKERS = {
    "case_status": "missing",
    "source_name": "calendar_gap",
    "source_document": "generated calendar row",
    "source_url": "generated:calendar-gap",
    "source_retrieved_at": "1970-01-01T00:00:00Z",
    "parser_version": "calendar-gap-v1",
}


def fill_gap_rows(df: DataFrame, *, status: str = "case_status") -> DataFrame:
    """Fill the source columns of rows that exist only because of the calendar."""
    generated = F.col(status).isNull()
    filled = {
        name: F.when(generated, F.lit(marker)).otherwise(F.col(name))
        for name, marker in GAP_MARKERS.items()
        if name in df.columns and name != status
    }
    return df.withColumns(
        {**filled, status: F.coalesce(F.col(status), F.lit(GAP_MARKERS["case_status"]))}
    )
