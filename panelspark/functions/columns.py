"""Small column expressions shared by the operators. All of them stay JVM-side."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def week_start(day: str | Column) -> Column:
    """Saturday that opens the week of ``day``."""
    d = as_col(day)
    return F.date_sub(d.cast("date"), F.dayofweek(d) % 7)


def plus_days(day: str | Column, days: int | Column) -> Column:
    return F.date_add(as_col(day), F.lit(days) if isinstance(days, int) else days.cast("int"))


def present(value: str | Column) -> Column:
    """Not null and not NaN: the single notion of "observed" used everywhere."""
    c = as_col(value)
    return c.isNotNull() & ~F.isnan(c.cast("double"))


def finite(value: str | Column) -> Column:
    c = as_col(value).cast("double")
    return F.coalesce(
        ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))),
        F.lit(False),
    )


def finite_nonnegative(value: str | Column) -> Column:
    return finite(value) & (as_col(value) >= 0)


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """Division that is null for a null or zero denominator."""
    d = as_col(denominator)
    return as_col(numerator) / F.when(d != 0, d)


def flag(condition: Column) -> Column:
    """1/0 of a condition; null counts as 0."""
    return F.when(condition, 1).otherwise(0)


def count_where(condition: Column) -> Column:
    return F.coalesce(F.sum(flag(condition)), F.lit(0)).cast("long")


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def rounded(value: str | Column, digits: int = 6) -> Column:
    """Presentation rounding; adding 0.0 turns -0.0 into 0.0."""
    return F.round(as_col(value).cast("double"), digits) + F.lit(0.0)


def digest_int(*parts: str | Column) -> Column:
    """Non-negative 32-bit integer from the md5 of the joined parts.

    The same number comes out of any engine that has md5, so seeded draws are reproducible
    without a random generator and without an ordering.
    """
    text = F.concat_ws("|", *[as_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def digest_sum(*parts: str | Column, half: int = 0) -> Column:
    """Exact sum of one 64-bit half of the md5 of the joined parts; independent of the order of rows."""
    text = F.concat_ws("|", *[as_col(p).cast("string") for p in parts])
    return F.sum(F.conv(F.substring(F.md5(text), 1 + 16 * half, 16), 16, 10).cast("decimal(20,0)"))


def set_digest(*parts: str | Column) -> Column:
    """Fingerprint of a set of rows: the sums of both md5 halves."""
    return F.concat_ws(":", *[digest_sum(*parts, half=h).cast("string") for h in (0, 1)])


def join_parts(parts: Sequence[Column], separator: str) -> Column:
    """Separator-joined non-null parts, null when there is none."""
    joined = F.concat_ws(separator, *parts)
    return F.when(joined != "", joined)


def null_safe_differs(left: Column, right: Column) -> Column:
    return ~left.eqNullSafe(right)
