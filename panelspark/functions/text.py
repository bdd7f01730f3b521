"""Names, printed numbers and printed periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.functions.columns import as_col


def alias_key(name: str | Column) -> Column:
    """Lookup form of a name: hyphens as blanks, blanks collapsed, case folded."""
    t = F.regexp_replace(as_col(name), "-", " ")
    return F.lower(F.trim(F.regexp_replace(t, r"(?U)\s+", " ")))


def clean_cell(cell: str | Column) -> Column:
    return F.trim(F.regexp_replace(as_col(cell), r"(?U)\s+", " "))


def strip_footnote(cell: str | Column) -> Column:
    return F.trim(F.regexp_replace(clean_cell(cell), r"\*+$", ""))


def printed_count(cell: str | Column) -> Column:
    """Lenient reading of a cell: its digits whatever else it holds (``12.5`` is 125), ``nil`` is 0."""
    c = clean_cell(cell)
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.lower(c) == "nil", F.lit(0).cast("long")).when(
        digits != "", digits.try_cast("long")
    )


def strict_count(cell: str | Column) -> Column:
    """Count of a cell that holds nothing but digits, separators of thousands and a footnote mark, or ``nil``."""
    c = strip_footnote(cell)
    return F.when(F.lower(c) == "nil", F.lit(0).cast("long")).when(
        c.rlike(r"^(\d+|\d{1,3}(,\d{3})+)$"), F.replace(c, F.lit(","), F.lit("")).try_cast("long")
    )


def revision_mark(cell: str | Column) -> Column:
    return as_col(cell).contains("*")


def cell_problem(cell: str | Column, *, lenient: bool = False) -> Column:
    """Why a cell gives no count: ``blank`` or ``not_numeric``."""
    c = clean_cell(cell)
    count = printed_count(cell) if lenient else strict_count(cell)
    return F.when(c.isNull() | (c == ""), "blank").when(count.isNull(), "not_numeric")


def number_word(n: int) -> str:
    """A small number as an English word, others in digits."""
    words = ("no", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
    return words[n] if 0 <= n < len(words) else str(n)


# Month names and the printed period layout.
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)
PERIOD_PATTERN = (
    r"(?i)(\d{1,2})\s*(?:st|nd|rd|th)?\s*(?:([a-z]+)\s*)?-\s*"
    r"(\d{1,2})\s*(?:st|nd|rd|th)?\s*([a-z]+)\s*-?,?\s*(\d{4})\s*"
    r"\((\d{1,2})(?:st|nd|rd|th)?\s*week\)"
)


def month_number(token: Column) -> Column:
    """Number of a month name or of its short form."""
    t = F.lower(token)
    out = F.lit(None).cast("int")
    for i, name in enumerate(MONTHS, start=1):
        short = {name, name[:3], *(["sept"] if i == 9 else [])}
        out = F.when(t.isin(*sorted(short)), i).otherwise(out)
    return out


def printed_period(text: str | Column) -> dict[str, Column]:
    """Day, month, year and week numbers of a printed period.

    A start month that is printed but unknown is 0, which no date fits; null means that none is printed.
    """
    t = F.regexp_replace(F.regexp_replace(as_col(text), "[–—]", "-"), r"\s+", " ")
    part = lambda i: F.regexp_extract(t, PERIOD_PATTERN, i)
    return {
        "start_day": part(1).try_cast("int"),
        "start_month": F.when(part(2) != "", F.coalesce(month_number(part(2)), F.lit(0))),
        "end_day": part(3).try_cast("int"),
        "end_month": month_number(part(4)),
        "source_year": part(5).try_cast("int"),
        "source_week": part(6).try_cast("int"),
    }


def infer_period_end(
    *,
    start_day: str,
    start_month: str,
    end_day: str,
    end_month: str,
    printed_year: str,
    issue_year: str,
) -> Column:
    """End date of the 7-day period that fits the printed parts.

    The year may be off by one around a printed or issue year; the nearest year that makes the
    period exactly seven days wins. Works inside the row: the candidates are a small array.
    """
    printed, issue = F.col(printed_year), F.col(issue_year)
    turn = (
        (issue == printed + 1)
        & (F.col(end_month) == 1)
        & (F.col(start_month).isNull() | (F.col(start_month) == 12))
    )
    anchor = F.when(F.coalesce(turn, F.lit(False)), issue).otherwise(printed)
    near = lambda y: F.array(y - 1, y, y + 1)
    years = F.when(issue.isNull(), near(printed)).otherwise(F.array_union(near(printed), near(issue)))

    def candidate(y: Column) -> Column:
        end = F.try_to_timestamp(
            F.format_string("%04d-%02d-%02d", y, F.col(end_month), F.col(end_day)),
            F.lit("yyyy-MM-dd"),
        ).cast("date")
        return F.struct(
            F.abs(y - anchor).alias("d1"), F.abs(y - printed).alias("d2"), end.alias("end")
        )

    def fits(c: Column) -> Column:
        start = F.date_sub(c["end"], 6)
        return (
            c["end"].isNotNull()
            & (F.dayofmonth(start) == F.col(start_day))
            & (F.col(start_month).isNull() | (F.month(start) == F.col(start_month)))
        )

    return F.array_min(F.filter(F.transform(years, candidate), fits))["end"]


def year_week_label(year: str, week: str) -> Column:
    return F.format_string("%d-W%02d", F.col(year), F.col(week))
