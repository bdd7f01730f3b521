"""Source normalisation: alias lookup, component sums, conflicts, quarantine, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.columns import as_col, count_where, plus_days, present
from panelspark.functions.text import alias_key


def alias_dimension(names: DataFrame, *, entity: str, aliases: str) -> DataFrame:
    """One row per (lookup key, entity) from an array column of aliases."""
    spread = names.select(entity, F.explode(aliases).alias("alias"))
    return spread.select(entity, alias_key("alias").alias("alias_key")).distinct()


def alias_conflicts(dimension: DataFrame, *, entity: str) -> DataFrame:
    """Lookup keys that lead to more than one entity."""
    return (
        dimension.groupBy("alias_key")
        .agg(
            F.count(F.lit(1)).alias("n_entities"),
            F.min(entity).alias("first_entity"),
            F.max(entity).alias("last_entity"),
        )
        .filter(F.col("n_entities") > 1)
    )


def resolve_aliases(df: DataFrame, dimension: DataFrame, *, name: str) -> DataFrame:
    """Attach the entity of a printed name; unmatched names keep a null entity."""
    return df.withColumn("alias_key", alias_key(name)).join(dimension, "alias_key", "left")


def component_rollup(
    components: DataFrame,
    keys: Sequence[str],
    *,
    component: str = "component",
    value: str = "value",
    expected: int,
    status: str = "case_status",
) -> DataFrame:
    """Entity value only when every expected component is present and observed."""
    observed = count_where(present(value))
    return (
        components.groupBy(*keys)
        .agg(
            F.sum(value).alias("_sum"),
            observed.alias("n_observed"),
            F.count(component).alias("n_present"),
        )
        .withColumn("_ok", (F.col("n_observed") == expected) & (F.col("n_present") == expected))
        .withColumn("value", F.when(F.col("_ok"), F.col("_sum")))
        .withColumn(status, F.when(F.col("_ok"), "observed").otherwise("missing"))
        .drop("_sum", "_ok")
    )


def component_provenance(
    components: DataFrame,
    keys: Sequence[str],
    *,
    component: str = "component",
    value: str = "value",
    expected: Sequence[str],
) -> DataFrame:
    """Ordered component lists, completeness and the text of what is missing.

    The rows are unique per component, so a list is bounded by the expected components.
    """
    parts = F.array_sort(F.collect_list(F.struct(F.col(component).alias("c"), F.col(value).alias("v"))))
    names = F.transform("_p", lambda s: s["c"])
    seen = F.transform(F.filter("_p", lambda s: s["v"].isNotNull()), lambda s: s["c"])
    wanted = F.array(*[F.lit(e) for e in expected])
    absent = F.array_except(wanted, names)
    unobserved = F.array_except(F.array_except(wanted, seen), absent)
    issue = F.concat_ws(
        "; ",
        F.when(
            F.size(absent) > 0,
            F.concat(F.lit("missing expected components: "), F.array_join(absent, ", ")),
        ),
        F.when(
            F.size(unobserved) > 0,
            F.concat(F.lit("components not observed/non-null: "), F.array_join(unobserved, ", ")),
        ),
    )
    return (
        components.groupBy(*keys)
        .agg(parts.alias("_p"))
        .select(
            *keys,
            F.array_join(names, "|").alias("component_names"),
            F.array_join(
                F.transform("_p", lambda s: F.coalesce(s["v"].cast("string"), F.lit(""))), "|"
            ).alias("component_values"),
            F.when((F.size(absent) == 0) & (F.size(unobserved) == 0), "complete")
            .otherwise("incomplete")
            .alias("completeness"),
            issue.alias("integrity_issue"),
        )
    )


def resolve_conflicts(
    df: DataFrame,
    keys: Sequence[str],
    *,
    value: str,
    status: str,
    order: Sequence[str],
) -> DataFrame:
    """One row per key; sources that disagree leave a null value with status ``missing``.

    Everything is a partial aggregate (min, max, min_by), so many copies of one report meet as one
    row per map task, never as a collected group.
    """
    payload = [c for c in df.columns if c not in keys]
    row, rank = F.struct(*payload), F.struct(*order)
    seen = present(value)
    agg = df.groupBy(*keys).agg(
        F.min_by(row, rank).alias("_any"),
        F.min_by(F.when(seen, row), F.when(seen, rank)).alias("_obs"),
        F.min(F.when(seen, F.col(value))).alias("_lo"),
        F.max(F.when(seen, F.col(value))).alias("_hi"),
    )
    conflict = F.coalesce(F.col("_lo") != F.col("_hi"), F.lit(False))
    pick = F.when(F.col("_lo").isNotNull() & ~conflict, F.col("_obs")).otherwise(F.col("_any"))
    out = agg.select(*keys, conflict.alias("is_conflict"), pick.alias("_r")).select(
        *keys, "is_conflict", *[F.col(f"_r.{c}").alias(c) for c in payload]
    )
    return out.withColumn(value, F.when(~F.col("is_conflict"), F.col(value))).withColumn(
        status, F.when(F.col("is_conflict"), "missing").otherwise(F.col(status))
    )


def conflict_pairs(
    df: DataFrame, keys: Sequence[str], *, source: str, value: str, order: Sequence[str]
) -> DataFrame:
    """Every observed value that differs from the key's first stable one, as ordered pairs.

    Each row meets only its key's baseline: the output is linear in the input.
    """
    observed = df.filter(present(value))
    base = observed.groupBy(*keys).agg(
        F.min_by(F.struct(F.col(source).alias("s"), F.col(value).alias("v")), F.struct(*order)).alias(
            "_b"
        )
    )
    joined = observed.join(base, list(keys)).filter(F.col(value) != F.col("_b.v"))
    text = lambda s, v: F.struct(s.alias("s"), v.cast("string").alias("t"), v.alias("v"))
    a, b = text(F.col("_b.s"), F.col("_b.v")), text(F.col(source), F.col(value))
    return joined.select(
        *keys,
        F.least(a, b).alias("_x"),
        F.greatest(a, b).alias("_y"),
    ).select(
        *keys,
        F.col("_x.s").alias("source_a"),
        F.col("_x.v").alias("value_a"),
        F.col("_y.s").alias("source_b"),
        F.col("_y.v").alias("value_b"),
        F.lit("unresolved_official_conflict").alias("resolution"),
    )


def quarantine_groups(
    df: DataFrame, group: Sequence[str], violation: Column, reason: Column
) -> DataFrame:
    """Mark all rows of a group that contains a violating row.

    The verdict is aggregated per group and joined back, so a group is never gathered whole.
    """
    verdict = df.groupBy(*group).agg(
        F.max(F.when(violation, 1).otherwise(0)).alias("_bad"),
        F.min(F.when(violation, reason)).alias("quarantine_reason"),
    )
    return (
        df.join(verdict, list(group))
        .withColumn("quarantined", F.col("_bad") == 1)
        .drop("_bad")
    )


# Keywords of error texts and their reason codes, first match wins.
ERROR_REASONS = (
    (("inconsistent with source", "period", "week boundary"), "REPORTING_PERIOD_AMBIGUITY"),
    (("cumulative",), "CUMULATIVE_WEEKLY_AMBIGUITY"),
    (("expected 26", "duplicate source components"), "DISTRICT_TABLE_INCOMPLETE"),
    (("national reconciliation failed",), "SOURCE_CONFLICT"),
    (("unsupported", "no supported", "parser matched"), "PARSER_ERROR"),
)
NORMALIZATION_REASONS = (
    (("duplicate", "revision"), "DUPLICATE_OR_REVISION"),
    (("conflict", "reconciliation", "disagree"), "SOURCE_CONFLICT"),
)


def classify_text(
    text: str | Column, rules: Sequence[tuple[Sequence[str], str]], default: Column | None = None
) -> Column:
    t = F.lower(as_col(text))
    out: Column | None = None
    for words, code in rules:
        hit = t.contains(words[0])
        for w in words[1:]:
            hit = hit | t.contains(w)
        out = F.when(hit, code) if out is None else out.when(hit, code)
    assert out is not None
    return out.otherwise(F.lit("UNKNOWN") if default is None else default)


def error_reason(text: str | Column) -> Column:
    return classify_text(text, ERROR_REASONS)


def normalization_reason(text: str | Column) -> Column:
    return classify_text(text, NORMALIZATION_REASONS, error_reason(text))


def dominant_weekday(df: DataFrame, date_col: str) -> Column:
    """Scalar: the most frequent weekday of a date column (ties: the earlier weekday)."""
    counts = df.groupBy(F.weekday(date_col).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max_by("d", F.struct("n", -F.col("d")))).scalar()


def split_by_weekday(df: DataFrame, date_col: str) -> DataFrame:
    """Flag the rows off the dominant weekday for quarantine."""
    return df.withColumn("off_anchor", F.weekday(date_col) != dominant_weekday(df, date_col))


def coverage_by_year(
    df: DataFrame, *, year: str, entity: str, week: str, value: str
) -> DataFrame:
    """Expected = weeks x entities seen in the year; observed, missing and percent."""
    # distinct (year, week) and (year, entity) are counted over pre-aggregated keys
    cells = df.groupBy(year, week, entity).agg(count_where(present(value)).alias("_o"))
    out = cells.groupBy(year).agg(
        F.count_distinct(week).alias("weeks"),
        F.count_distinct(entity).alias("entities"),
        F.sum("_o").alias("observed"),
    )
    expected = F.col("weeks") * F.col("entities")
    return out.select(
        year,
        expected.alias("expected"),
        "observed",
        (expected - F.col("observed")).alias("missing"),
        F.round(F.col("observed") / expected * 100.0, 2).alias("coverage_pct"),
    )


# Bucket widths in days by length class; an interval touches at most two buckets of its class or a wider one.
CLASS_DAYS = tuple(7 * 8**k for k in range(7))


def length_class(start: str, end: str) -> Column:
    """Number of the narrowest class whose buckets are at least as wide as the interval."""
    days = F.datediff(F.col(end), F.col(start)) + 1
    return sum(((days > w).cast("int") for w in CLASS_DAYS[:-1]), F.lit(0))


def spread_intervals(df: DataFrame, start: str, end: str, levels: Column) -> DataFrame:
    """Intervals under the day buckets they touch, at their own length class and the wider ones of ``levels``.

    ``_class`` is the class of the interval, ``_level`` that of the listing and ``_k`` the bucket. At most
    two copies per level, however long the interval; intervals with a null or reversed end are left out.
    """
    epoch = F.lit("1970-01-01").cast("date")
    some = df.filter(F.col(start) <= F.col(end)).withColumns({"_class": length_class(start, end), "_levels": levels})
    listed = F.array_distinct(F.concat(F.array("_class"), F.filter("_levels", lambda v: v > F.col("_class"))))
    width = F.element_at(F.lit(list(CLASS_DAYS)), F.col("_level") + 1)
    bucket = lambda d: F.floor(F.datediff(F.col(d), epoch) / width)
    return some.withColumn("_level", F.explode(listed)).withColumn("_k", F.explode(F.sequence(bucket(start), bucket(end))))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    *,
    entity: str = "entity_id",
    start: str = "start",
    end: str = "end",
) -> DataFrame:
    """Pairs of overlapping intervals of the same entity.

    Buckets come in length classes. The longer interval of a pair is listed at its own class only, the
    shorter one also at each wider class that the other side has, and they meet by equi-join on (entity,
    class, bucket). ``_way`` tells whether the left or the right one is the longer, so two intervals never meet
    at a class wider than both. A pair is kept only in the bucket of its overlap start, so it appears once.
    """
    epoch = F.lit("1970-01-01").cast("date")

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(entity, *[F.col(c).alias(f"{tag}_{c}") for c in df.columns if c != entity])

    def classes(df: DataFrame, tag: str) -> Column:
        """The length classes that occur, seven at most."""
        lo, hi = f"{tag}_{start}", f"{tag}_{end}"
        return df.filter(F.col(lo) <= F.col(hi)).agg(F.collect_set(length_class(lo, hi))).scalar()

    a, b = side(left, "a"), side(right, "b")
    of_a, of_b = classes(a, "a"), classes(b, "b")
    home = F.col("_level") == F.col("_class")
    smaller = F.exists("_levels", lambda v: v < F.col("_class"))
    a = spread_intervals(a, f"a_{start}", f"a_{end}", of_b).withColumn("_way", F.when(home, 0).otherwise(1))
    b = spread_intervals(b, f"b_{start}", f"b_{end}", of_a)
    b = b.withColumn("_way", F.explode(F.when(home & smaller, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    joined = a.drop("_class", "_levels").join(b.drop("_class", "_levels"), [entity, "_level", "_way", "_k"])
    width = F.element_at(F.lit(list(CLASS_DAYS)), F.col("_level") + 1)
    bucket = lambda d: F.floor(F.datediff(d, epoch) / width)
    lo = F.greatest(F.col(f"a_{start}"), F.col(f"b_{start}"))
    hi = F.least(F.col(f"a_{end}"), F.col(f"b_{end}"))
    return (
        joined.filter((lo <= hi) & (F.col("_k") == bucket(lo)))
        .drop("_k", "_level", "_way")
        .withColumn("overlap_start", lo)
        .withColumn("overlap_end", hi)
        .withColumn("overlap_days", (F.datediff(hi, lo) + 1).cast("long"))
        .withColumn(
            "exact_interval",
            (F.col(f"a_{start}") == F.col(f"b_{start}")) & (F.col(f"a_{end}") == F.col(f"b_{end}")),
        )
    )


# Fixed value: text of a report that does not add up; the groups are (sum of parts, printed total).
TOTAL_MISMATCH = (
    r"(?i)national reconciliation failed:\s*\w+ sum\s+(\d+)\s*!=\s*national\s+(\d+)"
)


def mismatch_numbers(text: str) -> dict[str, Column]:
    return {
        "value_a": F.regexp_extract(text, TOTAL_MISMATCH, 2).try_cast("long"),
        "value_b": F.regexp_extract(text, TOTAL_MISMATCH, 1).try_cast("long"),
    }


def union_dedupe(
    left: DataFrame, right: DataFrame, keys: Sequence[str], *, order: Sequence[str]
) -> DataFrame:
    """Align two tables by name, append, keep the first row per key."""
    both = left.withColumn("_side", F.lit(0)).unionByName(
        right.withColumn("_side", F.lit(1)), allowMissingColumns=True
    )
    payload = [c for c in both.columns if c not in keys and c != "_side"]
    first = F.min_by(F.struct(*payload), F.struct("_side", *order))
    return (
        both.groupBy(*keys).agg(first.alias("_r")).select(*keys, *[f"_r.{c}" for c in payload])
    )


def unobserved_reports(value: str, returns: str) -> dict[str, Column]:
    """Zero counts with zero returns are missing; unknown returns are flagged."""
    silent = (F.col(value) == 0) & F.coalesce(F.col(returns) == 0, F.lit(False))
    return {
        "value": F.when(~silent, F.col(value)),
        "case_status": F.when(silent, "missing").otherwise("observed"),
        "completeness_flag": F.when(silent, "zero_with_zero_returns").when(
            F.col(returns).isNull(), "quality_unavailable"
        ),
    }


def first_period_corroboration(
    rows: DataFrame,
    doc: Sequence[str],
    *,
    current: str,
    cumulative: str,
    reported: str,
    total: str,
    expected_rows: int,
) -> DataFrame:
    """Documents of period 1 whose parts corroborate the cumulative total, not the printed one."""
    agg = rows.groupBy(*doc).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(current).alias("_nc"),
        F.bool_and(F.col(current) == F.col(cumulative)).alias("_same"),
        F.sum(current).alias("calculated"),
        F.max(reported).alias("reported"),
        F.max(total).alias("cumulative_total"),
    )
    ok = (
        (F.col("n_rows") == expected_rows)
        & (F.col("_nc") == expected_rows)
        & F.col("_same")
        & (F.col("calculated") == F.col("cumulative_total"))
        & (F.col("reported") != F.col("calculated"))
    )
    return agg.filter(ok).drop("_nc", "_same")


def source_calendar(
    df: DataFrame, anchors: DataFrame, *, year: str = "source_year", week: str = "source_week"
) -> DataFrame:
    """Start date of a source (year, week) from the anchor of the year's week 1."""
    return df.join(anchors.select(year, "anchor"), year, "left").withColumn(
        "expected_start", plus_days("anchor", (F.col(week) - 1) * 7)
    )


def wanted_issues(
    df: DataFrame,
    *,
    year: str = "issue_year",
    week: str = "issue_week",
    start_year: int,
    end_year: int,
    tail_weeks: int = 2,
) -> DataFrame:
    """Issues of the wanted years plus the first weeks of the year after."""
    tail = (F.col(year) == end_year + 1) & F.col(week).between(1, tail_weeks)
    return df.filter(F.col(year).between(start_year, end_year) | tail)


def comparison_summary(
    pairs: DataFrame, *, exact: str, period: str, left: str, right: str
) -> DataFrame:
    """Counts of overlapping pairs by comparability."""
    reason = F.when(F.col(exact), "exact_interval").otherwise("not_comparable_interval")
    return pairs.groupBy(reason.alias("reason")).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_distinct(period).alias("periods"),
        F.sum("overlap_days").alias("overlap_days"),
        count_where(F.col(left) == F.col(right)).alias("equal_values"),
    )


def corroboration_warnings(
    quality: DataFrame, doc: Sequence[str], *, reported: str, calculated: str, corroborating: str
) -> DataFrame:
    """One explained warning per accepted document with its first known totals."""
    return quality.groupBy(*doc).agg(
        F.lit("accepted_first_week_corroboration").alias("warning_type"),
        F.first(reported, ignorenulls=True).alias("raw_reported"),
        F.first(calculated, ignorenulls=True).alias("calculated"),
        F.first(corroborating, ignorenulls=True).alias("corroborating_total"),
        F.first(calculated, ignorenulls=True).alias("chosen_value"),
        F.count(F.lit(1)).alias("quality_rows"),
    )


def issue_summary(conflicts: DataFrame, kind: str = "conflict_type") -> DataFrame:
    """Counts by conflict type and the overall status."""
    typed = F.coalesce(F.col(kind), F.lit("accepted_cross_source"))
    within = count_where(typed == "within_report_national")
    return conflicts.agg(
        count_where(typed == "accepted_cross_source").alias("accepted_cross_source"),
        within.alias("within_report_national"),
        F.count(F.lit(1)).alias("total_issues"),
        F.when(within > 0, "unresolved_or_quarantined_conflicts_present")
        .otherwise("no_unresolved_or_quarantined_conflicts_reported")
        .alias("status"),
    )


def requested_coverage(
    entities: DataFrame,
    reports: DataFrame,
    weather: DataFrame,
    *,
    first: str,
    last: str,
    value: str,
    available: str,
    entity: str = "entity_id",
) -> DataFrame:
    """Per requested year: expected entity-weeks against the two sources."""
    weeks = F.sequence(
        F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 7 days")
    )
    spine = entities.select(entity, F.explode(weeks).alias("week_start"))
    keys = [entity, "week_start"]
    joined = spine.join(reports.select(*keys, value), keys, "left").join(
        weather.select(*keys, available), keys, "left"
    )
    n, r, w = F.col("expected_rows"), F.col("observed_reports"), F.col("observed_weather")
    return (
        joined.groupBy(F.year("week_start").cast("long").alias("year"))
        .agg(
            F.count(F.lit(1)).alias("expected_rows"),
            F.count(value).alias("observed_reports"),
            count_where(F.col(available)).alias("observed_weather"),
        )
        .withColumn("report_coverage_pct", F.round(r / n * 100.0, 2))
        .withColumn("weather_coverage_pct", F.round(w / n * 100.0, 2))
        .withColumn(
            "status",
            F.when((r == n) & (w == n), "complete").otherwise("partial_boundary_or_gaps"),
        )
    )


def cohort_status(
    index: DataFrame, *, date: str, failed: str, first: str, last: str, rows: str | None = None
) -> DataFrame:
    """Status per document: quarantined, parsed, or outside the wanted dates.

    With ``rows``, the rows read from a document, only those of parsed documents are accepted.
    """
    inside = F.col(date).between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    out = index.withColumn(
        "status",
        F.when(F.col(failed) == 1, "quarantined")
        .when(inside, "parsed")
        .otherwise("excluded_outside_cohort"),
    )
    if rows is None:
        return out
    accepted = F.when(F.col("status") == "parsed", F.col(rows)).otherwise(F.lit(0))
    return out.withColumn("accepted_rows", F.coalesce(accepted.cast("long"), F.lit(0).cast("long")))


def quarantine_summary(
    index: DataFrame, *, status: str, reason: str, document: str, observed: str
) -> DataFrame:
    return index.groupBy(status, reason).agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(observed).alias("observed_rows"),
        F.min(document).alias("first_document"),
    )


def wide_to_long(
    printed: DataFrame, keys: Sequence[str], columns: Sequence[str], *, lenient: bool = False
) -> DataFrame:
    """One row per printed component cell with its count, revision mark and problem.

    A cell that is no plain count has a null value and says why; ``lenient`` takes its digits instead.
    """
    from panelspark.functions.text import cell_problem, printed_count, revision_mark, strict_count

    cells = F.array(
        *[F.struct(F.lit(c).alias("component"), F.col(c).alias("cell")) for c in columns]
    )
    long = printed.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")
    count = printed_count("cell") if lenient else strict_count("cell")
    return long.select(
        *keys, "component", count.alias("value"), revision_mark("cell").alias("revised"),
        cell_problem("cell", lenient=lenient).alias("problem"),
    )


def component_names(df: DataFrame, name: str, expected: Sequence[str]) -> DataFrame:
    """Printed component names, footnote marks removed, against the expected ones."""
    from panelspark.functions.text import strip_footnote

    clean = strip_footnote(name)
    seen = df.groupBy(clean.alias("component")).agg(F.count(F.lit(1)).alias("n_rows"))
    status = F.when(F.col("component").isin(*expected), "expected").otherwise("unexpected")
    absent = df.agg(*[count_where(clean == e).alias(e) for e in expected])
    missing = absent.unpivot([], list(expected), "component", "n_rows").filter("n_rows = 0")
    return seen.withColumn("status", status).unionByName(
        missing.withColumn("status", F.lit("missing"))
    )
