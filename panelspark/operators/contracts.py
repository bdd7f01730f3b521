"""Contracts. Every check returns its violations as rows; ``enforce`` turns them into an error."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.columns import (
    as_col,
    count_where,
    finite,
    finite_nonnegative,
    flag,
    null_safe_differs,
    plus_days,
    present,
)


class ContractViolation(ValueError):
    pass


@dataclass(frozen=True)
class ColumnRule:
    dtype: str
    required: bool = True
    nullable: bool = True
    allowed: tuple[str, ...] = ()
    minimum: float | None = None
    maximum: float | None = None


@dataclass(frozen=True)
class TableContract:
    name: str
    key: tuple[str, ...]
    columns: Mapping[str, ColumnRule] = field(default_factory=dict)


def enforce(violations: DataFrame, what: str) -> None:
    """Raise when there is any violation; only a few sample rows reach the driver."""
    sample = violations.take(5)
    if sample:
        raise ContractViolation(f"{what}: {[r.asDict() for r in sample]}")


def _column_checks(name: str, rule: ColumnRule, dtype: T.DataType) -> dict[str, Column]:
    c = F.col(name)
    some = c.isNotNull()
    checks: dict[str, Column] = {}
    if not rule.nullable:
        checks["null"] = c.isNull()
    if rule.dtype in ("integer", "float"):
        number = c.try_cast("double")
        checks["not_numeric"] = some & number.isNull()
        checks["not_finite"] = some & number.isNotNull() & ~finite(number)
        if rule.dtype == "integer":
            checks["not_integral"] = some & finite(number) & (number != F.round(number))
        if rule.minimum is not None:
            checks["below_min"] = number < rule.minimum
        if rule.maximum is not None:
            checks["above_max"] = number > rule.maximum
    elif rule.dtype == "date":
        checks["not_a_date"] = some & strict_date(name, dtype).isNull()
    elif rule.dtype == "datetime":
        checks["not_a_datetime"] = some & c.try_cast("timestamp").isNull()
    elif rule.dtype == "enum":
        checks["not_allowed"] = some & ~c.isin(*rule.allowed)
    elif rule.dtype in ("boolean", "string"):
        kind = T.BooleanType if rule.dtype == "boolean" else T.StringType
        checks[f"not_{rule.dtype}"] = some & F.lit(not isinstance(dtype, kind))
    else:
        raise ValueError(f"no such kind: {rule.dtype}")
    return checks


def check_schema(df: DataFrame, contract: TableContract) -> DataFrame:
    """Violation counts per (column, rule); ``repeated_key`` counts rows beyond the first of their key.

    One scan for all: rows are first counted per key, together with their violations, so the shuffle that
    finds a key that occurs more than once (null parts included) carries the counts of the rules along.
    """
    missing = [n for n, r in contract.columns.items() if r.required and n not in df.columns]
    checks = {
        (name, rule_name): cond
        for name, rule in contract.columns.items()
        if name in df.columns
        for rule_name, cond in _column_checks(name, rule, df.schema[name].dataType).items()
    }
    key = [k for k in contract.key if k in df.columns]
    missing += [k for k in contract.key if k not in df.columns and k not in missing]
    labels = {f"_v{i}": f"{n}|{r}" for i, (n, r) in enumerate(checks)}
    sums = [count_where(cond).alias(v) for v, cond in zip(labels, checks.values(), strict=True)]
    if key and len(key) == len(contract.key):
        name = "+".join(key)
        per_key = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(
            F.count(F.lit(1)).alias("_n"), *sums
        )
        zero = F.lit(0).cast("long")
        counted = per_key.agg(
            *[F.coalesce(F.sum(v), zero).alias(label) for v, label in labels.items()],
            F.coalesce(F.sum(F.col("_n") - 1), zero).alias(f"{name}|repeated_key"),
        )
    else:
        first = count_where(F.lit(False)).alias("|")
        counted = df.agg(first, *sums).withColumnsRenamed(labels)
    counted = counted.withColumns({f"{n}|missing_column": F.lit(1).cast("long") for n in missing})
    names = [c for c in counted.columns if c != "|"]
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, rule string, violations long")
    parts = F.split("rule_key", r"\|")
    return (
        counted.unpivot([], [F.col(f"`{n}`") for n in names], "rule_key", "violations")
        .select(parts[0].alias("column_name"), parts[1].alias("rule"), "violations")
    )


def strict_date(name: str | Column, dtype: T.DataType | None = None) -> Column:
    """Calendar date of a 10-character text, or of a date or midnight timestamp; else null."""
    c = as_col(name)
    if isinstance(dtype, T.DateType):
        return c
    if isinstance(dtype, T.TimestampType | T.TimestampNTZType):
        return F.when(F.date_trunc("day", c) == c, c.cast("date"))
    text = F.trim(c)
    return F.when(
        text.rlike(r"^\d{4}-\d{2}-\d{2}$"),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"),
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)
    )


def bad_week_intervals(df: DataFrame, start: str = "week_start", end: str = "week_end") -> DataFrame:
    span = F.datediff(F.col(end), F.col(start))
    return df.filter(span.isNull() | (span != 6))


def dimension_violations(
    df: DataFrame, dimension: DataFrame, *, key: str, name: str
) -> DataFrame:
    """Distinct (key, name) pairs with an unknown key or a name that is not the key's."""
    seen = df.select(key, name).distinct()
    dim = dimension.select(key, F.col(name).alias("expected_name"))
    joined = seen.join(dim, key, "left")
    problem = F.when(F.col("expected_name").isNull(), "unknown_id").when(
        F.col(name) != F.col("expected_name"), "name_mismatch"
    )
    return joined.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def status_value_violations(df: DataFrame, *, status: str, value: str) -> DataFrame:
    """``missing`` must go with a null value, ``observed`` and ``imputed`` with a present one."""
    bad = ((F.col(status) == "missing") & present(value)) | (
        F.col(status).isin("observed", "imputed") & ~present(value)
    )
    return df.filter(bad)


# The quality tokens a weather row may carry.
QUALITY_TOKENS = (
    "low_temporal_coverage",
    "low_spatial_coverage",
    "rain_missing",
    "climate_missing",
    "low_weather_coverage",
)


def quality_tokens(value: str | Column) -> Column:
    parts = F.transform(F.split(as_col(value), ";"), lambda t: F.lower(F.trim(t)))
    return F.filter(parts, lambda t: t != "")


def normalize_quality_tokens(value: str | Column) -> Column:
    """Upper-case token list; a lone ``ok`` is ``OK``; null when empty or not recognised."""
    tokens = quality_tokens(value)
    lone_ok = (F.size(tokens) == 1) & (tokens[0] == "ok")
    known = F.forall(tokens, lambda t: t.isin(*QUALITY_TOKENS))
    return F.when(F.size(tokens) <= 0, F.lit(None).cast("string")).when(lone_ok, "OK").when(
        known, F.upper(F.array_join(tokens, ";"))
    )


def unknown_quality_tokens(value: str | Column) -> Column:
    tokens = quality_tokens(value)
    allowed = F.array(*[F.lit(t) for t in QUALITY_TOKENS])
    lone_ok = (F.size(tokens) == 1) & (tokens[0] == "ok")
    return F.when(lone_ok, F.array().cast("array<string>")).otherwise(
        F.array_except(tokens, allowed)
    )


def missing_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of ``left`` that ``right`` lacks."""
    return left.select(*keys).distinct().join(right.select(*keys), list(keys), "left_anti")


def label_conflicts(df: DataFrame, key: str, labels: Sequence[str]) -> DataFrame:
    """Key values that carry more than one distinct label combination."""
    return (
        df.select(key, *labels)
        .distinct()
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n_labels"))
        .filter(F.col("n_labels") > 1)
    )


def grid_steps(
    df: DataFrame, *, entity: str = "entity_id", week: str = "week_start"
) -> DataFrame:
    """Step in days to the previous week of the entity, for every row that has one."""
    w = Window.partitionBy(entity).orderBy(week)
    return df.select(
        entity, week, F.datediff(F.col(week), F.lag(week).over(w)).cast("long").alias("step_days")
    ).filter(F.col("step_days").isNotNull())


def bad_grid_steps(df: DataFrame, *, strict: bool = True, **names: str) -> DataFrame:
    """Steps that are not exactly 7 days (strict) or not a multiple of 7."""
    steps = grid_steps(df, **names)
    bad = F.col("step_days") != 7 if strict else (F.col("step_days") % 7) != 0
    return steps.filter(bad)


def misaligned(
    df: DataFrame,
    value: str,
    offsets: Mapping[str, int],
    *,
    entity: str = "entity_id",
    week: str = "week_start",
) -> DataFrame:
    """Rows per shifted column whose content differs from the value that many weeks away.

    ``offsets`` maps a column to the weeks it looks back (negative: ahead).
    """
    from panelspark.operators.features import exact_date_shift

    expected = exact_date_shift(
        df.select(entity, week, value, *offsets),
        value,
        {f"_e_{c}": k for c, k in offsets.items()},
        entity=entity,
        week=week,
    )
    counted = expected.agg(
        *[
            count_where(null_safe_differs(F.col(c), F.col(f"_e_{c}"))).alias(c)
            for c in offsets
        ]
    )
    return counted.unpivot([], list(offsets), "column_name", "violations")


def weather_coverage_violations(
    df: DataFrame,
    *,
    variables: Sequence[str],
    coverage: str,
    threshold: float,
    entity: str = "entity_id",
) -> DataFrame:
    """All rows under the threshold, a variable null everywhere, or an entity null everywhere."""
    per_entity = df.groupBy(entity).agg(
        *[F.count(v).alias(v) for v in variables],
        count_where(F.col(coverage) >= threshold).alias("_good"),
    )
    overall = per_entity.agg(
        F.when(F.sum("_good") == 0, F.lit("all_rows_low")).alias("r0"),
        *[
            F.when(F.sum(v) == 0, F.lit(f"variable_all_null:{v}")).alias(f"r{i + 1}")
            for i, v in enumerate(variables)
        ],
    )
    table_rules = overall.select(
        F.explode(F.array_compact(F.array(*overall.columns))).alias("rule"),
        F.lit(None).cast("long").alias(entity),
    )
    empty = per_entity.filter(
        reduce(lambda a, b: a & b, [F.col(v) == 0 for v in variables])
    ).select(F.lit("entity_all_null").alias("rule"), F.col(entity).cast("long").alias(entity))
    return table_rules.unionByName(empty)


def control_totals(
    parts: DataFrame,
    reported: DataFrame,
    *,
    group: Sequence[str],
    value: str,
    total: str,
    expected_parts: int,
) -> DataFrame:
    """Per group: sum and number of parts against the reported total."""
    sums = parts.groupBy(*group).agg(
        F.sum(value).alias("sum_of_parts"), F.count(value).alias("n_parts")
    )
    joined = reported.join(sums, list(group), "left")
    status = (
        F.when(F.coalesce("n_parts", F.lit(0)) != expected_parts, "incomplete")
        .when(F.col("sum_of_parts") != F.col(total), "mismatch")
        .otherwise("ok")
    )
    return joined.withColumn("status", status)


def guard_baseline(
    baseline: DataFrame,
    candidate: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    *,
    review: Column | None = None,
) -> DataFrame:
    """Change class per key: deleted, changed, added, or added inside the guarded range."""
    b = baseline.select(*keys, F.lit(1).alias("_b"), *[F.col(v).alias(f"b_{v}") for v in values])
    c = candidate.select(*keys, F.lit(1).alias("_c"), *[F.col(v).alias(f"c_{v}") for v in values])
    joined = b.join(c, list(keys), "full_outer")
    differs = reduce(
        lambda x, y: x | y, [null_safe_differs(F.col(f"b_{v}"), F.col(f"c_{v}")) for v in values]
    )
    change = (
        F.when(F.col("_c").isNull(), "deleted")
        .when(F.col("_b").isNull() & (review if review is not None else F.lit(False)), "review")
        .when(F.col("_b").isNull(), "added")
        .when(differs, "changed")
    )
    return (
        joined.withColumn("change", change)
        .filter(F.col("change").isNotNull())
        .drop("_b", "_c")
    )


def date_cutoff_audit(df: DataFrame, date_cols: Sequence[str], cutoff: str) -> DataFrame:
    """Per date column: range, unparseable values and rows at or after the cutoff.

    The whole text must be a date, with or without a time of day; anything else is unparseable.
    """
    whole = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    parsed = df.select(
        F.posexplode(F.array(*[F.col(c).cast("string") for c in date_cols])).alias("_i", "_t")
    ).select(
        F.element_at(F.array(*[F.lit(c) for c in date_cols]), F.col("_i") + 1).alias("column_name"),
        "_t",
        F.when(F.col("_t").rlike(whole), F.try_to_timestamp(F.substring("_t", 1, 10), F.lit("yyyy-MM-dd")).cast("date")).alias("_d"),
    )
    return parsed.groupBy("column_name").agg(
        F.min("_d").alias("min_date"),
        F.max("_d").alias("max_date"),
        count_where(F.col("_d") >= F.lit(cutoff).cast("date")).alias("rows_at_or_after"),
        count_where(F.col("_t").isNotNull() & F.col("_d").isNull()).alias("unparseable"),
    )


def coverage_of_expected(
    expected: DataFrame, observed: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Expected combinations that were not observed."""
    return expected.join(observed.select(*keys).distinct(), list(keys), "left_anti")


def reconcile(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    *,
    rtol: float = 1e-9,
    atol: float = 1e-9,
) -> DataFrame:
    """Per column: one-sided keys, null-parity breaks, maximum difference, rows out of tolerance."""
    joined = left.select(*keys, F.lit(1).alias("_l"), *[F.col(c).alias(f"l_{c}") for c in columns]).join(
        right.select(*keys, F.lit(1).alias("_r"), *[F.col(c).alias(f"r_{c}") for c in columns]),
        list(keys),
        "full_outer",
    )
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    per_column = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.col(f"l_{c}").cast("double").alias("l"),
                    F.col(f"r_{c}").cast("double").alias("r"),
                )
                for c in columns
            ]
        )
    )
    long = joined.select(F.col("_l"), F.col("_r"), both.alias("_both"), per_column.alias("_p")).select(
        "_l", "_r", "_both", "_p.*"
    )
    diff = F.abs(F.col("l") - F.col("r"))
    return long.groupBy("column_name").agg(
        count_where(F.col("_r").isNull()).alias("left_only"),
        count_where(F.col("_l").isNull()).alias("right_only"),
        count_where(F.col("_both") & (F.col("l").isNull() != F.col("r").isNull())).alias(
            "null_parity_breaks"
        ),
        F.max(diff).alias("max_abs_diff"),
        count_where(diff > F.lit(atol) + F.lit(rtol) * F.abs("r")).alias("out_of_tolerance"),
    )


def daily_grid_gaps(
    df: DataFrame,
    entities: DataFrame,
    bounds: Column,
    *,
    entity: str = "entity_id",
    day: str = "day",
) -> DataFrame:
    """Missing (entity, day) pairs of the full daily grid between two dates."""
    grid = entities.select(
        entity, F.explode(F.sequence(bounds["lo"], bounds["hi"], F.expr("interval 1 day"))).alias(day)
    )
    return grid.join(df.select(entity, day).distinct(), [entity, day], "left_anti")


def feature_input_violations(
    df: DataFrame, *, numeric: Sequence[str], category: str, levels: DataFrame
) -> DataFrame:
    """Counts of null or unknown categories and of non-finite features, one row per rule."""
    known = levels.select(F.col(category), F.lit(1).alias("_known"))
    joined = df.select(category, *numeric).join(known, category, "left")
    counted = joined.agg(
        count_where(F.col(category).isNull()).alias(f"{category}:null"),
        count_where(F.col(category).isNotNull() & F.col("_known").isNull()).alias(
            f"{category}:unknown"
        ),
        *[
            count_where(F.col(c).isNotNull() & ~finite(c)).alias(f"{c}:not_finite")
            for c in numeric
        ],
    )
    return counted.unpivot([], counted.columns, "rule", "violations")


def missing_or_extra_columns(df: DataFrame, expected: Sequence[str]) -> tuple[list[str], list[str]]:
    """Schema-only check: what is missing and what is not expected."""
    return (
        [c for c in expected if c not in df.columns],
        [c for c in df.columns if c not in expected],
    )


def not_finite_nonnegative(df: DataFrame, columns: Sequence[str], *, allow_null: bool) -> DataFrame:
    """Per column: values that are null (when not allowed), not finite or negative."""
    counted = df.agg(
        *[
            count_where(
                (F.col(c).isNotNull() & ~finite_nonnegative(c))
                | (F.lit(not allow_null) & F.col(c).isNull())
            ).alias(c)
            for c in columns
        ]
    )
    return counted.unpivot([], list(columns), "column_name", "violations")


def rule_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Violations per named row rule in one pass."""
    counted = df.agg(*[count_where(cond).alias(name) for name, cond in rules.items()])
    return counted.unpivot([], list(rules), "rule", "violations")


def prediction_rules() -> dict[str, Column]:
    """Row rules of a prediction table: interval arithmetic, persistence, finite values."""
    h = F.col("horizon")
    return {
        "origin_end": F.col("origin_end") != plus_days("origin_start", 6),
        "target_start": F.col("target_start") != plus_days("origin_start", h * 7),
        "target_end": F.col("target_end") != plus_days("origin_start", h * 7 + 6),
        "persistence": null_safe_differs(
            F.col("prediction_persistence"), F.col("observed_current").cast("double")
        ),
        "model_finite_nonnegative": ~finite_nonnegative("prediction_model"),
        "target_finite_nonnegative": ~finite_nonnegative("observed_target"),
    }


def union_violations(checks: Iterable[tuple[str, DataFrame]]) -> DataFrame:
    """(rule, number of violating rows) of several checks as one small table."""
    counted = [
        v.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")
        for name, v in checks
    ]
    return reduce(DataFrame.unionByName, counted)


def panel_contract(
    df: DataFrame, *, entity: str, start: str, end: str, value: str, cutoff: str
) -> DataFrame:
    """Composite contract of a panel read: violations per rule.

    The row rules share one pass; only the key rule needs a shuffle.
    """
    span = F.datediff(F.col(end), F.col(start))
    rows = df.agg(
        (F.count(F.lit(1)) == 0).cast("long").alias("empty_table"),
        count_where(span.isNull() | (span != 6)).alias("bad_interval"),
        count_where(F.col(entity).isNull()).alias("null_entity"),
        count_where(F.col(end) >= F.lit(cutoff).cast("date")).alias("past_cutoff"),
        count_where(F.col(value).isNotNull() & ~finite_nonnegative(value)).alias(
            "not_finite_nonnegative"
        ),
    )
    per_rule = rows.unpivot([], rows.columns, "rule", "violations")
    keys = union_violations([("duplicate_key", duplicate_keys(df, [entity, start]))])
    return per_rule.unionByName(keys)


def expected_combinations(df: DataFrame, config: Sequence[str], fold: str) -> DataFrame:
    """Every configuration with every fold seen in a metric table.

    The folds travel as one array (they are bounded by the calendar years), not as a join.
    """
    folds = df.agg(F.collect_set(fold)).scalar()
    return df.select(*config).distinct().withColumn(fold, F.explode(folds))


def prediction_contract(
    pred: DataFrame,
    expected: DataFrame,
    *,
    config: Sequence[str],
    key: Sequence[str],
    expected_key: Sequence[str],
    target: str = "observed_target",
    prediction: str = "prediction_model",
    tolerance: float = 1e-12,
) -> DataFrame:
    """Per configuration: duplicate, missing and extra keys, bad values, targets that differ.

    The expected keys are offered to every configuration by explode and met in one full join.
    """
    configs = pred.select(*config).distinct()
    shared = [c for c in config if c in expected.columns]
    want = (
        expected.select(
            *shared,
            *[F.col(e).alias(k) for e, k in zip(expected_key, key, strict=True)],
            F.col("target").alias("_target"),
        )
        .distinct()
        .join(configs, shared)
        .withColumn("_w", F.lit(1))
    )
    have = pred.groupBy(*config, *key).agg(
        F.count(F.lit(1)).alias("_copies"),
        F.max(flag(~finite_nonnegative(prediction))).alias("_bad"),
        F.max(F.col(target).cast("double")).alias("_hi"),
        F.min(F.col(target).cast("double")).alias("_lo"),
    )
    joined = want.join(have, [*config, *key], "full_outer")
    off = lambda c: F.abs(F.col(c) - F.col("_target").cast("double")) > tolerance
    return joined.groupBy(*config).agg(
        count_where(F.col("_copies") > 1).alias("duplicate_keys"),
        count_where(F.col("_copies").isNull()).alias("missing_keys"),
        count_where(F.col("_w").isNull()).alias("extra_keys"),
        count_where(F.col("_bad") == 1).alias("bad_values"),
        count_where(off("_hi") | off("_lo")).alias("target_mismatch"),
    )


def recomputed_agreement(
    saved: DataFrame,
    pred: DataFrame,
    keys: Sequence[str],
    *,
    target: str,
    prediction: str,
    tolerance: float = 1e-9,
) -> DataFrame:
    """Recorded MAE against the one recomputed from saved predictions, with null parity."""
    err = F.abs(F.col(prediction) - F.col(target).cast("double"))
    again = pred.groupBy(*keys).agg(F.avg(err).alias("recomputed_mae"))
    joined = saved.withColumnRenamed("mae", "saved_mae").join(again, list(keys), "full_outer")
    same_nulls = F.col("saved_mae").isNull() == F.col("recomputed_mae").isNull()
    close = F.coalesce(
        F.abs(F.col("saved_mae") - F.col("recomputed_mae")) <= tolerance, F.lit(True)
    )
    return joined.withColumn("agrees", same_nulls & close)


def evidence_agreement(
    plan: DataFrame, registry: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Per planned fit: whether it is registered and which recorded facts equal the plan."""
    reg = registry.select(*keys, F.lit(True).alias("_r"), *[F.col(c).alias(f"_r_{c}") for c in columns])
    joined = plan.join(reg, list(keys), "left")
    return joined.select(
        *keys,
        F.col("_r").isNotNull().alias("registered"),
        *[F.col(c).eqNullSafe(F.col(f"_r_{c}")).alias(f"{c}_ok") for c in columns],
    )
