"""Row filters and the choices offered for them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tableprofile.functions.columns import as_double, as_text, clean, pick_fields, quoted


def project(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.select(*[quoted(f) for f in pick_fields(df, fields)])


def equals(df: DataFrame, field: str, values: list) -> Column:
    return quoted(field).isin(list(values))


def contains(df: DataFrame, field: str, value: str) -> Column:
    return F.lower(as_text(df, field)).contains(value.lower())


def starts_with(df: DataFrame, field: str, value: str) -> Column:
    return F.lower(as_text(df, field)).startswith(value.lower())


def regex(df: DataFrame, field: str, pattern: str) -> Column:
    """Anchored at the start, ignoring case."""
    return as_text(df, field).rlike("(?i)^(?:" + pattern + ")")


# The comparisons use the bare column, so that they reach the scan. NaN, which counts as null,
# is greater than every number in Spark and must be kept out of greater_than only.


def in_range(df: DataFrame, field: str, low, high) -> Column:
    return quoted(field).between(low, high)


def less_than(df: DataFrame, field: str, value) -> Column:
    return quoted(field) < value


def greater_than(df: DataFrame, field: str, value) -> Column:
    above = quoted(field) > value
    return above & ~F.isnan(quoted(field)) if dict(df.dtypes)[field] in ("float", "double") else above


_BUILDERS = {
    "equals": lambda df, f, s: equals(df, f, s["values"]),
    "contains": lambda df, f, s: contains(df, f, s["value"]),
    "starts_with": lambda df, f, s: starts_with(df, f, s["value"]),
    "regex": lambda df, f, s: regex(df, f, s["value"]),
    "range": lambda df, f, s: in_range(df, f, s["min"], s["max"]),
    "less_than": lambda df, f, s: less_than(df, f, s["value"]),
    "greater_than": lambda df, f, s: greater_than(df, f, s["value"]),
}


def predicate(df: DataFrame, spec: dict[str, dict]) -> Column:
    """One AND predicate for {field: {"type": ..., ...}}."""
    terms = []
    for field, one in spec.items():
        pick_fields(df, [field])
        if one["type"] not in _BUILDERS:
            raise ValueError(f"unknown filter type {one['type']!r}")
        terms.append(_BUILDERS[one["type"]](df, field, one))
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def apply_filters(df: DataFrame, spec: dict[str, dict]) -> DataFrame:
    return df.where(predicate(df, spec))


def filter_choices(df: DataFrame, field: str) -> DataFrame:
    """(value): sorted distinct values; for text, without nan / none / empty, ignoring case."""
    if dict(df.dtypes)[field] != "string":
        return df.select(clean(df, field).alias("value")).where(F.col("value").isNotNull()) \
                 .distinct().orderBy("value")
    values = df.select(quoted(field).alias("value")).where(
        F.col("value").isNotNull() & ~F.lower("value").isin("nan", "none", "")).distinct()
    return values.orderBy(F.lower("value"), "value")


def filter_bounds(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, min_value, max_value, mean): one wide aggregate for all fields."""
    fields = pick_fields(df, fields)
    aggs = [fn(as_double(df, f)).alias(f"__{name}{i}") for i, f in enumerate(fields)
            for name, fn in (("lo", F.min), ("hi", F.max), ("avg", F.avg))]
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"__lo{i}").alias("min_value"),
                              F.col(f"__hi{i}").alias("max_value"), F.col(f"__avg{i}").alias("mean"))
                     for i, f in enumerate(fields)])
    return df.agg(*aggs).select(F.inline(rows))
