"""Histograms and box-plot numbers of a numeric field."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tableprofile.functions.columns import as_double, numeric_columns, pick_fields
from tableprofile.operators.outliers import FENCE, column_stats
from tableprofile.plans.quantiles import exact_quantiles


def _finite(df: DataFrame, field: str) -> Column:
    x = as_double(df, pick_fields(df, [field])[0])
    return F.when(F.abs(x) < float("inf"), x)


def nice_step(low: float, high: float, max_bins: int) -> float:
    """Smallest step of the form 1, 2 or 5 times a power of ten that needs at most max_bins bins."""
    if not high > low:
        return 1.0
    power = math.floor(math.log10((high - low) / max_bins)) - 1
    while True:
        for lead in (1, 2, 5):
            step = lead * 10.0 ** power if power >= 0 else lead / 10.0 ** -power
            if math.floor(high / step) - math.floor(low / step) + 1 <= max_bins:
                return step
        power += 1


def _bins(df: DataFrame, fields: list[str], max_bins: int, flag: dict[str, Column] | None = None) -> DataFrame:
    """(field, step, bin, flag) per row and field: the bounds of all fields come from one aggregate."""
    xs = {f: _finite(df, f) for f in fields}
    bounds = df.agg(*[g(x).alias(f"{n}{i}") for i, x in enumerate(xs.values()) for n, g in (("low", F.min), ("high", F.max))]).first()
    entries = []
    for i, (f, x) in enumerate(xs.items()):
        low, high = bounds[f"low{i}"], bounds[f"high{i}"]
        step = nice_step(low, high, max_bins) if low is not None else 1.0
        marked = F.coalesce(flag[f], F.lit(False)) if flag else F.lit(False)
        entries.append(F.struct(F.lit(f).alias("field"), F.lit(step).alias("step"), F.floor(x / step).alias("bin"), marked.alias("flag")))
    return df.select(F.inline(F.array(*entries))).where(F.col("bin").isNotNull())


def _bin_edges() -> list[Column]:
    return [(F.col("bin") * F.col("step")).alias("bin_start"), ((F.col("bin") + 1) * F.col("step")).alias("bin_end")]


def histograms(df: DataFrame, fields: list[str] | None = None, max_bins: int = 30) -> DataFrame:
    """(field, bin_start, bin_end, count) of the occupied bins of all numeric fields; infinite values have none.

    Two scans whatever the number of fields: the bounds of all, then a count per field and bin that is
    combined map-side.
    """
    fields = numeric_columns(df) if fields is None else pick_fields(df, fields)
    if not fields:
        return df.sparkSession.createDataFrame([], "field string, bin_start double, bin_end double, count long")
    counts = _bins(df, fields, max_bins).groupBy("field", "step", "bin").agg(F.count(F.lit(1)).alias("count"))
    return counts.select("field", *_bin_edges(), "count")


def histogram(df: DataFrame, field: str, max_bins: int = 30) -> DataFrame:
    """(bin_start, bin_end, count) of one field, as in histograms."""
    return histograms(df, [field], max_bins).drop("field")


def box_stats(df: DataFrame, field: str) -> DataFrame:
    """One row: q1, median, q3, whiskers (extreme values within the fences) and points outside."""
    x = as_double(df, pick_fields(df, [field])[0])
    q1, median, q3 = exact_quantiles(df, {field: x}, [0.25, 0.5, 0.75])[field]
    values = [F.lit(v).cast("double").alias(n) for n, v in (("q1", q1), ("median", median), ("q3", q3))]
    if q1 is None:
        inside, outside = F.lit(None).cast("double"), F.lit(None)
    else:
        low, high = q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1)
        inside, outside = F.when(x.between(low, high), x), F.when((x < low) | (x > high), 1)
    return df.agg(F.min(inside).alias("lower_whisker"), F.max(inside).alias("upper_whisker"),
                  F.count(outside).alias("points_outside")).select(
        *values, "lower_whisker", "upper_whisker", "points_outside")


def outlier_histograms(df: DataFrame, fields: list[str] | None = None, max_bins: int = 50) -> DataFrame:
    """(field, bin_start, bin_end, count, zscore_outliers) of all numeric fields: each distribution with its
    z-score outliers per bin. The moments of all fields come from one pass, the bins from another."""
    fields = numeric_columns(df) if fields is None else pick_fields(df, fields)
    if not fields:
        return df.sparkSession.createDataFrame([], "field string, bin_start double, bin_end double, count long, zscore_outliers long")
    far = {s.name: s.is_zscore(_finite(df, s.name)) for s in column_stats(df, fields)}
    counts = _bins(df, fields, max_bins, far).groupBy("field", "step", "bin").agg(
        F.count(F.lit(1)).alias("count"), F.count(F.when(F.col("flag"), 1)).alias("zscore_outliers"))
    return counts.select("field", *_bin_edges(), "count", "zscore_outliers")


def outlier_histogram(df: DataFrame, field: str, max_bins: int = 50) -> DataFrame:
    """(bin_start, bin_end, count, zscore_outliers) of one field, as in outlier_histograms."""
    return outlier_histograms(df, [field], max_bins).drop("field")
