"""Single-column outliers: z-score and inter-quartile range."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tableprofile.functions.columns import as_double, numeric_columns, pick_fields, quoted
from tableprofile.plans.quantiles import exact_quantiles

Z_LIMIT = 3.0
FENCE = 1.5

SUMMARY_SCHEMA = ("column string, total_values long, zscore_outliers long, iqr_outliers long, "
                  "zscore_outlier_pct double, iqr_outlier_pct double, min_value double, max_value double, "
                  "mean double, std_dev double, q1 double, q3 double, iqr double")


@dataclass
class ColumnStats:
    """Statistics of one numeric column; None where undefined."""

    name: str
    total: int
    filled: int
    low: float | None
    high: float | None
    mean: float | None
    std: float | None
    q1: float | None = None
    q3: float | None = None

    @property
    def iqr(self) -> float:
        return self.q3 - self.q1

    @property
    def fences(self) -> tuple[float, float]:
        return self.q1 - FENCE * self.iqr, self.q3 + FENCE * self.iqr

    @property
    def eligible(self) -> bool:
        """More than one distinct value and at most half nulls."""
        return self.filled > 0 and self.low != self.high and (self.total - self.filled) / self.total <= 0.5

    def is_zscore(self, x: Column) -> Column:
        if not self.std:
            return F.lit(False)
        return F.coalesce(F.abs((x - self.mean) / self.std) > Z_LIMIT, F.lit(False))

    def is_iqr(self, x: Column) -> Column:
        if self.q1 is None:
            return F.lit(False)
        low, high = self.fences
        return F.coalesce((x < low) | (x > high), F.lit(False))


def column_stats(df: DataFrame, fields: list[str], only_eligible: bool = False) -> list[ColumnStats]:
    """Moments in one wide aggregate, then exact quartiles. A few numbers per column are fetched."""
    if not fields:
        return []
    aggs = [F.count(F.lit(1)).alias("total")]
    for i, f in enumerate(fields):
        x = as_double(df, f)
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"),
                 F.avg(x).alias(f"avg{i}"), F.stddev_samp(x).alias(f"std{i}")]
    r = df.agg(*aggs).first()
    stats = [ColumnStats(f, r["total"], r[f"n{i}"], r[f"lo{i}"], r[f"hi{i}"], r[f"avg{i}"], r[f"std{i}"])
             for i, f in enumerate(fields)]
    if only_eligible:
        stats = [s for s in stats if s.eligible]
    if stats:
        quartiles = exact_quantiles(df, {s.name: as_double(df, s.name) for s in stats}, [0.25, 0.75])
        for s in stats:
            s.q1, s.q3 = quartiles[s.name]
    return stats


def outlier_summary(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One row per eligible numeric column; percentages are over all rows, nulls included."""
    fields = numeric_columns(df) if fields is None else pick_fields(df, fields)
    stats = column_stats(df, fields, only_eligible=True)
    if not stats:
        return df.sparkSession.createDataFrame([], SUMMARY_SCHEMA)
    aggs, rows = [], []
    for i, s in enumerate(stats):
        x = as_double(df, s.name)
        aggs += [F.count(F.when(s.is_zscore(x), 1)).alias(f"z{i}"), F.count(F.when(s.is_iqr(x), 1)).alias(f"q{i}")]
        rows.append(F.struct(
            F.lit(s.name).alias("column"), F.lit(s.total).cast("long").alias("total_values"),
            F.col(f"z{i}").alias("zscore_outliers"), F.col(f"q{i}").alias("iqr_outliers"),
            (F.col(f"z{i}") / s.total * 100.0).alias("zscore_outlier_pct"),
            (F.col(f"q{i}") / s.total * 100.0).alias("iqr_outlier_pct"),
            *[F.lit(v).cast("double").alias(n) for n, v in (
                ("min_value", s.low), ("max_value", s.high), ("mean", s.mean), ("std_dev", s.std),
                ("q1", s.q1), ("q3", s.q3), ("iqr", s.iqr))]))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def outlier_rows(df: DataFrame, field: str, method: str, row_id: str | None = None) -> DataFrame:
    """([row_id,] value) of the rows a method ("zscore" or "iqr") flags."""
    s = column_stats(df, pick_fields(df, [field]))[0]
    x = as_double(df, field)
    flag = {"zscore": s.is_zscore, "iqr": s.is_iqr}[method](x)
    ids = [quoted(row_id)] if row_id else []
    return df.where(flag).select(*ids, x.alias("value"))


def outlier_export(df: DataFrame, field: str, row_id: str | None = None) -> DataFrame:
    """Both outlier sets with a method tag; a row flagged twice appears twice. One scan."""
    s = column_stats(df, pick_fields(df, [field]))[0]
    x = as_double(df, field)
    ids = [quoted(row_id)] if row_id else []
    tags = F.array_compact(F.array(F.when(s.is_zscore(x), "Z-score"), F.when(s.is_iqr(x), "IQR")))
    return df.select(*ids, x.alias("value"), F.explode(tags).alias("method"))


def outlier_overview(summary: DataFrame) -> DataFrame:
    """Totals per method over an outlier summary; flags rates more than 5 points apart."""
    sums = summary.agg(F.sum("zscore_outliers").alias("zscore_outliers"), F.sum("iqr_outliers").alias("iqr_outliers"),
                       F.sum("total_values").alias("total_values"))
    z = F.col("zscore_outliers") / F.col("total_values") * 100.0
    q = F.col("iqr_outliers") / F.col("total_values") * 100.0
    return sums.select("zscore_outliers", "iqr_outliers", "total_values", z.alias("zscore_pct"), q.alias("iqr_pct"),
                       (F.abs(z - q) > 5).alias("methods_differ"))


def outlier_flags(summary: DataFrame) -> DataFrame:
    """(column, high_variability, wide_spread) for the columns that have outliers."""
    return summary.where((F.col("zscore_outliers") > 0) | (F.col("iqr_outliers") > 0)).select(
        "column", (F.col("std_dev") > F.col("mean")).alias("high_variability"),
        (F.col("iqr") > F.col("mean")).alias("wide_spread"))
