"""Date trends and date listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tableprofile.functions.columns import pick_fields, quoted, type_labels
from tableprofile.functions.dates import PERIODS, parse_date, period_label, period_start, period_step, shift_period


def as_timestamp(df: DataFrame, field: str) -> Column:
    """A date or timestamp column as it is; text parsed."""
    label = type_labels(df)[pick_fields(df, [field])[0]]
    if label == "datetime":
        return quoted(field)
    if label == "string":
        return parse_date(quoted(field))
    raise ValueError(f"{field} is neither a date nor text")


def trend(df: DataFrame, field: str, period: str = "day") -> DataFrame:
    """(period, count) with a zero row for every empty period between first and last.

    The rows are counted map-side per period. The gaps are then filled from the counts alone:
    each period carries the empty ones up to its successor, so there is neither a second scan
    nor a join. The single-task window sees one row per occupied period.
    """
    if period not in PERIODS:
        raise ValueError(f"period must be one of {PERIODS}")
    start = period_start(as_timestamp(df, field).cast("date"), period)
    counts = df.select(start.alias("start")).where(F.col("start").isNotNull()) \
               .groupBy("start").agg(F.count(F.lit(1)).alias("n"))
    upto = F.coalesce(shift_period(F.lead("start").over(Window.orderBy("start")), period, -1), F.col("start"))
    filled = counts.withColumn("upto", upto).select(
        "start", "n", F.explode(F.sequence("start", "upto", period_step(period))).alias("p"))
    return filled.select(period_label(F.col("p"), period).alias("period"),
                         F.when(F.col("p") == F.col("start"), F.col("n")).otherwise(0).alias("count"))


def date_listing(df: DataFrame, field: str) -> DataFrame:
    """(date): every parsed date as yyyy-MM-dd HH:mm:ss."""
    ts = as_timestamp(df, field)
    return df.select(F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("date")).where(F.col("date").isNotNull())
