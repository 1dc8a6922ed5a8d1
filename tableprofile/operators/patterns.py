"""Value patterns per field."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tableprofile.functions.columns import as_text, pick_fields
from tableprofile.functions.shapes import known_format, trimmed, value_pattern
from tableprofile.plans.longform import filled_counts, to_long


def pattern_report(df: DataFrame, fields: list[str] | None = None, row_id: str | None = None) -> DataFrame:
    """(field, pattern, example, count, confidence_pct) over the non-null values.

    The pattern is computed where the row is read and combined map-side, so what is shuffled
    grows with the number of patterns, not of values. The example is the value with the
    smallest row_id (of rows that share it, the smallest value), or the smallest value when no row_id is given.
    """
    long = to_long(df, fields, row_id).where(F.col("value").isNotNull())
    # rows that share an id would otherwise make the example depend on the partitions
    order = F.when(F.col("row_id").isNotNull(), F.struct("row_id", "value")) if row_id else None
    example = F.min_by("value", order) if row_id else F.min("value")
    counts = long.withColumn("pattern", value_pattern(F.col("value"))).groupBy("field", "pattern").agg(
        F.count(F.lit(1)).alias("count"), example.alias("example"))
    # counted apart: summing the counts would compute every pattern a second time
    totals = filled_counts(df, pick_fields(df, fields))
    return counts.join(F.broadcast(totals), "field").select(  # one row per field
        "field", "pattern", "example", "count",
        (F.col("count") / F.col("filled") * 100.0).alias("confidence_pct"))


def top_pattern(df: DataFrame, fields: list[str] | None = None, row_id: str | None = None) -> DataFrame:
    """The most common pattern per field; ties by pattern."""
    w = Window.partitionBy("field").orderBy(F.desc("count"), "pattern")
    return pattern_report(df, fields, row_id).withColumn("rank", F.row_number().over(w)) \
        .where(F.col("rank") == 1).drop("rank")


def known_formats(df: DataFrame, field: str) -> DataFrame:
    """(pattern, count) of one field, restricted to the named formats; no shape is computed.

    Only values that hold a dot, or colons or hyphens of a MAC address, go further; equal ones are counted
    first, map-side, and labelled once.
    """
    v = F.col("value")
    usable = v.contains(".") | (((F.length(v) >= 17) & (v.contains(":") | v.contains("-"))))
    values = df.select(as_text(df, field).alias("value")).where(usable).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return values.select(known_format(trimmed(v)).alias("pattern"), "n").where(F.col("pattern").isNotNull()) \
                 .groupBy("pattern").agg(F.sum("n").alias("count"))
