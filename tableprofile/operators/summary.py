"""Field summary, coverage and key detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tableprofile.functions.columns import as_text, clean, pick_fields, quoted, type_labels
from tableprofile.plans.longform import field_table, filled_counts, key_counts


def _share(part: Column, whole: Column) -> Column:
    """Percentage clamped to 0..100; 0 when undefined."""
    pct = F.when(whole > 0, part / whole * 100.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(pct, F.lit(0.0))))


def field_profile(df: DataFrame, fields: list[str] | None = None, approx: bool = False) -> DataFrame:
    """(field, total, nulls, distinct_values): the counts behind summary and key detection.

    Exact: one pass, one shuffle of typed values or digests after map-side combine.
    approx=True: one wide aggregate with a sketch per column, and no data-sized shuffle at all.
    """
    fields = pick_fields(df, fields)
    if approx:
        sketches = []
        for i, f in enumerate(fields):
            c = as_text(df, f) if type_labels(df)[f] == "other" else clean(df, f)
            sketches += [F.count(c).alias(f"__n{i}"),
                         F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(c)), 12).alias(f"__d{i}")]
        wide = df.agg(F.count(F.lit(1)).alias("total"), *sketches)
        counts = wide.select(F.inline(F.array(*[F.struct(
            F.lit(i).alias("pos"), F.col("total").alias("total"), (F.col("total") - F.col(f"__n{i}")).alias("nulls"),
            F.coalesce(F.hll_sketch_estimate(f"__d{i}"), F.lit(0)).alias("distinct_values"))
            for i in range(len(fields))])))
    else:
        counts = key_counts(df, fields).groupBy("pos").agg(
            F.sum("n").alias("total"),
            F.sum(F.when(~F.col("filled"), F.col("n")).otherwise(0)).alias("nulls"),
            F.count(F.when(F.col("filled"), 1)).alias("distinct_values"),
        )
    zero = F.lit(0).cast("long")
    # at most one row per field on either side
    return field_table(df, fields).join(F.broadcast(counts), "pos", "left").select(
        "pos", "field", "type",
        F.coalesce("total", zero).alias("total"),
        F.coalesce("nulls", zero).alias("nulls"),
        F.coalesce("distinct_values", zero).alias("distinct_values"),
    )


def field_summary(df: DataFrame, fields: list[str] | None = None, approx: bool = False) -> DataFrame:
    """(field, type, coverage_pct, nulls, distinct_values), nulls not counted as a value."""
    p = field_profile(df, fields, approx)
    return p.select(
        "field", "type",
        _share(F.col("total") - F.col("nulls"), F.col("total")).alias("coverage_pct"),
        "nulls", "distinct_values",
    )


def coverage(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(field, coverage_pct): a single wide aggregate, no distinct count."""
    return filled_counts(df, pick_fields(df, fields)).select(
        "field", _share(F.col("filled"), F.col("total")).alias("coverage_pct"))


def dataset_stats(df: DataFrame) -> DataFrame:
    """(total_rows, total_columns)."""
    return df.agg(F.count(F.lit(1)).alias("total_rows")).withColumn("total_columns", F.lit(len(df.columns)))


def detect_keys(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(field): columns without nulls whose values are all different."""
    p = field_profile(df, fields)
    return p.where((F.col("total") > 0) & (F.col("nulls") == 0)
                   & (F.col("distinct_values") == F.col("total"))).orderBy("pos").select("field")


def _key_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: all rows, and distinct key tuples without a null part.

    Group first, count second: the second step sees one row per tuple already spread over
    the cluster. Rows with a null part share one group and are combined map-side.
    """
    labels = type_labels(df)
    parts = [as_text(df, k) if labels[k] == "other" else clean(df, k) for k in pick_fields(df, keys)]
    whole = F.lit(True)
    for p in parts:
        whole = whole & p.isNotNull()
    named = [F.when(whole, p).alias(f"__k{i}") for i, p in enumerate(parts)]
    tuples = df.select(*named).groupBy(*[f"__k{i}" for i in range(len(parts))]).agg(F.count(F.lit(1)).alias("n"))
    return tuples.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
                      F.count("__k0").alias("unique_keys"))


def check_composite_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total_rows, unique_keys, is_key)."""
    return _key_counts(df, keys).select(
        F.lit(", ".join(keys)).alias("keys"), "total_rows", "unique_keys",
        (F.col("unique_keys") == F.col("total_rows")).alias("is_key"))


def key_in_force(df: DataFrame, manual: list[str] | None = None) -> list[str]:
    """The caller's key, else the first detected single-column key, else nothing."""
    if manual:
        return pick_fields(df, manual)
    # at most one row per column reaches the driver
    return [r.field for r in detect_keys(df).collect()][:1]


def unique_key_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total_rows, unique_keys)."""
    return _key_counts(df, keys).select(F.lit(", ".join(keys)).alias("keys"), "total_rows", "unique_keys")


def drop_nulls(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Rows in which none of the fields is null or NaN."""
    keep = F.lit(True)
    for f in pick_fields(df, fields):
        c = quoted(f)
        keep = keep & c.isNotNull()
        if dict(df.dtypes)[f] in ("float", "double"):
            keep = keep & ~F.isnan(c)
    return df.where(keep)
