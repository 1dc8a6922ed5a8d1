"""Value counts: top values, unique values, per-key counts, chart rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tableprofile.functions.columns import as_text, clean, pick_fields, quoted
from tableprofile.plans.longform import DIGEST_ABOVE, digest, to_long, value_counts

NULL_TEXT = "NULL"
TOTAL_TEXT = "Total"


def _ranked(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent values per field; ties by value.

    The `rank <= k` filter sits right on the window, so Spark puts a group limit below the
    shuffle and each task forwards at most k rows per field.
    """
    w = Window.partitionBy("field").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _top_counts(df: DataFrame, fields: list[str] | None, k: int) -> tuple[DataFrame, DataFrame]:
    """The k most frequent values per field, nulls as NULL, and the counts they are among.

    Long texts are grouped by digest and first characters, so that whole texts are not shuffled;
    those of the winners, and of what ties with them in both, are fetched by a second scan.
    """
    long = to_long(df, fields).select("field", F.coalesce("value", F.lit(NULL_TEXT)).alias("value")).select(
        "field", "value", digest(F.col("value")).alias("key"), F.substring("value", 1, DIGEST_ABOVE).alias("head"),
        (F.length("value") > DIGEST_ABOVE).alias("cut"))
    counts = long.groupBy("field", "key", "head", "cut").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("field").orderBy(F.desc("n"), F.asc("head"))
    best = counts.withColumn("place", F.rank().over(w)).where(F.col("place") <= k)
    short = best.where("NOT cut").select("field", F.col("head").alias("value"), "n")
    wanted = best.where("cut").select("field", "key", "n")
    texts = long.where("cut").join(wanted, ["field", "key"]).groupBy("field", "key").agg(
        F.first("value").alias("value"), F.first("n").alias("n"))
    return _ranked(short.unionByName(texts.select("field", "value", "n")), k), counts


def _with_total(top: DataFrame, counts: DataFrame) -> DataFrame:
    totals = counts.groupBy("field").agg(F.sum("n").alias("total"))
    top = top.join(F.broadcast(totals), "field")  # one row per field
    rows = top.select("field", "value", F.col("n").alias("count"),
                      (F.col("n") / F.col("total") * 100.0).alias("percentage"))
    total_rows = totals.select("field", F.lit(TOTAL_TEXT).alias("value"), F.col("total").alias("count"),
                               F.lit(100.0).alias("percentage"))
    return rows.unionByName(total_rows)


def top_values(df: DataFrame, fields: list[str] | None = None, k: int = 10) -> DataFrame:
    """(field, value, count, percentage) plus a Total row per field; nulls count as NULL."""
    return _with_total(*_top_counts(df, fields, k))


def unique_values(df: DataFrame, field: str) -> DataFrame:
    """(value, count) of the non-null values, most frequent first; distributed sort."""
    counts = value_counts(df, [field]).where(F.col("value").isNotNull())
    return counts.select("value", F.col("n").alias("count")).orderBy(F.desc("count"), "value")


def top_values_per_key(df: DataFrame, keys: list[str], fields: list[str], row_id: str,
                       k: int = 10) -> DataFrame:
    """Top values after keeping one row per key: the one with the smallest row_id.

    Rows with null key parts stay and null parts are equal to each other. The first row is
    found with an aggregate, not a window, so a key holding a third of the table leaves each
    map task as one row.
    """
    keys, fields = pick_fields(df, keys), [f for f in pick_fields(df, fields) if f not in keys]
    kept = [F.coalesce(as_text(df, f), F.lit(NULL_TEXT)).alias(f"__f{i}") for i, f in enumerate(fields)]
    first = df.groupBy(*[clean(df, c).alias(f"__k{i}") for i, c in enumerate(keys)]).agg(F.min_by(F.struct(*kept), quoted(row_id)).alias("row"))
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"row.__f{i}").alias("value"))
                      for i, f in enumerate(fields)])
    counts = first.select(F.inline(pairs)).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    return _with_total(_ranked(counts, k), counts)


def chart_rows(df: DataFrame, fields: list[str] | None = None, k: int = 10, max_len: int = 50) -> DataFrame:
    """(field, value, count, percentage, label): top values with shortened labels.

    The percentage is the share of the values shown, to one decimal.
    """
    top, _ = _top_counts(df, fields, k)
    return label_rows(top.select("field", "value", F.col("n").alias("count")), max_len)


def label_rows(top: DataFrame, max_len: int = 50) -> DataFrame:
    """Chart labels for a result table (field, value, count)."""
    short = F.when(F.length("value") <= max_len, F.col("value")).otherwise(
        F.concat(F.substring("value", 1, max_len - 3), F.lit("...")))
    shown = F.sum("count").over(Window.partitionBy("field"))
    return top.select("field", short.alias("value"), "count",
                      F.round(F.col("count") / shown * 100.0, 1).alias("percentage")).select(
        "field", "value", "count", "percentage",
        F.concat(F.col("value"), F.lit(" ("), F.col("count").cast("string"), F.lit(", "),
                 F.col("percentage").cast("string"), F.lit("%)")).alias("label"))
