"""Which display a field calls for, and whether text holds dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tableprofile.functions.columns import pick_fields, type_labels
from tableprofile.functions.dates import has_date_hint, may_be_date, parse_date
from tableprofile.operators.values import NULL_TEXT
from tableprofile.plans.longform import digest, field_table, to_long

DATE_SHARE = 0.9
LONG_TEXT = 50
TOP_K = 10
DONUT_BELOW = 5
_HINT_ROWS = 10


def _date_hints(df: DataFrame, fields: list[str], row_id: str | None) -> DataFrame:
    """(field, hint): does one of the first ten non-null values look like a date?

    A limit after a sort keeps ten rows per task and sorts nothing else; each field reads
    only its own column and the row id.
    """
    firsts = []
    for f in fields:
        rows = to_long(df, [f], row_id).where(F.col("value").isNotNull())
        firsts.append(rows.orderBy("row_id" if row_id else "value").limit(_HINT_ROWS).select("field", "value"))
    return reduce(DataFrame.unionByName, firsts).groupBy("field").agg(
        F.bool_or(has_date_hint(F.col("value"))).alias("hint"))


def _measures(df: DataFrame, fields: list[str], row_id: str | None) -> DataFrame:
    """One row per field. Every measure is a function of the value, so it is taken where the
    row is read and travels as a number; long values travel as digests."""
    labels = type_labels(df)
    texts = [f for f in fields if labels[f] == "string"]
    v = F.col("value")
    # what may be a date travels as text and is parsed once per value
    dated = F.when(F.col("field").isin(texts) & may_be_date(v), v) if texts else F.lit(None).cast("string")
    long = to_long(df, fields).select(
        "field", digest(v).alias("value"), F.length(v).alias("size"), dated.alias("dated"),
        v.rlike(r"\p{L}").alias("letter"), (v == NULL_TEXT).alias("null_text"))
    per_value = long.groupBy("field", "value").agg(
        F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.max("dated").alias("dated"),
        F.max("letter").alias("letter"), F.max("null_text").alias("null_text"))
    per_value = per_value.withColumn("parses", F.coalesce(parse_date(F.col("dated")).isNotNull(), F.lit(False)))
    filled = F.col("value").isNotNull()
    out = per_value.groupBy("field").agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(filled, F.col("n"))), F.lit(0)).alias("filled"),
        F.count("value").alias("distinct_values"),
        F.sum(F.col("n") * F.col("size")).alias("chars"),
        F.coalesce(F.sum(F.when(F.col("parses"), F.col("n"))), F.lit(0)).alias("dates"),
        F.coalesce(F.bool_or("letter"), F.lit(False)).alias("letter"),
        F.coalesce(F.bool_or("null_text"), F.lit(False)).alias("null_text"))
    out = field_table(df, fields).join(F.broadcast(out), "field", "left")  # one row per field
    if texts:
        out = out.join(F.broadcast(_date_hints(df, texts, row_id)), "field", "left")
    else:
        out = out.withColumn("hint", F.lit(None).cast("boolean"))
    return out


def _is_date() -> Column:
    ratio = F.col("dates") / F.col("filled")
    return (F.col("type") == "datetime") | F.coalesce(
        (F.col("filled") > 0) & (ratio >= DATE_SHARE) & F.col("hint"), F.lit(False))


def detect_dates(df: DataFrame, fields: list[str] | None = None, row_id: str | None = None) -> DataFrame:
    """(field, date_share, is_date) for text and date columns."""
    labels = type_labels(df)
    fields = [f for f in pick_fields(df, fields) if labels[f] in ("string", "datetime")]
    if not fields:
        return df.sparkSession.createDataFrame([], "field string, date_share double, is_date boolean")
    share = F.when(F.col("type") == "datetime", 1.0).otherwise(
        F.coalesce(F.when(F.col("filled") > 0, F.col("dates") / F.col("filled")), F.lit(0.0)))
    return _measures(df, fields, row_id).select("field", share.alias("date_share"), _is_date().alias("is_date"))


def field_kinds(df: DataFrame, fields: list[str] | None = None, row_id: str | None = None) -> DataFrame:
    """(field, kind): unique, numeric, datetime, long_text, donut or bar."""
    fields = pick_fields(df, fields)
    nulls = F.col("total") > F.col("filled")
    shown = F.least(F.lit(TOP_K), F.col("distinct_values") + (nulls & ~F.col("null_text")).cast("int"))
    kind = (
        F.when(F.col("total").isNull(), "empty")
        .when(F.col("distinct_values") == F.col("total"), "unique")
        .when(F.col("type").isin("int", "float"), "numeric")
        .when(_is_date(), "datetime")
        .when((F.col("chars") / F.col("filled") > LONG_TEXT) & F.col("letter"), "long_text")
        .when(shown < DONUT_BELOW, "donut").otherwise("bar"))
    return _measures(df, fields, row_id).orderBy("pos").select("field", kind.alias("kind"))
