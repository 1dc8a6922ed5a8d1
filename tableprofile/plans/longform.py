"""Long form of a table: one row per (row, field), all values as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tableprofile.functions.columns import as_text, clean, pick_fields, quoted, type_labels

# Values longer than this are replaced by a SHA-256 digest where only equality matters,
# so that counting distinct documents does not shuffle the documents.
DIGEST_ABOVE = 64


def to_long(df: DataFrame, fields: list[str] | None = None, row_id: str | None = None,
            *more: Column) -> DataFrame:
    """(row_id, field, value): nulls kept, no shuffle.

    `inline` rather than `unpivot`: it puts the field name in as a literal, and the Expand
    behind unpivot breaks code generation when an expression above it is shared.
    """
    fields = pick_fields(df, fields)
    ids = [quoted(row_id).alias("row_id")] if row_id else []
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), as_text(df, f).alias("value")) for f in fields])
    return df.select(*ids, *more, F.inline(pairs))


def digest(value: Column) -> Column:
    """A short binary stand-in for a text, equal exactly when the texts are equal."""
    return F.when(F.length(value) > DIGEST_ABOVE, F.concat(F.lit(b"\x00"), F.unhex(F.sha2(value, 256)))) \
            .otherwise(value.cast("binary"))


def value_counts(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(field, value, n) over all rows; nulls form their own group.

    One hash aggregate with map-side combine: a value that fills a third of the
    table leaves each map task as a single row.
    """
    return to_long(df, fields).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def _typed_key(df: DataFrame, name: str) -> dict[str, Column]:
    """The value as a number where it is one, else as short text: cheaper to make, compare and
    shuffle than text. Exactly one of the three is set unless the value is null."""
    slots = {"number": F.lit(None).cast("long"), "decimal": F.lit(None).cast("double"), "text": F.lit(None).cast("binary")}
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        slots["number"] = quoted(name).cast("long")
    elif isinstance(dtype, T.BooleanType):
        slots["number"] = quoted(name).cast("int").cast("long")
    elif isinstance(dtype, T.DateType):
        slots["number"] = F.unix_date(quoted(name)).cast("long")
    elif isinstance(dtype, T.TimestampType):
        slots["number"] = F.unix_micros(quoted(name))
    elif isinstance(dtype, T.TimestampNTZType):     # by its parts: a cast would pass through the session's time zone
        at = quoted(name)
        slots["number"] = F.unix_date(at.cast("date")).cast("long") * 86_400_000_000 + (
            (F.hour(at) * 60 + F.minute(at)).cast("long") * 60_000_000 + (F.date_part(F.lit("SECOND"), at) * 1_000_000).cast("long"))
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        slots["decimal"] = clean(df, name).cast("double")
    else:
        slots["text"] = digest(as_text(df, name))
    return slots


def key_counts(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(pos, filled, n): one row per field and distinct value, without the value itself.

    For counting distinct values only. Map-side combine as in value_counts.
    """
    fields = pick_fields(df, fields)
    rows = []
    for i, f in enumerate(fields):
        rows.append(F.struct(F.lit(i).alias("pos"), *[c.alias(n) for n, c in _typed_key(df, f).items()]))
    keys = ["pos", "number", "decimal", "text"]
    counts = df.select(F.inline(F.array(*rows))).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("pos", F.coalesce(F.col("number").isNotNull() | F.col("decimal").isNotNull()
                                           | F.col("text").isNotNull(), F.lit(False)).alias("filled"), "n")


def filled_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, total, filled): all rows and non-null values per field, from one wide count."""
    wide = df.agg(F.count(F.lit(1)).alias("total"),
                  *[F.count(clean(df, f)).alias(f"__c{i}") for i, f in enumerate(fields)])
    return wide.select("total", F.inline(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"__c{i}").alias("filled")) for i, f in enumerate(fields)])))


def field_table(df: DataFrame, fields: list[str]) -> DataFrame:
    """(pos, field, type), one row per field: lets empty tables report every field."""
    labels = type_labels(df)
    rows = [(i, f, labels[f]) for i, f in enumerate(fields)]
    return df.sparkSession.createDataFrame(rows, "pos int, field string, type string")
