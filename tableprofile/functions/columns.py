"""Column typing and text rendering shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType, T.DecimalType)
_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def quoted(name: str) -> Column:
    """Reference a top-level column whose name may contain dots or back-quotes."""
    return F.col("`" + name.replace("`", "``") + "`")


def type_label(dtype: T.DataType) -> str:
    """One of int, float, string, bool, datetime, other."""
    if isinstance(dtype, _INTS):
        return "int"
    if isinstance(dtype, _FLOATS):
        return "float"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, _DATES):
        return "datetime"
    return "other"


def type_labels(df: DataFrame) -> dict[str, str]:
    return {f.name: type_label(f.dataType) for f in df.schema.fields}


def columns_of(df: DataFrame, *labels: str) -> list[str]:
    return [name for name, label in type_labels(df).items() if label in labels]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, "int", "float")


def text_columns(df: DataFrame) -> list[str]:
    return columns_of(df, "string")


def pick_fields(df: DataFrame, fields: list[str] | None) -> list[str]:
    if fields is None:
        return list(df.columns)
    unknown = [f for f in fields if f not in df.columns]
    if unknown:
        raise ValueError(f"unknown fields: {unknown}")
    return list(fields)


def clean(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into null and -0.0 into 0.0."""
    dtype = df.schema[name].dataType
    c = quoted(name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c + F.lit(0.0).cast(dtype))
    return c


def as_double(df: DataFrame, name: str) -> Column:
    return clean(df, name).cast("double")


def as_text(df: DataFrame, name: str) -> Column:
    """Text form of a column; null stays null.

    Floats are printed without an exponent between 1e-4 and 1e16, as most
    tools print them; Spark's own cast switches at 1e7 and 1e-3.
    """
    dtype = df.schema[name].dataType
    c = clean(df, name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        short = c.cast("string")
        size = F.abs(c)
        digits = F.regexp_replace(short.try_cast("decimal(38,20)").cast("string"), r"0+$", "")
        plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
        rewrite = ((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3))
        return F.when(rewrite, plain).otherwise(short)
    if isinstance(dtype, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(dtype, T.BinaryType):
        return F.base64(c)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(c)
    return c.cast("string")
