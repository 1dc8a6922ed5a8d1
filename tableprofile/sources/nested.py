"""Nested columns to flat ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tableprofile.functions.columns import quoted


def _item_text(item: Column, dtype: T.DataType) -> Column:
    """Text of a list item, spelled as Python spells it."""
    if isinstance(dtype, T.BooleanType):
        text = F.when(item, "True").when(~item, "False")
    elif isinstance(dtype, (T.StructType, T.MapType, T.ArrayType)):
        text = F.to_json(item)
    else:
        text = item.cast("string")
    return F.coalesce(text, F.lit("None"))


def _leaves(column: Column, name: str, dtype: T.DataType) -> list[Column]:
    if isinstance(dtype, T.StructType):
        return [leaf for f in dtype.fields for leaf in _leaves(column.getField(f.name), f"{name}.{f.name}", f.dataType)]
    if isinstance(dtype, T.ArrayType):
        joined = F.array_join(F.transform(column, lambda x: _item_text(x, dtype.elementType)), "|")
        return [joined.alias(name)]
    return [column.alias(name)]


def flatten(df: DataFrame) -> DataFrame:
    """Struct fields become columns named a.b.c; lists become text joined with |."""
    return df.select(*[leaf for f in df.schema.fields for leaf in _leaves(quoted(f.name), f.name, f.dataType)])
