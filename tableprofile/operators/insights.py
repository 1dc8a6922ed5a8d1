"""Everything there is to show about each field, by kind."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from tableprofile.functions.columns import pick_fields
from tableprofile.functions.dates import PERIODS
from tableprofile.operators.histograms import histograms
from tableprofile.operators.kinds import field_kinds
from tableprofile.operators.trends import date_listing, trend
from tableprofile.operators.values import chart_rows, top_values, top_values_per_key, unique_values
from tableprofile.operators.words import word_counts


@dataclass
class FieldInsight:
    """Kind of a field and the result tables that belong to it; the tables are lazy."""

    kind: str
    tables: dict[str, DataFrame] = field(default_factory=dict)


def insights(df: DataFrame, fields: list[str] | None = None, row_id: str | None = None,
             keys: list[str] | None = None) -> dict[str, FieldInsight]:
    """{field: insight}. One job finds the kinds (a row per field) and one the bounds of the numeric
    fields, however many there are; the tables run when asked for.

    unique: the values; datetime: a trend per period and the dates; numeric: histogram and top
    values; other fields: top values, overall and (with keys and row_id) once per key. What all fields
    share is one plan, of which each table is a part.
    """
    fields = pick_fields(df, fields)
    kind_of = {r.field: r.kind for r in field_kinds(df, fields, row_id).collect()}      # a row a field
    counted = [f for f, kind in kind_of.items() if kind not in ("unique", "datetime", "empty")]
    numeric = [f for f in counted if kind_of[f] == "numeric"]
    tops = top_values(df, counted) if counted else None
    bins = histograms(df, numeric) if numeric else None

    def own(table: DataFrame, name: str) -> DataFrame:
        return table.where(F.col("field") == name)

    out = {}
    for name, kind in kind_of.items():
        one = FieldInsight(kind)
        if kind == "unique":
            one.tables["unique_values"] = unique_values(df, name)
        elif kind == "datetime":
            one.tables.update({f"trend_{p}": trend(df, name, p) for p in PERIODS})
            one.tables["dates"] = date_listing(df, name)
        elif kind != "empty":
            one.tables["top_values"] = own(tops, name)
            if kind == "numeric":
                one.tables["histogram"] = own(bins, name).drop("field")
            else:
                one.tables["words" if kind == "long_text" else "chart"] = (
                    word_counts(df, name) if kind == "long_text" else chart_rows(df, [name]))
                if keys and row_id and name not in keys:
                    one.tables["top_values_per_key"] = top_values_per_key(df, keys, [name], row_id)
        out[name] = one
    return out
