"""Feature matrix of the multi-column methods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tableprofile.functions.columns import as_double, numeric_columns, pick_fields
from tableprofile.plans.cuts import id_column, packed

DEFAULT_COLUMNS = 5


@dataclass
class Features:
    """Rows (row_id, x0, x1, ...) without nulls, written once, with the moments per column."""

    rows: DataFrame
    names: list[str]
    count: int
    means: list[float]
    stds: list[float]

    @property
    def columns(self) -> list[str]:
        return [f"x{i}" for i in range(len(self.names))]

    @property
    def scaled(self) -> list[Column]:
        """Columns with mean 0 and population standard deviation 1; constants become 0."""
        return [((F.col(c) - m) / (s if s > 0 else 1.0)).alias(c)
                for c, m, s in zip(self.columns, self.means, self.stds)]

    def scaled_rows(self) -> DataFrame:
        return self.rows.select("row_id", *self.scaled)


def features(df: DataFrame, row_id: str, columns: list[str] | None = None) -> Features:
    """At least two numeric columns (the first five by default); rows with a null are dropped."""
    columns = [c for c in numeric_columns(df) if c != row_id][:DEFAULT_COLUMNS] if columns is None \
        else pick_fields(df, columns)
    if len(columns) < 2:
        raise ValueError("at least two numeric columns are needed")
    slots = [f"x{i}" for i in range(len(columns))]
    rows = df.select(id_column(df, row_id), *[as_double(df, c).alias(s) for c, s in zip(columns, slots)]).dropna(subset=slots)
    rows = packed(rows)
    r = rows.agg(F.count(F.lit(1)).alias("n"), *[f(s).alias(f"{k}{s}") for s in slots
                                                 for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return Features(rows, columns, r["n"], [r[f"m{s}"] for s in slots], [r[f"s{s}"] or 0.0 for s in slots])


def standardise(df: DataFrame, row_id: str, columns: list[str] | None = None) -> DataFrame:
    """(row_id, one standardised column per input column)."""
    f = features(df, row_id, columns)
    return f.scaled_rows().toDF("row_id", *f.names)
