"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tableprofile.functions.columns import quoted
from tableprofile.plans.cuts import free_shuffles, passing, written

# A side is broadcast only below this many bytes of data, estimated from all its rows.
BROADCAST_BYTES = 32 << 20
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, row_bytes: Column) -> DataFrame:
    """Mark df for broadcast if its bytes, summed over all rows, are below the bound; beyond it the
    join is left to a shuffle. df should be cheap to read twice (written, or small input)."""
    size = df.agg(F.sum(row_bytes.cast("long") + 32)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed names, so that other columns can't clash."""
    return df.select(*(quoted(c).alias(name) for name, c in columns.items()))
