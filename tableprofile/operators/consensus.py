"""The four multi-column methods together, or any other methods that flag rows."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tableprofile.operators.dbscan import dbscan_noise
from tableprofile.operators.features import Features, features
from tableprofile.operators.isolation_forest import isolation_outliers
from tableprofile.operators.kmeans import kmeans_outliers
from tableprofile.operators.lof import lof_outliers
from tableprofile.plans.cuts import cut

METHODS = {
    "Isolation Forest": isolation_outliers,
    "Local Outlier Factor": lof_outliers,
    "DBSCAN": dbscan_noise,
    "k-Means": kmeans_outliers,
}


@dataclass
class Detection:
    """Features, the flagged rows as (row_id, method), and the names of all methods in order."""

    features: Features
    flagged: DataFrame
    methods: list[str] = field(default_factory=lambda: list(METHODS))


def detect(df: DataFrame, row_id: str, columns: list[str] | None = None) -> Detection:
    """Run all four methods on the same rows and keep who flagged what."""
    f = features(df, row_id, columns)
    return combine(f, {name: run(f) for name, run in METHODS.items()})


def combine(f: Features, found: dict[str, DataFrame]) -> Detection:
    """A Detection from the flagged rows (row_id) of each method."""
    tagged = [rows.select("row_id").withColumn("method", F.lit(name)) for name, rows in found.items()]
    return Detection(f, cut(reduce(DataFrame.unionByName, tagged)), list(found))


def _method_table(d: Detection) -> DataFrame:
    return d.flagged.sparkSession.createDataFrame([(m,) for m in d.methods], "method string")


def method_summary(d: Detection) -> DataFrame:
    """(method, outliers_found, outlier_pct) of the usable rows; methods without a hit show 0."""
    counts = d.flagged.groupBy("method").agg(F.count(F.lit(1)).alias("n"))
    found = F.coalesce("n", F.lit(0).cast("long"))
    return _method_table(d).join(F.broadcast(counts), "method", "left").select(
        "method", found.alias("outliers_found"), (found / F.lit(max(1, d.features.count)) * 100.0).alias("outlier_pct"))


def consensus(d: Detection) -> DataFrame:
    """(row_id): rows flagged by every method."""
    return d.flagged.groupBy("row_id").agg(F.count_distinct("method").alias("m")) \
            .where(F.col("m") == len(d.methods)).select("row_id")


def method_ranking(d: Detection) -> DataFrame:
    """One row: total flags, their share of the rows, the methods with most and fewest, high flag (> 10 %)."""
    s = method_summary(d)     # four rows
    order = {m: i for i, m in enumerate(d.methods)}
    pos = F.create_map(*[F.lit(v) for pair in order.items() for v in pair])[F.col("method")]
    share = F.sum("outliers_found") / F.lit(max(1, d.features.count))
    return s.agg(
        F.sum("outliers_found").alias("total_flags"), (share * 100.0).alias("total_pct"),
        F.max_by("method", F.struct("outliers_found", (-pos).alias("p"))).alias("most"),
        F.min_by("method", F.struct("outliers_found", pos.alias("p"))).alias("fewest"),
        (share > 0.1).alias("high"))


def labelled_points(d: Detection) -> DataFrame:
    """(row_id, method, is_outlier, one column per feature): scatter data for every method."""
    f = d.features
    flags = d.flagged.groupBy("row_id").agg(F.collect_set("method").alias("methods"))   # at most four entries
    points = f.rows.join(flags, "row_id", "left")
    each = points.select("row_id", *f.columns, "methods",
                         F.explode(F.array(*[F.lit(m) for m in d.methods])).alias("method"))
    return each.select("row_id", "method",
                       F.coalesce(F.array_contains("methods", F.col("method")), F.lit(False)).alias("is_outlier"),
                       *[F.col(c).alias(n) for c, n in zip(f.columns, f.names)])


def all_outliers(d: Detection) -> DataFrame:
    """(row_id, method, one column per feature): a row appears once per method that flags it."""
    f = d.features
    return d.flagged.join(f.rows, "row_id").select(
        "row_id", "method", *[F.col(c).alias(n) for c, n in zip(f.columns, f.names)])
