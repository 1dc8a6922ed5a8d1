"""Country names to coordinates, and the map layers built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tableprofile.operators.similar_names import similar_names
from tableprofile.plans.cuts import cut

ACCEPT = 80
RADIUS = (100_000.0, 400_000.0)
DEFAULT_RADIUS = 200_000.0


def _exact(names: DataFrame, dim: DataFrame) -> DataFrame:
    """names plus the dimension row with the same name ignoring case; nulls when there is none."""
    first = dim.groupBy(F.lower("country").alias("key")).agg(
        F.min(F.struct("country", "lat", "lon")).alias("place"))
    return names.join(first, F.lower(F.col("name")) == F.col("key"), "left").drop("key")


def match_countries(df: DataFrame, column: str, dim: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(name, country, lat, lon, score) per distinct matched name; dim has country, lat, lon.

    Names are made distinct first. Those without an exact match meet the places whose names may be
    similar enough, by shared pieces; the place of the highest score counts, of equals the smaller name.
    The dimension may have any size.
    """
    names = df.select(F.col(column).alias("name")).where(F.col("name").isNotNull()).distinct()
    exact = _exact(names, dim)
    hits = exact.where(F.col("place").isNotNull()).select(
        "name", "place.country", "place.lat", "place.lon", F.lit(100).alias("score"))
    if not fuzzy:
        return hits
    places = dim.groupBy("country").agg(F.min(F.struct(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))).alias("at"))
    like = similar_names(exact.where(F.col("place").isNull()), places.select(F.col("country").alias("name")), ACCEPT)
    rest = like.join(places, F.col("known") == F.col("country")).select("name", "country", "at.lat", "at.lon", "score")
    return hits.unionByName(rest)


def map_layer(df: DataFrame, column: str, dim: DataFrame, value: str | None = None, fuzzy: bool = True) -> DataFrame:
    """(country, lat, lon, value, radius) of the matched names.

    With several rows per name the largest value counts. The smallest and largest value of all come from an
    aggregate.
    """
    places = match_countries(df, column, dim, fuzzy).select("name", "lat", "lon")
    if value is None:
        return places.select(F.col("name").alias("country"), "lat", "lon", F.lit(None).cast("double").alias("value"),
                             F.lit(DEFAULT_RADIUS).alias("radius"))
    values = df.groupBy(F.col(column).alias("name")).agg(F.round(F.max(F.col(value).cast("double")), 2).alias("value"))
    rows = cut(places.join(values, "name"))
    bounds = F.broadcast(rows.agg(F.min("value").alias("low"), F.max("value").alias("high")))      # one row
    small, large = RADIUS
    radius = F.when(F.col("high") > F.col("low"), small + (large - small) * (F.col("value") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(DEFAULT_RADIUS)
    return rows.join(bounds, F.lit(True)).select(F.col("name").alias("country"), "lat", "lon", "value", radius.alias("radius"))


def map_lines(layer: DataFrame) -> DataFrame:
    """Each country joined to the next one by falling value.

    The layer is sorted over many tasks; inside each the next row is at hand, and the last row of one
    is followed by the first of the next, of which there is one a task.
    """
    order = [F.desc("value"), F.col("country")]
    place = F.struct("country", "lat", "lon", "value")
    sorted_rows = cut(layer.select("country", "lat", "lon", "value").orderBy(*order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(*order)
    rows = sorted_rows.withColumn("end", F.lead(place).over(inside))
    firsts = sorted_rows.withColumn("rank", F.row_number().over(inside)).where("rank = 1").select("part", place.alias("first"))
    behind = firsts.select("part", F.lead("first").over(Window.orderBy("part")).alias("behind"))       # a row a task
    pairs = rows.join(F.broadcast(behind), "part").withColumn("end", F.coalesce("end", "behind")).where(F.col("end").isNotNull())
    return pairs.select(
        F.col("country").alias("start_country"), F.col("lat").alias("start_lat"), F.col("lon").alias("start_lon"),
        F.col("value").alias("start_value"), *[F.col("end")[c].alias(f"end_{c}") for c in ("country", "lat", "lon", "value")])


def heat_weights(layer: DataFrame) -> DataFrame:
    """(lat, lon, weight): summed value per place; each row weighs 1 without values."""
    return layer.groupBy("lat", "lon").agg(F.sum(F.coalesce("value", F.lit(1.0))).alias("weight"))
