"""Mixing sources to target weights along a curriculum, in DataFrame functions only.

A source's documents, in the order of a hash, repeated without end, are its stream of words; the mix
takes the stream up to the source's target. A schedule gives each source a rate over training time
0..1, linear from `start` to `end` with mean 1. The integral of the rate is the share of the target
demanded by a time; inverting it at the middle of each copy gives the copy's training position.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tableprofile.llm.common import WORD, pick, small, written

WEIGHTS = (5.0, 2.0, 1.0)
#: Rate of each source at the start and at the end of training, repeating like the weights.
SCHEDULE = ((1.2, 0.8), (1.0, 1.0), (0.6, 1.4))
MAX_EPOCHS = 3
SHARE = 1.0
BUCKET_ROWS = 50_000


def _cycle(values: tuple, place: Column) -> Column:
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)), (F.pmod(place - 1, F.lit(len(values))) + 1).cast("int"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS,
            schedule: tuple = SCHEDULE) -> DataFrame:
    """Per source: source_size, target, rate at start and end. One row per source.

    With sources ordered by what they can give per weight, those before some place are capped at
    max_epochs times their size and share what is left by weight: target = min(cap, level * weight).
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everyone = Window.partitionBy(F.lit(0))
    ranked = by_source.withColumn("place", F.row_number().over(everyone.orderBy(F.col("source").asc_nulls_last()))).withColumn(
        "weight", _cycle(weights, F.col("place"))).withColumn("cap", max_epochs * F.col("source_size"))
    filled = everyone.orderBy(F.col("cap") / F.col("weight"), "place")
    level = (share * F.sum("source_size").over(everyone) - (F.sum("cap").over(filled) - F.col("cap"))) / (
        F.sum("weight").over(everyone) - (F.sum("weight").over(filled) - F.col("weight")))
    level = F.when(level * F.col("weight") <= F.col("cap"), level)
    found = ranked.withColumn("level", level).withColumn("level", F.max("level").over(everyone))
    return found.select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"),
        _cycle(tuple(a / ((a + b) / 2) for a, b in schedule), F.col("place")).alias("rate_start"),
        _cycle(tuple(b / ((a + b) / 2) for a, b in schedule), F.col("place")).alias("rate_end"))


def mix(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS,
        share: float = SHARE, max_epochs: int = MAX_EPOCHS, schedule: tuple = SCHEDULE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per row: id, source, size (words; null text 0), source_size, target, positions.

    `positions` has the training position, in 0..1, of each copy that the mix takes: at most
    max_epochs; none for what lies beyond its source's target. Sources weigh `weights`, repeating in
    code point order, null last; they share `share` of all words, and targets are at most max_epochs
    times the source's size. A source of no words takes nothing. Rows of one id are in the order of
    their sizes; equal rows are copies of their own. Reruns agree, on any number of partitions.
    Texts are read once. A source's running sum is made in parts by hash prefix, of about
    `bucket_rows` rows whatever the source's size, joined to the sums of the parts before.
    """
    rows = pick(df, id=id, text=text, source=source)
    sizes = written(rows.select("id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    digits = max(0, math.ceil(math.log(max(1, sizes.count() / bucket_rows), 16)))
    keyed = sizes.withColumn("key", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))).withColumn("part", F.substring("key", 1, digits))
    parts = keyed.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "part", F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("source", "part").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    running = keyed.withColumn("in_part", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    sources = written(targets(sizes, weights, share, max_epochs, schedule))
    same = running["source"].eqNullSafe(parts["source"]) & (running["part"] == parts["part"])
    placed = running.join(parts, same).select(
        "id", running["source"].alias("source"), "size", (F.col("part_start") + F.col("in_part")).alias("start"))
    given = small(sources.withColumnRenamed("source", "name"), F.coalesce(F.length("name"), F.lit(0)) + 40)
    placed = placed.join(given, placed["source"].eqNullSafe(given["name"]))

    def position(copy: Column) -> Column:
        share_before = (copy * F.col("source_size") + F.col("start") + F.col("size") / 2) / F.col("target")
        a, b = F.col("rate_start"), F.col("rate_end")
        return 2 * share_before / (a + F.sqrt(a * a + 2 * (b - a) * share_before))

    copies = F.filter(F.array(*(F.lit(c) for c in range(max_epochs))),
                      lambda c: 2 * (c * F.col("source_size") + F.col("start")) + F.col("size") < 2 * F.col("target"))
    return placed.select(F.col("id").alias(id), F.col("source").alias(source), "size", "source_size", "target",
                         F.transform(copies, position).alias("positions"))


def schedule(mixed: DataFrame, id: str = "doc_id") -> DataFrame:
    """One row per copy, sorted by position over all partitions: id, source columns, copy, position."""
    rest = [c for c in mixed.columns if c != "positions"]
    copies = mixed.select(*rest, F.posexplode("positions").alias("copy", "position"))
    return copies.orderBy("position", id, "copy")
