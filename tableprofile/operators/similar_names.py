"""Best matches between two tables of names by token-sort similarity: a similarity join.

The similarity of two texts is 200 M / (length of both), M the characters in matching blocks: the longest
common block, then those left and right of it. Blocks are a common subsequence, so texts of similarity s
turn into each other by at most (1 - s) (length of both) deletions and insertions. Cut into one piece more
than that, the known name has a piece that stands unchanged in the other name, not further from its place
than the number of changes. Pieces, with both lengths, are the join key; only names that share one
are compared, and none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

_PAIRS = 4_000              # compared at a time


def sorted_tokens(name: Column) -> Column:
    """Lower-cased words in order, without Latin-1 characters and punctuation."""
    words = F.split(F.lower(F.regexp_replace(F.regexp_replace(name, "[\u0080-ÿ]", ""), r"[^\p{L}\p{N}_]", " ")), " ")
    return F.array_join(F.array_sort(F.filter(words, lambda w: w != "")), " ")


def _codes(texts: list[str], fill: int) -> np.ndarray:
    out = np.full((len(texts), max([1, *map(len, texts)])), fill, np.int32)
    for row, t in enumerate(texts):
        out[row, :len(t)] = np.frombuffer(t.encode("utf-32-le"), np.int32)
    return out


def matched_characters(left: list[str], right: list[str]) -> np.ndarray:
    """Characters in matching blocks of each pair. Of longest blocks the first in left, then in right, counts.

    All pairs go together: each round finds the longest block of every open pair of ranges.
    """
    a, b = _codes(left, -1), _codes(right, -2)
    total = np.zeros(len(left), np.int64)
    pair = np.arange(len(left))
    zero = np.zeros(len(left), np.int64)
    a_low, a_high, b_low, b_high = zero, np.array([len(t) for t in left], np.int64), zero, np.array([len(t) for t in right], np.int64)
    place = np.arange(b.shape[1])
    while len(pair):
        inside = (place >= b_low[:, None]) & (place < b_high[:, None])
        mine, run = b[pair], np.zeros((len(pair), b.shape[1] + 1), np.int64)
        best, a_end, b_end = (np.zeros(len(pair), np.int64) for _ in range(3))
        for i in range(int(a_low.min()), int(a_high.max())):
            open_ = (i >= a_low) & (i < a_high)
            equal = (a[pair, i][:, None] == mine) & inside & open_[:, None]
            run[:, 1:] = np.where(equal, run[:, :-1] + 1, 0)
            at = run.argmax(1)
            longest = run[np.arange(len(pair)), at]
            more = longest > best
            best[more], a_end[more], b_end[more] = longest[more], i + 1, at[more]
        np.add.at(total, pair, best)
        found = best > 0
        pair, best, a_end, b_end = (x[found] for x in (pair, best, a_end, b_end))
        a_low, a_high, b_low, b_high = (x[found] for x in (a_low, a_high, b_low, b_high))
        parts = [(pair, a_low, a_end - best, b_low, b_end - best), (pair, a_end, a_high, b_end, b_high)]
        pair, a_low, a_high, b_low, b_high = (np.concatenate(x) for x in zip(*parts))
        left_over = (a_low < a_high) & (b_low < b_high)
        pair, a_low, a_high, b_low, b_high = (x[left_over] for x in (pair, a_low, a_high, b_low, b_high))
    return total


def token_sort_scores(left: list[str], right: list[str]) -> np.ndarray:
    """0..100 for pairs of names whose tokens are sorted; 0 for an empty one."""
    both = np.array([len(x) + len(y) for x, y in zip(left, right)], float)
    empty = np.array([not x or not y for x, y in zip(left, right)], bool)
    return np.where(empty, 0, np.rint(100 * (2.0 * matched_characters(left, right) / np.maximum(both, 1)))).astype(np.int64)


def _pieces(length: Column, other: Column, share: float, text: Column, probe: bool) -> Column:
    """Structs (pieces, piece, text): the known text cut evenly, or all stretches of another that may be one.

    `length` is that of the known text, `other` of the text it is compared with. The pieces follow from both.
    """
    changes = F.floor(F.lit(share) * (length + other) + 1e-9).cast("int")
    count = changes + 1
    start = lambda k: F.floor(k * length / count).cast("int")

    def cut(k: Column) -> Column:
        size = start(k + 1) - start(k)
        if not probe:
            return F.array(F.struct(k.alias("piece"), F.substring(text, start(k) + 1, size).alias("part")))
        low, high = F.greatest(F.lit(0), start(k) - changes), F.least(other - size, start(k) + changes)
        return F.when(high >= low, F.transform(F.sequence(low, F.greatest(low, high)), lambda p: F.struct(
            k.alias("piece"), F.substring(text, p + 1, size).alias("part")))).otherwise(F.array().cast("array<struct<piece:int,part:string>>"))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), changes), cut)))


def similar_names(names: DataFrame, known: DataFrame, accept: int) -> DataFrame:
    """(name, known, score): each name with its most similar known name of at least `accept` percent (rounded); of
    equals the smaller. Names that have no letters, digits or underscores are like none.

    Both tables may be of any size: what meets are pieces, equal names once. accept must be over 0.
    """
    share = 1.0 - (accept - 0.5) / 100
    # M is at most the shorter length, so lengths further apart can't be similar enough
    widest = (1.0 + share) / (1.0 - share)
    left = names.select("name").where("name IS NOT NULL").distinct().withColumn("sorted", sorted_tokens(F.col("name"))).where("sorted <> ''")
    right = known.select(F.col("name").alias("known")).where("known IS NOT NULL").distinct().withColumn("like", sorted_tokens(F.col("known"))).where("like <> ''")
    a, b = (t.select(F.col(c).alias("text")).distinct().withColumn("own", F.length("text"))
            .withColumn("with", F.explode(F.sequence(F.ceil(F.col("own") / widest - 1e-9).cast("int"), F.floor(F.col("own") * widest + 1e-9).cast("int"))))
            for t, c in ((left, "sorted"), (right, "like")))
    pieces = a.select(F.col("text").alias("sorted"), F.col("own").alias("la"), F.col("with").alias("lb"),
                      F.inline(_pieces(F.col("with"), F.col("own"), share, F.col("text"), True)))
    index = b.select(F.col("text").alias("like"), F.col("own").alias("lb"), F.col("with").alias("la"),
                     F.inline(_pieces(F.col("own"), F.col("with"), share, F.col("text"), False)))
    pairs = pieces.join(index, ["la", "lb", "piece", "part"]).select("sorted", "like").distinct()

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for first in range(0, len(pdf), _PAIRS):
                part = pdf.iloc[first:first + _PAIRS].copy()
                part["score"] = token_sort_scores(part["sorted"].tolist(), part["like"].tolist())
                yield part[part["score"] >= accept]

    scored = pairs.mapInPandas(score, "sorted string, like string, score long")
    best = scored.join(right, "like").groupBy("sorted").agg(F.min(F.struct((-F.col("score")).alias("s"), "known")).alias("b"))
    return left.join(best, "sorted").select("name", F.col("b.known").alias("known"), (-F.col("b.s")).cast("int").alias("score"))
