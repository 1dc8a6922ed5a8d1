"""Exact, linearly interpolated quantiles without a group that holds a whole column.

Spark's exact `percentile` merges one value->count map per column into a single task, which
fails when the column has billions of distinct values. Here each wanted order statistic is
first bracketed by a bounded sketch; scans narrow the bracket until it holds few distinct
values, and only those are ranked. No step shuffles more than a bracket.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

# A bracket with at most this many distinct values is ranked directly.
RANK_DISTINCT = 100_000
_ACCURACY = 10_000
_SLACK = 4.0 / _ACCURACY


@dataclass
class _Target:
    """One order statistic of one column, inside the open interval (low, high)."""

    name: str
    column: Column
    rank: int                    # zero-based, over the whole column
    inside_rows: int             # rows in the interval
    below: int = 0               # rows left of the interval
    low: float | None = None
    high: float | None = None
    distinct: int = 0
    value: float | None = None

    def inside(self) -> Column:
        cond = self.column.isNotNull()
        if self.low is not None:
            cond = cond & (self.column > self.low)
        if self.high is not None:
            cond = cond & (self.column < self.high)
        return F.when(cond, self.column)


def exact_quantiles(df: DataFrame, columns: dict[str, Column], probs: list[float],
                    rank_distinct: int = RANK_DISTINCT) -> dict[str, list[float | None]]:
    """{name: [quantile per prob]} for numeric columns; nulls are ignored.

    Runs a few jobs; a handful of numbers per column reach the driver.
    """
    names = list(columns)
    cols = {n: columns[n].cast("double") for n in names}
    first = df.agg(*[F.count(cols[n]).alias(f"n{i}") for i, n in enumerate(names)],
                   *[_distinct(cols[n]).alias(f"d{i}") for i, n in enumerate(names)]).first()
    n_of = {n: first[f"n{i}"] for i, n in enumerate(names)}

    targets: dict[tuple[str, int], _Target] = {}
    for i, n in enumerate(names):
        for p in probs if n_of[n] else []:
            at = (n_of[n] - 1) * p
            for r in (math.floor(at), math.ceil(at)):
                targets[(n, r)] = _Target(n, cols[n], r, n_of[n], distinct=first[f"d{i}"])

    while wide := [t for t in targets.values() if t.value is None and t.distinct > rank_distinct]:
        _narrow(df, wide)
    _rank(df, [t for t in targets.values() if t.value is None])

    def at_prob(n: str, p: float) -> float | None:
        if not n_of[n]:
            return None
        at = (n_of[n] - 1) * p
        lo, hi = targets[(n, math.floor(at))].value, targets[(n, math.ceil(at))].value
        return lo + (hi - lo) * (at - math.floor(at))

    return {n: [at_prob(n, p) for p in probs] for n in names}


def _distinct(column: Column) -> Column:
    """About how many different values; one compact sketch per column."""
    return F.hll_sketch_estimate(F.hll_sketch_agg(F.when(column.isNotNull(), F.xxhash64(column)), 12))


def _narrow(df: DataFrame, targets: list[_Target]) -> None:
    """One sketch and one counting scan for all targets.

    A rank that falls on an end of the sketched bracket is settled; otherwise the bracket
    becomes the open interval between the ends, which is strictly smaller than before.
    """
    brackets: dict[tuple, list[_Target]] = {}
    for t in targets:
        brackets.setdefault((t.name, t.low, t.high), []).append(t)
    wanted, sketches = [], []
    for b, ts in enumerate(brackets.values()):       # one sketch of a column and bracket, for all its ranks
        shares = [(t.rank - t.below) / max(1, t.inside_rows - 1) for t in ts]
        wanted.append(sorted({e for p in shares for e in (max(0.0, p - _SLACK), min(1.0, p + _SLACK))}))
        sketches.append(F.percentile_approx(ts[0].inside(), wanted[b], _ACCURACY).alias(f"q{b}"))
    found = df.agg(*sketches).first()
    ends: dict[int, tuple[float, float]] = {}
    for b, ts in enumerate(brackets.values()):
        value = dict(zip(wanted[b], found[f"q{b}"]))
        for t in ts:
            p = (t.rank - t.below) / max(1, t.inside_rows - 1)
            ends[id(t)] = value[max(0.0, p - _SLACK)], value[min(1.0, p + _SLACK)]

    # each end and each interval is counted once, however many ranks share it
    values = {(t.name, v): t.column for t in targets for v in ends[id(t)]}
    intervals = {(t.name, *ends[id(t)]): t.column for t in targets}
    counts = []
    for i, ((_, v), column) in enumerate(values.items()):
        counts += [F.count(F.when(column < v, 1)).alias(f"lt{i}"), F.count(F.when(column <= v, 1)).alias(f"le{i}")]
    for i, ((_, low, high), column) in enumerate(intervals.items()):
        counts.append(_distinct(F.when((column > low) & (column < high), column)).alias(f"d{i}"))
    seen = df.agg(*counts).first()
    place, between = {k: i for i, k in enumerate(values)}, {k: i for i, k in enumerate(intervals)}
    for t in targets:
        low, high = ends[id(t)]
        lt_low, le_low = (seen[f"{x}{place[t.name, low]}"] for x in ("lt", "le"))
        lt_high, le_high = (seen[f"{x}{place[t.name, high]}"] for x in ("lt", "le"))
        if lt_low <= t.rank < le_low:
            t.value = low
        elif lt_high <= t.rank < le_high:
            t.value = high
        elif t.rank < lt_low:          # left of the sketch: keep what is below it
            t.high, t.inside_rows = low, lt_low - t.below
        elif t.rank >= le_high:        # right of the sketch
            t.inside_rows -= le_high - t.below
            t.low, t.below = high, le_high
        else:
            t.low, t.high, t.below = low, high, le_low
            t.inside_rows, t.distinct = lt_high - t.below, seen[f"d{between[t.name, low, high]}"]


def _rank(df: DataFrame, targets: list[_Target]) -> None:
    """Order statistics from the (value, count) table of each bracket, ranked in Spark.

    Targets with the same bracket share one group, which after the count by value holds
    about RANK_DISTINCT rows at most.
    """
    brackets: dict[tuple, list[_Target]] = {}
    for t in targets:
        brackets.setdefault((t.name, t.low, t.high), []).append(t)
    if not brackets:
        return
    groups = list(brackets.values())
    pairs = F.array(*[F.struct(F.lit(b).alias("bracket"), ts[0].inside().alias("v"))
                      for b, ts in enumerate(groups)])
    freq = df.select(F.inline(pairs)).where(F.col("v").isNotNull()) \
             .groupBy("bracket", "v").agg(F.count(F.lit(1)).alias("n"))
    ranked = freq.withColumn("upto", F.sum("n").over(Window.partitionBy("bracket").orderBy("v")))
    hit = F.lit(False)
    for b, ts in enumerate(groups):
        for t in ts:
            r = t.rank - t.below
            hit = hit | ((F.col("bracket") == b) & (F.col("upto") > r) & (F.col("upto") - F.col("n") <= r))
    for row in ranked.where(hit).collect():        # at most one row per order statistic
        for t in groups[row.bracket]:
            if row.upto - row.n <= t.rank - t.below < row.upto:
                t.value = row.v
