"""k-means outliers: rows far from their nearest centre.

All numbers of clusters are fitted together: a pass over the rows assigns them for every k and sends home
a few sums per task. Sums are of whole numbers (coordinates in steps of 2^-30), so they don't depend on
the partitions, and the start comes from rows in the order of a hash of their ids. The same rows give the same
clusters however they are stored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tableprofile.operators.features import Features
from tableprofile.plans.cuts import cut
from tableprofile.plans.quantiles import exact_quantiles

MAX_K = 10
FAR_SHARE = 0.9
START_ROWS = 5_000          # rows the start is worked out on
_RESTARTS = 4
_STEPS = 20
_TOLERANCE = 1e-4           # centres that move less have settled
_UNIT = 1 << 30
_PART = 20_000


@dataclass
class KChoice:
    k: int
    scores: list[tuple[int, float]]
    centres: list[list[float]]


def _squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.zeros((len(points), len(centres)))
    for j in range(points.shape[1]):
        diff = points[:, j, None] - centres[None, :, j]
        out += diff * diff
    return out


def _start(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centres for a bounded sample: spread seeds (k-means++), a few rounds; the best of some tries."""
    best, least = points[:k], math.inf
    for _ in range(_RESTARTS):
        centres = points[rng.integers(len(points))][None]
        while len(centres) < k:
            near = _squares(points, centres).min(1)
            chosen = rng.choice(len(points), p=near / near.sum()) if near.sum() > 0 else rng.integers(len(points))
            centres = np.vstack([centres, points[chosen]])
        for _ in range(_STEPS):
            which = _squares(points, centres).argmin(1)
            centres = np.array([points[which == c].mean(0) if (which == c).any() else centres[c] for c in range(k)])
        cost = _squares(points, centres).min(1).sum()
        if cost < least:
            best, least = centres, cost
    return best


def _steps_of(values: np.ndarray) -> np.ndarray:
    return np.rint(values * _UNIT).astype(np.int64)


def _summed(rows: DataFrame, width: int, work: Callable[[np.ndarray], list[tuple[int, int, int, np.ndarray]]]) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """{(k, cluster): (rows, sums)} of the whole-number parts that work gives for some points."""
    numbers = [f"s{i}" for i in range(width)]
    schema = pa.schema([("k", pa.int32()), ("cluster", pa.int32()), ("n", pa.int64()), *[(s, pa.decimal128(38, 0)) for s in numbers]])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            points = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            for first in range(0, len(points), _PART):
                for k, cluster, n, sums in work(points[first:first + _PART]):
                    old = total.setdefault((k, cluster), [0] * (width + 1))
                    for i, v in enumerate((n, *sums)):
                        old[i] += int(v)
        columns = list(zip(*[(k, c, n, *map(Decimal, sums)) for (k, c), (n, *sums) in total.items()])) or [[]] * (width + 3)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, schema)], schema=schema)

    spec = "k int, cluster int, n long, " + ", ".join(f"{s} decimal(38,0)" for s in numbers)
    found = rows.mapInArrow(fold, spec).groupBy("k", "cluster").agg(F.sum("n").alias("n"), *[F.sum(s).cast("decimal(38,0)").alias(s) for s in numbers])
    return {(r.k, r.cluster): (r.n, [int(r[s]) for s in numbers]) for r in found.collect()}     # a row a cluster


def _step(rows: DataFrame, centres: dict[int, np.ndarray]) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Per k and cluster: rows, sum of each coordinate, sum of squared lengths (all in whole steps)."""
    def work(points: np.ndarray) -> list[tuple[int, int, int, np.ndarray]]:
        whole = np.column_stack([_steps_of(points), _steps_of((points * points).sum(1))])
        out = []
        for k, at in centres.items():
            which = _squares(points, at).argmin(1)
            for c in np.unique(which):
                mine = which == c
                out.append((k, int(c), int(mine.sum()), whole[mine].sum(0)))
        return out

    width = next(iter(centres.values())).shape[1] + 1
    return _summed(rows, width, work)


def _fitted(rows: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Lloyd's steps for all k at once; a k whose centres have settled takes no more part."""
    done: dict[int, np.ndarray] = {}
    for _ in range(_STEPS):
        if not centres:
            break
        sums, moved = _step(rows, centres), {}
        for k, old in centres.items():
            new = old.copy()
            for c in range(k):
                if (k, c) in sums:
                    n, total = sums[k, c]
                    new[c] = [float(Decimal(t) / n) / _UNIT for t in total[:-1]]
            (moved if ((new - old) ** 2).sum(1).max() > _TOLERANCE ** 2 else done)[k] = new
        centres = moved
    return {**done, **centres}


def _silhouettes(rows: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, float]:
    """Mean silhouette per k, of squared Euclidean distances; k without two clusters that hold rows are left out.

    The mean squared distance to a cluster follows from its rows, sums and squared lengths.
    """
    sums = _step(rows, centres)
    clusters = {k: {c: sums[k, c] for c in range(k) if (k, c) in sums} for k in centres}
    clusters = {k: held for k, held in clusters.items() if len(held) > 1}
    if not clusters:
        return {}
    arrays = {}
    for k, held in clusters.items():
        n = np.array([v[0] for v in held.values()], float)
        means = np.array([[t / _UNIT / v[0] for t in v[1]] for v in held.values()])
        arrays[k] = (centres[k], {c: i for i, c in enumerate(held)}, n, means)

    def work(points: np.ndarray) -> list[tuple[int, int, int, np.ndarray]]:
        length, out = (points * points).sum(1), []
        for k, (at, place, n, means) in arrays.items():
            nearest = _squares(points, at).argmin(1)
            which = np.array([place.get(c, 0) for c in range(k)])[nearest]
            apart = np.maximum(0.0, length[:, None] + means[None, :, -1] - 2 * points @ means[:, :-1].T)
            rows_at = np.arange(len(points))
            own = apart[rows_at, which] * n[which] / np.maximum(1, n[which] - 1)
            apart[rows_at, which] = np.inf
            other = apart.min(1)
            most = np.maximum(own, other)
            s = np.where((n[which] > 1) & (most > 0), (other - own) / np.where(most > 0, most, 1.0), 0.0)
            out.append((k, 0, len(points), _steps_of(s)[:, None].sum(0)))
        return out

    return {k: float(Decimal(total) / n) / _UNIT for (k, _), (n, (total,)) in _summed(rows, 1, work).items()}


def _rounded(values: list[float]) -> list[float]:
    """To twelve digits: sums over other partitions differ in the last ones."""
    return [float(f"{v:.12g}") for v in values]


def _scaled(f: Features) -> list[Column]:
    return [((F.col(c) - m) / (s if s > 0 else 1.0)).alias(c) for c, m, s in zip(f.columns, _rounded(f.means), _rounded(f.stds))]


def choose_k(f: Features, seed: int = 42) -> KChoice:
    """The k in 2..min(10, n-1) with the best silhouette (squared Euclidean); of equals the smaller.

    The start is worked out on the START_ROWS rows whose ids have the smallest hashes.
    """
    rows = cut(f.rows.select(*_scaled(f)))
    first = f.rows.select(F.xxhash64("row_id").alias("h"), F.col("row_id").cast("string").alias("id"), *_scaled(f)) \
        .orderBy("h", "id", *f.columns).limit(START_ROWS).toPandas()[f.columns].to_numpy(dtype=float)
    tries = list(range(2, min(MAX_K, f.count - 1) + 1))
    fallback = max(2, min(3, f.count - 1))
    if not len(first):
        return KChoice(fallback, [], [])
    starts = {k: _start(first, k, np.random.default_rng([seed, k])) for k in tries or [fallback]}
    centres = _fitted(rows, starts)
    scores = sorted(_silhouettes(rows, centres).items()) if tries else []
    best = max(scores, key=lambda t: (t[1], -t[0]))[0] if scores else fallback
    if best not in centres:
        centres = _fitted(rows, {best: _start(first, best, np.random.default_rng([seed, best]))})
    return KChoice(best, scores, centres[best].tolist())


def best_k(f: Features, seed: int = 42) -> DataFrame:
    """(k, silhouette, best): at most nine rows."""
    choice = choose_k(f, seed)
    return f.rows.sparkSession.createDataFrame(
        [(k, s, k == choice.k) for k, s in choice.scores], "k int, silhouette double, best boolean")


def centre_distance(columns: list[Column], centres: list[list[float]]) -> Column:
    """Distance to the nearest centre, as a plain expression: k and the columns are few."""
    squares = []
    for centre in centres:
        total = F.lit(0.0)
        for c, v in zip(columns, centre):
            total = total + (c - float(v)) * (c - float(v))
        squares.append(total)
    return F.sqrt(F.least(*squares) if len(squares) > 1 else squares[0])


def kmeans_outliers(f: Features, seed: int = 42) -> DataFrame:
    """(row_id): rows whose distance to the nearest centre exceeds the 90th percentile."""
    centres = choose_k(f, seed).centres
    if not centres:
        return f.rows.select("row_id").limit(0)
    far = cut(f.rows.select("row_id", *_scaled(f)).select("row_id", centre_distance([F.col(c) for c in f.columns], centres).alias("d")))
    limit = exact_quantiles(far, {"d": F.col("d")}, [FAR_SHARE])["d"][0]
    return far.where(F.col("d") > limit).select("row_id")
