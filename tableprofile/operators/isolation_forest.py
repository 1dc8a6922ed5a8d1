"""Isolation Forest (Liu, Ting, Zhou 2008)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tableprofile.operators.features import Features
from tableprofile.plans.cuts import cut
from tableprofile.plans.quantiles import exact_quantiles

TREES = 100
SAMPLE = 256
CONTAMINATION = 0.1


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


def grow_tree(points: np.ndarray, rng: np.random.Generator, max_depth: int) -> tuple[np.ndarray, ...]:
    """Node arrays (feature, cut, left, right, path): feature is -1 at a leaf."""
    nodes: list[list[float]] = []

    def grow(idx: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, depth + float(mean_path(len(idx)))])
        if depth < max_depth and len(idx) > 1:
            low, high = points[idx].min(axis=0), points[idx].max(axis=0)
            usable = np.flatnonzero(high > low)
            if len(usable):
                f = int(rng.choice(usable))
                at = rng.uniform(low[f], high[f])
                left = points[idx, f] <= at
                if left.all():
                    left = points[idx, f] < high[f]
                nodes[me][:2] = [f, at]
                nodes[me][2] = grow(idx[left], depth + 1)
                nodes[me][3] = grow(idx[~left], depth + 1)
        return me

    grow(np.arange(len(points)), 0)
    table = np.array(nodes)
    return (table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64),
            table[:, 3].astype(np.int64), table[:, 4])


def path_lengths(points: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    feature, at, left, right, path = tree
    node = np.zeros(len(points), dtype=np.int64)
    rows = np.arange(len(points))
    while True:
        f = feature[node]
        inner = f >= 0
        if not inner.any():
            return path[node]
        r, n = rows[inner], node[inner]
        node[inner] = np.where(points[r, f[inner]] <= at[n], left[n], right[n])


def _sample_pool(f: Features, trees: int, size: int, seed: int) -> np.ndarray:
    """Uniform rows for all trees, about trees*size of them, chosen by a hash of the row id.

    The filter keeps a known fraction of the rows, so the driver receives a bounded number
    whatever the size of the table; a lost partition yields the same rows again.
    """
    wanted = trees * size
    share = min(1.0, 1.3 * wanted / max(1, f.count))
    bucket = F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(1 << 40))
    pool = f.rows.where(bucket < int(share * (1 << 40)))
    data = pool.orderBy(F.xxhash64("row_id", F.lit(seed)), "row_id").select(*f.columns).toPandas()
    return data.to_numpy(dtype=float)


def isolation_scores(f: Features, seed: int = 42, trees: int = TREES, size: int = SAMPLE) -> DataFrame:
    """(row_id, x..., score): minus the anomaly score; lower is more unusual."""
    pool = _sample_pool(f, trees, size, seed)
    size = min(size, len(pool))
    rng = np.random.default_rng(seed)
    depth = math.ceil(math.log2(max(size, 2)))
    forest = [grow_tree(pool[rng.choice(len(pool), size, replace=False)], rng, depth) for _ in range(trees)]
    norm = trees * max(float(mean_path(size)), 1e-12)
    shared = f.rows.sparkSession.sparkContext.broadcast(forest)   # at most 2*size nodes per tree
    cols = f.columns

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            points = pdf[cols].to_numpy(dtype=float)
            total = np.zeros(len(points))
            for tree in shared.value:
                total += path_lengths(points, tree)
            yield pdf.assign(score=-np.exp2(-total / norm))

    schema = ", ".join(f"{n} {t}" for n, t in f.rows.dtypes) + ", score double"
    return f.rows.mapInPandas(score, schema)


def isolation_outliers(f: Features, seed: int = 42) -> DataFrame:
    """(row_id): rows whose score lies strictly below the 10th percentile."""
    scored = cut(isolation_scores(f, seed).select("row_id", "score"))
    limit = exact_quantiles(scored, {"score": F.col("score")}, [CONTAMINATION])["score"][0]
    return scored.where(F.col("score") < limit).select("row_id")
