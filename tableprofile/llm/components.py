"""Connected components of a graph given by its links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tableprofile.llm.common import BROADCAST_BYTES, written

PART_LINKS = 250_000       # links that a task solves by itself


def _parts(a: np.ndarray, b: np.ndarray, parent: dict[int, int]) -> list[int]:
    """Join the ends of links in `parent`; numbers of the links that joined something."""
    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        for v in (x, y):
            parent.setdefault(v, v)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(i)
    return kept


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of the links that join two parts not joined by the links before."""
    return np.array(_parts(a, b, {}), np.int64)


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop the links of a batch that close a circle."""
    for batch in batches:
        yield batch.take(pa.array(forest(batch.column("a").to_numpy(), batch.column("b").to_numpy())))


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Link every node of a partition to the smallest node it reaches there."""
    parent: dict[int, int] = {}
    for batch in batches:
        _parts(batch.column("a").to_numpy(), batch.column("b").to_numpy(), parent)
    found = []
    for x in list(parent):
        root = x
        while parent[root] != root:
            parent[root] = root = parent[parent[root]]
        if root != x:
            found.append((x, root))
    found = np.array(found, np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def components(links: DataFrame, rounds: int = 60, part_links: int = PART_LINKS, thin: bool = True) -> DataFrame:
    """Per linked node: node, component, the smallest node reachable. links: long columns a, b.

    Links that are null or join a node to itself are left out; direction and repeats don't matter.
    Each task solves its part of the links, about `part_links` of them, and passes on one link a
    node. As long as there are several parts, a large-star and a small-star step follow: every node's
    neighbours are linked to its smallest neighbour, by minima summed up before the shuffle, until
    nothing changes. Each step is written. thin=False: links come from a Python step that has already
    dropped those that close a circle, and no second one is put beside it. A node with very many links is a hot key of a join only,
    which a checked broadcast avoids or adaptive execution splits.
    """
    graph = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    graph = written(graph.mapInArrow(_thin, "a long, b long") if thin else graph)
    state, n = None, graph.count()
    for _ in range(rounds):
        parts = max(1, -(-n // part_links))
        solved = graph.coalesce(parts).mapInArrow(_solve, "a long, b long")
        if parts == 1:
            graph = written(solved)
            break
        graph = written(solved)
        hint = F.broadcast if 2 * n * 48 <= BROADCAST_BYTES else lambda df: df      # a minimum a node
        least = graph.union(graph.select("b", "a")).groupBy("a").agg(F.min("b").alias("m"))
        least = hint(least.select(F.col("a").alias("b"), F.least("a", "m").alias("m")))
        large = graph.join(least, "b").select("a", F.col("m").alias("b")).where("a <> b")
        low = hint(large.groupBy("a").agg(F.min("b").alias("m")))
        star = large.join(low, "a").select("a", "b", "m")
        graph = written(star.select(F.col("b").alias("a"), F.col("m").alias("b")).union(star.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        before, state = state, graph.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        n = state[0]
        if state == before:
            break
    else:
        raise RuntimeError(f"components not settled in {rounds} rounds")
    low = graph.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = low.select(F.col("component").alias("node")).distinct().withColumn("component", F.col("node"))
    return low.union(roots)
