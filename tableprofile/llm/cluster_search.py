"""Exact search for links inside clusters, in tasks of bounded size.

A cluster's nodes, in the order of their sizes, are cut into blocks. Each block is searched in
itself, with one visitor from each other block of its cluster. What is then not in the largest part
of a cluster is searched against all its blocks. Nodes that are connected already are not compared,
and only links that connect something are returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tableprofile.llm.common import written
from tableprofile.llm.components import components

# prepare(payloads of the right side) -> partners(payload, open rows as booleans) -> rows linked to it
Prepare = Callable[[list[bytes]], Callable[[bytes, np.ndarray], np.ndarray]]


def _links(left: list[bytes], right: list[bytes], left_ids: np.ndarray, right_ids: np.ndarray, known: dict[int, int],
           prepare: Prepare) -> list[tuple[int, int]]:
    """Links between left and right that connect what was not connected (known: id -> part)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        x = known.get(x, x)
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    partners, out = prepare(right), []
    roots = np.array([root(int(i)) for i in right_ids])
    for ident, payload in zip(left_ids.tolist(), left):
        mine = root(ident)
        open_ = roots != mine
        if not open_.any():
            continue
        hit = partners(payload, open_)
        for other in np.unique(roots[hit]).tolist():
            target = int(right_ids[hit[roots[hit] == other][0]])
            out.append((ident, target))
            a, b = root(ident), root(target)
            parent[max(a, b)] = min(a, b)
            roots[(roots == a) | (roots == b)] = min(a, b)
    return out


def _task(prepare: Prepare, keys: list[str]):
    """From rows in order of keys: the links of each group. Held: a batch, and the last group."""
    def solved(table: pa.Table) -> list[tuple[int, int]]:
        node, part = (table[c].to_numpy() for c in ("node", "part"))
        asks, answers = (np.array(table[c].to_pylist(), bool) for c in ("asks", "answers"))
        right, payload = ~asks | answers, np.array([*table["payload"].to_pylist(), None], object)[:-1]
        if not asks.any() or not right.any():
            return []
        return _links(list(payload[asks]), list(payload[right]), node[asks], node[right], dict(zip(node.tolist(), part.tolist())), prepare)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None
        for batch in batches:
            if not len(batch):
                continue
            columns = [batch.column(c).to_numpy() for c in keys]
            new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
            edges, found = [0, *new.tolist(), len(batch)], []
            for begin, end in zip(edges, edges[1:]):
                key = tuple(int(c[begin]) for c in columns)
                if key != last and held:
                    found += solved(pa.concat_tables(held))
                    held = []
                last = key
                held.append(pa.Table.from_batches([batch.slice(begin, end - begin)]))
            if found:
                yield _pairs(found)
        if held:
            yield _pairs(solved(pa.concat_tables(held)))
    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _solved(rows: DataFrame, prepare: Prepare, *keys: str) -> DataFrame:
    """Links of each group of rows; small groups cost no start of their own."""
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_task(prepare, list(keys)), "a long, b long")


def in_blocks(clusters: DataFrame, nodes: DataFrame, block: int) -> DataFrame:
    """clusters: node, component; nodes: node, n and others. The nodes of clusters, with `cluster` and
    `block`: a block's sizes n sum up to about `block`; a larger node is a block of its own."""
    joined = clusters.withColumnRenamed("component", "cluster").join(nodes, "node")
    before = F.sum("n").over(Window.partitionBy("cluster").orderBy("n", "node")) - F.col("n")
    return written(joined.withColumn("block", F.floor(before / block)))


def search(nodes: DataFrame, held: DataFrame, percent: int, block: int, prepare: Prepare) -> DataFrame:
    """Links (a, b) that connect the nodes of each cluster as all its links would.

    nodes: from `in_blocks`; held: node, payload. Nodes whose sizes differ by more than `percent`
    allows are never linked: 100 * smaller < percent * larger.
    """
    held = held.join(nodes.select("node", "cluster", "block", "n"), "node")
    blocks = nodes.groupBy("cluster", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    near = f"100 * high >= {percent} * least AND 100 * most >= {percent} * low"
    several = written(blocks.groupBy("cluster").agg(F.count("*").alias("n_blocks")).where("n_blocks > 1"))
    yes, no = F.lit(True), F.lit(False)

    pivots = nodes.groupBy("cluster", "block").agg(F.min_by("node", F.struct("n", "node")).alias("node"))
    member = held.select("cluster", "block", "node", "payload", yes.alias("asks"), yes.alias("answers"), F.col("node").alias("part"))
    pivot = held.join(pivots.join(several, "cluster").select("node"), "node", "left_semi").select(
        "cluster", "node", "payload", F.col("n").alias("least"), F.col("n").alias("most"), F.col("block").alias("own"))
    visiting = pivot.join(blocks, "cluster").where("own <> block AND " + near).select(
        "cluster", "block", "node", "payload", yes.alias("asks"), no.alias("answers"), F.col("node").alias("part"))
    inner = written(_solved(member.union(visiting), prepare, "cluster", "block"))
    if not several.limit(1).count():
        return inner

    parts = components(inner).withColumnRenamed("component", "part")
    found = held.join(several, "cluster", "left_semi").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    sizes = found.groupBy("cluster", "part").agg(F.count("*").alias("rows"))
    largest = sizes.groupBy("cluster").agg(F.max_by("part", F.struct("rows", "part")).alias("largest"))
    rest = found.join(largest, "cluster").where("part <> largest")
    before = F.sum("n").over(Window.partitionBy("cluster").orderBy("n", "node")) - F.col("n")
    chunked = written(rest.select("cluster", "node", "n", F.floor(before / block).alias("chunk")))
    chunks = chunked.groupBy("cluster", "chunk").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    tasks = blocks.join(chunks, "cluster").where(near).select("cluster", "block", "chunk")
    columns = ["cluster", "block", "chunk", "node", "payload"]
    full = found.join(tasks, ["cluster", "block"]).select(*columns, no.alias("asks"), no.alias("answers"), "part")
    asking = rest.select("node", "payload", "part").join(chunked, "node").join(tasks, ["cluster", "chunk"]).select(
        *columns, yes.alias("asks"), no.alias("answers"), "part")
    outer = _solved(full.union(asking), prepare, "cluster", "block", "chunk")
    return inner.union(written(outer))
