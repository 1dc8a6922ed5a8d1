"""Hard negatives by exact search in an inverted multi-index.

Vectors become whole numbers, equal vectors of one label a node. The dimensions are halved, each half
gets a codebook (k-means over a sample); a node lies in the cell of its nearest word in both halves.
What a query can score with any node of a cell is at most the sum of two half-scores: with the words,
and with the radii of their words' nodes. A heap over the two sorted lists of half-scores (multi-sequence)
gives the cells in order of that bound.

The search goes in rounds: each open query visits its next cells, nodes and queries of a cell meet in
parts of bounded size, and the best rows so far are kept. A query is closed when its next bound lies
below what it still lacks, so the result is exact, however good or bad the codebooks are.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tableprofile.llm.common import pick, written

SCALE = 256
SAMPLE = 20_000             # nodes that the codebooks are made from
CELL_NODES = 500            # nodes of a cell, on average
WORDS = 256                 # of a codebook at most, so there are at most 65,536 cells
FIRST_CELLS = 16            # of the first round; each round visits four times as many
PART_NODES, PART_QUERIES = 2_000, 2_000     # of a cell that meet in one task
LEAST, MOST = -(1 << 62), 1 << 62
QUERY = "node long, label {0}, vector array<double>, lows array<long>, highs array<long>, floors array<long>, visited long"


def whole_vectors(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """(id, label, vector): components as floor(scale x). Rows with a null label, id or vector, or with
    a component that is null or not finite, are left out."""
    x = F.col("vector")
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    rows = pick(df, id=id, vector=vector, label=label).where(F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()).where(usable)
    # through bigint and back: -0.0 and 0.0 are one vector
    return rows.select(F.col("id").cast("long").alias("id"), "label",
                       F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double") + F.lit(0.0)).alias("vector"))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """One row per list, padded with zeros to `width`."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _nearest(points: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest word, distance to it)."""
    squares = (points * points).sum(1)[:, None] - 2 * points @ words.T + (words * words).sum(1)
    which = squares.argmin(1)
    return which, np.sqrt(((points - words[which]) ** 2).sum(1))


def _codebook(points: np.ndarray, size: int, steps: int = 8) -> np.ndarray:
    """k-means that starts from evenly spaced rows; the same rows give the same words."""
    words = points[np.linspace(0, len(points) - 1, size).astype(int)].copy()
    for _ in range(steps):
        which, _ = _nearest(points, words)
        counts = np.bincount(which, minlength=size)
        for d in range(points.shape[1]):
            sums = np.bincount(which, weights=points[:, d], minlength=size)
            words[counts > 0, d] = sums[counts > 0] / counts[counts > 0]
    return words


class _Index:
    """The nodes by cell, and the arrays that queries need (words, radii, nodes per cell; bounded)."""

    def __init__(self, nodes: DataFrame, cell_nodes: int):
        spark = nodes.sparkSession
        count, width = nodes.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
        self.width = max(width or 0, 2)
        size = max(1, min(WORDS, math.ceil(math.sqrt((count or 1) / cell_nodes))))
        key = F.pmod(F.xxhash64("vector", "label"), F.lit(1 << 30))
        share = math.ceil((1 << 30) * min(1.0, SAMPLE / max(1, count)))
        sample = nodes.where(key < share).select("vector", key.alias("key")).orderBy("key", "vector").limit(2 * SAMPLE).toArrow()
        points, half = _matrix(sample.column("vector"), self.width), self.width // 2
        if not len(points):
            points = np.zeros((1, self.width))
        words = [_codebook(points[:, :half], size), _codebook(points[:, half:], size)]
        shared, width = spark.sparkContext.broadcast(words), self.width

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = _matrix(batch.column("vector"), width)
                (i, near), (j, far) = _nearest(at[:, :half], shared.value[0]), _nearest(at[:, half:], shared.value[1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(i), pa.array(j), pa.array(near), pa.array(far)],
                                                 names=[*batch.schema.names, "i", "j", "near", "far"])

        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
        placed = written(nodes.mapInArrow(place, f"{columns}, i long, j long, near double, far double"))
        self.nodes = placed.select("node", "label", "vector", "ids", (F.col("i") * size + F.col("j")).alias("cell"))
        radii, counts = np.zeros((2, size)), np.zeros(size * size, np.int64)
        for i, j, near, far, n in placed.groupBy("i", "j").agg(F.max("near"), F.max("far"), F.count(F.lit(1))).collect():     # a row a cell
            radii[0, i], radii[1, j], counts[i * size + j] = max(radii[0, i], near), max(radii[1, j], far), n
        self.arrays = spark.sparkContext.broadcast({"words": words, "radii": radii, "counts": counts})


def _cells_in_order(one: dict, vector: np.ndarray, skip: int, most: int, least: float) -> tuple[list[int], int, float | None]:
    """(next cells that hold nodes, cells passed so far, bound of the cell behind them).

    The bound is None when no cell is left or the next one lies below `least`.
    """
    half, size = len(vector) // 2, len(one["words"][0])
    sides = []
    for words, radius, x in zip(one["words"], one["radii"], (vector[:half], vector[half:])):
        bound = words @ x + radius * math.sqrt(x @ x)
        order = np.argsort(-bound, kind="stable")
        sides.append((order, bound[order] + 1e-9 * (np.abs(bound).max() + 1.0) + 1e-6))
    (first, high), (second, low) = sides
    heap, seen, cells, passed = [(-(high[0] + low[0]), 0, 0)], {(0, 0)}, [], 0
    while heap:
        bound, a, b = heap[0]
        cell = int(first[a]) * size + int(second[b])
        held = one["counts"][cell] > 0
        if -bound < least:
            return cells, passed, None
        if held and passed >= skip and len(cells) == most:
            return cells, passed, -bound
        heapq.heappop(heap)
        if held and passed >= skip:
            cells.append(cell)
        passed += 1
        for step in ((a + 1, b), (a, b + 1)):
            if max(step) < size and step not in seen:
                seen.add(step)
                heapq.heappush(heap, (-(high[step[0]] + low[step[1]]), *step))
    return cells, passed, None


def _best(queries: pa.Table, nodes: pa.Table, width: int, k: int, same: bool) -> pa.Table:
    """(node, w, score, id): per query and window, its k best rows among these nodes, or better than its floor."""
    schema = pa.schema([("node", pa.int64()), ("w", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])
    parts = []
    if len(queries) and len(nodes):
        firsts = np.array([ids[0] for ids in nodes.column("ids").to_pylist()])
        nodes = nodes.take(pa.array(np.argsort(firsts, kind="stable")))      # by smallest id, so that columns break ties
        ids, labels = nodes.column("ids").to_pylist(), nodes.column("label").combine_chunks().dictionary_encode()
        known = {v: i for i, v in enumerate(labels.dictionary.to_pylist())}
        label = labels.indices.to_numpy()
        asked = np.array([known.get(v, -1) for v in queries.column("label").to_pylist()])
        scores = _matrix(queries.column("vector"), width) @ _matrix(nodes.column("vector"), width).T
        limit = float(1 << 62)
        scores = np.clip(scores, -limit, limit).astype(np.int64)
        fits = (asked[:, None] == label) == same
        lows, highs, floors = (queries.column(c).to_pylist() for c in ("lows", "highs", "floors"))
        number = queries.column("node").to_numpy()
        for w in range(max(map(len, lows))):
            at = np.array([i for i, x in enumerate(lows) if len(x) > w])
            floor, high = (np.array([x[i][w] for i in at])[:, None] for x in (floors, highs))
            s = np.where(fits[at] & (scores[at] >= floor) & (scores[at] <= high), scores[at], LEAST - 1)
            if s.shape[1] > k:
                s = np.where(s >= -np.partition(-s, k - 1, axis=1)[:, k - 1:k], s, LEAST - 1)
            row, column = np.nonzero(s >= LEAST)
            order = np.lexsort((column, -s[row, column], row))
            row, column = row[order], column[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            for r, c in zip(row[keep].tolist(), column[keep].tolist()):
                parts += [(int(number[at[r]]), w, int(s[r, c]), i) for i in ids[c]]
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*parts) if parts else ([], [], [], []), schema)], schema=schema)


def _search(index: _Index, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """(node, w, score, id, rank): per query and window (lows, highs), the first k rows whose label is
    the query's (same) or another, by falling score and rising id. Exact; every round is written."""
    label = queries.schema["label"].dataType.simpleString()
    shared, width = index.arrays, index.width
    cells = queries.sparkSession.createDataFrame(
        [(c, -(-int(n) // PART_NODES)) for c, n in enumerate(shared.value["counts"]) if n] or [(0, 1)], "cell long, parts long")
    rank = F.row_number().over(Window.partitionBy("node", "w").orderBy(F.col("score").desc(), "id"))
    best, budget = None, FIRST_CELLS
    still = queries.withColumn("floors", F.col("lows")).withColumn("visited", F.lit(0).cast("long"))
    while True:
        most = budget

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors, floors = _matrix(batch.column("vector"), width), batch.column("floors").to_pylist()
                skips = batch.column("visited").to_pylist()
                found = [_cells_in_order(shared.value, v, skip, most, min(f)) for v, skip, f in zip(vectors, skips, floors)]
                cell, passed, bound = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(passed, pa.int64()), pa.array(cell, pa.list_(pa.int64())), pa.array(bound, pa.float64())],
                    names=[*batch.schema.names, "cells", "bound"])

        plan = written(still.mapInArrow(visit, QUERY.format(label) + ", cells array<long>, bound double"))
        visits = plan.select("node", "label", "vector", "lows", "highs", "floors", F.explode("cells").alias("cell"))
        slots = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART_QUERIES).alias("slots")).join(F.broadcast(cells), "cell")    # a row a cell
        asked = visits.join(F.broadcast(slots), "cell").withColumn("slot", F.pmod(F.xxhash64("node"), F.col("slots"))) \
            .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        held = index.nodes.join(F.broadcast(slots), "cell").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))) \
            .withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)))
        place = ["cell", "part", "slot"]
        found = asked.select(*place, "node", "label", "vector", "lows", "highs", "floors").groupBy(*place).cogroup(
            held.select(*place, "label", "vector", "ids").groupBy(*place)).applyInArrow(
            lambda left, right: _best(left, right, width, k, same), "node long, w int, score long, id long")
        together = found if best is None else best.select("node", "w", "score", "id").unionByName(found)
        best = written(together.withColumn("rank", rank).where(F.col("rank") <= k))
        full = best.where(F.col("rank") == k).groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))    # a few windows
        floors = F.transform("lows", lambda low, w: F.greatest(low, F.coalesce(F.col("kth")[w.cast("int")], low)))
        still = written(plan.where(F.col("bound").isNotNull()).join(full, "node", "left").withColumn("floors", floors)
                        .where(F.col("bound") >= F.array_min("floors")).drop("cells", "bound", "kth"))
        if still.isEmpty():
            return best
        budget *= 4


def hard_negatives(df: DataFrame, anchor: Column, id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5,
                   negatives: int = 3, low: int = 50, high: int = 95, scale: int = SCALE, cell_nodes: int = CELL_NODES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components count as floor(scale x), scores are inner products, higher first, ties by smaller id.
    Anchors are the rows for which `anchor`, a condition on column `id`, holds. An anchor's positives are its first
    `positives` other rows of the same label; for each, the first `negatives` rows of another label are
    returned whose score is at least `low` and at most `high` percent of the positive's.

    Rows with a null label, id or vector or a component that is null or not finite take no part. Ids are
    integers. Rows that repeat an id are rows of their own, each an anchor where the id is one.
    Shorter vectors count as padded with zeros. Scores are exact while they are below 2^53; larger
    ones are rounded doubles, held within 2^62. An empty table, or one without anchors, gives no rows.

    The codebooks come from at most 2 SAMPLE nodes; all nodes are indexed and the search is exact, so its recall is 1. The rounds
    run when this is called. Equal vectors of a label are one node that keeps its smallest ids, as many as
    any result can need; nodes and queries of a cell meet in parts of PART_NODES and PART_QUERIES.
    """
    spark = df.sparkSession
    rows = written(whole_vectors(df, id, vector, label, scale))
    of_node, kept = ["label", "vector"], max(positives + 1, negatives)
    number = F.row_number().over(Window.partitionBy(*of_node).orderBy("id"))
    nodes = written(rows.withColumn("number", number).where(F.col("number") <= kept).groupBy(*of_node)
                    .agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("node", F.monotonically_increasing_id()))
    anchors = rows.where(anchor)
    index = _Index(nodes.select("node", "label", "vector", "ids"), cell_nodes)
    asked = written(nodes.join(anchors.select(*of_node).distinct(), of_node, "left_semi").select("node", *of_node))
    named = anchors.join(asked, of_node).select("id", "node")

    one = asked.select("node", *of_node, F.array(F.lit(LEAST)).alias("lows"), F.array(F.lit(MOST)).alias("highs"))
    near = _search(index, one, positives + 1, True)
    first = written(near.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("near")))     # positives + 1
    scores = F.sort_array(F.array_distinct(F.transform("near", lambda p: p["score"])))
    windows = asked.join(first, "node").select("node", *of_node, scores.alias("scores")) \
        .withColumn("lows", F.transform("scores", lambda p: F.ceil(p * F.lit(low) / F.lit(100)).cast("long"))) \
        .withColumn("highs", F.transform("scores", lambda p: F.floor(p * F.lit(high) / F.lit(100)).cast("long")))
    windows = written(windows)
    found = _search(index, windows.select("node", *of_node, "lows", "highs"), negatives, False)
    of_score = found.join(windows.select("node", "scores"), "node").groupBy("node", F.get("scores", F.col("w")).alias("score")) \
        .agg(F.collect_list(F.struct("rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))).alias("negatives"))

    own = F.array_position(F.transform("near", lambda p: p["id"]), F.col("id"))
    others = F.slice(F.filter("near", lambda p, i: i + 1 != own), 1, positives)
    pairs = named.join(first, "node").select("id", "node", F.explode(others).alias("p")).select(
        F.col("id").alias("anchor_id"), "node", F.col("p.id").alias("positive_id"), F.col("p.score").alias("score"))
    return pairs.join(of_score, ["node", "score"]).select(
        "anchor_id", "positive_id", F.inline("negatives"), F.col("score").alias("positive_score")).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
