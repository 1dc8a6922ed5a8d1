"""Exact Jaccard self join of word shingle sets with PartEnum signatures.

Sizes are cut into bands so wide that linked sets lie in the same or in neighbouring bands. For each
pair of neighbouring bands, linked sets differ in at most k elements. The domain of elements is cut
into n1 > k/2 parts, and each into three; by the pigeonhole, one of the n1 holds at most one
difference, so two of its three parts are equal in both sets. A set's signatures are the three
subsets of two, of all n1 parts: linked sets share one.

Sets that share a signature are linked to one of them only, not in pairs. The clusters of
these links are then searched exactly, in blocks of bounded size; sets that are already connected
are not compared again.

Signatures are by far the most that is shuffled. They travel in groups, with 5 bytes for what the group
doesn't tell and 5 for the set's hash: what is equal by chance only makes a cluster larger. Those of a
large table go in TURNS turns, and the disk of one is free before the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tableprofile.llm.bit_set import bit_set
from tableprofile.llm.common import free_shuffles, passing, pick, written
from tableprofile.llm.cluster_search import in_blocks, search
from tableprofile.llm.components import components, forest
from tableprofile.llm.text_arrays import U, mix, row_windows, slices, words_of

BLOCK_SHINGLES = 400_000   # elements of a block; a larger set is a block of its own
TURNS = 3
TURN_SHINGLES = 10_000_000 # of a turn at least
_GROUP = 1_000_000         # signatures of a group, and of a task before it hands them on
_WIDE = 5                  # bytes of a signature and of a set's hash
_NAME = (1 << 8 * _WIDE) - 1
_SALT, _SALT2 = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)


def sets_of(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, element), sorted and distinct: the shingles of n words of each text, A-Z as a-z; fewer
    words, but not none, are one shingle."""
    row, h = row_windows(words_of(data, at, lower=True), n, short=True)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[keep], h[keep]


def set_hashes(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """One value for each row's set; equal sets have equal values. 0 for an empty set."""
    at = np.searchsorted(row, np.arange(rows + 1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ _SALT))])
    found = mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64))
    found[np.diff(at) == 0] = 0
    return found


class Bands:
    """Size bands for a threshold in percent, as far as they are asked for."""

    def __init__(self, percent: int):
        self.percent, self.upper, self.k = percent, [0], []
        self.reach(100)

    def reach(self, size: int) -> None:
        while len(self.upper) < 3 or self.upper[-3] < size:
            self.upper.append(100 * (self.upper[-1] + 1) // self.percent)
        p = self.percent
        # k[j]: differences of linked sets of band j, or of bands j and j + 1 (band j has sizes up to upper[j])
        self.k = [(100 - p) * (a + b) // (100 + p) for a, b in zip(self.upper, self.upper[1:])]

    def of(self, sizes: np.ndarray) -> np.ndarray:
        self.reach(int(sizes.max(initial=0)))
        return np.searchsorted(self.upper, sizes)


def signatures(row: np.ndarray, h: np.ndarray, rows: int, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of all sets, for the pair of bands above and the pair below its band."""
    size = np.bincount(row, minlength=rows)
    band = bands.of(size)
    out_row, out_sig = [], []
    for shift in (0, 1):
        j = band - shift
        k = np.where((size > 0) & (j > 0), np.array(bands.k)[np.maximum(j, 0)], 0)    # k 0: only equal sets are linked
        need = k // 2 + 1
        n1 = np.where(k > 0, need + np.where(need >= 3, np.maximum(1, need // 8), 0), 0)
        first = np.concatenate([[0], np.cumsum(n1)])
        inside = np.flatnonzero(n1[row] > 0)
        if not len(inside):
            continue
        r, value = row[inside], mix(h[inside] ^ _SALT2)
        cell = (first[r] + (value % n1[r].astype(np.uint64)).astype(np.int64)) * 3 + ((value >> U(40)) % U(3)).astype(np.int64)
        strong = mix(h[inside] ^ _SALT)
        cells = 3 * int(first[-1])
        low = np.bincount(cell, (strong & U(0xFFFFFFFF)).astype(np.float64), cells).astype(np.uint64)
        high = np.bincount(cell, (strong >> U(32)).astype(np.float64), cells).astype(np.uint64)
        sums = ((high << U(32)) + low).reshape(-1, 3)
        counts = np.bincount(cell, minlength=cells).reshape(-1, 3)
        of = np.repeat(np.arange(rows), n1)
        full = (counts > 0).sum(axis=1) >= 2             # no subset of two is empty
        lacking = np.bincount(of[full], minlength=rows) < need
        for subset, (x, y) in enumerate(((0, 1), (0, 2), (1, 2))):
            n = counts[:, x] + counts[:, y]
            keep = np.flatnonzero((n > 0) | lacking[of])  # empty subsets count only where too few parts are full
            place = mix(((np.arange(len(of)) - first[of]) * 3 + subset).astype(np.uint64) ^ (j[of].astype(np.uint64) << U(40)))
            out_sig.append(mix(mix(sums[:, x] + place) + sums[:, y] * _SALT + n.astype(np.uint64))[keep])
            out_row.append(of[keep])
    return (np.concatenate(out_row), np.concatenate(out_sig)) if out_row else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _handed_on(sig: np.ndarray, node: np.ndarray, lead: int) -> pa.RecordBatch:
    """Rows group, rows: for each signature of a group, its next bytes and the lowest ones of the set's hash."""
    group = (sig >> U(64 - lead)).astype(np.int64)
    order = np.argsort(group.astype(np.uint16) if lead <= 16 else group, kind="stable")
    rest = sig >> U(64 - lead - 8 * _WIDE)
    rows = np.concatenate([np.ascontiguousarray(x[order]).view(np.uint8).reshape(-1, 8)[:, :_WIDE] for x in (rest, node)], axis=1)
    group = group[order]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    places = (np.append(first, len(group)) * 2 * _WIDE).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(group[first]), pa.Array.from_buffers(
        pa.binary(), len(first), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(rows))])], names=["group", "rows"])


def _stars(batches: Iterator[pa.RecordBatch], most: int = 4 * _GROUP) -> Iterator[pa.RecordBatch]:
    """From rows of `_handed_on` in order of groups: (one name of a signature, other name). Held: a batch, and `most` signatures
    or those of a group that differ."""
    def solved(held: list[np.ndarray]) -> tuple[pa.RecordBatch, np.ndarray]:
        rows = np.concatenate(held)
        wide = np.zeros((2, len(rows), 8), np.uint8)
        wide[0, :, :_WIDE], wide[1, :, :_WIDE] = rows[:, :_WIDE], rows[:, _WIDE:]
        sig, node = wide.view(np.int64).reshape(2, -1)
        order = np.argsort(sig)
        sig, node = sig[order], node[order]
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        lead = node[np.maximum.accumulate(np.where(new, np.arange(len(sig)), 0))]
        other = lead != node
        pairs = np.unique(np.stack([lead[other], node[other]], axis=1), axis=0)
        pairs = pairs[forest(pairs[:, 0], pairs[:, 1])]
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"]), rows[order[new]]

    held: list[np.ndarray] = []
    of, size, least = None, 0, most
    for batch in batches:
        for group, rows in zip(batch.column("group").to_pylist(), batch.column("rows")):
            if held and (group != of or size > least):
                found, different = solved(held)
                yield found
                held, size, least = ([different], len(different), max(most, 2 * len(different))) if group == of else ([], 0, most)
            of = group
            held.append(np.frombuffer(rows.as_buffer(), np.uint8).reshape(-1, 2 * _WIDE))
            size += len(held[-1])
    if held:
        yield solved(held)[0]


def _intersections(percent: int):
    """For `search`: rows of the right side that a set of the left side is linked to."""
    def prepare(right: list[bytes]):
        sets = [np.frombuffer(r, np.uint64) for r in right]
        size = np.array([len(r) for r in sets])
        values, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        order = np.argsort(values, kind="stable")
        values, owners = values[order], owners[order]

        def partners(payload: bytes, open_: np.ndarray) -> np.ndarray:
            one = np.frombuffer(payload, np.uint64)
            lo, hi = np.searchsorted(values, one, "left"), np.searchsorted(values, one, "right")
            n = hi - lo
            lo, n = lo[n > 0], n[n > 0]
            where = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            common = np.bincount(owners[where], minlength=len(sets))
            return np.flatnonzero((100 * common >= percent * (size + len(one) - common)) & open_)
        return partners
    return prepare


def jaccard_components(df: DataFrame, id: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85,
                       block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Per row: id, n_shingles (size of the set), component_id.

    Two rows are linked when 100 * |intersection| >= percent * |union| of their sets of n-word
    shingles; component_id is the smallest id reachable by links, the row's own included. Null and
    empty texts, and texts without words, have empty sets and no links: their own id. A row with a
    null id takes part without being named; its component is null if it has no other member.
    Rows with equal sets are one node; repeated ids are rows of their own, each with its own links,
    and the smaller of their components is not merged. Ids are integers; other columns are not read.

    Texts are read for the sets' hashes, for the signatures, TURNS times if there are many, and for the elements of the sets in
    clusters; they are not shuffled. Only signatures (about 0.4 a word, 10 bytes each, a turn at a time) and those elements are.
    """
    rows = pick(df, id=id, text=text).withColumn("id", F.col("id").cast("long"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in slices(batch.column("text")):
                row, h = sets_of(data, at, n)
                size = np.bincount(row, minlength=end - first)
                node = set_hashes(row, h, end - first).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, end - first), pa.array(size.astype(np.int64)), pa.array(node)],
                                                 names=["id", "n_shingles", "node"])

    def signed(turn: int, turns: int, lead: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bands, seen, held, size = Bands(percent), set(), [], 0
            for batch in batches:
                for first, end, data, at in slices(batch.column("text")):
                    row, h = sets_of(data, at, n)
                    node = set_hashes(row, h, end - first).view(np.int64)
                    fresh = np.zeros(end - first, bool)
                    for i, v in enumerate(node.tolist()):       # a task sends a set's signatures once
                        if v and v not in seen:
                            seen.add(v)
                            fresh[i] = True
                    keep = fresh[row]
                    of, sig = signatures(row[keep], h[keep], end - first, bands)
                    due = sig % U(turns) == U(turn)
                    held.append((sig[due], node[of[due]]))
                    size += len(held[-1][0])
                    if size >= _GROUP:
                        yield _handed_on(*map(np.concatenate, zip(*held)), lead)
                        held, size = [], 0
            if size:
                yield _handed_on(*map(np.concatenate, zip(*held)), lead)
        return run

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_id, node = mix(batch.column("id").to_numpy().view(np.uint64) ^ _SALT), batch.column("node").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([of_id, mix(of_id ^ node)]).view(np.int64))], names=["mark"])

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("id").is_valid())
            of_id = mix(batch.column("id").to_numpy().view(np.uint64) ^ _SALT)
            there = wanted.value.has(of_id)
            batch, of_id = batch.filter(pa.array(there)), of_id[there]
            for first, end, data, at in slices(batch.column("text")):
                row, h = sets_of(data, at, n)
                node = set_hashes(row, h, end - first)
                cut = np.searchsorted(row, np.arange(end - first + 1))
                keep = np.flatnonzero((node != 0) & wanted.value.has(mix(of_id[first:end] ^ node)))    # an id may have other texts
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[keep].view(np.int64)), pa.array([h[cut[i]:cut[i + 1]].tobytes() for i in keep], pa.binary())], names=["node", "payload"])

    spark = df.sparkSession
    with passing(spark):
        docs = written(rows.mapInArrow(hashes, "id long, n_shingles long, node long"), outlives=True)
        number, shingles = int(spark.conf.get("spark.sql.shuffle.partitions")), docs.agg(F.sum("n_shingles")).first()[0] or 0
        turns = max(1, min(TURNS, shingles // TURN_SHINGLES))
        lead = min(24, max(8, int(np.ceil(np.log2(max(8 * number, shingles / turns / _GROUP))))))
        stars = []
        for turn in range(turns):
            sig = rows.select("text").mapInArrow(signed(turn, turns, lead), "group long, rows binary")
            stars.append(written(sig.repartition(number, "group").sortWithinPartitions("group").mapInArrow(_stars, "a long, b long")))
            free_shuffles(spark)
        clusters = components(reduce(DataFrame.union, stars), thin=False)
        nodes = docs.where("n_shingles > 0").groupBy("node").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n")).where("id IS NOT NULL")
        nodes = in_blocks(clusters, nodes.select(F.col("node").bitwiseAND(F.lit(_NAME)).alias("node"), F.col("node").alias("whole"), "id", "n"), block_shingles)
        nodes = nodes.drop("node").withColumnRenamed("whole", "node")
        wanted = bit_set(nodes.select("id", "node").mapInArrow(marked, "mark long"))
        held = written(rows.mapInArrow(elements, "node long, payload binary").groupBy("node").agg(F.first("payload").alias("payload")))
        free_shuffles(spark)
        of = written(components(search(nodes, held, percent, block_shingles, _intersections(percent))), outlives=True)
    joined = docs.join(of.withColumnRenamed("node", "v"), docs["node"] == F.col("v"), "left").withColumn(
        "part", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")))
    smallest = joined.where("part IS NOT NULL").groupBy("part").agg(F.min("id").alias("component_id"))
    return joined.join(smallest, "part", "left").select(
        F.col("id").alias(id), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
