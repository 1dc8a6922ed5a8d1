"""Fuzzy line deduplication: SimHash, joins on pigeonhole blocks, edit similarity, connected groups.

Lines are normalised: A-Z as a-z, white space runs as one space, none at the ends. The SimHash of a
line has BLOCKS blocks of BLOCK_BITS bits: the signs of sums over its different 4-byte strings, one rule
for all lengths. Two lines are linked when they share a block (any two within BLOCKS - 1 bits do, by the
pigeonhole principle), differ in at most DISTANCE bits of all and NEAR of the SHOWN bits that travel
with a block, and their edit similarity, 1 - distance / longer length in code points, reaches the
threshold. Every such pair is judged, or connected already by pairs that were. Chance meetings in a
block grow with the number of lines; BLOCK_BITS of about its binary logarithm keeps them few.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tableprofile.llm.common import passing, pick, small, written
from tableprofile.llm.components import components, forest
from tableprofile.llm.text_arrays import LOWER, U, Words, _power, lowered, mix, slices, words_of

GRAM = 4                   # bytes of a string that votes
BLOCKS = 15                # three in each of five longs
BLOCK_BITS = 20            # at most 21
SHOWN = 98                 # bits next to a block: all 60 of the next long, 38 of the one after it
NEAR = 22                  # of those, in which linked lines may differ
DISTANCE = 66              # of all 300
PERCENT = 80
FEATURES = 1024            # dimensions into which the strings are hashed before the projection; a power of two
SKETCH = tuple(f"s{i}" for i in range(BLOCKS // 3))
_SLICE = 1 << 18           # bytes of text handled at a time
_LINES = 1024              # projected at a time
_GRAMS = 1 << 15           # strings sorted and summed at a time: their arrays stay in the cache of a core
_PAIRED = 1 << 11          # sums of lines of fewer strings are projected two at once: one counts as it is, one 2 * _PAIRED times
_GROUP = 1 << 17           # lines whose blocks are handed on together, and about the rows of a group of blocks
_REACH = 24                # words, of both lines together, over which an alignment looks for equal ones


def line_edges(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of all lines: texts cut at \\n."""
    cuts = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([at[:-1], cuts + 1]), kind="stable")
    ends = np.sort(np.concatenate([cuts, at[1:]]), kind="stable")
    of = np.repeat(np.arange(len(at) - 1), np.bincount(np.searchsorted(at, cuts, "right") - 1, minlength=len(at) - 1) + 1)
    return of, starts, ends


def line_hashes(words: Words, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of the words in order of each run of words first..last."""
    up, down = _power(len(words.hash) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words.hash) * up[:len(words.hash)])])
    return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))


_SIGNS = np.random.default_rng(7).choice(np.array([-1, 1], np.float32), (FEATURES, 3 * BLOCK_BITS * len(SKETCH)))


def _inside(start: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Which of `size` places lie in one of the ranges; these don't overlap."""
    steps = np.zeros(size + 1, np.int8)
    steps[start] = 1
    steps[end] -= 1
    return np.cumsum(steps[:-1], dtype=np.int8).view(bool)


def simhash(data: np.ndarray, words: Words, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """(run, long): SimHash of runs of words, none empty, none overlapping. A string votes once in a run; the line ends in spaces."""
    order = np.argsort(first, kind="stable")
    first, n = first[order], (last - first)[order]
    begin = np.cumsum(n) - n
    word = np.repeat(first - begin, n) + np.arange(n.sum())
    start, end = words.start[word], words.end[word]
    size = end - start + 1                                      # the space before it
    size[begin + n - 1] += GRAM - 1
    at = np.cumsum(size) - size
    text = np.full(max(GRAM, size.sum()), 32, np.uint8)
    text[_inside(at + 1, at + 1 + end - start, len(text))] = lowered(data[_inside(start, end, len(data))])
    gram = np.ndarray(len(text) - GRAM + 1, "<u4", text.data, strides=(1,))
    edge = np.append(at[begin], size.sum())                     # of the lines
    out = np.empty((len(n), len(SKETCH)), np.int64)
    sums = np.empty((min(len(n), _LINES), FEATURES), np.float32)
    for low in range(0, len(n), _LINES):
        high, a = min(low + _LINES, len(n)), low
        while a < high:
            b = min(high, max(a + 1, int(np.searchsorted(edge, edge[a] + _GRAMS, "right")) - 1))
            sums[a - low:b - low] = _votes(gram, edge[a:b + 1])
            a = b
        bits = np.zeros((high - low, len(SKETCH), 64), bool)
        bits[:, :, :3 * BLOCK_BITS] = _above(sums[:high - low], np.diff(edge[low:high + 1])).reshape(high - low, len(SKETCH), -1)
        out[order[low:high]] = np.packbits(bits.reshape(high - low, -1), axis=1, bitorder="little").view("<i8")
    return out


def _above(sums: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """(line, bit): which projections of the lines' sums are above 0. No sum or projection exceeds a line's number of strings, so
    two lines of fewer than _PAIRED fit in one number of 24 bits, and are projected exactly in one go."""
    out = np.empty((len(sums), _SIGNS.shape[1]), bool)
    few, many = np.flatnonzero(strings < _PAIRED), np.flatnonzero(strings >= _PAIRED)
    a, b = few[:len(few) // 2], few[len(few) // 2:len(few) // 2 * 2]
    both = (sums[a] + np.float32(2 * _PAIRED) * sums[b]) @ _SIGNS
    high = np.rint(both * np.float32(0.5 / _PAIRED))
    out[b] = high > 0
    out[a] = both > high * np.float32(2 * _PAIRED)
    rest = np.concatenate([many, few[len(few) // 2 * 2:]])
    if len(rest):
        out[rest] = sums[rest] @ _SIGNS > 0
    return out


def _votes(gram: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """(line, feature): sums over the different strings of lines between the edges; the last GRAM - 1 places of a line begin none."""
    lines, ends = len(edge) - 1, edge[1:] - edge[0] - GRAM + 1
    votes = gram[edge[0]:edge[-1] - GRAM + 1].copy()
    starts = edge[:-1] - edge[0]
    for a, b in zip(starts.tolist(), ends.tolist()):
        votes[a:b].sort()
    own = np.concatenate([[True], votes[1:] != votes[:-1]])
    own[starts] = True
    for k in range(GRAM - 1):
        own[ends[:-1] + k] = False
    code = votes[own].astype(np.uint64)
    code *= U(0xFF51AFD7ED558CCD)                               # mix of 32 bits
    code ^= code >> U(33)
    code *= U(0xC4CEB9FE1A85EC53)
    one = (code & U(1 << 63) | U(0x3FF0000000000000)).view(np.float64)     # 1.0 or -1.0
    code ^= code >> U(33)
    code >>= U(24)
    code &= U(FEATURES - 1)
    place = code.view(np.int64)
    place += np.repeat(np.arange(0, lines * FEATURES, FEATURES), np.add.reduceat(own, starts, dtype=np.int64))
    return np.bincount(place, one, lines * FEATURES).reshape(-1, FEATURES)


def _normal(line: str) -> str:
    """The normalised line; white space is that of the words: ASCII's."""
    return b" ".join(line.encode().translate(_LOWER).split()).decode()


_LOWER = LOWER.tobytes()


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance; one step of bit arithmetic per character of b."""
    while a and b and a[-1] == b[-1] and a[0] == b[0]:
        lead = 0
        top = min(len(a), len(b))
        while lead < top and a[lead] == b[lead]:
            lead += 1
        a, b = a[lead:], b[lead:]
        tail = 0
        top = min(len(a), len(b))
        while tail < top and a[-1 - tail] == b[-1 - tail]:
            tail += 1
        a, b = a[:len(a) - tail], b[:len(b) - tail]
    if not a or not b:
        return len(a) + len(b)
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    mask = (1 << len(a)) - 1
    plus, minus = mask, 0                   # where distances down a column go up, and down, by one
    for x in map(places.get, b, repeat(0)):
        d = ((x & plus) + plus ^ plus | x | minus) & mask
        p = ((minus | (d | plus) ^ mask) << 1 | 1) & mask
        plus, minus = (plus & d) << 1 & mask | (d | p) ^ mask, p & d
    return len(b) + plus.bit_count() - minus.bit_count()


def _aligned(a: str, b: str) -> tuple[int, list[tuple[str, str]]]:
    """Stretches between equal words, and a distance that the edit distance doesn't exceed: these are replaced as wholes.

    Where words differ, the alignment goes on at the nearest two neighbouring words that are equal; the text ends in an empty word.
    """
    x, y = [*a.split(" "), ""], [*b.split(" "), ""]
    i, j, cost, n, m, stretches = 0, 0, 0, len(x), len(y), []
    while i < n or j < m:
        if i < n and j < m and x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        p, q = next(((p, s - p) for s in range(1, _REACH) for p in range(max(0, s - (m - 1 - j)), min(s, n - 1 - i) + 1)
                     if x[i + p] == y[j + s - p] and x[i + p + 1:i + p + 2] == y[j + s - p + 1:j + s - p + 2]), (n - i, m - j))
        cost += max(sum(map(len, x[i:i + p])) + p, sum(map(len, y[j:j + q])) + q)
        stretches.append((" ".join([*x[i:i + p], ""]), " ".join([*y[j:j + q], ""])))
        i, j = i + p, j + q
    return cost, stretches


def aligned_distance(a: str, b: str, limit: int) -> int:
    """A distance that the edit distance doesn't exceed; stretches between equal words are compared only if it would be over the limit."""
    cost, stretches = _aligned(a, b)
    if cost > limit and 10 * max(len(x) + len(y) for x, y in stretches) < len(a) + len(b) + 100:
        return sum(edit_distance(x, y) for x, y in stretches)
    return cost


def similar(a: str, b: str, percent: int) -> bool:
    """Whether the edit distance is small enough; in most cases that of aligned words is already."""
    longer = max(len(a), len(b))
    limit = (100 - percent) * longer // 100
    if longer - min(len(a), len(b)) > limit:
        return False
    if a.count(" ") == b.count(" ") and sum(max(len(x), len(y)) for x, y in zip(a.split(" "), b.split(" ")) if x != y) <= limit:
        return True             # words replaced in their places
    return aligned_distance(a, b, limit) <= limit or edit_distance(a, b) <= limit


def _near(key: np.ndarray, bits: np.ndarray, at: np.ndarray, other: np.ndarray) -> np.ndarray:
    shown = (key[at] ^ key[other]) & (1 << SHOWN - 3 * BLOCK_BITS) - 1     # the block is the same
    return np.bitwise_count(shown).astype(np.int64) + np.bitwise_count(bits[at] ^ bits[other]) <= NEAR


def _connect(block: np.ndarray, key: np.ndarray, bits: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Pairs that connect the nodes of each block as all pairs of near ones would."""
    links = []
    same = np.flatnonzero((key[1:] == key[:-1]) & (bits[1:] == bits[:-1])) + 1
    if len(same):
        links.append(np.stack([node[same - 1], node[same]], axis=1))
        keep = np.ones(len(key), bool)
        keep[same] = False
        block, key, bits, node = block[keep], key[keep], bits[keep], node[keep]
    part, step = np.arange(len(key)), 1
    at = np.flatnonzero(block[1:] == block[:-1])
    while len(at):
        open_ = at[part[at] != part[at + step]]
        open_ = open_[_near(key, bits, open_, open_ + step)]
        if len(open_):
            links.append(np.stack([node[open_], node[open_ + step]], axis=1))
            part = _joined(part, open_, open_ + step)
        step += 1
        at = at[at + step < len(key)]
        at = at[block[at] == block[at + step]]
    links = np.concatenate([*links, np.zeros((0, 2), np.int64)])
    return links[forest(links[:, 0], links[:, 1])] if len(links) else links


def _across(block: np.ndarray, key: np.ndarray, bits: np.ndarray, node: np.ndarray, part: np.ndarray) -> Iterator[np.ndarray]:
    """All near pairs of a block whose parts differ, step by step."""
    cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    mixed = np.minimum.reduceat(part, cuts) != np.maximum.reduceat(part, cuts)
    keep = np.repeat(mixed, np.diff(np.append(cuts, len(block))))
    block, key, bits, node, part = block[keep], key[keep], bits[keep], node[keep], part[keep]
    at, step = np.flatnonzero(block[1:] == block[:-1]), 1
    while len(at):
        open_ = at[part[at] != part[at + step]]
        open_ = open_[_near(key, bits, open_, open_ + step)]
        if len(open_):
            yield np.stack([node[open_], node[open_ + step]], axis=1)
        step += 1
        at = at[at + step < len(key)]
        at = at[block[at] == block[at + step]]


def _in_order(key: np.ndarray, bits: np.ndarray, node: np.ndarray, *also: np.ndarray) -> list[np.ndarray]:
    """Columns sorted by key, sorted by bits and node too. Few rows share a key, so a sort by one long is left to Spark."""
    columns, same = [key, bits, node, *also], key[1:] == key[:-1]
    if same.any():
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
        order = tied[np.lexsort((node[tied], bits[tied], key[tied]))]
        columns = [x.copy() for x in columns]
        for x in columns:
            x[tied] = x[order]
    return columns


def _meetings(across: bool):
    """From rows of `_blocks`: pairs (a, b), a < b. Held: a batch, and the last group."""
    width = 3 + across

    def solved(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(held).reshape(-1, width)
        order = np.argsort(rows[:, 0])
        columns = _in_order(*(rows[:, i][order] for i in range(width)))
        block = columns[0] >> SHOWN - 3 * BLOCK_BITS
        for pairs in _across(block, *columns) if across else [_connect(block, *columns)]:
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        of = None
        for batch in batches:
            for group, rows in zip(batch.column("group").to_pylist(), batch.column("rows")):
                if held and group != of:
                    yield from solved(held)
                    held = []
                of = group
                held.append(np.frombuffer(rows.as_buffer(), np.int64))
        if held:
            yield from solved(held)
    return run


def _joined(part: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Parts after joining those of a with those of b, one pair after another."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(part[a].tolist(), part[b].tolist()):
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)
    change = np.arange(len(part))
    for x in list(parent):
        change[x] = root(x)
    return change[part]


def _blocks(lines: DataFrame, *also: str) -> DataFrame:
    """The blocks of all lines, sorted by group: group, rows (for each line there: key, bits, node and the further columns, all longs).

    A key is number and bits of the block and 38 further bits. A group is the blocks of one number with the same first bits; there are
    so many groups that one has about _GROUP rows, or as few as balance the partitions. Rows of a group travel together, as bytes.
    """
    number = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = max(lines.count() / _GROUP, 16 * number / BLOCKS, 1)
    lead, tail = min(BLOCK_BITS, int(np.ceil(np.log2(least)))), SHOWN - 3 * BLOCK_BITS

    def handed_on(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        sketch, other = ([table.column(c).to_numpy() for c in names] for names in (SKETCH, ("node", *also)))
        for i in range(BLOCKS):
            own, after, last = (sketch[(i // 3 + k) % len(SKETCH)] for k in range(3))
            block = own >> BLOCK_BITS * (i % 3) & (1 << BLOCK_BITS) - 1
            group = block >> BLOCK_BITS - lead
            order = np.argsort(group.astype(np.uint16) if lead <= 16 else group, kind="stable")
            key = (block + (i << BLOCK_BITS) << tail) + (last & (1 << tail) - 1)
            rows = np.stack([key, after, *other], axis=1)[order]
            group = group[order]
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            places = (np.append(first, len(group)) * rows.strides[0]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(group[first] + (i << lead)), pa.Array.from_buffers(
                pa.binary(), len(first), [None, pa.py_buffer(places), pa.py_buffer(rows)])], names=["group", "rows"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held += [batch] if len(batch) else []
            if sum(map(len, held)) >= _GROUP:
                yield from handed_on(held)
                held = []
        if held:
            yield from handed_on(held)

    cut_up = lines.select("node", *SKETCH, *also).mapInArrow(cut, "group long, rows binary")
    return cut_up.repartition(number, "group").sortWithinPartitions("group")


def _judged(pairs: DataFrame, lines: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs whose SimHashes and lengths are near enough and whose lines are similar."""
    def side(name: str) -> DataFrame:
        return lines.select(F.col("node").alias(name), F.struct("n", *SKETCH).alias(f"of_{name}"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("line_a").to_pylist(), batch.column("line_b").to_pylist()
            yield batch.select(["a", "b"]).filter(pa.array([similar(x, y, percent) for x, y in zip(a, b)], pa.bool_()))

    far = sum((F.bit_count(F.col(f"of_a.{c}").bitwiseXOR(F.col(f"of_b.{c}"))) for c in SKETCH), F.lit(0))
    sizes = F.least("of_a.n", "of_b.n") * 100 >= F.greatest("of_a.n", "of_b.n") * percent
    near = written(pairs.join(side("a"), "a").join(side("b"), "b").where((far <= DISTANCE) & sizes).select("a", "b"))
    number = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = near.join(held.select(F.col("node").alias("a"), F.col("line").alias("line_a")), "a").join(
        held.select(F.col("node").alias("b"), F.col("line").alias("line_b")), "b")
    return written(full.repartition(number, "a", "b").mapInArrow(judge, "a long, b long"))


def removed_lines(df: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per text that loses lines: id, version (hash of the text), removed (line numbers from 0, sorted)."""
    rows = pick(df, id=id, text=text).withColumn("version", F.xxhash64("text"))
    id_type = df.schema[id].dataType.simpleString()

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in slices(batch.column("text"), _SLICE):
                of, starts, ends = line_edges(data, at)
                words = words_of(data, at, lower=True)
                lo, hi = np.searchsorted(words.start, starts), np.searchsorted(words.start, ends)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                inner = np.concatenate([[0], np.cumsum(chars[words.end] - chars[words.start])])
                size = inner[hi] - inner[lo] + np.maximum(0, hi - lo - 1)       # code points of the normalised line
                number = np.arange(len(of)) - np.searchsorted(of, of)
                keep = np.flatnonzero(hi > lo)
                lo, hi = lo[keep], hi[keep]
                node = line_hashes(words, lo, hi)
                _, once, again = np.unique(node, return_index=True, return_inverse=True)
                sketch = simhash(data, words, lo[once], hi[once])[again]
                take = pa.array(first + of[keep])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(take), batch.column("version").take(take), pa.array(number[keep]), pa.array(node.view(np.int64)),
                     pa.array(size[keep]), *(pa.array(np.ascontiguousarray(x)) for x in sketch.T)], names=["id", "version", "line", "node", "n", *SKETCH])

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            per_text = batch.column("lines")
            chosen = per_text.flatten()
            number, at = chosen.field("line").to_pylist(), np.concatenate([[0], np.cumsum(pc.list_value_length(per_text).to_numpy())]).tolist()
            taken = []
            for i, text_ in enumerate(batch.column("text")):
                split = text_.as_py().split("\n")
                taken += [_normal(split[k]) for k in number[at[i]:at[i + 1]]]
            yield pa.RecordBatch.from_arrays([chosen.field("node"), pa.array(taken, pa.string())], names=["node", "line"])

    longs = ", ".join(f"{c} long" for c in ("version", "line", "node", "n", *SKETCH))
    found = written(rows.mapInArrow(occurrences, f"id {id_type}, {longs}"))
    place = F.struct("id", "version", "line")
    lines = written(found.groupBy("node").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("seen"), *(F.min(c).alias(c) for c in ("n", *SKETCH))))
    first = written(_blocks(lines).mapInArrow(_meetings(False), "a long, b long").distinct())
    met = small(written(first.select(F.explode(F.array("a", "b")).alias("node")).distinct()), F.lit(8))
    near = written(lines.join(met, "node", "left_semi"))
    wanted = near.groupBy("at.id", "at.version").agg(F.collect_list(F.struct("at.line", "node")).alias("lines"))
    wanted = small(written(wanted), 16 * F.size("lines") + 40)
    texts = rows.join(wanted, rows["id"].eqNullSafe(wanted["id"]) & rows["version"].eqNullSafe(wanted["version"])).select("text", "lines")
    held = written(texts.mapInArrow(texts_of, "node long, line string").groupBy("node").agg(F.min("line").alias("line")))
    links = _judged(first, near, held, percent)
    parts = components(links).withColumnRenamed("component", "part")
    known = near.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    second = _blocks(known, "part").mapInArrow(_meetings(True), "a long, b long").distinct().join(first, ["a", "b"], "left_anti")
    groups = components(links.union(_judged(written(second), near, held, percent)))
    grouped = near.join(groups, "node")
    keepers = grouped.groupBy("component").agg(F.min("at").alias("kept"))
    fuzzy = grouped.join(keepers, "component").select("node", F.col("kept"))
    repeated = lines.where("seen > 1").select("node", "at")
    kept = repeated.join(fuzzy, "node", "full").select("node", F.coalesce("kept", "at").alias("kept"))     # a line met once stays
    gone = found.select("id", "version", "line", "node").join(kept, "node").where(~place.eqNullSafe(F.col("kept")))
    return gone.groupBy("id", "version").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def dedup_lines(df: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """All columns of df, the text without its removed lines, and n_lines, n_removed.

    Of each connected group of linked lines, equal ones included, the first occurrence stays: by id
    (nulls first), the text's hash, line number. Lines without a word stay. Null and empty texts stay
    as they are and have 0 and 1 lines. Rows that repeat id and text are one document: each loses the
    same lines. Columns of df called n_lines or n_removed are replaced. An empty table gives no rows.

    Texts are read three times. Shuffled are a row per line with its SimHash, 24 bytes for each block of each
    different line, handed on in groups of blocks, and the text of lines that met near ones; texts only if the list of removed lines is too
    large to broadcast. All lines of one block value are one task's; equal SimHashes there count once.
    """
    with passing(df.sparkSession):
        gone = removed_lines(df, id, text, percent).select(F.col("id").alias("__id"), F.col("version").alias("__version"), F.col("removed").alias("__removed"))
        gone = written(gone, outlives=True)
    gone = small(gone, 8 * F.size("__removed") + 40)
    target = F.col("`" + text.replace("`", "``") + "`")
    key = F.col("`" + id.replace("`", "``") + "`")
    rows = df.join(gone, key.eqNullSafe(F.col("__id")) & F.xxhash64(target).eqNullSafe(F.col("__version")), "left")
    split = F.split(target, "\n")
    breaks = F.octet_length(target) - F.octet_length(F.replace(target, F.lit("\n"), F.lit("")))
    stays = F.filter(split, lambda x, i: ~F.array_contains("__removed", i.cast("long")))
    text_out = F.when(F.col("__removed").isNull(), target).otherwise(F.array_join(stays, "\n"))
    kept = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    return rows.select(*((text_out.alias(c) if c == text else F.col("`" + c.replace("`", "``") + "`")) for c in kept),
                       F.when(target.isNull(), 0).otherwise(breaks + 1).cast("long").alias("n_lines"),
                       F.when(F.col("__removed").isNull(), 0).otherwise(F.size("__removed")).cast("long").alias("n_removed"))
