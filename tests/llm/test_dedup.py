"""Near copies, lines and repeated strings against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import DOCS, rows

from tableprofile.llm import cluster_search, jaccard_join, line_dedup, suffix_dedup
from tableprofile.llm.components import components
from tableprofile.llm.text_arrays import words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Parts:
    def __init__(self):
        self.up = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("links", [
    [], [(1, 1)], [(None, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 200)],
    [(random.Random(3).randrange(i + 1), i) for i in range(100)]], ids=["none", "loop", "null", "path", "star", "tree"])
@pytest.mark.parametrize("part", [250_000, 7])
def test_components(spark, links, part):
    brute = Parts()
    for a, b in links:
        if a is not None and a != b:
            brute.join(a, b)
    found = components(spark.createDataFrame(links, "a long, b long"), part_links=part)
    assert {r.node: r.component for r in found.collect()} == {x: brute.root(x) for x in brute.up}


def shingle_set(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


@pytest.mark.parametrize(("n", "percent", "block"), [(4, 85, 400_000), (4, 85, 300), (5, 80, 1000), (1, 50, 100)])
def test_jaccard_join(spark, n, percent, block):
    given = rows()
    sets = [(r[0], shingle_set(r[1], n)) for r in given]
    brute = Parts()
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                brute.join(a, b)
    found = jaccard_join.jaccard_components(spark.createDataFrame(given, DOCS).repartition(5), n=n, percent=percent, block_shingles=block)
    assert Counter(map(tuple, found.collect())) == Counter((a, len(x), brute.root(a)) for a, x in sets)


def test_signatures_never_lose_a_link():
    rng = np.random.default_rng(5)
    bands = jaccard_join.Bands(85)
    for size in [*range(1, 60), 200, 700]:
        for _ in range(12):
            a = np.unique(rng.integers(0, 2 ** 63, size, dtype=np.uint64))
            out = int(rng.integers(0, max(1, 8 * len(a) // 100) + 1))
            b = np.concatenate([a[out:], rng.integers(0, 2 ** 63, int(rng.integers(0, max(1, 8 * len(a) // 100) + 1)), dtype=np.uint64)])
            common = len(np.intersect1d(a, b))
            if not len(b) or (len(a) == len(b) == common) or 100 * common < 85 * (len(a) + len(b) - common):
                continue
            row = np.repeat([0, 1], [len(a), len(b)])
            of, sig = jaccard_join.signatures(row, np.concatenate([a, b]), 2, bands)
            assert len(np.intersect1d(sig[of == 0], sig[of == 1])), (len(a), len(b), common)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert jaccard_join.jaccard_components(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert suffix_dedup.dedup_strings(none).count() == 0
    only_null = spark.createDataFrame([(None,) * 10], DOCS)
    assert jaccard_join.jaccard_components(only_null).collect()[0][1:] == (0, None)
    assert line_dedup.dedup_lines(only_null).select("text", "n_lines", "n_removed").collect() == [(None, 0, 0)]
    assert suffix_dedup.dedup_strings(only_null).collect()[0][1:4] == (0, 0, 0)


def levenshtein(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(last[j] + (x != y), last[j + 1] + 1, now[j] + 1))
        last = now
    return last[-1]


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(1500):
        a = "".join(rng.choices("abcé", k=rng.randint(0, 90)))
        b = "".join(rng.choices("abcé", k=rng.randint(0, 90))) if rng.random() < 0.5 else a[:30] + "x" + a[rng.randint(30, 40):]
        assert line_dedup.edit_distance(a, b) == levenshtein(a, b)


def test_most_pairs_are_judged_by_aligned_words(monkeypatch):
    """Words replaced, added, left out and swapped in a long line: no edit distance is worked out."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(80)]
    other = words[:10] + ["new", *words[10:30], "other", *words[31:50], *words[52:60], words[61], words[60], *words[62:]]
    judged, pairs = [], []
    for _ in range(400):
        a = rng.choices(words[:12], k=rng.randint(1, 14))
        b = [w if rng.random() < 0.8 else rng.choice(words) for w in a]
        for _ in range(rng.randint(0, 2)):
            b.insert(rng.randint(0, len(b)), rng.choice(words))
        pairs.append((" ".join(a), " ".join(b)))
    for a, b in pairs:
        distance, longer = levenshtein(a, b), max(len(a), len(b))
        assert all(line_dedup.aligned_distance(a, b, limit) >= distance for limit in (0, 5, 1000))
        judged.append(line_dedup.similar(a, b, 80))
        assert judged[-1] == (100 * distance <= 20 * longer)
    assert 50 < sum(judged) < 350
    monkeypatch.setattr(line_dedup, "edit_distance", None)
    assert line_dedup.similar(" ".join(words), " ".join(other), 80) and line_dedup.similar(" ".join(other), " ".join(words), 80)


def test_simhash_of_runs_in_any_order(monkeypatch):
    """Each line's SimHash is the one it has alone, also when lines are short and few strings are summed at a time."""
    lines = ["a", "Be two", "  and a LONGER line, again and again ", "é", "x " * 40, "the end"]
    data = np.frombuffer("".join(lines).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(x.encode()) for x in lines])])
    words = words_of(data, at, lower=True)
    first, last = words.first, words.first + words.per_row
    alone = []
    for i in range(len(lines)):
        one = np.frombuffer(line_dedup._normal(lines[i]).encode(), np.uint8)
        alone.append(line_dedup.simhash(one, words_of(one, np.array([0, len(one)])), np.array([0]), np.array([words.per_row[i]]))[0].tolist())
    order = [3, 0, 5, 2, 4, 1]
    assert line_dedup.simhash(data, words, first[order], last[order]).tolist() == [alone[i] for i in order]
    monkeypatch.setattr(line_dedup, "_LINES", 4)
    monkeypatch.setattr(line_dedup, "_GRAMS", 16)
    assert line_dedup.simhash(data, words, first[order], last[order]).tolist() == [alone[i] for i in order]


def test_rows_sorted_by_key_are_put_in_order():
    rng = np.random.default_rng(6)
    key, bits, node = np.sort(rng.integers(0, 60, 200)), rng.integers(0, 4, 200), rng.permutation(200)
    order = np.lexsort((node, bits, key))
    for got, column in zip(line_dedup._in_order(key, bits, node, node * 2), (key, bits, node, node * 2)):
        assert got.tolist() == column[order].tolist()
    assert [x.tolist() for x in line_dedup._in_order(np.arange(3), bits[:3], node[:3])] == [[0, 1, 2], bits[:3].tolist(), node[:3].tolist()]


def meet(a, b):
    """Of SimHashes as five longs of three blocks: a common block with near bits in the longs after it, and few different bits in all."""
    far = [x ^ y for x, y in zip(a, b)]
    tail = (1 << line_dedup.SHOWN - 3 * line_dedup.BLOCK_BITS) - 1
    for i in range(line_dedup.BLOCKS):
        block = far[i // 3] >> line_dedup.BLOCK_BITS * (i % 3) & (1 << line_dedup.BLOCK_BITS) - 1
        shown = far[(i // 3 + 1) % 5].bit_count() + (far[(i // 3 + 2) % 5] & tail).bit_count()
        if not block and shown <= line_dedup.NEAR:
            return sum(x.bit_count() for x in far) <= line_dedup.DISTANCE
    return False


def brute_lines(given):
    """(doc_id, text) -> text without the lines that repeat an earlier one."""
    lines = sorted({(d, t) for d, t in given if t is not None})
    kinds = list(dict.fromkeys(line_dedup._normal(x) for _, t in lines for x in t.split("\n")))
    kinds = [k for k in kinds if k]
    sketch = []
    for k in kinds:
        data = np.frombuffer(k.encode(), np.uint8)
        words = words_of(data, np.array([0, len(data)]))
        sketch.append(line_dedup.simhash(data, words, np.array([0]), np.array([len(words.hash)]))[0].tolist())
    brute = Parts()
    for i, k in enumerate(kinds):
        brute.root(i)
        for j in range(i):
            if meet(sketch[i], sketch[j]) and 100 * levenshtein(k, kinds[j]) <= 20 * max(len(k), len(kinds[j])):
                brute.join(i, j)
    group, seen, out = {k: brute.root(i) for i, k in enumerate(kinds)}, set(), {}
    for d, t in lines:
        kept = []
        for x in t.split("\n"):
            g = group.get(line_dedup._normal(x))
            if g is None or g not in seen:
                kept.append(x)
            seen.add(g)
        out[d, t] = "\n".join(kept)
    return out


def test_line_dedup(spark):
    given = [r for r in rows() if r[1] is None or len(r[1]) < 5000]
    found = line_dedup.dedup_lines(spark.createDataFrame(given, DOCS).repartition(4))
    assert [c for c in found.columns if c not in ("n_lines", "n_removed")] == DOCS.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    want = brute_lines([(r[0], r[1]) for r in given])
    assert Counter((r.doc_id, r.text) for r in found.collect()) == Counter((r[0], r[1] if r[1] is None else want[r[0], r[1]]) for r in given)


def test_line_dedup_keeps_the_first_and_blank_lines(spark):
    given = [(2, "Same line here\n\nother words"), (1, "  same   LINE here \n\nfirst words"), (3, "same line here"), (None, "null id line\nsame line here")]
    found = line_dedup.dedup_lines(spark.createDataFrame(given, "doc_id long, text string"))
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in found.collect()} == {
        2: ("\nother words", 3, 1), 1: ("\nfirst words", 3, 1), 3: ("", 1, 1), None: ("null id line\nsame line here", 2, 0)}


def brute_strings(given, length=100):
    first, out = {}, {}
    for d, t in sorted({(d if d is not None else -2 ** 63, t or "") for d, t in given}):
        data = t.encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            window = data[p:p + length]
            if window in first:
                gone[p:p + length] = True
            else:
                first[window] = True
        runs = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        out[d, t] = (len(data), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest())
    return out


@pytest.mark.parametrize("piece", [suffix_dedup.PIECE, 800])
def test_repeated_strings(spark, monkeypatch, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)       # 800: texts are longer than a piece
    monkeypatch.setattr(suffix_dedup, "SLICE", piece // 4)
    rng = random.Random(4)
    base = ["".join(rng.choices("abcdefgh \né", k=400)) for _ in range(5)]
    given = [(r[0], (r[1] or "")[:30_000] if r[1] else r[1]) for r in rows() if r[0] not in (12, 1001)]
    given += [(2000 + i, rng.choice(base)[rng.randint(0, 150):rng.randint(200, 400)] + rng.choice(base)[:rng.randint(0, 300)]) for i in range(60)]
    given += [(3000, "ab" * 700), (3001, "abc" * 50 + "x" * 99), (3002, base[0][:99]), (3003, "a" * 100), (3004, "a" * 99), (3003, "a" * 100), (None, base[1])]
    found = suffix_dedup.dedup_strings(spark.createDataFrame(given, "doc_id long, text string").repartition(6)).collect()
    want = brute_strings(given)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in found) == Counter(
        (d, *want[d if d is not None else -2 ** 63, t or ""]) for d, t in given)


def test_search_takes_payloads_of_any_kind(spark):
    """Numbers are linked when they differ by one; blocks of two."""
    def prepare(right):
        values = np.array([int(v) for v in right])
        return lambda payload, open_: np.flatnonzero((abs(values - int(payload)) == 1) & open_)

    numbers = [1, 2, 3, 5, 6, 9, 20, 21, 22, 23, 24]
    nodes = spark.createDataFrame([(v, 1) for v in numbers], "node long, n long")
    clusters = spark.createDataFrame([(v, 1) for v in numbers], "node long, component long")
    held = spark.createDataFrame([(v, str(v).encode()) for v in numbers], "node long, payload binary")
    links = cluster_search.search(cluster_search.in_blocks(clusters, nodes, 2), held, 80, 2, prepare)
    found = defaultdict(set)
    for r in components(links).collect():
        found[r.component].add(r.node)
    assert sorted(map(sorted, found.values())) == [[1, 2, 3], [5, 6], [20, 21, 22, 23, 24]]


class CountedSigns:
    """Signs that note how many sums are projected."""

    __array_ufunc__ = None

    def __init__(self, signs):
        self.signs, self.shape, self.rows = signs, signs.shape, 0

    def __rmatmul__(self, sums):
        self.rows += len(sums)
        return sums @ self.signs


def test_short_lines_are_projected_two_at_once(monkeypatch):
    rng = random.Random(8)
    lines = [" ".join("".join(rng.choices("abcdefé", k=rng.randint(1, 8))) for _ in range(n)) for n in [*rng.choices(range(1, 40), k=61), 900, 3000]]
    data = np.frombuffer("\n".join(lines).encode(), np.uint8)
    of, starts, ends = line_dedup.line_edges(data, np.array([0, len(data)]))
    words = words_of(data, np.array([0, len(data)]))
    first, last = np.searchsorted(words.start, starts), np.searchsorted(words.start, ends)
    signs = CountedSigns(line_dedup._SIGNS)
    monkeypatch.setattr(line_dedup, "_SIGNS", signs)
    paired = line_dedup.simhash(data, words, first, last)
    assert signs.rows == 30 + 1 + 2         # 61 short lines, two long ones
    monkeypatch.setattr(line_dedup, "_PAIRED", 1)           # one at a time
    assert line_dedup.simhash(data, words, first, last).tolist() == paired.tolist()


def test_rows_of_a_group_of_blocks_travel_together(spark):
    rng = np.random.default_rng(4)
    sketch = rng.integers(-1 << 60, 1 << 60, (3000, len(line_dedup.SKETCH)))
    lines = spark.createDataFrame([(i, *map(int, x)) for i, x in enumerate(sketch)], ["node", *line_dedup.SKETCH]).repartition(2)
    tail, want = line_dedup.SHOWN - 3 * line_dedup.BLOCK_BITS, []
    for i in range(line_dedup.BLOCKS):
        own, after, last = (sketch[:, (i // 3 + k) % 5] for k in range(3))
        block = (own >> line_dedup.BLOCK_BITS * (i % 3) & (1 << line_dedup.BLOCK_BITS) - 1) + (i << line_dedup.BLOCK_BITS)
        want += zip(((block << tail) + (last & (1 << tail) - 1)).tolist(), after.tolist(), range(3000))
    cut = line_dedup._blocks(lines)
    assert cut.columns == ["group", "rows"]
    cut = cut.collect()
    assert len(cut) < len(want) / 4
    got, of = [], {}
    for r in cut:
        for key, bits, node in np.frombuffer(r.rows, np.int64).reshape(-1, 3).tolist():
            got.append((key, bits, node))
            assert of.setdefault(key >> tail, r.group) == r.group       # a block is in one group
    assert sorted(got) == sorted(want)


def test_words_replaced_in_their_places_need_no_alignment(monkeypatch):
    monkeypatch.setattr(line_dedup, "_aligned", None)
    assert line_dedup.similar("one two three four five six seven", "one two three four five six eleven", 80)
    assert not line_dedup.similar("one two", "one two and many more", 80)
