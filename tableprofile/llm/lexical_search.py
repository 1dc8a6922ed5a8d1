"""Ranked lexical search of all documents for given items, without an index of the documents.

The items' terms, each between two guards, make one Aho-Corasick automaton that goes to all tasks.
A document, its separators turned into guards, is read through it once: the automaton's outputs are
the terms that occur, as whole terms only, and their numbers lead to the items that hold them. The
documents are read twice: first to count, per term, the documents that hold it, then to score, where
each task keeps the best of each item only.

Where the items' terms are more than a broadcast may hold, the items are dealt into parts by hash, and
each part reads the documents for itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tableprofile.llm.common import BROADCAST_BYTES, pick, written
from tableprofile.llm.text_arrays import slices

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GUARD = 0x20
#: Every separator becomes the guard, A-Z small letters; bytes of other characters stay.
TABLE = np.array([b if b >= 0x80 or chr(b).isalnum() else GUARD for b in range(256)], np.uint8)
TABLE[65:91] += 32
SLICE = 2_000_000           # bytes of text, and (document, item) sums, at a time
KEPT = 50_000               # candidates of a task before the best are picked
SALT = 64


def _automaton(terms: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for number, term in enumerate(terms):
        found.add_word(f" {term} ", number)
    found.make_automaton()
    return found


def _occurrences(automaton: ahocorasick.Automaton, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of some texts: terms per text, then (text, number of an item's term, times) that occur."""
    plain = TABLE[data]
    inside = plain != GUARD
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = at[:-1][np.diff(at) > 0]
    begins[first] = inside[first]
    n = np.diff(np.append(0, np.cumsum(begins))[at])
    whole, rows, terms, times = plain.tobytes(), [], [], []
    for row, (i, j) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        values = [v for _, v in automaton.iter(f" {whole[i:j].decode()} ")] if j > i else ()
        if values:
            term, count = np.unique(np.array(values, np.int64), return_counts=True)
            rows.append(np.full(len(term), row))
            terms.append(term)
            times.append(count)
    joined = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, terms, times))
    return n, *joined


def item_terms(items: DataFrame, id: str = "item_id", text: str = "text") -> DataFrame:
    """(id, term, n): the terms of each item. Rows that share an id are one item of all their terms."""
    words = F.regexp_extract_all(F.translate("text", CAPITALS, SMALL), F.lit(TERM), F.lit(0))
    return pick(items, id=id, text=text).select("id", F.explode(words).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("n"))


def search(docs: DataFrame, items: DataFrame, k: int = 20, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", part_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(item id, rank, document id, score): the k documents of highest score above 0 for each item.

    Terms are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A term weighs
    w = floor(1000 ln((2N + 2) / (2 df + 1))) and adds w ((10^9 tf) div (1000 tf + 12 m)) to a score, once for
    each time the item holds it, with m = 75 + (25 n N) div L: N documents with terms, L terms of all of
    them, n of this one. Equal scores are ranked by ascending document id, null first.

    Null texts and texts without a term are no documents; items without a term, or none of whose terms
    occurs, have no rows. Rows that repeat a document id are documents of their own; items that share
    an id are one. Empty tables give an empty table; other columns are not read. Ids must be of a type with an order.

    Counting runs when this is called. A task holds one part's automaton (`part_bytes` of terms, measured),
    SLICE bytes of text or one longer text, and candidates: KEPT or 4 k per item, whichever is more.
    """
    spark = docs.sparkSession
    id_type, item_type = docs.schema[id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"item {item_type}, id {id_type}, score long"
    terms = written(item_terms(items, item_id, item_text))
    size = terms.agg(F.sum(F.octet_length("term") + F.coalesce(F.octet_length(F.col("id").cast("string")), F.lit(0)) + 48)).first()[0] or 0
    parts = math.ceil(2 * size / part_bytes) if size > part_bytes else 1
    given, best = pick(docs, id=id, text=text), spark.createDataFrame([], schema)
    for part in range(parts):
        mine = terms if parts == 1 else terms.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        best = best.unionByName(_best(given, _Part(mine), k, schema))
    order = [F.col("score").desc(), F.col("id").asc_nulls_first()]
    salted = F.row_number().over(Window.partitionBy("item", F.pmod(F.xxhash64("id"), F.lit(SALT))).orderBy(*order))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    return best.withColumn("rank", salted).where(F.col("rank") <= k).withColumn("rank", rank).where(F.col("rank") <= k).select(
        F.col("item").alias(item_id), "rank", F.col("id").alias(id), "score")


class _Part:
    """The terms of some items as arrays: what goes to the tasks."""

    def __init__(self, terms: DataFrame):
        rows = terms.toArrow()      # bounded by part_bytes
        coded, items = rows.column("term").combine_chunks().dictionary_encode(), rows.column("id").combine_chunks()
        self.terms = coded.dictionary.to_pylist()
        known = pc.unique(items)
        item = pc.index_in(items, known).to_numpy()
        number, n = coded.indices.to_numpy().astype(np.int64), rows.column("n").to_numpy()
        order = np.argsort(number, kind="stable")
        counts = np.bincount(number, minlength=len(self.terms))
        self.arrays = {"terms": self.terms, "ids": known, "item": item[order].astype(np.int64), "n": n[order], "counts": counts,
                       "first": np.cumsum(counts) - counts, "longest": int(np.bincount(item, weights=n).max()) if len(item) else 0}


def _best(given: DataFrame, part: _Part, k: int, schema: str) -> DataFrame:
    """(item, id, score): at least the k best documents of each item, k per item and task at most."""
    spark = given.sparkSession
    if not part.terms:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(part.arrays)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, sums = _automaton(shared.value["terms"]), np.zeros(len(shared.value["terms"]) + 2, np.int64)
        for batch in batches:
            for *_, data, at in slices(batch.column("text"), SLICE):
                n, _, term, _ = _occurrences(automaton, data, at)
                sums[:-2] += np.bincount(term, minlength=len(sums) - 2)
                sums[-2:] += (n > 0).sum(), n.sum()
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[found])], names=["number", "n"])

    sums = np.zeros(len(part.terms) + 2, np.int64)
    for number, n in given.mapInArrow(count, "number long, n long").groupBy("number").agg(F.sum("n")).collect():    # a row a term
        sums[number] = n
    documents, all_terms = int(sums[-2]), int(sums[-1])
    weights = spark.sparkContext.broadcast(np.array(
        [math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in sums[:-2].tolist()], np.int64))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, w = shared.value, weights.value
        automaton, best = _automaton(one["terms"]), _Best(k, len(one["ids"]))
        exact = one["longest"] * int(w.max(initial=0)) * 10 ** 6 < 1 << 53      # of sums in doubles
        for batch in batches:
            for begin, end, data, at in slices(batch.column("text"), SLICE):
                n, row, term, times = _occurrences(automaton, data, at)
                if not len(row):
                    continue
                m = 75 + 25 * n[row] * documents // all_terms
                value = w[term] * (10 ** 9 * times // (1000 * times + 12 * m))
                for i, j, low, high in _groups(row, one["counts"][term], end - begin, len(one["ids"])):
                    counts = one["counts"][term[i:j]]
                    before = np.cumsum(counts) - counts
                    at_entry = np.repeat(one["first"][term[i:j]] - before, counts) + np.arange(counts.sum())
                    cell = np.repeat(row[i:j] - low, counts) * len(one["ids"]) + one["item"][at_entry]
                    added = np.repeat(value[i:j], counts) * one["n"][at_entry]
                    cells = (high - low) * len(one["ids"])
                    if exact:
                        sums = np.bincount(cell, weights=added, minlength=cells).astype(np.int64)
                    else:
                        sums = np.zeros(cells, np.int64)
                        np.add.at(sums, cell, added)
                    best.add(sums.reshape(high - low, -1), batch.column("id").slice(begin + low, high - low))
        if best.any():
            yield pa.RecordBatch.from_arrays([one["ids"].take(pa.array(best.item)), best.ids, pa.array(best.score)], names=["item", "id", "score"])

    return given.mapInArrow(score, schema)


def _groups(row: np.ndarray, counts: np.ndarray, rows: int, items: int) -> Iterator[tuple[int, int, int, int]]:
    """(first and end entry, first and end row) of runs of rows with about SLICE sums and products."""
    step, upto = max(1, SLICE // items), np.append(0, np.cumsum(counts))
    bounds = np.searchsorted(row, np.arange(rows + 1))
    low = 0
    while low < rows:
        high = int(np.searchsorted(upto[bounds], upto[bounds[low]] + SLICE, "right")) - 1
        high = min(max(low + 1, high), low + step, rows)
        if bounds[high] > bounds[low]:
            yield bounds[low], bounds[high], low, high
        low = high


class _Best:
    """The best documents of each item so far: higher scores, then smaller ids."""

    def __init__(self, k: int, items: int):
        self.k, self.limit = k, max(KEPT, 4 * k * items)
        self.floor = np.ones(items, np.int64)       # a document needs this score to be looked at
        self.item, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        self.new: list[tuple] = []
        self.waiting = 0

    def add(self, sums: np.ndarray, ids: pa.Array) -> None:
        row, item = np.nonzero(sums >= self.floor)
        if len(row):
            self.new.append((item, sums[row, item], ids.take(pa.array(row))))
            self.waiting += len(row)
            if self.waiting > self.limit:
                self._pick()

    def _pick(self) -> None:
        kept = [] if self.ids is None else [(self.item, self.score, self.ids)]
        item, score, ids = zip(*kept, *self.new)
        rows = pa.table({"item": np.concatenate(item), "score": np.concatenate(score), "id": pa.chunked_array(list(ids))})
        order = pc.sort_indices(rows, sort_keys=[("item", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start")
        item = rows.column("item").to_numpy()[order.to_numpy()]
        first = np.searchsorted(item, item)
        keep = np.flatnonzero(np.arange(len(item)) - first < self.k)
        rows = rows.take(order.take(pa.array(keep)))
        self.item, self.score = rows.column("item").to_numpy(), rows.column("score").to_numpy()
        self.ids = rows.column("id").combine_chunks()
        last = np.flatnonzero(np.arange(len(item))[keep] - first[keep] == self.k - 1)
        self.floor[self.item[last]] = np.maximum(1, self.score[last])
        self.new, self.waiting = [], 0

    def any(self) -> bool:
        """Pick from what waits; whether there is anything."""
        if self.new:
            self._pick()
        return self.ids is not None
