"""Token counts by byte-pair merging with a heap and a linked list.

A word's symbols are its bytes; the adjacent pair of lowest rank is merged until none has a rank.
Only the number of merges is kept: tokens = bytes - merges. No identifiers are made.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from tableprofile.llm.common import pick

#: The split of byte-level vocabularies, and their printable form of bytes.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

CACHED_WORDS = 400_000     # entries of each cache of a worker; a full cache is emptied
CACHED_LENGTH = 48
GAP = re.compile(r"\s\s|^\s|\s$")


class Words(dict):
    """word -> tokens, worked out when first asked for."""

    def __init__(self, merges: list, vocab: dict[str, int]):
        super().__init__()
        others = [b for b in range(256) if b not in set(PRINTABLE)]
        chars = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.byte_ids = [vocab[chars[b]] for b in range(256)]
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in merges]
        self.ranks = {vocab[a] << 20 | vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]

    def __missing__(self, word: str) -> int:
        n = self.count(word.encode())
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = n
        return n

    def count(self, data: bytes) -> int:
        """Bytes minus merges. The heap holds rank * n + position; an entry counts only while the
        pair at its position still has its rank."""
        ids, rank_of, made = self.byte_ids, self.ranks.get, self.made
        symbol = [ids[b] for b in data]
        n = len(symbol)
        live = [rank_of(a << 20 | b, -1) for a, b in zip(symbol, symbol[1:])]
        live.append(-1)
        heap = [rank * n + i for i, rank in enumerate(live) if rank >= 0]
        if not heap:
            return n
        heapify(heap)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        merges = 0
        while heap:
            rank, i = divmod(heappop(heap), n)
            if live[i] != rank:
                continue
            merges += 1
            j = right[i]
            live[j] = -1
            new = symbol[i] = made[rank]
            k = right[i] = right[j]
            live[i] = -1
            if k < n:
                left[k] = i
                live[i] = rank = rank_of(new << 20 | symbol[k], -1)
                if rank >= 0:
                    heappush(heap, rank * n + i)
            h = left[i]
            if h >= 0:
                live[h] = rank = rank_of(symbol[h] << 20 | new, -1)
                if rank >= 0:
                    heappush(heap, rank * n + h)
        return n - merges


class Spaced(dict):
    """Text between two single spaces -> tokens, its leading space included."""

    def __init__(self, words: Words):
        super().__init__()
        self.words, self.split = words, regex.compile(SPLIT).findall

    def __missing__(self, piece: str) -> int:
        n = self.text(" " + piece)
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[piece] = n
        return n

    def text(self, text: str) -> int:
        return sum(map(self.words.__getitem__, self.split(text)))


@lru_cache(maxsize=2)
def counter_of(path: str) -> tuple[Spaced, list[str]]:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    return (Spaced(Words(spec["model"]["merges"], spec["model"]["vocab"])),
            sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True))


def count_text(text: str, path: str) -> int:
    """Tokens of one text; each of the vocabulary's added strings inside it is one token.

    A space between two other characters always starts a word of the split, so where no white
    space meets other white space or the ends, the pieces between spaces are counted one by one.
    """
    counter, added = counter_of(path)
    if any(a in text for a in added):
        parts = re.split("(" + "|".join(map(re.escape, added)) + ")", text)
        return len(parts) // 2 + sum(map(counter.text, parts[::2]))
    if GAP.search(text):
        return counter.text(text)
    first, *rest = text.split(" ")
    return counter.text(first) + sum(map(counter.__getitem__, rest))


def token_counts(df: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text",
                 limit: int = 1024) -> DataFrame:
    """Per row: its id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    `vocabulary` is the path, on every worker, of a byte-level BPE file of the `tokenizers` library;
    no begin, end or other special token is added. Null text is empty: 0 bytes, 0 tokens. Repeated
    rows and ids each give a row; other columns are not read. One scan, no shuffle; a worker holds
    the merge table, a bounded cache of words and one batch of texts.
    """
    id_type = df.schema[id].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            n = np.fromiter((count_text(t.as_py() or "", vocabulary) for t in texts), np.int64, len(texts))
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), size, pa.array(n), pa.array(n > limit)],
                names=["id", "n_bytes", "n_tokens", "over_limit"])

    return pick(df, id=id, text=text).mapInArrow(
        count, f"id {id_type.simpleString()}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id)
