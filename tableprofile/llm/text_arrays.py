"""Array forms of text for the Arrow batches of these operators: bytes, words and their hashes.

All functions work on whole texts of a batch at once. `slices` cuts a batch so that the arrays
made for one slice stay near a fixed size; a single longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 1_000_000
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_RNG = np.random.default_rng(20240229)
_BYTE_VALUES = _RNG.integers(1, 2 ** 63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: dict[str, np.ndarray] = {}

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z, as LOWER has them."""
    return data + ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive parts of about `size` bytes."""
    data, at = bytes_of(column)
    n, first = len(at) - 1, 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield first, end, data[at[first]:at[end]], at[first:end + 1] - at[first]
        first = end


@dataclass
class Words:
    """Words of some texts in order: the row each belongs to, its byte range and its hash."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    per_row: np.ndarray     # words of each row
    first: np.ndarray       # number of the first word of each row


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; equal bytes have equal hashes wherever they stand."""
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[:len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def words_of(data: np.ndarray, at: np.ndarray, lower: bool = False, separators: np.ndarray = SPACES) -> Words:
    """Words between separator bytes; with `lower`, A-Z count as a-z."""
    n = len(at) - 1
    if lower:
        data = lowered(data)
    inside = (data != 0x20) & (data - np.uint8(9) > 4) if separators is SPACES else ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(start, at)
    per_row = np.diff(first)
    return Words(np.repeat(np.arange(n), per_row), start, end, range_hashes(data, start, end), per_row, first[:-1])


def windows(values: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every `size` consecutive values (fewer than `size`: none)."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = values[:n].copy()
    for i in range(1, size):
        h = h * U(0xD6E8FEB86659FD93) + values[i:n + i]
    return mix(h)


def row_windows(words: Words, size: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the windows of `size` words inside each row, in order. With `short`, a row
    of fewer words, but not none, has its whole sequence as one window."""
    full = windows(words.hash, size)
    row = words.row[:len(full)]
    keep = row == words.row[size - 1:] if len(full) else np.zeros(0, bool)
    row, full = row[keep], full[keep]
    if not short:
        return row, full
    few = np.flatnonzero((words.per_row > 0) & (words.per_row < size))
    if not len(few):
        return row, full
    h = np.zeros(len(few), np.uint64)
    for i in range(size - 1):
        has = words.per_row[few] > i
        h[has] = h[has] * U(0xD6E8FEB86659FD93) + words.hash[words.first[few[has]] + i]
    h = mix(h + words.per_row[few].astype(np.uint64))
    row, full = np.concatenate([row, few]), np.concatenate([full, h])
    order = np.argsort(row, kind="stable")
    return row[order], full[order]
