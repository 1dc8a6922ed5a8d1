"""Number arrays as compressed bytes, for tables and shuffles that hold many of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=3)


def pack_bytes(data: bytes | np.ndarray) -> bytes:
    """Eight bytes of length, then the data, compressed where that is shorter."""
    data = bytes(data)
    small = _codec().compress(data, asbytes=True) if len(data) > 32 else data
    return len(data).to_bytes(8, "little") + (small if len(small) < len(data) else data)


def unpack_bytes(packed: bytes) -> bytes:
    size, data = int.from_bytes(packed[:8], "little"), packed[8:]
    return data if len(data) == size else _codec().decompress(data, decompressed_size=size, asbytes=True)


def pack(values: np.ndarray) -> bytes:
    """The lowest bytes of all values first, then the next ones: the high bytes of small numbers cost nothing."""
    width = values.dtype.itemsize
    return pack_bytes(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes())


def unpack(packed: bytes, dtype: type) -> np.ndarray:
    flat = np.frombuffer(unpack_bytes(packed), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).reshape(-1)
