"""A set of 64-bit hashes that is sent to all tasks, of bounded size whatever their number."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from tableprofile.llm.text_arrays import U

MOST_BITS = 28              # 32 MB
_PART_BITS = 20


@dataclass
class BitSet:
    """One bit for the first `bits` bits of a hash: `has` is true for all in the set and for few others."""

    marks: np.ndarray
    bits: int

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> U(64 - self.bits)
        return (self.marks[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def bit_set(hashes: DataFrame, most_bits: int = MOST_BITS) -> Broadcast:
    """A broadcast BitSet of a column of longs, well mixed. 64 bits a hash, 2 to the power of `most_bits` in all at most.

    Parts of the set are made by tasks; the driver only puts them together. The column is read twice.
    """
    spark, (column,) = hashes.sparkSession, hashes.columns
    bits = min(most_bits, max(_PART_BITS, int(np.ceil(np.log2(64 * max(1, hashes.count()))))))
    inner = min(bits, _PART_BITS)

    def part(table: pa.Table) -> pa.Table:
        there = np.zeros(1 << inner, np.uint8)
        there[table["at"].to_numpy()] = 1
        return pa.table({"part": table["part"][:1], "marks": pa.array([np.packbits(there, bitorder="little").tobytes()], pa.binary())})

    at = F.shiftrightunsigned(column, 64 - bits)
    parts = hashes.select(F.shiftright(at, inner).alias("part"), at.bitwiseAND(F.lit((1 << inner) - 1)).alias("at")).distinct()
    marks = np.zeros((1 << bits - inner, (1 << inner) // 8), np.uint8)
    for row in parts.groupBy("part").applyInArrow(part, "part long, marks binary").collect():
        marks[row["part"]] = np.frombuffer(row["marks"], np.uint8)
    return spark.sparkContext.broadcast(BitSet(marks.reshape(-1), bits))
