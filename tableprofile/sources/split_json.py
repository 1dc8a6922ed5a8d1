"""JSON arrays of objects, each file read by many tasks.

A file is read in the pieces between closing braces, in the splits that Spark gives to its tasks. What a piece
means depends on all before it: whether it begins inside a string, and how deep. A first scan finds
both changes per split, for a start inside and outside a string; composed along a file they give the true
start of every split. The second scan writes each object of the outer array as one line. An object that
a split's border cuts is put together from its pieces. The lines are then read like any JSON lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tableprofile.plans.cuts import cut, scratch_folder
from tableprofile.sources.split_csv import HEAD, MIDDLE, TAIL, WHOLE, runs

_STRING = r'(?s)"(?:[^"\\]|\\.)*"'
_REST_OF_STRING = r'(?s)\A(?:[^"\\]|\\.)*"'


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): texts between closing braces, in file order inside each split."""
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _after(outside: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(is a string open behind the piece, change of depth, its closing brace included), begun outside strings."""
    plain = pc.replace_substring_regex(outside, _STRING, "")
    opened = pc.match_substring(plain, '"').to_numpy(zero_copy_only=False)
    plain = pc.replace_substring_regex(plain, r'(?s)".*\z', "")
    depth = np.zeros(len(outside), np.int64)
    for bracket, change in (("{", 1), ("[", 1), ("]", -1)):
        depth += change * pc.count_substring(plain, bracket).to_numpy(zero_copy_only=False)
    return opened, depth - ~opened


def _steps(values: pa.Array) -> tuple[list[int], list[int], list[int], list[int]]:
    """Per piece: string open behind it and change of depth, begun outside a string; the same, begun inside."""
    values = values.cast(pa.large_string())
    opened, depth = _after(values)
    ended = pc.match_substring_regex(values, _REST_OF_STRING).to_numpy(zero_copy_only=False)
    opened_too, depth_too = _after(pc.replace_substring_regex(values, _REST_OF_STRING, ""))
    return opened.astype(int).tolist(), depth.tolist(), np.where(ended, opened_too, True).astype(int).tolist(), np.where(ended, depth_too, 0).tolist()


def _split_states(pieces: DataFrame) -> DataFrame:
    """(file, start, s0, d0, s1, d1, array): what a split does to a start outside and inside a string; whether
    its first character opens an array."""
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), *[(n, pa.int64()) for n in ("s0", "d0", "s1", "d1")], ("array", pa.bool_())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, array = None, [(0, 0), (1, 0)], False

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*now, *state[0], *state[1], array)], schema=schema)

        for batch in batches:
            for file, start, values in runs(batch):
                if now != (file, start):
                    if now:
                        yield row()
                    now, state, array = (file, start), [(0, 0), (1, 0)], values[0].as_py().lstrip("﻿ \t\r\n").startswith("[")
                for step in zip(*_steps(values)):
                    state = [(step[2 * s], d + step[2 * s + 1]) for s, d in state]
        if now:
            yield row()

    return pieces.mapInArrow(work, "file string, start long, s0 long, d0 long, s1 long, d1 long, array boolean")


def _starts(splits: DataFrame) -> DataFrame:
    """(file, start, s, d, ends): state at the start of each split; whether an object is open at its end."""
    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, s, d, out = pdf.sort_values("start"), 0, 0, []
        for r in pdf.itertuples():
            before = (s, d)
            s, d = (r.s1, d + r.d1) if s else (r.s0, d + r.d0)
            out.append((r.file, r.start, *before, bool(s or d > 1)))
        return pd.DataFrame(out, columns=["file", "start", "s", "d", "ends"])

    return splits.groupBy("file").applyInPandas(compose, "file string, start long, s long, d long, ends boolean")


def _objects(pieces: DataFrame, states: dict[tuple[str, int], tuple[int, int]]) -> DataFrame:
    """(file, start, kind, record): objects of the outer array, and the parts of those that a border cuts."""
    known = pieces.sparkSession.sparkContext.broadcast(states)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, s, d, open_, head = None, 0, 0, [], False

        def rows(found: list[tuple[int, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]] * len(found), pa.string()), pa.array([now[1]] * len(found), pa.int64()), pa.array([k for k, _ in found], pa.int32()),
                 pa.array([t for _, t in found], pa.string())], names=["file", "start", "kind", "record"])

        def last() -> list[tuple[int, str]]:
            return [(MIDDLE if head else TAIL, "}".join(open_))] if open_ and (s or d > 1) else []

        for batch in batches:
            for file, start, values in runs(batch):
                if now != (file, start):
                    if now:
                        yield rows(last())
                    if (file, start) not in known.value:
                        raise RuntimeError(f"{file} is split otherwise than when it was scanned; read it again")
                    now, (s, d), open_ = (file, start), known.value[file, start], []
                    head = bool(s or d > 1)
                found = []
                for text, *step in zip(values.to_pylist(), *_steps(values)):
                    s, d = step[2 * s], d + step[2 * s + 1]
                    open_.append(text)
                    if d == 1 and not s:
                        found.append((HEAD if head else WHOLE, "}".join(open_)))
                        open_, head = [], False
                yield rows(found)
        if now:
            yield rows(last())

    return pieces.mapInArrow(work, "file string, start long, kind int, record string")


def array_lines(spark: SparkSession, path: str) -> str | None:
    """Write the objects of the outer arrays, one a line, and return the folder; None if a file holds no array."""
    pieces = _pieces(spark, path)
    splits = cut(_split_states(pieces))                                  # a row a split
    first = splits.where("start = 0")
    if first.isEmpty() or not first.where("NOT array").isEmpty():
        return None
    starts = cut(_starts(splits))
    found = _objects(pieces, {(r.file, r.start): (r.s, r.d) for r in starts.collect()})
    whole = found.where(F.col("kind") == WHOLE).select("record")
    across = starts.where("ends OR s = 1 OR d > 1").select("file", "start")
    if not across.isEmpty():
        bordering = pieces.join(F.broadcast(across), ["file", "start"], "left_semi").select("file", "start", "value")     # a row a split
        parts = cut(_objects(bordering, {(r.file, r.start): (r.s, r.d) for r in starts.collect()}).where(F.col("kind") != WHOLE))
        order = F.struct("start", F.when(F.col("kind") == TAIL, 1).otherwise(0).alias("at"))
        group = F.count(F.when(F.col("kind") == TAIL, 1)).over(
            Window.partitionBy("file").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        joined = parts.withColumn("order", order).withColumn("group", group).groupBy("file", "group").agg(
            F.array_sort(F.collect_list(F.struct("order", "record"))).alias("parts"), F.max(F.col("kind") == HEAD).alias("closed"))    # one object
        whole = whole.unionByName(joined.where("closed").select(F.array_join(F.transform("parts", lambda p: p["record"]), "}").alias("record")))
    # strings hold no raw line breaks, so these are white space
    line = F.concat(F.regexp_replace(F.regexp_replace("record", r"\A[\s,\[\x{feff}]*", ""), r"[\r\n]+", " "), F.lit("}"))
    folder = scratch_folder(spark)
    whole.select(line.alias("value")).where(F.col("value").startswith("{")).write.option("lineSep", "\n").text(folder)
    return folder
