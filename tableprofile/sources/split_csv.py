"""CSV with line breaks inside quotes, each file read by many tasks.

A file is read as lines, in the splits that Spark gives to its tasks. Whether a line begins inside quotes
depends on all lines before it, so a first scan finds, per split, the state at its end for both
states at its start: a function of one bit. Composed along a file, these give the true state at the
start of every split. The second scan joins lines to records inside each split; only the piece of a record
that a split's border cuts travels, and is put together with its neighbours.

A quote opens a quoted field only where a field begins, and "" inside one is a quote. Other quotes are text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tableprofile.plans.cuts import cut

#: A whole field, and a line whose last field is whole: begun outside quotes, or inside.
_FIELD = r'(?:"(?:[^"]|"")*"(?:[^",][^,]*)?|[^",][^,]*|)'
_OUTSIDE = rf"(?s)\A{_FIELD}(?:,{_FIELD})*\z"
_INSIDE = rf'(?s)\A(?:[^"]|"")*"(?:[^",][^,]*)?(?:,{_FIELD})*\z'
WHOLE, HEAD, TAIL, MIDDLE = 0, 1, 2, 3


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): lines in file order inside each split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _steps(lines: pa.Array) -> tuple[np.ndarray, list[int], list[int]]:
    """(lines with a quote, state after each if it began outside, if it began inside); 1 is inside."""
    lines = lines.cast(pa.large_string())
    with_quote = pc.match_substring(lines, '"')
    quoted = lines.filter(with_quote)
    ends = [pc.invert(pc.match_substring_regex(quoted, p)).cast(pa.int8()).to_pylist() for p in (_OUTSIDE, _INSIDE)]
    return np.flatnonzero(with_quote.to_numpy(zero_copy_only=False)), *ends


def runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """(file, start, lines) of consecutive lines of one split."""
    file, start = batch.column("file").dictionary_encode(), batch.column("start").to_numpy()
    code = file.indices.to_numpy()
    first = np.flatnonzero(np.append(True, (np.diff(code) != 0) | (np.diff(start) != 0))) if len(code) else []
    for i, j in zip(first, np.append(first[1:], len(code)) if len(code) else []):
        yield file.dictionary[int(code[i])].as_py(), int(start[i]), batch.column("value").slice(i, j - i)


def _split_states(lines: DataFrame) -> DataFrame:
    """(file, start, outside, inside, opens): state at the end of each split for both states at its start;
    whether a quote is open at some line's end."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, opens = None, (0, 1), False

        def row() -> pa.RecordBatch:
            values = (*now, *state, opens)
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], schema=schema)

        schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("outside", pa.int64()), ("inside", pa.int64()), ("opens", pa.bool_())])
        for batch in batches:
            for file, start, values in runs(batch):
                if now != (file, start):
                    if now:
                        yield row()
                    now, state, opens = (file, start), (0, 1), False
                a, b = state
                for from_outside, from_inside in zip(*_steps(values)[1:]):
                    opens = opens or from_outside == 1
                    a, b = from_inside if a else from_outside, from_inside if b else from_outside
                state = a, b
        if now:
            yield row()

    return lines.mapInArrow(work, "file string, start long, outside long, inside long, opens boolean")


def _starts(splits: DataFrame) -> DataFrame:
    """(file, start, state, ends): the true states of each split; the splits of a file are composed in order."""
    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        state, before, after = 0, [], []
        for outside, inside in zip(pdf["outside"], pdf["inside"]):
            before.append(state)
            state = int(inside if state else outside)
            after.append(state)
        return pd.DataFrame({"file": pdf["file"], "start": pdf["start"], "state": before, "ends": after})

    return splits.groupBy("file").applyInPandas(compose, "file string, start long, state long, ends long")


class _Joiner:
    """Lines of one split to records. A record that was open at the split's start is its head; one
    that is open at its end is its tail, or its middle if it is both."""

    def __init__(self, file: str, start: int, state: int):
        self.file, self.start, self.state, self.head = file, start, state, state == 1
        self.open: list[str] = []
        self.header = start == 0        # the next record is the header of the file

    def _rows(self, records: pa.Array, kind: int) -> pa.RecordBatch:
        n = len(records)
        header = np.zeros(n, bool)
        if n and kind != HEAD and kind != MIDDLE:
            header[0], self.header = self.header, False
        return pa.RecordBatch.from_arrays(
            [pa.array([self.file] * n, pa.string()), pa.array(np.full(n, self.start)), pa.array(np.full(n, kind, np.int32)),
             pa.array(header), records.cast(pa.string())], names=["file", "start", "kind", "header", "record"])

    def _close(self, kind: int) -> pa.RecordBatch:
        joined, self.open = "\n".join(self.open), []
        return self._rows(pa.array([joined], pa.string()), kind)

    def add(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        at, outside, inside = _steps(lines)
        before = np.zeros(len(lines), np.int8)
        last, state = 0, self.state
        for i, a, b in zip(at.tolist(), outside, inside):
            new = b if state else a
            if new != state:
                before[last:i + 1] = state
                last, state = i + 1, new
        before[last:] = state
        begins = np.flatnonzero(before == 0)
        if self.state:
            rest = int(begins[0]) if len(begins) else len(lines)
            self.open += lines.slice(0, rest).to_pylist()
            if len(begins) or state == 0:
                yield self._close(HEAD if self.head else WHOLE)
                self.head = False
        if len(begins):
            ends = np.append(begins[1:], len(lines))
            if state:
                self.open = lines.slice(int(begins[-1])).to_pylist()
                begins, ends = begins[:-1], ends[:-1]
            if len(begins):
                kept = lines.slice(int(begins[0]), int(ends[-1] - begins[0])).cast(pa.large_string())
                bounds = np.append(begins, ends[-1]) - begins[0]
                lists = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), kept)
                yield self._rows(pc.binary_join(lists, pa.scalar("\n", pa.large_string())), WHOLE)
        self.state = state

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.open or self.state:
            yield self._close(MIDDLE if self.head else TAIL)


def _records(lines: DataFrame, states: dict[tuple[str, int], int]) -> DataFrame:
    """(file, start, kind, header, record)."""
    known = lines.sparkSession.sparkContext.broadcast(states)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for file, start, values in runs(batch):
                if now is None or (now.file, now.start) != (file, start):
                    if now:
                        yield from now.end()
                    if (file, start) not in known.value:
                        raise RuntimeError(f"{file} is split otherwise than when it was scanned; read it again")
                    now = _Joiner(file, start, known.value[file, start])
                yield from now.add(values)
        if now:
            yield from now.end()

    return lines.mapInArrow(work, "file string, start long, kind int, header boolean, record string")


def breaks_in_quotes(spark: SparkSession, path: str) -> DataFrame | None:
    """The splits of the files with their states, or None if no line ends inside quotes. One scan."""
    splits = cut(_split_states(_lines(spark, path)))      # a row a split
    return None if splits.where("opens").isEmpty() else splits


def read_records(spark: SparkSession, path: str, splits: DataFrame) -> DataFrame:
    """All columns as text, as the CSV reader gives them; empty lines are left out, the header of each file too."""
    names = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).columns
    starts = cut(_starts(splits))
    states = {(r.file, r.start): r.state for r in starts.collect()}       # a row a split
    lines = _lines(spark, path)
    records = _records(lines, states)
    whole = records.where((F.col("kind") == WHOLE) & ~F.col("header")).select("record")
    across = starts.where("state = 1 OR ends = 1").select("file", "start")
    if not across.isEmpty():
        bordering = lines.join(F.broadcast(across), ["file", "start"], "left_semi")      # a row a split
        pieces = cut(_records(bordering.select("file", "start", "value"), states).where(F.col("kind") != WHOLE))
        order = F.struct("start", F.when(F.col("kind") == TAIL, 1).otherwise(0).alias("at"))
        group = F.count(F.when(F.col("kind") == TAIL, 1)).over(
            Window.partitionBy("file").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        joined = pieces.withColumn("order", order).withColumn("group", group).groupBy("file", "group").agg(
            F.array_sort(F.collect_list(F.struct("order", "record"))).alias("parts"), F.max("header").alias("header"))    # one record
        whole = whole.unionByName(joined.where(~F.col("header")).select(
            F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record")))
    fields = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    text = F.regexp_replace("record", r"\r\z", "")
    return whole.select(text.alias("record")).where(F.trim("record") != "").select(
        F.from_csv("record", fields, {"escape": '"', "maxCharsPerColumn": "-1"}).alias("r")).select("r.*")
