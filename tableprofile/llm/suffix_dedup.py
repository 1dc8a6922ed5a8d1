"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only through their first LENGTH bytes, by passes from the most significant digit
on; suffixes that stay in one group through all passes begin with the same LENGTH bytes.

The first digit is taken by content: a window of LENGTH bytes has one anchor, the leftmost of its
GRAM-byte strings of smallest hash, so equal windows have equal anchors at equal places. A suffix
whose anchor string occurs once in the corpus is alone in its group and goes no further. The others
are dealt out by this digit, each anchor with the stretch of text around it that all its windows
cover (equal stretches count once), and ordered there by eight bytes a pass; groups of one drop out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tableprofile.functions.columns import quoted
from tableprofile.llm.common import small, written
from tableprofile.llm.text_arrays import U, mix, range_hashes, slices

LENGTH = 100
GRAM = 32
SLICE = 1 << 20
PIECE = 4 * SLICE          # bytes whose anchors are found at once: no slice of several texts is longer
_FACTORS = np.random.default_rng(7).integers(1, 2 ** 63, 8, dtype=np.uint64) * U(2) + U(1)
_BYTES = np.random.default_rng(8).integers(1, 2 ** 63, 256, dtype=np.uint64)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place, made of those of halves."""
    h, size = _BYTES[data], 1
    while size < GRAM:
        h = h[:-size] * _FACTORS[size.bit_length()] + (h[size:] ^ (h[size:] >> U(29)))
        size *= 2
    return mix(h)


def anchors(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, anchor place, its gram's hash, first and last window start) of all anchors, in order.

    Places are in data; every window of a text belongs to one anchor. Long data is taken in pieces,
    at whose ends an anchor may be cut in two.
    """
    found = []
    for begin in range(0, max(1, len(data) - length + 1), PIECE):
        piece = data[begin:begin + PIECE + length - 1]
        if len(piece) < length:
            break
        gram = _gram_hashes(piece)
        least = (gram & ~U((1 << 24) - 1)) | np.arange(len(gram), dtype=np.uint64)    # ties: the leftmost
        span, size = length - GRAM + 1, 1
        while size * 2 <= span:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < span:
            least = np.minimum(least[:len(least) - (span - size)], least[span - size:])
        place = (least & U((1 << 24) - 1)).astype(np.int64)
        start = np.arange(len(place))
        text = np.searchsorted(at, start + begin, "right") - 1
        inside = np.flatnonzero(start + begin + length <= at[text + 1])
        if not len(inside):
            continue
        place, start, text = place[inside], start[inside], text[inside]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(place)) - 1
        found.append((text[first], place[first] + begin, gram[place[first]], start[first] + begin, start[last] + begin))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*found))


def _ordinals(text: np.ndarray) -> np.ndarray:
    """Number of each anchor inside its text."""
    return np.arange(len(text)) - np.searchsorted(text, text)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (gram, version, n) in order: the (version, n) whose gram has another (version, n)."""
    held, told = None, False
    for batch in batches:
        new = [batch.column(c).to_numpy() for c in ("gram", "version", "n")]
        gram, version, n = new if held is None else [np.concatenate([a, b]) for a, b in zip(held, new)]
        if not len(gram):
            continue
        keep = np.ones(len(gram), bool)     # a text read by two tasks counts once
        keep[1:] = (gram[1:] != gram[:-1]) | (version[1:] != version[:-1]) | (n[1:] != n[:-1])
        gram, version, n = gram[keep], version[keep], n[keep]
        same = gram[1:] == gram[:-1]
        twice = np.zeros(len(gram), bool)
        twice[1:] |= same
        twice[:-1] |= same
        held, held_told = [a[-1:] for a in (gram, version, n)], bool(twice[-1] or (told and len(gram) == 1))
        twice[0] &= not told                # the row held back may have been given out
        told = held_told
        yield pa.RecordBatch.from_arrays([pa.array(version[twice]), pa.array(n[twice])], names=["version", "n"])


def equal_windows(data: np.ndarray, group: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The passes: numbers of the suffixes (places in data) that share their group and their first
    `length` bytes with another, and the number of each one's group. The given order is kept in groups."""
    digits = np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))
    rest = np.arange(len(start))
    order = np.argsort(group, kind="stable")
    rest, gid = rest[order], group[order]
    for place in [None, *range(0, length - 8, 8), length - 8]:
        if place is not None:
            value = digits[start[rest] + place]
            order = np.lexsort((value, gid))
            rest, gid, value = rest[order], gid[order], value[order]
            new = np.ones(len(gid), bool)
            new[1:] = (gid[1:] != gid[:-1]) | (value[1:] != value[:-1])
        else:
            new = np.ones(len(gid), bool)
            new[1:] = gid[1:] != gid[:-1]
        gid = np.cumsum(new) - 1
        many = np.bincount(gid, minlength=1)[gid] > 1 if len(gid) else np.zeros(0, bool)
        rest, gid = rest[many], gid[many]
        if not len(rest):
            break
    return rest, gid


def _sort_stretches(gram, lo, hi, place, data, begin, end, length):
    """Stretches in order of gram, document, place: (number, first, end of removed bytes)."""
    content = range_hashes(data, begin, end) ^ mix((place - lo).astype(np.uint64) + U(1))
    order = np.lexsort((content, gram))
    equal = np.zeros(len(gram), bool)
    equal[order[1:]] = (gram[order][1:] == gram[order][:-1]) & (content[order][1:] == content[order][:-1])    # the sort is stable: the first stays
    out = [(np.flatnonzero(equal), lo[equal], hi[equal] + length)]
    ones = np.flatnonzero(~equal)
    number = np.cumsum(np.concatenate([[True], gram[ones][1:] != gram[ones][:-1]])) - 1 if len(ones) else ones
    several = np.bincount(number, minlength=1)[number] > 1 if len(ones) else np.zeros(0, bool)
    ones, number = ones[several], number[several]
    if len(ones):
        n = hi[ones] - lo[ones] + 1
        of = np.repeat(np.arange(len(ones)), n)
        shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        window = lo[ones][of] + shift
        group = number[of] * (length + 1) + (place[ones][of] - window)
        rest, gid = equal_windows(data, group, begin[ones][of] + shift, length)
        later = np.zeros(len(gid), bool)
        later[1:] = gid[1:] == gid[:-1]         # all but the earliest of a group
        gone = np.sort(rest[later])             # by stretch and place
        if len(gone):
            new = np.ones(len(gone), bool)
            new[1:] = (of[gone][1:] != of[gone][:-1]) | (window[gone][1:] != window[gone][:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(gone)) - 1
            out.append((ones[of[gone[first]]], window[gone[first]], window[gone[last]] + length))
    return tuple(np.concatenate(c) for c in zip(*out))


def repeated_spans(df: DataFrame, id: str, text: str, length: int = LENGTH) -> DataFrame:
    """Per different text with repeats: id and version of its first document, spans (start, end),
    merged and in order. Copies of a text are left out: all their windows start in its first one."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    rows = _documents(df, id, text)
    firsts = _firsts(rows)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            version = batch.column("version").to_numpy()
            fresh = np.zeros(len(version), bool)
            for i, v in enumerate(version.tolist()):        # a task sends a text's anchors once
                if v not in seen:
                    seen.add(v)
                    fresh[i] = True
            for first, end, data, at in slices(batch.column("text"), SLICE):
                of, _, gram, _, _ = anchors(data, at, length)
                n = _ordinals(of)
                keep = fresh[first:end][of]
                yield pa.RecordBatch.from_arrays([pa.array(gram[keep].view(np.int64)), pa.array(version[first:end][of[keep]]), pa.array(n[keep].astype(np.int32))],
                                                 names=["gram", "version", "n"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ns in batch.column("ns"):
                n = ns.values.to_numpy()
                bits = np.zeros(int(n.max()) + 1, bool)
                bits[n] = True
                out.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("version"), pa.array(out, pa.binary())], names=["version", "flags"])

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions, flags = batch.column("id").to_numpy(), batch.column("version").to_numpy(), batch.column("flags")
            for first, end, data, at in slices(batch.column("text"), 2 * SLICE):
                of, place, gram, lo, hi = anchors(data, at, length)
                bits = [np.unpackbits(np.frombuffer(flags[i].as_py(), np.uint8)) for i in range(first, end)]
                edge = np.concatenate([[0], np.cumsum([len(b) for b in bits])])
                n = _ordinals(of)
                known = n < np.diff(edge)[of]
                keep = np.flatnonzero(known)
                keep = keep[np.concatenate(bits)[edge[of[keep]] + n[keep]] > 0]
                of, place, gram, lo, hi = of[keep], place[keep], gram[keep], lo[keep], hi[keep]
                doc, version, base = ids[first:end][of], versions[first:end][of], at[of]
                # equal stretches of this slice: the first goes on, the others are repeats
                content = range_hashes(data, lo, hi + length) ^ mix((place - lo).astype(np.uint64) + U(1))
                order = np.lexsort((lo - base, version, doc, content, gram))
                again, same = np.zeros(len(of), bool), np.zeros(len(of), bool)
                again[order[1:]] = (gram[order][1:] == gram[order][:-1]) & (content[order][1:] == content[order][:-1])
                same[order[1:]] = again[order[1:]] & (doc[order][1:] == doc[order][:-1]) & (version[order][1:] == version[order][:-1]) & (
                    (lo - base)[order][1:] == (lo - base)[order][:-1])
                only = ~same                # rows that repeat id and text are one document
                of, place, gram, lo, hi, doc, version, base, again = (x[only] for x in (of, place, gram, lo, hi, doc, version, base, again))
                size = np.where(again, 0, hi - lo + length)
                where = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                payload = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(offsets), pa.py_buffer(data[where])])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.where(again, mix(version.astype(np.uint64) + lo.astype(np.uint64)), gram).view(np.int64)), pa.array(doc), pa.array(version),
                     pa.array(lo - base), pa.array(hi - base), pa.array(place - base), payload], names=names)

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            gram = table["gram"].to_numpy()
            if not len(gram):
                continue
            cut = int(np.flatnonzero(gram != gram[-1])[-1]) + 1 if gram[0] != gram[-1] else 0
            held = table.slice(cut)
            if cut:
                yield from removed(table.slice(0, cut))
        if held is not None:
            yield from removed(held)

    def removed(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        gram, doc, version, lo, hi, place = (table[c].to_numpy() for c in names[:-1])
        payload = table["payload"].chunk(0)
        offsets = np.frombuffer(payload.buffers()[1], np.int32)[payload.offset:payload.offset + len(payload) + 1].astype(np.int64)
        data = np.frombuffer(payload.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if payload.buffers()[2] is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        full = offsets[1:] > offsets[:-1]
        once = np.ones(len(gram), bool)     # rows that repeat id and text are one document
        once[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1]) | (version[1:] != version[:-1]) | (lo[1:] != lo[:-1]) | ~full[1:] | ~full[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(doc[~full]), pa.array(version[~full]), pa.array(lo[~full]), pa.array(hi[~full] + length)],
                                         names=["id", "version", "start", "end"])
        k = np.flatnonzero(full & once)
        if len(k):
            number, start, end = _sort_stretches(gram[k], lo[k], hi[k], place[k], data, offsets[k], offsets[k + 1], length)
            yield pa.RecordBatch.from_arrays([pa.array(doc[k[number]]), pa.array(version[k[number]]), pa.array(start), pa.array(end)],
                                             names=["id", "version", "start", "end"])

    names = ["gram", "id", "version", "lo", "hi", "place", "payload"]
    sent = rows.where(F.octet_length("text") >= length).select("text", "version").mapInArrow(sparse, "gram long, version long, n int")
    again = sent.repartition("gram").sortWithinPartitions("gram", "version", "n").mapInArrow(_repeated, "version long, n int")
    flags = written(again.groupBy("version").agg(F.collect_list("n").alias("ns")).mapInArrow(packed, "version long, flags binary"))
    flags = flags.join(firsts.select("version", "id"), "version")
    flags = small(written(flags), F.octet_length("flags") + 32)
    wide = rows.join(flags, ["id", "version"]).select("id", "version", "text", "flags").mapInArrow(
        stretches, "gram long, id long, version long, lo long, hi long, place long, payload binary")
    spans = wide.repartition("gram").sortWithinPartitions("gram", "id", "version", "lo").mapInArrow(
        ordered, "id long, version long, start long, end long")
    by_text = spans.groupBy("id", "version").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    return by_text.mapInArrow(_merge, "id long, version long, spans array<struct<start:long,end:long>>")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        merged, edge = [], [0]
        for spans in batch.column("spans"):
            fields = spans.values
            start, end = fields.field("start").to_numpy()[:], fields.field("end").to_numpy()[:]
            reach = np.maximum.accumulate(end)
            new = np.ones(len(start), bool)
            new[1:] = start[1:] > reach[:-1]
            first = np.flatnonzero(new)
            merged.append((start[first], reach[np.append(first[1:], len(start)) - 1]))
            edge.append(edge[-1] + len(first))
        start, end = (np.concatenate([m[i] for m in merged]) if merged else np.zeros(0, np.int64) for i in (0, 1))
        out = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.StructArray.from_arrays([pa.array(start), pa.array(end)], names=["start", "end"]))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("version"), out], names=["id", "version", "spans"])


def _documents(df: DataFrame, id: str, text: str) -> DataFrame:
    content = F.coalesce(quoted(text), F.lit(""))
    return df.select(F.coalesce(quoted(id).cast("long"), F.lit(-2 ** 63)).alias("id"), content.alias("text"), F.xxhash64(content).alias("version"))


def _second(text: Column) -> Column:
    """With xxhash64(text), 128 bits that tell texts apart."""
    return F.xxhash64(F.lit(1), text)


def _firsts(rows: DataFrame) -> DataFrame:
    """Per different text: version, second, id of its first document."""
    return written(rows.groupBy("version", _second(F.col("text")).alias("second")).agg(F.min("id").alias("id")))


def dedup_strings(df: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans (maximal removed runs), kept (bytes that stay).

    Removed is each byte covered by a string of `length` bytes that also starts earlier: in a document
    of smaller id, or in the same one at an earlier place; overlaps count, and all strings are judged
    on the input. Strings never cross documents. Null text is empty. A null id comes before all ids;
    of rows with one id and different texts, the smaller text hash comes first; rows that repeat id
    and text are one document and lose the same bytes. Ids are integers; other columns are not read.

    Texts are read four times. Shuffled are an anchor of about 20 bytes for every 35 bytes of text,
    and the stretches around repeated anchors, less those equal within a slice; texts only if the
    flags or spans, measured, are too large to broadcast.
    """
    rows = _documents(df, id, text)
    firsts = _firsts(rows).withColumnRenamed("id", "first")
    spans = written(repeated_spans(df, id, text, length)).withColumnRenamed("id", "first")
    per_text = firsts.join(spans, ["version", "first"], "left")
    per_text = small(written(per_text), 16 * F.coalesce(F.size("spans"), F.lit(0)) + 40)
    joined = df.select(quoted(id).alias("given"), F.coalesce(quoted(text), F.lit("")).alias("text")).withColumn(
        "version", F.xxhash64("text")).withColumn("second", _second(F.col("text"))).join(per_text, ["version", "second"], "left")
    size = F.octet_length("text").cast("long")
    copy = (F.coalesce(F.col("given").cast("long"), F.lit(-2 ** 63)) > F.col("first")) & (size >= length)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), size.alias("end")))
    cut = F.when(copy, whole).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_removed, kept = [], []
            for content, spans in zip(batch.column("text"), batch.column("cut")):
                raw, at, parts = content.as_py().encode(), 0, []
                for s in spans.as_py():
                    parts.append(raw[at:s["start"]])
                    at = s["end"]
                parts.append(raw[at:])
                kept.append(b"".join(parts))
                n_removed.append(len(raw) - len(kept[-1]))
            yield pa.RecordBatch.from_arrays([batch.column("given"), batch.column("n_bytes"), pa.array(n_removed, pa.int64()),
                                              batch.column("n_spans"), pa.array(kept, pa.binary())], names=["given", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.select("given", "text", size.alias("n_bytes"), cut.alias("cut")).withColumn("n_spans", F.size("cut").cast("long")).mapInArrow(
        keep, f"given {df.schema[id].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("given", id)
