"""SentencePiece encoding and decoding through a table of distinct chunks.

White space is a marker in front of a word. Where no piece of the vocabulary holds a marker after
another character, no merge can cross the place before a run of markers, so a text falls into
chunks (markers and the word behind them) that are segmented independently of each other:

1. texts are cut into chunks; a block of texts keeps its different chunks once and, per chunk of
   its texts, the number of that chunk, compressed (a block is some MB or a single text),
2. the blocks' chunks meet by hash and are sorted, so that each different one is segmented once,
3. the pieces go back to the blocks, which put the ids of their texts together by position.

Step 1 is done twice, once for the chunks and once for their places, which costs less than to keep
them: writing the places doubles the disk. Both readings must give the same blocks. A block is
known by its place and by a hash of its texts, and a reading that differs raises an error.

What meets by hash are the blocks' different chunks, not the texts. A frequent word is one entry a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tableprofile.llm.common import pick
from tableprofile.llm.packed import pack, pack_bytes, unpack, unpack_bytes
from tableprofile.llm.text_arrays import bytes_of, range_hashes, slices

BLOCK_BYTES = 8_000_000
BUCKETS = 8                # of a block's chunks, for each shuffle partition
PART = 250_000             # chunks put together, or ids decoded, at a time

#: Fixed values of the model format: the marker of white space, kinds of pieces, kind of model.
MARKER = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2


@dataclass
class Pieces:
    """What encoding and decoding need of a model file; markers are written as spaces."""

    id_of: dict[str, int]
    rank_of: dict[str, int]     # normal pieces in order of their score; equal scores, equal rank
    byte_ids: list[int]
    kinds: np.ndarray
    surface: list[bytes]        # of each id when it is decoded
    prefix: bool                # a marker is put before each text

    def segment(self, chunk: str) -> list[int]:
        """Ids of one chunk: the adjacent pair that makes the best piece is merged, the leftmost of
        equals first, until none makes a piece. A single character that is no piece becomes its bytes.

        The heap holds rank * n + position; an entry counts only while the pair at its position
        still has its rank.
        """
        rank_of = self.rank_of.get
        symbol = list(chunk)
        n = len(symbol)
        live = [rank_of(a + b, -1) for a, b in zip(symbol, symbol[1:])]
        live.append(-1)
        heap = [rank * n + i for i, rank in enumerate(live) if rank >= 0]
        heapify(heap)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            rank, i = divmod(heappop(heap), n)
            if live[i] != rank:
                continue
            j = right[i]
            new = symbol[i] = symbol[i] + symbol[j]
            symbol[j] = ""
            live[j] = live[i] = -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                live[i] = rank = rank_of(new + symbol[k], -1)
                if rank >= 0:
                    heappush(heap, rank * n + i)
            h = left[i]
            if h >= 0:
                live[h] = rank = rank_of(symbol[h] + new, -1)
                if rank >= 0:
                    heappush(heap, rank * n + h)
        out: list[int] = []
        for s in filter(None, symbol):
            if s in self.id_of:
                out.append(self.id_of[s])
            else:
                out += [self.byte_ids[b] for b in s.encode()]
        return out

    def text(self, ids: list[int]) -> str:
        """Decoded text. Neighbouring byte pieces are read as UTF-8 together, each byte that fits no
        character becomes U+FFFD; control pieces give nothing; the marker before the text goes."""
        out, run, begun = [], bytearray(), False

        def flush() -> None:
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[at:at + size].decode())
                        at += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i in ids:
            if self.kinds[i] == BYTE:
                run += self.surface[i]
                begun = True
                continue
            flush()
            piece = self.surface[i].decode()
            if self.kinds[i] == NORMAL and not begun and self.prefix and piece.startswith(" "):
                piece = piece[1:]
            begun = begun or self.kinds[i] != CONTROL
            out.append(piece)
        flush()
        return "".join(out)


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    """Read a model file. Models for which chunks would not be exact raise ValueError."""
    from sentencepiece import sentencepiece_model_pb2 as format

    model = format.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    trained, norm = model.trainer_spec, model.normalizer_spec
    names, kinds = [p.piece for p in model.pieces], np.array([p.type for p in model.pieces])
    if trained.model_type != BPE or not trained.byte_fallback or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("only byte-pair models with byte fallback and without user-defined or unused pieces")
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or trained.treat_whitespace_as_suffix:
        raise ValueError("only models that keep characters and white space as they are")
    if any(MARKER in name.lstrip(MARKER) for name, kind in zip(names, kinds) if kind == NORMAL):
        raise ValueError("pieces of this model cross white space, so texts can't be cut there")
    normal = [(p.piece.replace(MARKER, " "), i, p.score) for i, p in enumerate(model.pieces) if p.type == NORMAL]
    order = {score: rank for rank, score in enumerate(sorted({-s for _, _, s in normal}))}
    of_byte = {int(name[3:5], 16): i for i, name in enumerate(names) if kinds[i] == BYTE}
    surface = [b"" if kind == CONTROL else trained.unk_surface.encode() if kind == UNKNOWN else bytes([int(name[3:5], 16)])
               if kind == BYTE else name.replace(MARKER, " ").encode() for name, kind in zip(names, kinds)]
    return Pieces({name: i for name, i, _ in normal}, {name: order[-s] for name, _, s in normal},
                  [of_byte[b] for b in range(256)], kinds, surface, norm.add_dummy_prefix)


def _chunks(texts: pa.Array, prefix: bool) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(different chunks, number of each chunk in order, chunks per text)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if pc.any(pc.match_substring(texts, MARKER)).as_py():
        texts = pc.replace_substring(texts, MARKER, " ")
    if prefix:
        none = pa.scalar("", pa.large_string())
        texts = pc.if_else(pc.equal(texts, none), none, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, none))
    data, at = bytes_of(texts)
    space = data == 0x20
    start = space.copy()
    start[1:] &= ~space[:-1]
    start[at[:-1][np.diff(at) > 0]] = True
    first = np.flatnonzero(start)
    ends = np.append(first, len(data)).astype(np.int64)
    cut = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))
    coded = cut.dictionary_encode()
    return coded.dictionary, coded.indices, np.diff(np.searchsorted(first, at)).astype(np.int32)


def _list(values: pa.Array) -> pa.Array:
    """One row that holds all the values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _packs(chunks: pa.Array, buckets: int, whole: bool) -> tuple[pa.StructArray | None, np.ndarray]:
    """(with `whole`, the chunks by bucket of their hash, sorted inside one; number of each given chunk in that order)."""
    data, at = bytes_of(chunks)
    order = pc.sort_indices(chunks).to_numpy().astype(np.int64)
    bucket = (range_hashes(data, at[:-1], at[1:]) % np.uint64(buckets)).astype(np.int32)[order]
    inside = np.argsort(bucket, kind="stable")
    order, bucket = order[inside], bucket[inside]
    number = np.empty(len(order), np.uint32)
    number[order] = np.arange(len(order), dtype=np.uint32)
    if not whole:
        return None, number
    data, at = bytes_of(chunks.take(pa.array(order)))
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(first[1:], len(bucket))
    lengths = np.diff(at).astype(np.uint32)
    return pa.StructArray.from_arrays([
        pa.array(bucket[first]), pa.array(first.astype(np.int32)),
        pa.array([pack(lengths[i:j]) for i, j in zip(first, ends)], pa.binary()),
        pa.array([pack_bytes(data[at[i]:at[j]]) for i, j in zip(first, ends)], pa.binary())],
        names=["bucket", "number", "lengths", "chars"]), number


def encode(df: DataFrame, model: str, id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: its id and `ids` (array of int), the ids of its whole text, without begin or end.

    `model` is the path, on every worker, of a byte-pair SentencePiece model with byte fallback whose
    pieces don't cross white space (others raise ValueError). Null and empty texts have no ids.
    Repeated rows and ids each give a row; other columns are not read; an empty table gives none. A
    text of any length is one block. Text is never normalised other than by the marker, which is
    also what the marker's own character in a text means.

    `df` must give the same rows in the same order when it is read again, as a table of files does;
    else RuntimeError says so, and `df` should be written first. Memory of a task: one block (`block_bytes` of texts, or one longer text) and a sort buffer.
    """
    ids_type = np.uint16 if len(pieces_of(model).surface) <= 1 << 16 else np.uint32     # also says now if the model doesn't fit
    id_type = df.schema[id].dataType.simpleString()
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        prefix, number = pieces_of(model).prefix, TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            for begin, end, data, at in slices(texts, block_bytes):
                mark = hashlib.blake2b(data.tobytes() + at.tobytes(), digest_size=8).digest()
                yield number, int.from_bytes(mark, "little", signed=True), ids.slice(begin, end - begin), *_chunks(texts.slice(begin, end - begin), prefix)
                number += 1

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, mark, ids, chunks, places, sizes in cut(batches):
            _, renumbered = _packs(chunks, tasks * BUCKETS, False)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([mark], pa.int64()), _list(ids), _list(pa.array(sizes)),
                 pa.array([pack(renumbered[places.to_numpy()])], pa.binary())], names=["block", "mark", "ids", "sizes", "places"])

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, mark, _, chunks, _, _ in cut(batches):
            made, _ = _packs(chunks, tasks * BUCKETS, True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(made), v), pa.int64()) for v in (number, mark)] + made.flatten(),
                names=["block", "mark", "bucket", "number", "lengths", "chars"])

    def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = unpack(row["lengths"], np.uint32)
                at = np.append(0, np.cumsum(lengths, dtype=np.int64))
                chunks = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(at), pa.py_buffer(unpack_bytes(row["chars"])))
                same = [pa.array(np.full(len(lengths), row[name])) for name in ("block", "mark", "bucket")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(len(lengths), dtype=np.int32) + row["number"]), chunks.cast(pa.string())],
                                                 names=["block", "mark", "bucket", "number", "chunk"])

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks come sorted, so each is worked out once; what a block gets from a batch is one row."""
        pieces, last = pieces_of(model), ("", [])
        for batch in batches:
            coded = batch.column("chunk").dictionary_encode()
            found = [last[1] if chunk == last[0] else pieces.segment(chunk) for chunk in coded.dictionary.to_pylist()]
            if not found:
                continue
            last = (batch.column("chunk")[-1].as_py(), found[-1])
            which, block = coded.indices.to_numpy(), batch.column("block").to_numpy()
            lengths, number = np.array([len(f) for f in found], np.uint32), batch.column("number").to_numpy()
            order = np.lexsort((number, block))
            first = np.flatnonzero(np.diff(block[order], prepend=-1))
            rows = []
            for of in np.split(order, first[1:]):
                flat = [i for w in which[of].tolist() for i in found[w]]
                rows.append((pack(np.diff(number[of].astype(np.uint32), prepend=np.uint32(0))), pack(lengths[which[of]]),
                             pack(np.array(flat, ids_type))))
            one = [batch.column(name).take(pa.array(order[first])) for name in ("block", "mark")]
            yield pa.RecordBatch.from_arrays([*one, *(pa.array(list(c), pa.binary()) for c in zip(*rows))],
                                             names=["block", "mark", "numbers", "lengths", "pieces"])

    given = pick(df, id=id, text=text)
    met = given.mapInArrow(packs, "block long, mark long, bucket int, number int, lengths binary, chars binary").repartition(tasks, "bucket")
    found = met.mapInArrow(chunks_of, "block long, mark long, bucket long, number int, chunk string").sortWithinPartitions("bucket", "chunk") \
        .mapInArrow(segment, "block long, mark long, numbers binary, lengths binary, pieces binary")
    of_block = found.groupBy("block", "mark").agg(F.collect_list(F.struct("numbers", "lengths", "pieces")).alias("entries"))     # a block's, so bounded
    whole = given.mapInArrow(blocks, f"block long, mark long, ids array<{id_type}>, sizes array<int>, places binary") \
        .join(of_block, ["block", "mark"], "left").select("ids", "sizes", "places", "entries")

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, sizes = batch.column("ids").slice(row, 1).flatten(), batch.column("sizes").slice(row, 1).flatten().to_numpy()
                entries = batch.column("entries")[row].as_py() or []
                places = unpack(batch.column("places")[row].as_py(), np.uint32)
                numbers, lengths, pieces = (
                    np.concatenate([np.zeros(0, kind), *parts]) for kind, parts in (
                        (np.uint32, [np.cumsum(unpack(e["numbers"], np.uint32), dtype=np.uint32) for e in entries]),
                        (np.uint32, [unpack(e["lengths"], np.uint32) for e in entries]), (ids_type, [unpack(e["pieces"], ids_type) for e in entries])))
                if len(places) and (not len(numbers) or len(numbers) <= places.max()):
                    raise RuntimeError("the table gave other rows when it was read again; write it to a file first")
                start, size = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
                start[numbers], size[numbers] = np.cumsum(lengths, dtype=np.int64) - lengths, lengths
                at = np.append(0, np.cumsum(sizes, dtype=np.int64))
                begin = 0
                while begin < len(sizes):       # so many texts that their chunks fill one part
                    end = max(begin + 1, int(np.searchsorted(at, at[begin] + PART, "right")) - 1)
                    part = places[at[begin]:at[end]]
                    counts = size[part]
                    before = np.append(0, np.cumsum(counts))
                    values = pieces[np.repeat(start[part] - before[:-1], counts) + np.arange(before[-1])].astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(begin, end - begin),
                         pa.ListArray.from_arrays(pa.array(before[at[begin:end + 1] - at[begin]], pa.int32()), pa.array(values))], names=["id", "ids"])
                    begin = end

    return whole.mapInArrow(together, f"id {id_type}, ids array<int>").withColumnRenamed("id", id)


def decode(df: DataFrame, model: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: its id and `text`, what its ids decode to; null ids or none give an empty text.

    Any ids of the model may come in any order; others raise an error. Repeated rows each give a row, other
    columns are not read, an empty table gives none. One scan, a batch at a time.
    """
    id_type = df.schema[id].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        surface = pa.array(pieces.surface, pa.large_binary())
        plain = pieces.kinds == NORMAL
        for batch in batches:
            all_ids = pc.fill_null(batch.column("ids"), pa.scalar([], batch.column("ids").type))
            upto = np.append(0, np.cumsum(pc.list_value_length(all_ids).to_numpy(zero_copy_only=False), dtype=np.int64))
            begin = 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + PART, "right")) - 1)
                flat, at = all_ids.slice(begin, end - begin).flatten(), upto[begin:end + 1] - upto[begin]
                lists = pa.LargeListArray.from_arrays(pa.array(at), surface.take(flat))
                joined = pc.binary_join(lists, pa.scalar(b"", pa.large_binary())).to_pylist()
                odd = np.append(0, np.cumsum(~plain[flat.to_numpy()]))
                odd = np.diff(odd[at])
                texts = []
                for row, whole in enumerate(joined):
                    if odd[row]:
                        # byte and control pieces: whole characters only where the bytes are right
                        part = flat.slice(at[row], at[row + 1] - at[row]).to_numpy()
                        kinds = pieces.kinds[part]
                        if kinds[0] != NORMAL or not np.isin(kinds, (NORMAL, BYTE)).all() or not _whole(whole):
                            texts.append(pieces.text(part.tolist()))
                            continue
                    texts.append(whole[1:].decode() if pieces.prefix and whole.startswith(b" ") else whole.decode())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(begin, end - begin), pa.array(texts, pa.string())], names=["id", "text"])
                begin = end

    return pick(df, id=id, ids=ids).mapInArrow(read, f"id {id_type}, text string").withColumnRenamed("id", id)


def _whole(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True
