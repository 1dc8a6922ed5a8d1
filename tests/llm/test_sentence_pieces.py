"""SentencePiece encoding and decoding against the library."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

import fixtures
from tableprofile.llm import sentence_pieces
from tableprofile.llm.queries import QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")
library = pytest.importorskip("sentencepiece")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def reference():
    return library.SentencePieceProcessor(model_file=MODEL)


ODD = [" ", "  ", "a", "the", "ing", "\n", "\t", "▁", "é", "\U0001f600", "x1", "2024", "<s>", "<0x41>", "\x00", "中", "文", "ﬁ", "́", "(", "=="]


def odd_texts(n: int) -> list[str]:
    rng = random.Random(5)
    return ["".join(rng.choices(ODD, k=rng.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("block_bytes", [50, 8_000_000])
def test_encode_and_decode(spark, reference, block_bytes):
    rows = fixtures.rows() + [(2000 + i, t, None, None, None, None, None, None, None, None) for i, t in enumerate(odd_texts(300))]
    rows.append((3000, "ab▁ c" * 60_000, None, None, None, None, None, None, None, None))      # white space only by marker
    rows.append((3001, "abcdefg" * 30_000, None, None, None, None, None, None, None, None))   # one word
    if block_bytes == 50:
        rows = [r for r in rows if len(r[1] or "") < 3000]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 5), fixtures.DOCS)
    ids = sentence_pieces.encode(df, MODEL, block_bytes=block_bytes)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted(((r.doc_id, list(r.ids)) for r in ids.collect()), key=key)
    assert got == sorted(((r[0], reference.encode(r[1] or "")) for r in rows), key=key)
    text = sorted(((r.doc_id, r.text) for r in sentence_pieces.decode(ids, MODEL).collect()), key=key)
    assert text == sorted(((r[0], reference.decode(reference.encode(r[1] or ""))) for r in rows), key=key)


def test_decode_any_ids(spark, reference):
    rng = random.Random(8)
    pool = [0, 1, 2, 259, 28705, 3 + 0xE2, 3 + 0x96, 3 + 0x81, 3 + 0xC3, 3 + 0xA9, 3 + 0xF0]
    rows = [(i, [rng.choice(pool + [rng.randrange(259, 32000)] * 8) for _ in range(rng.randint(0, 9))]) for i in range(1500)]
    rows += [(5000, []), (5000, [])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    got = sorted((r.doc_id, r.text) for r in sentence_pieces.decode(df, MODEL).collect())
    assert got == sorted((i, reference.decode(ids) if ids else "") for i, ids in rows)
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert [tuple(r) for r in sentence_pieces.decode(nothing, MODEL).collect()] == [(1, "")]


def test_empty_table_and_other_id(spark, reference):
    empty = spark.createDataFrame([], fixtures.DOCS)
    done = sentence_pieces.encode(empty, MODEL)
    assert done.count() == 0 and sentence_pieces.decode(done, MODEL).count() == 0
    named = spark.createDataFrame([("a", "x y"), (None, None)], "id string, ids string")
    got = {r.id: list(r.ids) for r in sentence_pieces.encode(named, MODEL, id="id", text="ids").collect()}
    assert got == {"a": reference.encode("x y"), None: []}


def test_rows_that_change(spark):
    """A table that gives other rows each time it is read is an error, not a wrong result."""
    changing = F.udf(lambda i: f"word {i} {time.time_ns()}", "string").asNondeterministic()
    shifting = spark.range(50).select(F.col("id").alias("doc_id"), changing("id").alias("text"))
    with pytest.raises(Exception, match="other rows"):
        sentence_pieces.encode(shifting, MODEL).collect()


def test_models_that_do_not_fit(spark, tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as format

    def changed(change) -> str:
        model = format.ModelProto()
        with open(MODEL, "rb") as file:
            model.ParseFromString(file.read())
        change(model)
        path = tmp_path / f"{random.random()}.model"
        path.write_bytes(model.SerializeToString())
        return str(path)

    def crossing(model):
        model.pieces[400].piece = "of▁the"

    def unigram(model):
        model.trainer_spec.model_type = 1

    def squeezed(model):
        model.normalizer_spec.remove_extra_whitespaces = True

    for change in (crossing, unigram, squeezed):
        with pytest.raises(ValueError):
            sentence_pieces.pieces_of(changed(change))


def test_query(spark, reference, tmp_path):
    rows = fixtures.rows(seed=3)
    spark.createDataFrame(rows, fixtures.DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    hashed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in rows:
        ids = reference.encode(r[1] or "")
        want.append((r[0], len(ids), hashed(",".join(map(str, ids))), hashed(reference.decode(ids))))
    got = [tuple(r) for r in QUERIES["op13_sentence_pieces"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
