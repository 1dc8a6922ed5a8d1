"""CSV records that span lines, in files of many splits, against Python's csv module."""

import csv
import io
import random

import pytest

from tableprofile.sources import split_csv
from tableprofile.sources.readers import read_csv


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def text_of(rows, line_end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=line_end).writerows(rows)
    return out.getvalue()


def sample(rng, n, first=0):
    words = ["plain", "a,b", 'say "hi"', "two\nlines", '"', "\n\n", "", "x\n\"y\",\n", "long " * 30]
    return [(str(first + i), rng.choice(words), rng.choice(words), rng.choice(words) + "." + rng.choice(words)) for i in range(n)]


def as_read(rows):
    return sorted(tuple(v if v != "" else None for v in r) for r in rows)


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_many_splits(spark, tmp_path, small_splits, line_end):
    rng = random.Random(4)
    rows, folder = [], tmp_path / "t.csv"
    folder.mkdir()
    for part in range(3):
        mine = sample(rng, 400, part * 1000)
        rows += mine
        (folder / f"part{part}.csv").write_text(text_of([("id", "a", "b", "c"), *mine], line_end), newline="")
    assert len(split_csv.breaks_in_quotes(spark, str(folder)).collect()) > 20
    got = read_csv(spark, str(folder))
    assert got.rdd.getNumPartitions() > 10
    assert sorted(tuple(None if v == "" else v for v in (str(r.id), r.a, r.b, r.c)) for r in got.collect()) == as_read(rows)


def test_records_longer_than_splits(spark, tmp_path, small_splits):
    rng = random.Random(6)
    long = "\n".join(f"line {i} \"quoted\", with, commas" for i in range(800))
    rows = [*sample(rng, 50), ("900", long, "x", "y"), *sample(rng, 50, 1000), ("901", "z", long, long), ("902", "end\n", "", "e")]
    path = tmp_path / "long.csv"
    path.write_text(text_of([("id", "a", "b", "c"), *rows]))
    got = read_csv(spark, str(path)).collect()
    assert sorted(tuple(None if v == "" else v for v in (str(r.id), r.a, r.b, r.c)) for r in got) == as_read(rows)


def test_quotes_inside_fields_are_text(spark, tmp_path, small_splits):
    """A stray quote opens nothing: the plain reader is used, and the same rows come."""
    path = tmp_path / "stray.csv"
    path.write_text("id,size\n" + "".join(f"{i},{i}\" pipe\n" for i in range(3000)))
    assert split_csv.breaks_in_quotes(spark, str(path)) is None
    got = read_csv(spark, str(path))
    assert got.rdd.getNumPartitions() > 5
    assert sorted((r.id, r["size"]) for r in got.collect()) == [(i, f'{i}" pipe') for i in range(3000)]


def test_states_of_lines():
    import pyarrow as pa

    lines = ["a,b", '"a', 'a"', 'x,"y', '"a","b"', '"a""', '""', 'a"b', '"a"b,"c', '"a"",b', ',"', '"a,b"c"d,"e"']
    at, outside, inside = split_csv._steps(pa.array(lines))

    def open_at_end(text):
        """Character by character."""
        state, i = "start", 0
        while i < len(text):
            c = text[i]
            if state == "start":
                state = "quoted" if c == '"' else "start" if c == "," else "plain"
            elif state == "plain":
                state = "start" if c == "," else "plain"
            elif c == '"':
                if text[i + 1:i + 2] == '"':
                    i += 1
                else:
                    state = "start" if text[i + 1:i + 2] == "," else "plain"
                    i += text[i + 1:i + 2] == ","
            i += 1
        return int(state == "quoted")

    assert at.tolist() == [i for i, x in enumerate(lines) if '"' in x]
    assert outside == [open_at_end(lines[i]) for i in at]
    assert inside == [open_at_end('"' + lines[i]) for i in at]


def test_empty_files_and_lines(spark, tmp_path):
    (tmp_path / "one.csv").write_text('id,note\n\n1,"a\n\nb"\n\n2,c\n\n')
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "one.csv")).orderBy("id").collect()] == [(1, "a\n\nb"), (2, "c")]
    (tmp_path / "two.csv").write_text('id,"no\nte"\n1,x\n')
    got = read_csv(spark, str(tmp_path / "two.csv"))
    assert [tuple(r) for r in got.collect()] == [(1, "x")] and got.columns == ["id", "no\nte"]
    (tmp_path / "three.csv").write_text("id,note\n")
    assert read_csv(spark, str(tmp_path / "three.csv")).count() == 0
