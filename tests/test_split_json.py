"""JSON arrays in files of many splits, against the json module."""

import json
import random

import pytest

from tableprofile.sources import split_json
from tableprofile.sources.readers import read_json


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def objects(rng, n):
    odd = ["plain", "br}ace", "{[", '"quoted"', "back\\slash", "\\", "]}", '\\"}', "é\n\t", "", "x" * 300]
    return [{"id": i, "a": rng.choice(odd), "b": {"c": rng.choice(odd), "d": [{"e": rng.choice(odd)} for _ in range(rng.randint(0, 3))]},
             "l": [rng.choice(odd) for _ in range(rng.randint(0, 3))]} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
def test_many_splits(spark, tmp_path, small_splits, indent):
    rng = random.Random(7)
    want, folder = [], tmp_path / "t.json"
    folder.mkdir()
    for part in range(3):
        mine = objects(rng, 150)
        want += mine
        (folder / f"part{part}.json").write_text(json.dumps(mine, indent=indent, ensure_ascii=bool(part % 2)) + "\n" * part, encoding="utf-8")
    lines = spark.read.text(split_json.array_lines(spark, str(folder)))
    assert lines.rdd.getNumPartitions() > 10
    assert sorted((json.loads(r.value) for r in lines.collect()), key=repr) == sorted(want, key=repr)
    flat = read_json(spark, str(folder))
    assert sorted((r.id, r.a, r["b.c"]) for r in flat.collect()) == sorted((o["id"], o["a"], o["b"]["c"]) for o in want)


def test_objects_longer_than_splits(spark, tmp_path, small_splits):
    long = {"id": 1, "a": "}{" * 4000, "b": [{"x": "]" * 500, "y": i} for i in range(40)]}
    want = [{"id": 0, "a": "s"}, long, {"id": 2, "a": "t"}, {**long, "id": 3}]
    path = tmp_path / "long.json"
    path.write_text(json.dumps(want))
    lines = spark.read.text(split_json.array_lines(spark, str(path)))
    assert sorted((json.loads(r.value) for r in lines.collect()), key=lambda o: o["id"]) == want


def test_other_documents(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"id": 1,\n "a": [1, 2]}')
    assert split_json.array_lines(spark, str(tmp_path / "one.json")) is None
    assert [tuple(r) for r in read_json(spark, str(tmp_path / "one.json")).select("id", "a").collect()] == [(1, "1|2")]
    (tmp_path / "two.json").write_text(' [ {"id": 1} ,\n{"id": 2}]')
    assert sorted(r.id for r in read_json(spark, str(tmp_path / "two.json"), lines=False).collect()) == [1, 2]
