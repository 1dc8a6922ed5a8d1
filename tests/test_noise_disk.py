"""Disk that DBSCAN noise holds: packed tables, deleted when they were read, and turns of bounded size."""

import os

import numpy as np
import pandas as pd
import pytest

from tableprofile.operators import dbscan, features
from tableprofile.plans import boxes
from tableprofile.plans.cuts import cut, packed, with_row_id

ROWS = 20_000


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(11)
    table = pd.DataFrame({"row_id": np.arange(ROWS), "x": rng.normal(size=ROWS).round(2), "y": rng.normal(size=ROWS).round(2), "z": rng.integers(0, 5, ROWS).astype(float)})
    table.loc[:2_000, ["x", "y", "z"]] = 0.0            # a location of many rows
    table.loc[0, "x"] = -0.0
    return table


def held(spark):
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if not f.endswith(".crc"))


def test_noise_in_turns_leaves_little_on_disk(spark, points, monkeypatch):
    df = spark.createDataFrame(points)
    f = features.features(df, "row_id", ["x", "y", "z"])
    x = (points[["x", "y", "z"]].to_numpy() - f.means) / f.stds
    near = [np.flatnonzero(((x - p) ** 2).sum(axis=1) <= 0.04) for p in x]
    core = np.array([len(n) >= 5 for n in near])
    want = {i for i, n in enumerate(near) if not core[n].any()}
    alive, parts = [], []
    discard = boxes.discard
    monkeypatch.setattr(boxes, "discard", lambda table: (alive.append(held(spark)), discard(table), alive.append(held(spark))))
    in_turns = dbscan._in_turns
    monkeypatch.setattr(dbscan, "_in_turns", lambda *a: parts.append(in_turns(*a)) or parts[-1])
    for turn_rows, turns in ((10_000_000, 1), (100, dbscan.TURNS)):
        monkeypatch.setattr(dbscan, "TURN_ROWS", turn_rows)
        before = held(spark)
        got = dbscan.dbscan_noise(f, 0.2, 5, box_rows=1_000)
        assert held(spark) - before < ROWS * 8        # a version of the locations has 40 bytes a row and more
        assert {r.row_id for r in got.collect()} == want and want
        assert [len(p) for p in parts[-2:]] == [turns, turns]
    assert alive[1] < alive[0]


def test_packed_tables_are_small_and_whole(spark, points):
    df = spark.createDataFrame(points.drop(columns="row_id")).selectExpr("*", "CAST(NULL AS string) AS `odd, name`", "CAST('NaN' AS double) AS n")
    before = held(spark)
    rows = with_row_id(df)
    assert held(spark) - before < ROWS * 30
    assert rows.columns == [*df.columns, "row_id"] and rows.select("row_id").distinct().count() == ROWS
    assert sorted(map(str, rows.drop("row_id").collect())) == sorted(map(str, df.collect()))
    for other in (df.selectExpr("x", "y AS x"), df.selectExpr("array(x) AS x", "NULL AS nothing")):
        assert packed(other).count() == ROWS and packed(other).columns == cut(other).columns
