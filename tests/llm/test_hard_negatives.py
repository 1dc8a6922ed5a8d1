"""Hard negatives against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tableprofile.llm import hard_negatives

ROWS = "vec_id long, embedding array<float>, label int, id string, node long, cell long, score long"


def brute_force(rows, anchor, positives=5, negatives=3, low=50, high=95):
    known = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            known.append((i, label, [math.floor(256 * x) for x in v]))
    out = []
    for at, (a, label, v) in enumerate(known):
        if not anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other == label) for n, (i, other, w) in enumerate(known) if n != at)
        for s, p, _ in [r for r in scored if r[2]][:positives]:
            fitting = [(i, t) for t, i, same in scored if not same and low * -s <= 100 * -t <= high * -s]
            out += [(a, p, r, i, -s, -t) for r, (i, t) in enumerate(fitting[:negatives], 1)]
    return sorted(out)


def vectors(seed, n, dims, labels, clusters=0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(clusters or 1)]
    out = []
    for i in rng.sample(range(3 * n), n):
        c = rng.choice(centres) if clusters else [0.0] * dims
        spread = 0.2 if clusters else 1.0
        # eighths: many equal scores
        out.append((i, [round(8 * (x + rng.gauss(0, spread))) / 8 for x in c], rng.randrange(labels)))
    return out


def check(spark, rows, anchor=(lambda i: i % 10 == 0), condition=None, **options):
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], ROWS).repartition(3)
    found = hard_negatives.hard_negatives(df, F.col("id") % 10 == 0 if condition is None else condition, **options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(tuple(r) for r in found.collect())
    named = {k: options[k] for k in ("positives", "negatives", "low", "high") if k in options}
    assert got == brute_force(rows, anchor, **named)
    return got


@pytest.mark.parametrize("clusters", [0, 6])
def test_all_pairs(spark, monkeypatch, clusters):
    """Many small cells and parts, so that rounds, stops and splits all happen."""
    monkeypatch.setattr(hard_negatives, "FIRST_CELLS", 2)
    monkeypatch.setattr(hard_negatives, "PART_NODES", 20)
    monkeypatch.setattr(hard_negatives, "PART_QUERIES", 7)
    assert check(spark, vectors(1, 400, 6, 4, clusters), cell_nodes=8)


def test_copies_nulls_and_repeated_ids(spark):
    rows = vectors(2, 120, 4, 3)
    base = rows[0][1]
    rows += [(1000 + i, base, i % 2) for i in range(60)]            # one vector, two labels
    rows += [(2000, [0.0] * 4, 0), (2010, [-0.0] * 4, 0), (2020, [1.0, None, 0.0, 0.0], 1), (2030, [1.0, float("nan"), 0.0, 0.0], 1),
             (2040, [float("inf")] * 4, 1), (2050, None, 1), (2060, [1.0] * 4, None), (None, [1.0] * 4, 1)]
    rows += [rows[5], rows[5], (1010, base, 0), (1010, [0.5] * 4, 0)]
    check(spark, rows)


def test_short_lists_and_options(spark):
    rows = vectors(3, 60, 3, 2)
    check(spark, rows, positives=2, negatives=7, low=0, high=100)
    check(spark, rows[:4] + [(10, [1.0, 1.0, 1.0], 9), (20, [1.0, 0.9, 1.0], 9)])       # fewer than asked for
    uneven = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [1.0], 0), (2, [0.75], 1), (3, [], 1)], "vec_id long, embedding array<double>, label int")
    got = [tuple(r) for r in hard_negatives.hard_negatives(uneven, F.col("id") == 0).collect()]
    assert got == [(0, 1, 1, 2, 65536, 49152)]


def test_empty(spark):
    empty = spark.createDataFrame([], ROWS)
    assert hard_negatives.hard_negatives(empty, F.col("id") % 50 == 0).count() == 0
    assert check(spark, vectors(4, 30, 2, 2), lambda i: False, F.lit(False)) == []


def test_cells_come_in_order_of_their_bounds():
    import numpy as np

    rng = np.random.default_rng(5)
    points = rng.normal(size=(300, 6)) * 100
    words = [hard_negatives._codebook(points[:, :3], 5), hard_negatives._codebook(points[:, 3:], 5)]
    (i, near), (j, far) = hard_negatives._nearest(points[:, :3], words[0]), hard_negatives._nearest(points[:, 3:], words[1])
    radii = np.array([[d[w == c].max(initial=0) for c in range(5)] for w, d in ((i, near), (j, far))])
    one = {"words": words, "radii": radii, "counts": np.bincount(i * 5 + j, minlength=25)}
    for query in points[:20]:
        scores, skip, all_cells, last = points @ query, 0, [], np.inf
        while True:
            cells, skip, bound = hard_negatives._cells_in_order(one, query, skip, 3, -np.inf)
            for c in cells:
                assert scores[i * 5 + j == c].max() <= last
            all_cells += cells
            if bound is None:
                break
            last = bound
            rest = ~np.isin(i * 5 + j, all_cells)
            assert scores[rest].max() <= bound
        assert sorted(all_cells) == sorted(set(i * 5 + j))
