"""Quantiles and the multi-column outlier methods against plain NumPy."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tableprofile.operators import consensus, dbscan, features, isolation_forest, kmeans, lof, outliers
from tableprofile.plans.boxes import cut_boxes, touched, tree_of
from tableprofile.plans.cuts import cut, hot_split_join, with_row_id
from tableprofile.plans.quantiles import exact_quantiles


def frame(spark, points):
    names = [f"p{i}" for i in range(points.shape[1])]
    pdf = pd.DataFrame(points, columns=names)
    pdf.insert(0, "id", range(len(pdf)))
    return spark.createDataFrame(pdf).repartition(4)


@pytest.fixture(scope="module")
def cloud():
    """Two clusters, a clump of identical rows, a discrete column, a few far points."""
    rng = np.random.default_rng(3)
    a = np.column_stack([rng.normal(0, 1, 350), rng.normal(0, 1, 350), rng.integers(0, 4, 350)])
    b = np.column_stack([rng.normal(9, 0.3, 250), rng.normal(9, 0.3, 250), rng.integers(0, 4, 250)])
    clump = np.tile([[2.0, 2.0, 1.0]], (180, 1))
    far = np.array([[40.0, -35.0, 3.0], [-30.0, 30.0, 0.0], [4.5, 4.5, 2.0]])
    return np.vstack([a, b, clump, far])


@pytest.fixture(scope="module")
def cloud_features(spark, cloud):
    return features.features(frame(spark, cloud), "id")


def test_quantiles(spark):
    rng = np.random.default_rng(1)
    data = {"u": rng.uniform(size=5000), "n": rng.normal(size=5000), "d": rng.integers(0, 5, 5000).astype(float),
            "heavy": np.where(rng.uniform(size=5000) < 0.9, 7.0, rng.uniform(size=5000)),
            "edge": np.concatenate([np.full(1250, 0.0), rng.uniform(size=3750)]), "same": np.full(5000, 3.0)}
    df = spark.createDataFrame(pd.DataFrame(data)).repartition(4)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    for distinct in (100_000, 50):
        got = exact_quantiles(df, {c: F.col(c) for c in data}, probs, rank_distinct=distinct)
        for c, v in data.items():
            assert np.allclose(got[c], np.quantile(v, probs), rtol=1e-12, atol=1e-12), c
    nothing = df.where("u > 2")
    assert exact_quantiles(nothing, {"u": F.col("u")}, [0.5]) == {"u": [None]}


def test_quantiles_ignore_nulls_and_extremes(spark):
    df = spark.createDataFrame([(None,), (1.0,), (2.0,), (1e300,), (-1e300,)], "x double")
    assert exact_quantiles(df, {"x": F.col("x")}, [0.5], rank_distinct=1)["x"] == [1.5]


def test_single_column_outliers(spark):
    values = [float(i % 10) for i in range(200)] + [500.0, None, float("nan")]
    df = spark.createDataFrame([(i, v, 1.0, v if i < 50 else None) for i, v in enumerate(values)],
                               "id long, x double, same double, gaps double")
    got = {r["column"]: r for r in outliers.outlier_summary(df).collect()}
    assert set(got) == {"id", "x"}                      # one distinct value; more than half nulls
    x = np.array(values[:201])
    assert got["x"].total_values == 203 and got["x"].zscore_outliers == 1 and got["x"].iqr_outliers == 1
    assert got["x"].std_dev == pytest.approx(x.std(ddof=1)) and got["x"].q3 == np.quantile(x, 0.75)
    assert got["x"].zscore_outlier_pct == pytest.approx(100 / 203)
    assert [r.id for r in outliers.outlier_rows(df, "x", "iqr", "id").collect()] == [200]
    assert sorted(r.method for r in outliers.outlier_export(df, "x", "id").collect()) == ["IQR", "Z-score"]
    summary = outliers.outlier_summary(df)
    assert outliers.outlier_overview(summary).first().methods_differ is False
    assert {r["column"]: r.high_variability for r in outliers.outlier_flags(summary).collect()} == {"x": True}
    assert outliers.outlier_summary(df.where("id < 0")).count() == 0


def test_features(spark):
    df = spark.createDataFrame([(1, 1.0, 5, 2.0), (2, None, 5, 2.0), (3, float("nan"), 5, 1.0), (4, 3.0, 5, -0.0)],
                               "id int, a double, b int, c double")
    f = features.features(df, "id")
    assert f.names == ["a", "b", "c"] and f.count == 2
    scaled = {r.row_id: tuple(r)[1:] for r in features.standardise(df, "id").collect()}
    assert scaled == {1: (-1.0, 0.0, 1.0), 4: (1.0, 0.0, -1.0)}
    with pytest.raises(ValueError):
        features.features(df, "id", ["a"])


def brute_noise(x, eps, m):
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= m
    return set(np.flatnonzero(~core & ~(near & core[None]).any(1)))


@pytest.mark.parametrize("eps,m", [(0.5, 5), (0.12, 5), (0.3, 40), (3.0, 5)])
def test_dbscan(cloud, cloud_features, eps, m):
    x = (cloud - cloud.mean(0)) / cloud.std(0)
    got = {r.row_id for r in dbscan.dbscan_noise(cloud_features, eps, m).collect()}
    assert got == brute_noise(x, eps, m)


@pytest.mark.parametrize("box_rows", [40, 7])
def test_dbscan_many_boxes(cloud, cloud_features, box_rows):
    x = (cloud - cloud.mean(0)) / cloud.std(0)
    got = {r.row_id for r in dbscan.dbscan_noise(cloud_features, 0.12, 5, box_rows, guests_per_task=9).collect()}
    assert got == brute_noise(x, 0.12, 5)


@pytest.mark.parametrize("dims", [2, 5, 7])
def test_dbscan_dimensions(spark, dims):
    rng = np.random.default_rng(dims)
    points = np.vstack([rng.normal(size=(150, dims)), rng.normal(6, 0.2, size=(150, dims))])
    f = features.features(frame(spark, points), "id", [f"p{i}" for i in range(dims)])
    x = (points - points.mean(0)) / points.std(0)
    got = {r.row_id for r in dbscan.dbscan_noise(f, 0.4, 5).collect()}
    assert got == brute_noise(x, 0.4, 5)


def brute_lof(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    n = len(x)
    # ties: all rows of the location whose first row comes first
    _, first, inverse = np.unique(x, axis=0, return_index=True, return_inverse=True)
    location = first[inverse.ravel()]
    order = np.array([[j for j in np.lexsort((np.arange(n), location, d[i])) if j != i][:k] for i in range(n)])
    near = np.take_along_axis(d, order, 1)
    k_distance = near[:, -1]
    lrd = 1.0 / (np.maximum(near, k_distance[order]).mean(1) + 1e-10)
    return lrd[order].mean(1) / lrd


@pytest.mark.parametrize("box_rows", [10_000, 120, 25])
def test_lof(cloud, cloud_features, box_rows):
    got = lof.lof_scores(cloud_features, 20, box_rows).orderBy("row_id").toPandas()
    assert list(got.row_id) == list(range(len(cloud)))
    assert np.allclose(got.lof, brute_lof(cloud, 20), rtol=1e-9)


def test_lof_small_k_many_visitors(cloud, cloud_features):
    locations, pairs = lof.neighbours(cloud_features, 5, 25, visitors_per_task=7)
    one, other = pairs.toPandas(), lof.neighbours(cloud_features, 5)[1].toPandas()
    by = ["id", "d", "other", "w"]
    assert one.sort_values(by)[by].reset_index(drop=True).equals(other.sort_values(by)[by].reset_index(drop=True))
    assert set(one.groupby("id").w.sum()) == {5}
    assert locations.count() == len(np.unique(cloud, axis=0))


def test_lof_text_ids(spark):
    rng = np.random.default_rng(0)
    df = frame(spark, rng.normal(size=(60, 2))).withColumn("name", F.concat(F.lit("r"), "id"))
    f = features.features(df, "name", ["p0", "p1"])
    assert lof.lof_outliers(f).count() == 6


def test_lof_text_ids_decide_ties(spark):
    """Points of a grid have many equal distances: the row_id that comes first wins, however the rows lie."""
    points = np.array([[i % 9, i // 9] for i in range(81)], dtype=float)
    names = [f"n{i:03d}" for i in range(81)]
    rows = list(zip(names, points[:, 0].tolist(), points[:, 1].tolist()))
    want = brute_lof(points, 3)
    for parts in (1, 7):
        df = spark.createDataFrame(rows[::-1], "name string, p0 double, p1 double").repartition(parts)
        got = {r.row_id: r.lof for r in lof.lof_scores(features.features(df, "name", ["p0", "p1"]), 3, 12).collect()}
        assert np.allclose([got[n] for n in names], want, rtol=1e-9)


def test_search_tree():
    rng = np.random.default_rng(2)
    low = rng.normal(size=(700, 3))
    high = low + rng.exponential(size=(700, 3)) * 0.3
    points, radius = rng.normal(size=(60, 3)), rng.exponential(size=60)
    at, box = touched(tree_of(low, high), points, radius)
    gap = np.maximum(0, np.maximum(low[None] - points[:, None], points[:, None] - high[None]))
    want = np.argwhere((gap ** 2).sum(-1) <= (radius ** 2)[:, None])
    assert sorted(zip(at, box)) == sorted(map(tuple, want))
    assert len(touched(tree_of(low[:1], high[:1]), points, np.full(60, 100.0))[0]) == 60


@pytest.mark.parametrize("top_boxes", [100_000, 40])
def test_boxes(spark, top_boxes):
    """Bounded population, with values that many points share and one nearly constant column."""
    rng = np.random.default_rng(0)
    points = np.column_stack([rng.normal(size=6000), rng.integers(0, 3, 6000), rng.exponential(size=6000),
                              np.where(rng.uniform(size=6000) < 0.99, 0.0, rng.normal(size=6000))])
    pdf = pd.DataFrame(points, columns=["x0", "x1", "x2", "x3"]).assign(id=range(6000), w=1)
    boxes = cut_boxes(cut(spark.createDataFrame(pdf)), ["x0", "x1", "x2", "x3"], 25, top_boxes=top_boxes)
    assert boxes.one_level == (top_boxes > 40)
    table = boxes.table.toPandas().set_index("box")
    assert table.n.sum() == 6000 and table.n.max() <= 25 and len(table) < 3000
    home = boxes.points.toPandas().set_index("id").sort_index()
    assert (home.box.map(table.top) == home.top).all()
    few = boxes.points.where("id < 60").withColumn("radius", F.lit(0.3)).drop("box", "top")
    visits = boxes.visits(few, 11).toPandas()
    near = ((points[:60, None] - points[None]) ** 2).sum(-1) <= 0.09
    for i in range(60):
        assert set(home.box[near[i]]) <= set(visits.box[visits.id == i])
    assert len(visits) == len(visits[["id", "box"]].drop_duplicates()) < 60 * len(table) / 5


def test_boxes_of_equal_coordinates(spark):
    """Points that differ in one column only, and most of them at its largest or smallest value in another."""
    pdf = pd.DataFrame({"id": range(1000), "w": 1, "x0": [0.0] * 990 + [1e-9 * i for i in range(10)], "x1": [5.0] * 10 + [9.0] * 990,
                        "x2": np.arange(1000) * 1e-3})
    boxes = cut_boxes(cut(spark.createDataFrame(pdf)), ["x0", "x1", "x2"], 30)
    most, total = boxes.table.agg(F.max("n"), F.sum("n")).first()
    assert most <= 30 and total == 1000


def test_planted_points_and_consensus(spark, cloud):
    d = consensus.detect(frame(spark, cloud), "id")
    n = len(cloud)
    who = {}
    for r in d.flagged.collect():
        who.setdefault(r.row_id, set()).add(r.method)
    # k-means may give a far point a cluster of its own
    for far in (n - 3, n - 2):
        assert {"Isolation Forest", "Local Outlier Factor", "DBSCAN"} <= who[far]
    assert {r.row_id for r in consensus.consensus(d).collect()} == {i for i, m in who.items() if len(m) == 4}
    found = {r.method: (r.outliers_found, r.outlier_pct) for r in consensus.method_summary(d).collect()}
    assert list(found) and set(found) == set(consensus.METHODS)
    for m in ("Isolation Forest", "Local Outlier Factor", "k-Means"):
        assert 0 < found[m][1] <= 10.0 + 100.0 / n
    rank = consensus.method_ranking(d).first()
    assert rank.total_flags == sum(v[0] for v in found.values())
    assert found[rank.most][0] == max(v[0] for v in found.values())
    assert found[rank.fewest][0] == min(v[0] for v in found.values())
    points = consensus.labelled_points(d)
    assert points.count() == 4 * n and points.where("is_outlier").count() == rank.total_flags
    assert consensus.all_outliers(d).count() == rank.total_flags
    assert consensus.all_outliers(d).columns == ["row_id", "method", "p0", "p1", "p2"]


def test_isolation_forest_repeats(cloud_features):
    one = isolation_forest.isolation_scores(cloud_features, seed=7).select("row_id", "score").orderBy("row_id").toPandas()
    two = isolation_forest.isolation_scores(cloud_features, seed=7).select("row_id", "score").orderBy("row_id").toPandas()
    assert one.equals(two) and one.score.between(-1, 0).all()


def test_isolation_forest_samples_large_tables(spark):
    df = spark.range(60_000).selectExpr("id", "cast(id % 1000 as double) a", "rand(3) b")
    f = features.features(df, "id", ["a", "b"])
    pool = isolation_forest._sample_pool(f, 20, 256, 42)
    assert 0.9 * 20 * 256 < len(pool) < 1.8 * 20 * 256


def test_best_k(spark):
    rng = np.random.default_rng(5)
    points = np.vstack([rng.normal(c, 0.1, size=(60, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    f = features.features(frame(spark, points), "id", ["p0", "p1"])
    got = kmeans.best_k(f).collect()
    assert [r.k for r in got if r.best] == [3] and [r.k for r in got] == list(range(2, 11))
    assert kmeans.kmeans_outliers(f).count() == 18


def test_kmeans_is_the_same_on_any_partitions(spark, cloud):
    """Centres and scores to the last digit; fewer distinct rows than clusters do no harm."""
    found = []
    for parts in (1, 16):
        f = features.features(frame(spark, cloud).repartition(parts, "id"), "id")
        choice = kmeans.choose_k(f)
        found.append((choice, sorted(r.row_id for r in kmeans.kmeans_outliers(f).collect())))
    assert found[0] == found[1] and len(found[0][0].scores) == 9
    same = features.features(frame(spark, np.tile([[1.0, 2.0], [3.0, 4.0]], (30, 1))), "id")
    choice = kmeans.choose_k(same)
    assert choice.k == 2 and kmeans.kmeans_outliers(same).count() == 0


def test_silhouette_against_all_pairs(spark):
    rng = np.random.default_rng(9)
    points = rng.normal(size=(80, 3))
    f = features.features(frame(spark, points), "id", ["p0", "p1", "p2"])
    x = (points - points.mean(0)) / points.std(0)
    centres = {k: x[:k].copy() for k in (2, 4)}
    got = kmeans._silhouettes(f.rows.select(*kmeans._scaled(f)), centres)
    for k, at in centres.items():
        which = ((x[:, None] - at[None]) ** 2).sum(-1).argmin(1)
        d, s = ((x[:, None] - x[None]) ** 2).sum(-1), []
        for i in range(80):
            own = [j for j in range(80) if which[j] == which[i] and j != i]
            a = d[i, own].mean() if own else None
            b = min(d[i, which == c].mean() for c in set(which) - {which[i]})
            s.append(0.0 if a is None else (b - a) / max(a, b))
        assert got[k] == pytest.approx(np.mean(s), abs=1e-8)


def test_tiny_tables(spark):
    f = features.features(frame(spark, np.array([[1.0, 2.0], [1.0, 2.5], [9.0, 9.0]])), "id", ["p0", "p1"])
    assert kmeans.choose_k(f).k == 2
    assert {r.row_id for r in dbscan.dbscan_noise(f).collect()} == {0, 1, 2}
    assert lof.lof_scores(f).count() == 3


def test_hot_split_join(spark):
    rows = spark.range(10_000).selectExpr("id", "if(id % 3 = 0, 0, id) k")
    keys = rows.groupBy("k").agg(F.count("*").alias("w")).withColumn("v", F.col("k") * 2)
    got = hot_split_join(rows, keys, ["k"], "w", 10_000)
    assert got.count() == 10_000 and got.where("v <> k * 2").count() == 0


def test_row_ids_are_stable(spark):
    df = with_row_id(spark.range(1000).selectExpr("id % 7 AS x").repartition(5))
    assert df.select("row_id").distinct().count() == 1000
    assert df.exceptAll(df).count() == 0


def test_points_of_a_box_are_compared_with_few(monkeypatch):
    rng = np.random.default_rng(5)
    points, weights, limit = np.vstack([rng.normal(size=(1_800, 3)), rng.uniform(-6, 6, size=(200, 3))]), rng.integers(1, 3, 2_000), 0.4 ** 2
    compared, near = [], dbscan._near
    monkeypatch.setattr(dbscan, "_near", lambda q, p, w, most: compared.append(len(q) * len(p)) or near(q, p, w, most))
    got, want = dbscan._near_home(points, weights, limit, 5), near(points, points, weights, limit)
    assert ((got >= 5) == (want >= 5)).all() and (got[got < 5] == want[got < 5]).all() and (got <= want).all()
    assert sum(compared) < 0.5 * 2_000 * 2_000 and (want < 5).any()
    assert sorted(np.concatenate(dbscan._parts(np.zeros((1_000, 2))))) == list(range(1_000))


def test_boxes_are_sketched_only_to_be_cut(spark, monkeypatch):
    """A table that fits one box takes no quantiles."""
    from tableprofile.plans import boxes
    df = spark.range(100).selectExpr("id", "CAST(id AS DOUBLE) AS x0", "1 AS w").localCheckpoint()
    monkeypatch.setattr(boxes, "_GRID", None)
    found = boxes.cut_boxes(df, ["x0"], 100)
    assert found.table.select("n", "w", "low", "high").first() == (100, 100, [0.0], [99.0])


def test_ties_sort_only_what_competes(monkeypatch):
    """Copies at equal steps tie everywhere; a point then sorts its nearest places, not the whole box."""
    points = np.column_stack([np.repeat(np.arange(40.0), 10), np.tile(np.arange(10.0), 40)])
    ids, weights = np.random.default_rng(1).permutation(400), np.ones(400, np.int64)
    longest, sort = [0], np.argsort

    def argsort(values, *args, **named):
        longest[0] = max(longest[0], len(values) if np.ndim(values) == 1 and values.dtype == float else 0)
        return sort(values, *args, **named)

    monkeypatch.setattr(lof.np, "argsort", argsort)
    q, d, other, w = lof.nearest(points, points, ids, weights, 6, own=np.arange(400))
    assert 7 <= longest[0] < 60
    for i in (0, 57, 399):
        away = sorted((np.sqrt(((points[i] - p) ** 2).sum()), n) for j, (p, n) in enumerate(zip(points, ids)) if j != i)[:6]
        assert [(x, int(n)) for x, n in zip(d[q == i], other[q == i])] == [(x, int(n)) for x, n in away]


def test_neighbours_in_a_full_box_take_little_memory(monkeypatch):
    """The distances of a box with 2,000 locations are held in parts; larger parts give the same neighbours."""
    rng = np.random.default_rng(1)
    points, ids, weights = np.column_stack([rng.integers(0, 5, 2000) * 0.14, rng.random(2000)]), rng.permutation(2000), np.ones(2000, np.int64)

    def found():
        return lof.nearest(points, points, ids, weights, 20, own=np.arange(2000)), dbscan._near(points, points, weights, 0.01)

    tracemalloc.start()
    few, few_near = found()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000
    monkeypatch.setattr(lof, "_CELLS", 4_000_000)
    monkeypatch.setattr(dbscan, "_CELLS", 4_000_000)
    many, many_near = found()
    assert all((a == b).all() for a, b in zip(few, many)) and (few_near == many_near).all()


@pytest.mark.parametrize("width", [1, 2, 5])
def test_neighbours_by_parts_are_those_of_the_whole_box(monkeypatch, width):
    """Ties, weights and far points included; most parts of a flat box meet few of its points."""
    rng = np.random.default_rng(2)
    points = np.unique(np.column_stack([rng.integers(0, 12, 1500) * 0.25, *[rng.normal(size=1500) for _ in range(width - 1)]]), axis=0)
    points = np.concatenate([points, np.full((1, width), 90.0), rng.integers(-3, 3, (100, width)) * 7.0 + 100]).astype(float)
    points = np.unique(points, axis=0)[rng.permutation(len(np.unique(points, axis=0)))]
    n = len(points)
    ids, weights = rng.permutation(n), rng.integers(1, 4, n)
    sizes, nearest = [], lof.nearest

    def same(got, want):
        return all((a == b).all() for a, b in zip(got, want))

    def seen(queries, points_, *rest, **named):
        sizes.append(len(queries) * len(points_))
        return nearest(queries, points_, *rest, **named)

    own, guests = nearest(points, points, ids, weights, 20, own=np.arange(n)), points[:400] + 0.01
    radius = rng.random(len(guests))
    away = nearest(guests, points, ids, weights, 20, radius=radius)
    monkeypatch.setattr(lof, "nearest", seen)
    assert same(lof.nearest_by_parts(points, points, ids, weights, 20, own=np.arange(n)), own)
    assert width != 2 or sum(sizes) < 0.6 * n * n
    assert same(lof.nearest_by_parts(guests, points, ids, weights, 20, radius=radius), away)
    assert [len(x) for x in lof.nearest_by_parts(guests, points + 1e6, ids, weights, 20, radius=radius)] == [0, 0, 0, 0]
