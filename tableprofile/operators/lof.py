"""Local Outlier Factor (Breunig et al. 2000) with exact nearest neighbours.

Identical rows are first merged into one location with a multiplicity. Space is cut into boxes
of bounded population by aggregates on the executors; each box finds the neighbours of its locations,
and a location is sent on only to the other boxes that its neighbour radius reaches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tableprofile.operators.features import Features
from tableprofile.plans.boxes import cut_boxes, meet, parts_of, touched
from tableprofile.plans.cuts import cut, dealt, hot_split_join, small_side
from tableprofile.plans.quantiles import exact_quantiles

NEIGHBOURS = 20
CONTAMINATION = 0.1
BOX_ROWS = 2_000
VISITORS_PER_TASK = 50_000
_CELLS = 250_000            # distances held at a time in a task: a few arrays of 2 MB


def nearest(queries: np.ndarray, points: np.ndarray, ids: np.ndarray, weights: np.ndarray, k: int,
            own: np.ndarray | None = None, radius: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(query, d, other, w): per query the nearest points up to a total weight of k.

    Ties go to the smaller id. `own` are the positions of the queries among the points: a
    location is a neighbour of itself with one copy less. Only points within `radius` count.
    """
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    points, ids, weights = points[order], ids[order], weights[order]
    take = min(k + 1, len(points))
    parts = []
    step = max(1, _CELLS // max(1, len(points)))
    for start in range(0, len(queries), step):
        part = queries[start:start + step]
        squares = np.zeros((len(part), len(points)))
        for j in range(points.shape[1]):
            diff = part[:, j, None] - points[None, :, j]
            squares += diff * diff
        if take < len(points):
            best = np.argpartition(squares, take - 1, axis=1)[:, :take]
            limit = np.take_along_axis(squares, best, axis=1).max(axis=1)
            within = squares <= limit[:, None]
            for r in np.flatnonzero(within.sum(axis=1) > take):     # ties: only what competes is sorted
                at = np.flatnonzero(within[r])
                best[r] = at[np.argsort(squares[r, at], kind="stable")[:take]]
            best.sort(axis=1)     # by id, so that the stable sort below keeps the tie order
        else:
            best = np.repeat(np.arange(len(points))[None, :], len(part), axis=0)
        near = np.take_along_axis(squares, best, axis=1)
        inner = np.argsort(near, axis=1, kind="stable")
        best, near = np.take_along_axis(best, inner, axis=1), np.sqrt(np.take_along_axis(near, inner, axis=1))
        w = weights[best]
        if own is not None:
            w = w - (best == place[own[start:start + step]][:, None])
        if radius is not None:
            w = np.where(near <= radius[start:start + step][:, None], w, 0)
        before = np.cumsum(w, axis=1) - w
        w = np.clip(k - before, 0, w)
        q, slot = np.nonzero(w > 0)
        parts.append((q + start, near[q, slot], ids[best[q, slot]], w[q, slot]))
    return tuple(np.concatenate(column) for column in zip(*parts))


def nearest_by_parts(queries: np.ndarray, points: np.ndarray, ids: np.ndarray, weights: np.ndarray, k: int,
                     own: np.ndarray | None = None, radius: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """`nearest`, part by part of queries beside each other, each against the points that its balls can reach.

    Without `radius`, the queries are the points, and a ball reaches as far as enough points of the own part.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, ids.dtype), np.zeros(0, weights.dtype))]
    for at in parts_of(queries):
        if radius is None:
            q, d, _, w = nearest(queries[at], points[at], ids[at], weights[at], k, own=np.arange(len(at)))
            reach = d.max(initial=0.0) if (np.bincount(q, w, len(at)) >= k).all() else np.inf
        else:
            reach = radius[at].max()
        reach = reach * (1.0 + 1e-9) + 1e-150
        low, high = queries[at].min(axis=0) - reach, queries[at].max(axis=0) + reach
        inside = np.flatnonzero(((points >= low) & (points <= high)).all(axis=1))
        if not len(inside):
            continue
        q, d, other, w = nearest(queries[at], points[inside], ids[inside], weights[inside], k,
                                 None if own is None else np.searchsorted(inside, own[at]), None if radius is None else radius[at])
        found.append((at[q], d, other, w))
    q, d, other, w = (np.concatenate(column) for column in zip(*found))
    order = np.argsort(q, kind="stable")
    return q[order], d[order], other[order], w[order]


def _locations(f: Features) -> DataFrame:
    """(id, x..., w): distinct points with their number of rows, combined map-side. The id follows the
    order of the smallest row_id, whatever its type."""
    merged = f.rows.groupBy(*f.columns).agg(F.count(F.lit(1)).alias("w"), F.min("row_id").alias("id"))
    if dict(merged.dtypes)["id"] not in ("bigint", "int", "smallint", "tinyint"):
        # numbers that rise with the partitions of a sort; fixed by the checkpoint
        merged = merged.orderBy("id").withColumn("id", F.monotonically_increasing_id())
    return cut(merged.select(F.col("id").cast("long").alias("id"), *f.columns, "w"))


def neighbours(f: Features, k: int, box_rows: int = BOX_ROWS, visitors_per_task: int = VISITORS_PER_TASK,
               ) -> tuple[DataFrame, DataFrame]:
    """Locations (id, x..., w) and their neighbours (id, d, other, w), weights adding up to k per id."""
    locations = _locations(f)
    cols = f.columns
    boxes = cut_boxes(locations, cols, max(box_rows, k + 1))
    shared, one_level = boxes.shared, boxes.one_level
    coords = ", ".join(f"{c} double" for c in cols)
    # a box with too few rows takes the bounds of the box it was cut from, which had enough
    up = boxes.parents.select(F.col("box").alias("up"), F.col("low").alias("up_low"), F.col("high").alias("up_high"))
    few = cut(boxes.table.where(F.col("w") <= k).join(up, "up").select("box", "up_low", "up_high"))
    boxed = boxes.points.join(small_side(few), "box", "left")

    def at_home(pdf: pd.DataFrame) -> pd.DataFrame:
        points, ids, top = pdf[cols].to_numpy(dtype=float), pdf["id"].to_numpy(), int(pdf["top"].iloc[0])
        q, d, other, w = nearest_by_parts(points, points, ids, pdf["w"].to_numpy(), k, own=np.arange(len(pdf)))
        radius = np.zeros(len(pdf))
        np.maximum.at(radius, q, d)
        if pdf["up_low"].iloc[0] is not None:
            low, high = np.array(pdf["up_low"].iloc[0]), np.array(pdf["up_high"].iloc[0])
            far = np.sqrt((np.maximum(np.abs(points - low), np.abs(points - high)) ** 2).sum(axis=1))
            radius = np.where(np.bincount(q, weights=w, minlength=len(pdf)) >= k, radius, far)
        travels = np.full(len(pdf), not one_level)
        if one_level:
            at, box = touched(shared.value, points, radius)
            travels[at[shared.value["top"][box] != top]] = True
        going = np.flatnonzero(travels)
        # whole numbers stay whole beside nulls: box ids have 64 bits
        whole = lambda values: pd.array(values, dtype="Int64")
        pairs = pd.DataFrame({"id": ids[q], "d": d, "other": whole(other), "w": whole(w), "travels": travels[q]})
        balls = pd.DataFrame({"id": ids[going], "travels": True, "home": whole(pdf["box"].to_numpy()[going]), "radius": radius[going],
                              **{c: points[going, i] for i, c in enumerate(cols)}})
        out = pd.concat([pairs, balls], ignore_index=True)
        out["travels"] = out["travels"].astype(bool)
        return out

    home = cut(dealt(boxed, "box").groupBy("box").applyInPandas(
        at_home, f"id long, d double, other long, w long, travels boolean, home long, radius double, {coords}"))
    pairs = home.where(F.col("home").isNull()).select("id", "d", "other", "w", "travels")
    balls = home.where(F.col("home").isNotNull()).select("id", *cols, "radius", "home")
    guests = cut(boxes.visits(balls, visitors_per_task).where(F.col("box") != F.col("home")).drop("home"))

    def abroad(guest: pd.DataFrame, host: pd.DataFrame) -> pd.DataFrame:
        q, d, other, w = nearest_by_parts(guest[cols].to_numpy(dtype=float), host[cols].to_numpy(dtype=float),
                                          host["id"].to_numpy(), host["w"].to_numpy(), k, radius=guest["radius"].to_numpy())
        return pd.DataFrame({"id": guest["id"].to_numpy()[q], "d": d, "other": other, "w": w})

    away = meet(guests, boxes.points.drop("top"), abroad, "id long, d double, other long, w long", visitors_per_task)

    # at most k entries from each box visited compete for the k places of a traveller
    before = F.sum("w").over(Window.partitionBy("id").orderBy("d", "other")
                             .rowsBetween(Window.unboundedPreceding, -1))
    merged = dealt(pairs.where("travels").drop("travels").unionByName(away), "id") \
        .withColumn("w", F.least(F.col("w"), F.lit(k) - F.coalesce(before, F.lit(0)))).where(F.col("w") > 0)
    return locations, cut(pairs.where(~F.col("travels")).drop("travels").unionByName(merged))


def lof_scores(f: Features, k: int | None = None, box_rows: int = BOX_ROWS) -> DataFrame:
    """(row_id, lof) for every row."""
    k = max(1, min(NEIGHBOURS if k is None else k, f.count - 1))
    locations, pairs = neighbours(f, k, box_rows)
    reach = pairs.groupBy(F.col("id").alias("other")).agg(F.max("d").alias("k_distance"))
    density = cut(pairs.join(reach, "other").groupBy("id").agg(
        (1.0 / (F.sum(F.col("w") * F.greatest("d", "k_distance")) / k + 1e-10)).alias("density")))
    around = pairs.join(density.select(F.col("id").alias("other"), F.col("density").alias("theirs")), "other") \
                  .groupBy("id").agg((F.sum(F.col("w") * F.col("theirs")) / k).alias("around"))
    scored = around.join(density, "id").select("id", (F.col("around") / F.col("density")).alias("lof"))
    placed = locations.join(scored, "id").drop("id")
    return hot_split_join(f.rows, placed, f.columns, "w", f.count).select("row_id", "lof")


def lof_outliers(f: Features, k: int | None = None, box_rows: int = BOX_ROWS) -> DataFrame:
    """(row_id): rows whose negative factor lies strictly below the 10th percentile."""
    if f.count < 2:
        return f.rows.select("row_id").limit(0)
    scored = cut(lof_scores(f, k, box_rows))
    limit = exact_quantiles(scored, {"s": -F.col("lof")}, [CONTAMINATION])["s"][0]
    return scored.where(-F.col("lof") < limit).select("row_id")
