"""DBSCAN noise (Ester et al. 1996): points that are neither core nor within eps of a core point.

Only noise is asked for, so no clusters are formed. Equal rows are one location with a weight. Space is
cut into boxes of bounded population, and counts only ever grow, so a location is settled as soon
as enough rows are known to be near:

1. at home, against the locations of its own part of the box and, if these are too few, of the whole box (a box no wider
   than eps needs no comparison),
2. by a box that lies within eps as a whole and holds enough rows,
3. as a guest of the other boxes that its eps ball reaches; only locations still open travel.

What is not core then looks for a core location in the boxes it reaches. In dense space nearly all is
settled at home, in thin space a ball reaches few boxes, so few rows travel either way.

Disk holds one or two versions of the locations beside the given rows. What shuffles all of them is done for a large table in
TURNS turns, and the shuffle files of one are deleted before the next.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tableprofile.operators.features import Features
from tableprofile.plans.boxes import GUESTS_PER_TASK, cut_boxes, meet, parts_of as _parts
from tableprofile.plans.cuts import dealt, discard, free_shuffles, packed, passing, small_side

EPS = 0.5
MIN_SAMPLES = 5
BOX_ROWS = 2_000
TURNS = 4
TURN_ROWS = 10_000_000      # of a turn at least
_CELLS = 250_000            # distances held at a time in a task: a few arrays of 2 MB


def _near(queries: np.ndarray, points: np.ndarray, weights: np.ndarray, limit: float) -> np.ndarray:
    """Total weight of the points within the squared distance `limit` of each query."""
    out = np.zeros(len(queries), np.int64)
    step = max(1, _CELLS // max(1, len(points)))
    for start in range(0, len(queries), step):
        part = queries[start:start + step]
        squares = np.zeros((len(part), len(points)))
        for j in range(points.shape[1]):
            diff = part[:, j, None] - points[None, :, j]
            squares += diff * diff
        out[start:start + step] = (squares <= limit) @ weights
    return out


def _near_home(points: np.ndarray, weights: np.ndarray, limit: float, enough: int) -> np.ndarray:
    """Total weight near each point of a box; from `enough` on it may be more. Most points have enough beside them."""
    out = np.zeros(len(points), np.int64)
    for at in _parts(points):
        out[at] = _near(points[at], points[at], weights[at], limit)
    few = np.flatnonzero(out < enough)
    out[few] = _near(points[few], points, weights, limit)
    return out


def dbscan_noise(f: Features, eps: float = EPS, min_samples: int = MIN_SAMPLES, box_rows: int = BOX_ROWS,
                 guests_per_task: int = GUESTS_PER_TASK) -> DataFrame:
    """(row_id): the noise points of the standardised data; a point counts as its own neighbour.

    Exact for any number of columns. Its jobs run when it is called. A task holds one box (`box_rows`
    locations) and up to `guests_per_task` guests.
    """
    with passing(f.rows.sparkSession):
        noise = packed(_noise_locations(f, eps, min_samples, box_rows, guests_per_task), outlives=True)
    return f.scaled_rows().join(small_side(noise), f.columns, "left_semi").select("row_id")


def _in_turns(rows: DataFrame, key: Column, turns: int, work: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """work(rows), written, for the rows of each turn by key."""
    out = []
    for turn in range(turns):
        out.append(packed(work(rows.where(F.pmod(key, F.lit(turns)) == turn) if turns > 1 else rows)))
        free_shuffles(rows.sparkSession)
    return out


def _noise_locations(f: Features, eps: float, min_samples: int, box_rows: int, guests_per_task: int) -> DataFrame:
    columns, limit = f.columns, eps * eps
    coords = ", ".join(f"{c} double" for c in columns)
    turns = max(1, min(TURNS, f.count // TURN_ROWS))
    merged = _in_turns(f.scaled_rows(), F.xxhash64(*[F.col(c) + 0.0 for c in columns]), turns,      # 0.0 and -0.0 are equal
                       lambda rows: rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("w")))
    locations = reduce(DataFrame.union, merged)
    boxes = cut_boxes(locations, columns, box_rows, own=merged)

    def at_home(pdf: pd.DataFrame) -> pd.DataFrame:
        points, weights = pdf[columns].to_numpy(dtype=float), pdf["w"].to_numpy()
        if (np.ptp(points, axis=0) ** 2).sum() <= limit and weights.sum() >= min_samples:
            pdf["near"] = weights.sum()
        else:
            pdf["near"] = _near_home(points, weights, limit, min_samples)
        return pdf[[*columns, "w", "box", "near"]]

    homes = _in_turns(boxes.points.drop("top"), F.col("box"), turns, lambda rows: dealt(rows, "box").groupBy("box").applyInPandas(
        at_home, f"{coords}, w long, box long, near long").withColumn("id", F.monotonically_increasing_id()))
    home = reduce(DataFrame.union, [part.withColumn("id", F.col("id") * turns + turn) for turn, part in enumerate(homes)])
    for part in (boxes.held, *merged):
        discard(part)
    is_open = F.col("near") < min_samples
    balls = home.where(is_open).select("id", *columns, "near", F.col("box").alias("home"), F.lit(float(eps)).alias("radius"))
    reached = packed(boxes.visits(balls, guests_per_task))

    # 2. boxes within the ball as a whole
    per_box = boxes.table.select("box", F.col("w").alias("held"), "low", "high")
    far = F.lit(0.0)
    for i, c in enumerate(columns):
        d = F.greatest(F.abs(F.col(c) - F.col("low")[i]), F.abs(F.col(c) - F.col("high")[i]))
        far = far + d * d
    inside = reached.join(small_side(per_box), "box").where((F.col("held") >= min_samples) & (far <= limit))
    settled = packed(inside.select("id").distinct())

    # 3. the others as guests
    def count(guests: pd.DataFrame, hosts: pd.DataFrame) -> pd.DataFrame:
        more = _near(guests[columns].to_numpy(dtype=float), hosts[columns].to_numpy(dtype=float), hosts["w"].to_numpy(), limit)
        return pd.DataFrame({"id": guests["id"].to_numpy()[more > 0], "more": more[more > 0]})

    away = reached.where(F.col("box") != F.col("home")).join(small_side(settled), "id", "left_anti")
    met = meet(away.select("id", *columns, "box"), home.select("box", *columns, "w"), count, "id long, more long", guests_per_task)
    late = home.where(is_open).select("id", "near").join(met.groupBy("id").agg(F.sum("more").alias("more")), "id") \
        .where(F.col("near") + F.col("more") >= min_samples).select("id")
    late = packed(settled.unionByName(late).distinct())

    # what is not core, against core locations
    cores = home.where(~is_open).select("box", *columns, "w").unionByName(
        home.where(is_open).join(small_side(late), "id", "left_semi").select("box", *columns, "w"))
    left = reached.join(small_side(late), "id", "left_anti").select("id", *columns, "box")

    def beside(guests: pd.DataFrame, hosts: pd.DataFrame) -> pd.DataFrame:
        near = _near(guests[columns].to_numpy(dtype=float), hosts[columns].to_numpy(dtype=float), np.ones(len(hosts), np.int64), limit)
        return pd.DataFrame({"id": guests["id"].to_numpy()[near > 0]})

    saved = meet(left, cores, beside, "id long", guests_per_task).distinct()
    return left.select("id", *columns).distinct().join(saved, "id", "left_anti").select(*columns)
