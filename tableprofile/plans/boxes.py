"""Space cut into boxes of bounded population, by aggregates on the executors.

Each round counts the rows of every box with their bounds; boxes with too many points are sketched, and cut
at quantiles of their widest dimensions, until none is left. A value that many
points share becomes a slab of its own, so every round makes the large boxes smaller, and distinct
points can always be parted. No point comes to the driver; what does are the bounds of the boxes of an
upper level, at most TOP_BOXES of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tableprofile.plans.cuts import cut, dealt, discard, free_shuffles, packed, small_side

TOP_BOXES = 100_000
GUESTS_PER_TASK = 50_000
_MOST_PARTS = 64            # of one dimension in a round
_MOST_CHILDREN = 4_096      # of a box in a round
_GRID = [i / _MOST_PARTS for i in range(1, _MOST_PARTS)]
_LEAF = 16
_PART_ROWS = 128            # locations of a box that are compared first
_CUT_ROWS = 20_000          # cuts of so many boxes may be broadcast (some kB each)


def tree_of(low: np.ndarray, high: np.ndarray) -> dict:
    """A binary search tree over boxes as plain arrays: halves by centre, down to _LEAF boxes."""
    centre, parts = (low + high) / 2, [np.arange(len(low))]
    while len(parts[0]) > _LEAF:
        halves = []
        for p in parts:
            widest = np.argmax(np.ptp(centre[p], axis=0))
            ordered = p[np.argsort(centre[p, widest], kind="stable")]
            halves += [ordered[:(len(p) + 1) // 2], ordered[(len(p) + 1) // 2:]]
        parts = halves
    lows, highs = [np.array([low[p].min(axis=0) for p in parts])], [np.array([high[p].max(axis=0) for p in parts])]
    while len(lows[0]) > 1:
        lows.insert(0, np.minimum(lows[0][::2], lows[0][1::2]))
        highs.insert(0, np.maximum(highs[0][::2], highs[0][1::2]))
    sizes = np.array([len(p) for p in parts])
    return {"order": np.concatenate(parts), "first": np.cumsum(sizes) - sizes, "sizes": sizes, "lows": lows, "highs": highs, "low": low, "high": high}


def _gap(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance to the nearest place of a box, summed as distances of points are."""
    total = np.zeros(len(points))
    for j in range(points.shape[1]):
        d = np.maximum(0.0, np.maximum(low[:, j] - points[:, j], points[:, j] - high[:, j]))
        total += d * d
    return total


def touched(tree: dict, points: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(point, box): the boxes that a ball around each point reaches."""
    limit = np.square(radius) * (1.0 + 1e-9) + 1e-300
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for start in range(0, len(points), 10_000):
        at = np.arange(start, min(len(points), start + 10_000))
        node = np.zeros(len(at), np.int64)
        for level, (low, high) in enumerate(zip(tree["lows"], tree["highs"])):
            if level:
                at, node = np.repeat(at, 2), np.column_stack([2 * node, 2 * node + 1]).ravel()
            near = _gap(points[at], low[node], high[node]) <= limit[at]
            at, node = at[near], node[near]
        sizes = tree["sizes"][node]
        before = np.cumsum(sizes) - sizes
        box = tree["order"][np.repeat(tree["first"][node] - before, sizes) + np.arange(sizes.sum())]
        at = np.repeat(at, sizes)
        near = _gap(points[at], tree["low"][box], tree["high"][box]) <= limit[at]
        found.append((at[near], box[near]))
    return tuple(np.concatenate(column) for column in zip(*found))


def parts_of(points: np.ndarray) -> list[np.ndarray]:
    """The places of the points in parts of at most _PART_ROWS, by halves of the widest dimension."""
    parts, small = [np.arange(len(points))], []
    while parts:
        at = parts.pop()
        if len(at) <= _PART_ROWS:
            small.append(at)
            continue
        x = points[at, np.argmax(np.ptp(points[at], axis=0))]
        ordered = at[np.argpartition(x, len(at) // 2)]
        parts += [ordered[:len(at) // 2], ordered[len(at) // 2:]]
    return small


@dataclass
class Boxes:
    """points: the given columns, `box`, `top` (its ancestor of the upper level). table: a row a box with
    `box`, `up` (its parent), `top`, `n`, `w`, `low`, `high`; parents: bounds of the boxes that were cut. All written; the points
    in `held`."""

    points: DataFrame
    table: DataFrame
    parents: DataFrame
    columns: list[str]
    held: DataFrame

    def __post_init__(self):
        top = self.table.groupBy("top").agg(
            F.count(F.lit(1)).alias("boxes"), *[g(F.col(side)[i]).alias(f"{side}{i}") for side, g in (("low", F.min), ("high", F.max))
                                                for i in range(len(self.columns))]).toPandas()      # at most TOP_BOXES rows
        low, high = ([f"{side}{i}" for i in range(len(self.columns))] for side in ("low", "high"))
        #: Whether the boxes in `shared` are the boxes themselves.
        self.one_level = bool((top["boxes"] == 1).all())
        self.shared = self.table.sparkSession.sparkContext.broadcast(
            {"top": top["top"].to_numpy(), **tree_of(top[low].to_numpy(dtype=float), top[high].to_numpy(dtype=float))})

    def visits(self, balls: DataFrame, guests_per_task: int = GUESTS_PER_TASK) -> DataFrame:
        """The rows of balls (the coordinates, `radius` and others) once for each `box` they reach."""
        columns, shared, names = self.columns, self.shared, balls.columns
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in balls.schema)

        def reach(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                at, which = touched(shared.value, pdf[columns].to_numpy(dtype=float), pdf["radius"].to_numpy(dtype=float))
                out = pdf.iloc[at].reset_index(drop=True)
                out["box"] = shared.value["top"][which]
                yield out

        at_top = balls.mapInPandas(reach, f"{schema}, box long")
        if self.one_level:
            return at_top

        def inside(guests: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
            tree = tree_of(np.array(boxes["low"].tolist()), np.array(boxes["high"].tolist()))
            at, which = touched(tree, guests[columns].to_numpy(dtype=float), guests["radius"].to_numpy(dtype=float))
            out = guests.iloc[at][names].reset_index(drop=True)
            out["box"] = boxes["inner"].to_numpy()[which]
            return out

        below = self.table.select(F.col("top").alias("box"), F.col("box").alias("inner"), "low", "high")
        return meet(cut(at_top), below, inside, f"{schema}, box long", guests_per_task)


def meet(guests: DataFrame, hosts: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
         guests_per_task: int = GUESTS_PER_TASK) -> DataFrame:
    """work(guests, hosts) for each `box` that has both. A box with many guests is copied to several tasks."""
    per_box = cut(guests.groupBy("box").agg(F.ceil(F.count(F.lit(1)) / guests_per_task).alias("slots")))
    slots = small_side(per_box)
    many = hosts.join(slots, "box").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)))
    spread = guests.join(slots, "box").withColumn("slot", F.pmod(F.xxhash64(*guests.columns), F.col("slots")))
    place = ["box", "slot"]
    return dealt(spread, *place).groupBy(*place).cogroup(dealt(many, *place).groupBy(*place)).applyInPandas(
        lambda guest, host: work(guest, host) if len(guest) and len(host) else pd.DataFrame(columns=_names(schema)), schema)


def _names(schema: str) -> list[str]:
    return [part.strip().split(" ")[0].strip("`") for part in schema.split(", ")]


def cut_boxes(points: DataFrame, columns: list[str], box_rows: int, weight: str = "w", top_boxes: int = TOP_BOXES,
              own: Sequence[DataFrame] = ()) -> Boxes:
    """Boxes of at most box_rows points each; the points (written, distinct, without nulls) keep their columns.

    No more than two versions of the points are held at a time, and the given one; of that, the tables in `own` are deleted when
    the next version is written.
    """
    held = points
    now = points.withColumns({"box": F.lit(0).cast("long"), "up": F.lit(0).cast("long"), "top": F.lit(0).cast("long")})
    parents = None
    while True:
        boxes = cut(now.groupBy("box").agg(
            F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"), F.first("up").alias("up"), F.first("top").alias("top"),
            F.array(*[F.min(c) for c in columns]).alias("low"), F.array(*[F.max(c) for c in columns]).alias("high")))
        large = boxes.where(F.col("n") > box_rows)
        size = boxes.agg(F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("n") > box_rows, 1)).alias("large")).first()
        # the upper level is the last one that the driver may know
        top = F.col("box") if size.all <= top_boxes else F.col("top")
        if not size.large:
            placed = now.withColumn("top", top).drop("up")
            return Boxes(placed, boxes.withColumn("top", top), boxes.limit(0) if parents is None else parents, columns, held)
        parents = large if parents is None else parents.unionByName(large)
        # sketches cost most, and after the first round only few boxes need one
        quantiles = now.join(small_side(large.select("box"), size.large), "box", "left_semi").groupBy("box").agg(
            F.array(*[F.percentile_approx(c, F.array(*map(F.lit, _GRID)), 1_000) for c in columns]).alias("at"))
        cuts = small_side(cut(large.join(quantiles, "box").select("box", *_cuts(columns, box_rows))), size.large, _CUT_ROWS)
        place = [_passed(F.col("over")[i], F.col(c), False) + _passed(F.col("from")[i], F.col(c), True) for i, c in enumerate(columns)]
        parted = now.join(cuts, "box", "left").withColumn(
            "child", F.when(F.col("over").isNull(), F.col("box")).otherwise(F.xxhash64("box", *place)))
        now = packed(parted.select(*points.columns, F.col("child").alias("box"),
                                  F.when(F.col("over").isNull(), F.col("up")).otherwise(F.col("box")).alias("up"), top.alias("top")))
        for older in own if held is points else [held]:
            discard(older)
        held = now
        free_shuffles(now.sparkSession)


def _passed(values: Column, x: Column, at: bool) -> Column:
    """How many of the values x lies above (with `at`: above or at)."""
    return F.coalesce(F.aggregate(values, F.lit(0), lambda n, v: n + ((x >= v) if at else (x > v)).cast("int")), F.lit(0))


def _cuts(columns: list[str], box_rows: int) -> tuple:
    """(over, from): per dimension, the values that points to the right lie above, or at and above.

    As many of the dimensions whose middle 80 percent are widest are cut as halving them makes enough
    children, each into equal parts. A value that fills a part is parted from its neighbours on both sides.
    """
    need = F.least(F.ceil(F.col("n") / F.lit(0.75 * box_rows)), F.lit(_MOST_CHILDREN)).cast("double")
    middle, whole = F.transform("at", lambda at: F.get(at, F.lit(56)) - F.get(at, F.lit(6))), F.transform("high", lambda h, i: h - F.get("low", i))
    spread = F.when(F.exists(middle, lambda s: s > 0), middle).otherwise(whole)
    wide = F.greatest(F.size(F.filter(spread, lambda s: s > 0)), F.lit(1))
    chosen = F.greatest(F.lit(1), F.least(wide, F.ceil(F.log2(need) - 1e-9).cast("int")))
    least = F.element_at(F.reverse(F.array_sort(spread)), chosen)
    parts = F.least(F.greatest(F.ceil(F.pow(need, F.lit(1.0) / chosen) - 0.1), F.lit(2)), F.lit(_MOST_PARTS))
    step = F.floor(F.lit(_MOST_PARTS) / parts).cast("int")
    over, beyond = [], []
    none = F.array().cast("array<double>")
    for i in range(len(columns)):
        at = F.col("at")[i]
        used = (spread[i] > 0) & (spread[i] >= least)
        steps = F.filter(at, lambda v, j: ((j + 1) % step == 0) & (j + 1 < step * parts))
        again = F.filter(steps, lambda v, j: ((j > 0) & (F.get(steps, j - 1) == v)) | (v == F.col("high")[i]))
        over.append(F.when(used, F.array_distinct(steps)).otherwise(none))
        beyond.append(F.when(used, F.array_distinct(again)).otherwise(none))
    return F.array(*over).alias("over"), F.array(*beyond).alias("from")
