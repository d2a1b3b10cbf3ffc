"""Density clusters of points: a grid that Spark counts, one small grid for each camera, and all points counted in the polygons placed there.

Whatever the number of points, a camera's grid has at most 64 x 96 cells, so the peak search runs on a
bounded table in ``applyInPandas``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.skew import hot_keys, join_per_key
from tessella.session import cut_lineage

#: How far from a polygon's edge a cell's side must lie for the cell to count as on one side of it, whatever rounding does.
MARGIN = 1e-6
#: Cells of the grid, a cluster's least share of its peak's height and its reach in cells, how near two
#: centres are one cluster, the least support in points and as a share of the strongest, and how polygons that meet shrink.
COLUMNS, ROWS = 64, 96
PEAK_SHARE, REACH, MERGE_BINS, LEAST, LEAST_SHARE, SHRINK, SHRINKS = 0.28, 4, 3.0, 40, 0.03, 0.85, 4


def smooth(grid: np.ndarray) -> np.ndarray:
    """Mean of the 3 by 3 neighbourhood, only cells inside the grid counting."""
    padded, ones = np.pad(grid, 1), np.pad(np.ones_like(grid), 1)
    total = sum(padded[i : i + grid.shape[0], j : j + grid.shape[1]] for i in range(3) for j in range(3))
    return total / sum(ones[i : i + grid.shape[0], j : j + grid.shape[1]] for i in range(3) for j in range(3))


def flood(grid: np.ndarray, taken: np.ndarray, peak: tuple[int, int]) -> list[tuple[int, int]]:
    """Free cells joined to the peak by edges, within REACH of it and of PEAK_SHARE of its height."""
    floor, todo, seen = grid[peak] * PEAK_SHARE, [peak], {peak}
    while todo:
        x, y = todo.pop()
        for at in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
            if at not in seen and 0 <= at[0] < grid.shape[0] and 0 <= at[1] < grid.shape[1] and not taken[at] and grid[at] >= floor and max(abs(at[0] - peak[0]), abs(at[1] - peak[1])) <= REACH:
                seen.add(at)
                todo.append(at)
    return sorted(seen)


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull, counter-clockwise, without points on its edges."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(order):
        out: list[tuple[float, float]] = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(reversed(points))


def overlap(a: list[tuple[float, float]], b: list[tuple[float, float]]) -> bool:
    """Whether two convex polygons share area: no edge normal separates them; touching is no overlap."""
    for p in (a, b):
        for (x1, y1), (x2, y2) in zip(p, [*p[1:], p[0]], strict=True):
            n = (y2 - y1, x1 - x2)
            da, db = ([x * n[0] + y * n[1] for x, y in q] for q in (a, b))
            if max(da) <= min(db) + 1e-12 or max(db) <= min(da) + 1e-12:
                return False
    return True


def shrink(p: list[tuple[float, float]], by: float = SHRINK) -> list[tuple[float, float]]:
    cx, cy = sum(x for x, _ in p) / len(p), sum(y for _, y in p) / len(p)
    return [(cx + (x - cx) * by, cy + (y - cy) * by) for x, y in p]


def grown(height: np.ndarray, most: int) -> list[dict]:
    """Up to ``most`` patches around the highest free cells, row by row among equal ones: cells, support (the smoothed points) and centre (the mean cell)."""
    taken, found = np.zeros(height.shape, bool), []
    while len(found) < most:
        left = np.where(taken, 0.0, height)
        y, x = np.unravel_index(int(left.T.argmax()), left.T.shape)
        if left[x, y] <= 0:
            break
        cells = flood(height, taken, (int(x), int(y)))
        for c in cells:
            taken[c] = True
        found.append({"cells": cells, "support": float(sum(height[c] for c in cells)), "at": np.mean(cells, axis=0)})
    return found


def merged(found: list[dict]) -> list[dict]:
    """Patches, strongest first, each joined to the first kept one whose centre is within MERGE_BINS along both axes."""
    out: list[dict] = []
    for c in sorted(found, key=lambda c: -c["support"]):
        near = next((m for m in out if np.abs(m["at"] - c["at"]).max() <= MERGE_BINS), None)
        if near is None:
            out.append(dict(c))
            continue
        near["cells"], near["support"] = near["cells"] + c["cells"], near["support"] + c["support"]
        near["at"] = np.mean(near["cells"], axis=0)
    return sorted(out, key=lambda c: -c["support"])


def apart(polygon: list[tuple[float, float]], others: list[list[tuple[float, float]]]) -> list[tuple[float, float]] | None:
    """The polygon, shrunk until it overlaps no other; None if SHRINKS times do not do."""
    for _ in range(SHRINKS + 1):
        if not any(overlap(polygon, o) for o in others):
            return polygon
        polygon = shrink(polygon)
    return None


def contains(polygon: F.Column, x: F.Column, y: F.Column) -> F.Column:
    """Whether a point lies in a convex polygon (array of x, y, counter-clockwise) or on its edge."""
    def beside(p: F.Column, i: F.Column) -> F.Column:
        q = F.get(polygon, (i + 1) % F.size(polygon))
        return (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"]) >= 0

    return F.forall(F.transform(polygon, beside), lambda ok: ok)


def clusters(grid: np.ndarray, most: int, least: int, rejected: set[int]) -> list[dict]:
    """Clusters of a count grid, strongest first, without the ``rejected`` places in that order: place, n points of their cells, polygon in shares; polygons never overlap."""
    found = merged(grown(smooth(smooth(grid.astype(float))), 3 * most))
    floor = max(least, LEAST_SHARE * max((c["support"] for c in found), default=0.0))
    out: list[dict] = []
    for place, c in enumerate(found):
        if len(out) >= most or c["support"] < floor:
            break
        if place in rejected:
            continue
        corners = hull([((x + i) / grid.shape[0], (y + j) / grid.shape[1]) for x, y in c["cells"] for i in (0, 1) for j in (0, 1)])
        polygon = apart(corners, [o["polygon"] for o in out])
        if polygon is not None:
            out.append({"place": place, "polygon": polygon})
    return out


def coverage(polygon: list[tuple[float, float]], grid: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
    """How many of a grid's points lie in a convex polygon for certain, and the cells, empty ones left out, whose single points decide about the rest."""
    x, y = np.meshgrid(np.arange(COLUMNS + 1) / COLUMNS, np.arange(ROWS + 1) / ROWS, indexing="ij")
    inside, beyond = np.ones(grid.shape, bool), np.zeros(grid.shape, bool)
    for (x1, y1), (x2, y2) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        far = ((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) / max(np.hypot(x2 - x1, y2 - y1), 1e-300)
        corners = np.stack([far[:-1, :-1], far[1:, :-1], far[:-1, 1:], far[1:, 1:]])
        inside &= corners.min(axis=0) > MARGIN
        beyond |= corners.max(axis=0) < -MARGIN
    xs, ys = zip(*polygon, strict=True)
    beyond |= (x[1:, 1:] < min(xs) - MARGIN) | (x[:-1, :-1] > max(xs) + MARGIN) | (y[1:, 1:] < min(ys) - MARGIN) | (y[:-1, :-1] > max(ys) + MARGIN)
    return int(grid[inside].sum()), [(int(i), int(j)) for i, j in np.argwhere(~inside & ~beyond & (grid > 0))]


_PLACED = "place int, polygon array<struct<x:double,y:double>>, sure long, cells array<struct<x:int,y:int>>"


def density_clusters(points: DataFrame, camera: str, x: str = "x", y: str = "y", most: int = 20, least: int = LEAST) -> DataFrame:
    """(camera, cluster, n, x, y, polygon) of each camera, numbered in reading order (by the polygon's mean y, then x).

    n: the points inside the polygon as it was placed; a polygon with fewer than ``least`` is dropped, and
    what is weaker than it is placed anew.  The cells' counts tell of most polygons whether they hold
    enough, so those are dropped where they are placed; a round of Spark is for the rest, and tests single
    points only where a polygon's edge cuts their cell.  Null coordinates take no part, null cameras are one.
    """
    def cell(c: str, n: int):
        return F.greatest(F.least(F.floor(F.col(c) * n), F.lit(n - 1)), F.lit(0)).cast("int")

    seen = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(camera).alias("camera"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    seen = seen.withColumns({"bin_x": cell("x", COLUMNS), "bin_y": cell("y", ROWS), "near": F.col("x").between(-MARGIN / 1000, 1 + MARGIN / 1000) & F.col("y").between(-MARGIN / 1000, 1 + MARGIN / 1000)})
    cells = cut_lineage(seen.groupBy("camera", "bin_x", "bin_y").agg(F.count(F.lit(1)).alias("n"), F.count_if("near").alias("near")))
    kind = dict(seen.dtypes)["camera"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid, near = np.zeros((COLUMNS, ROWS), np.int64), np.zeros((COLUMNS, ROWS), np.int64)
        grid[pdf["bin_x"], pdf["bin_y"]], near[pdf["bin_x"], pdf["bin_y"]] = pdf["n"], pdf["near"]
        rejected, passed = set(pdf["rejected"].iloc[0]), set(pdf["passed"].iloc[0])
        weak: int | None = -1
        while weak is not None:
            found, weak, certain = [(c, *coverage(c["polygon"], near)) for c in clusters(grid, most, least, rejected)], None, True
            for c, sure, open_ in found:
                if certain and c["place"] not in passed:
                    if sure + sum(near[at] for at in open_) < least:
                        weak = c["place"]
                        rejected.add(weak)
                        break
                    certain = sure >= least
        rows = [(pdf["camera"].iloc[0], c["place"], [{"x": px, "y": py} for px, py in c["polygon"]], sure, [{"x": i, "y": j} for i, j in open_]) for c, sure, open_ in found]
        return pd.DataFrame(rows, columns=["camera", "place", "polygon", "sure", "cells"])

    own = F.xxhash64("camera", "bin_x", "bin_y").alias("cell")
    spots = seen.where("near").select("camera", "x", "y", own)
    hot = hot_keys(cells.select(own, F.col("near").alias("n")), "cell")
    none = F.array().cast("array<int>")
    known = cells.select("camera").distinct().select("camera", none.alias("rejected"), none.alias("passed"))
    same = F.col("camera").eqNullSafe(F.col("__camera"))
    while True:
        told = known.select(F.col("camera").alias("__camera"), "rejected", "passed")
        placed = cut_lineage(cells.join(told, same).drop("__camera").groupBy("camera").applyInPandas(run, f"camera {kind}, {_PLACED}"))
        cut = placed.select("camera", "place", "polygon", F.explode("cells").alias("c"))
        per_cell = cut.groupBy(F.xxhash64("camera", "c.x", "c.y").alias("cell")).agg(F.collect_list(F.struct(F.col("camera").alias("of"), "place", "polygon")).alias("polygons"))  # ``most`` of them
        met = join_per_key(spots, per_cell, hot, "cell").select("camera", F.explode(F.filter("polygons", lambda p: p["of"].eqNullSafe(F.col("camera")) & contains(p["polygon"], F.col("x"), F.col("y")))).alias("p"))
        counts = met.groupBy("camera", F.col("p.place").alias("place")).agg(F.count(F.lit(1)).alias("n")).select(F.col("camera").alias("__camera"), F.col("place").alias("__place"), "n")
        counted = cut_lineage(placed.join(counts, same & (F.col("place") == F.col("__place")), "left").select("camera", "place", "polygon", (F.col("sure") + F.coalesce("n", F.lit(0))).alias("n")))
        weak = cut_lineage(counted.where(F.col("n") < least).groupBy("camera").agg(F.min("place").alias("weak")))
        if weak.isEmpty():
            break
        # of these cameras: the place that failed, and those before it, which stay as they are
        more = counted.join(weak.select(F.col("camera").alias("__camera"), "weak"), same).where(F.col("place") < F.col("weak")).groupBy("camera").agg(F.collect_list("place").alias("before"))
        more = weak.join(more.select(F.col("camera").alias("__camera"), "before"), same, "left").select(F.col("camera").alias("__camera"), "weak", F.coalesce("before", none).alias("before"))
        known = cut_lineage(known.join(more, same, "left").select("camera", F.when(F.col("weak").isNull(), F.col("rejected")).otherwise(F.concat("rejected", F.array("weak"))).alias("rejected"), F.coalesce("before", "passed").alias("passed")))
    mean = lambda c: F.aggregate("polygon", F.lit(0.0), lambda s, p: s + p[c]) / F.size("polygon")
    out = counted.withColumns({"x": mean("x"), "y": mean("y")})
    number = F.row_number().over(Window.partitionBy("camera").orderBy("y", "x"))  # ``most`` rows
    return out.select(F.col("camera").alias(camera), number.alias("cluster"), "n", "x", "y", "polygon")
