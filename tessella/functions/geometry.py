"""Boxes, points and polygons as column functions.

A box is given by its four columns x1, y1, x2, y2; a polygon is array<struct<x double, y double>>.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]
EPSILON = 1e-12


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}").cast("double") for c in ("x1", "y1", "x2", "y2"))


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.least(c, F.lit(high) if not isinstance(high, Column) else high), F.lit(low) if not isinstance(low, Column) else low)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or one of them is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def area(b: Box) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def intersection(a: Box, b: Box) -> Column:
    return area((F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 for empty boxes."""
    i = intersection(a, b)
    return ratio(i, area(a) + area(b) - i)


def ios(a: Box, b: Box) -> Column:
    """Intersection over the smaller box; 0 for empty boxes."""
    return ratio(intersection(a, b), F.least(area(a), area(b)))


def centre(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def foot(b: Box) -> tuple[Column, Column]:
    """The middle of the lower edge."""
    return (b[0] + b[2]) / 2, b[3]


def in_zone(x: Column, y: Column, zone: tuple[float, float, float, float]) -> Column:
    """Inside an upright rectangle, edges included."""
    return x.between(zone[0], zone[2]) & y.between(zone[1], zone[3])


def to_yolo(b: Box, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """Centre and size as shares of the frame."""
    x, y = centre(b)
    return x / width, y / height, (b[2] - b[0]) / width, (b[3] - b[1]) / height


def from_yolo(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> Box:
    return (cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height


def to_xyah(b: Box) -> tuple[Column, Column, Column, Column]:
    """Centre, aspect (width over height) and height."""
    x, y = centre(b)
    return x, y, ratio(b[2] - b[0], b[3] - b[1]), b[3] - b[1]


def project(x: Column, y: Column, h: list[list[float]]) -> tuple[Column, Column]:
    """A point under a homography; null where it goes to infinity."""
    u, v, w = (F.lit(r[0]) * x + F.lit(r[1]) * y + F.lit(r[2]) for r in h)
    return F.when(F.abs(w) > EPSILON, u / w), F.when(F.abs(w) > EPSILON, v / w)


def contains(points: list[tuple[float, float]], x: Column, y: Column, epsilon: float = EPSILON) -> Column:
    """Whether the literal polygon holds the point, its edges included: an edge passes through it, or a ray crosses an odd number of edges."""
    odd, touches = F.lit(0), F.lit(False)
    for (ax, ay), (bx, by) in zip(points, [*points[1:], points[0]], strict=True):
        cross = (x - ax) * (by - ay) - (y - ay) * (bx - ax)
        near = (F.abs(cross) <= epsilon) & x.between(min(ax, bx) - epsilon, max(ax, bx) + epsilon) & y.between(min(ay, by) - epsilon, max(ay, by) + epsilon)
        touches = touches | near
        if ay != by:
            at = (bx - ax) * (y - ay) / (by - ay) + ax
            odd = odd + F.when(((F.lit(ay) > y) != (F.lit(by) > y)) & (x < at), 1).otherwise(0)
    return touches | (odd % 2 == 1)


def contains_polygon(polygon: Column, x: Column, y: Column, epsilon: float = EPSILON) -> Column:
    """The same for a polygon column."""
    n = F.size(polygon)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(polygon, i).alias("a"), F.get(polygon, (i + 1) % n).alias("b")))

    def touches(e):
        a, b = e["a"], e["b"]
        cross = (x - a["x"]) * (b["y"] - a["y"]) - (y - a["y"]) * (b["x"] - a["x"])
        return (F.abs(cross) <= epsilon) & x.between(F.least(a["x"], b["x"]) - epsilon, F.greatest(a["x"], b["x"]) + epsilon) & y.between(F.least(a["y"], b["y"]) - epsilon, F.greatest(a["y"], b["y"]) + epsilon)

    def crosses(e):
        a, b = e["a"], e["b"]
        at = F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"]) + a["x"]
        return F.coalesce(((a["y"] > y) != (b["y"] > y)) & (x < at), F.lit(False))

    return F.when(n >= 3, F.exists(edges, touches) | (F.size(F.filter(edges, crosses)) % 2 == 1)).otherwise(False)


def polygon_area(polygon: Column) -> Column:
    """Signed area by the shoelace formula."""
    n = F.size(polygon)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(polygon, i)["x"] * F.get(polygon, (i + 1) % n)["y"] - F.get(polygon, (i + 1) % n)["x"] * F.get(polygon, i)["y"])
    return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2


def self_intersects(polygon: Column) -> Column:
    """Whether two edges that are not neighbours cross or touch."""
    n = F.size(polygon)

    def turn(a, b, c):
        return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))

    def on(a, b, c):
        return c["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & c["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    def meet(i, j):
        a, b, c, d = F.get(polygon, i), F.get(polygon, (i + 1) % n), F.get(polygon, j), F.get(polygon, (j + 1) % n)
        s = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
        proper = (s[0] * s[1] < 0) & (s[2] * s[3] < 0)
        return proper | ((s[0] == 0) & on(a, b, c)) | ((s[1] == 0) & on(a, b, d)) | ((s[2] == 0) & on(c, d, a)) | ((s[3] == 0) & on(c, d, b))

    places = F.sequence(F.lit(0), n - 1)
    return F.exists(places, lambda i: F.exists(places, lambda j: (j > i + 1) & ~((i == 0) & (j == n - 1)) & meet(i, j)))


def valid_polygon(polygon: Column, least_area: float = 1e-9) -> Column:
    """Three distinct points or more, all in the unit square, some area, no self-intersection."""
    inside = F.forall(polygon, lambda p: p["x"].between(0, 1) & p["y"].between(0, 1))
    distinct = F.size(F.array_distinct(polygon)) == F.size(polygon)
    sound = (F.size(polygon) >= 3) & inside & distinct & (F.abs(polygon_area(polygon)) >= least_area)
    return F.coalesce(F.when(sound, ~self_intersects(polygon)).otherwise(False), F.lit(False))


def centroid(polygon: Column) -> tuple[Column, Column]:
    """Mean of the corners."""
    n = F.size(polygon)
    return tuple(F.aggregate(polygon[k], F.lit(0.0), lambda a, b: a + b) / n for k in ("x", "y"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
