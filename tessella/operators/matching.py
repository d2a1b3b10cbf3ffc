"""One-to-one assignment and greedy matching inside small groups (the boxes of one frame).

The group is the unit of work: pairs are scored by Spark expressions where that is enough, and the
order-dependent choice runs on arrays of boxes, a row for each group, many groups to an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sizes(a: np.ndarray) -> np.ndarray:
    return np.maximum(a[:, 2] - a[:, 0], 0) * np.maximum(a[:, 3] - a[:, 1], 0)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The area that each box of one list has in common with each of the other."""
    wide = np.minimum(a[:, 2, None], b[:, 2]) - np.maximum(a[:, 0, None], b[:, 0])
    high = np.minimum(a[:, 3, None], b[:, 3]) - np.maximum(a[:, 1, None], b[:, 1])
    return np.maximum(wide, 0) * np.maximum(high, 0)


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of two lists of boxes (x1, y1, x2, y2); 0 for empty boxes."""
    a, b = np.asarray(a, float).reshape(-1, 4), np.asarray(b, float).reshape(-1, 4)
    both = _common(a, b)
    whole = _sizes(a)[:, None] + _sizes(b) - both
    return np.divide(both, whole, out=np.zeros_like(both), where=whole > 0)


def ios_matrix(a: np.ndarray) -> np.ndarray:
    """Intersection over the smaller box, of each two boxes of one list."""
    a = np.asarray(a, float).reshape(-1, 4)
    size, both = _sizes(a), _common(a, a)
    least = np.minimum(size[:, None], size)
    return np.divide(both, least, out=np.zeros_like(both), where=least > 0)


def minimum_cost_assignment(costs: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a cheapest one-to-one assignment of the shorter side, by shortest augmenting paths; ties go to the lower column."""
    costs = np.asarray(costs, float)
    if costs.size == 0:
        return []
    turned = costs.shape[0] > costs.shape[1]
    c = costs.T if turned else costs
    pairs = _cheapest(*c.shape, c.__getitem__)
    return sorted((j, i) if turned else (i, j) for i, j in pairs)


def _cheapest(rows: int, columns: int, cost: Callable[[int], np.ndarray]) -> list[tuple[int, int]]:
    """The pairs (row, column) of a cheapest assignment of all rows, no more than there are columns; ``cost`` makes a row's costs when they are needed."""
    row_price, column_price = np.zeros(rows), np.zeros(columns)
    owner = np.full(columns, -1)
    for start in range(rows):
        reach, via, done = np.full(columns, np.inf), np.full(columns, -1), np.zeros(columns, bool)
        row, last, base = start, -1, 0.0
        while True:
            step = base + cost(row) - row_price[row] - column_price
            better = ~done & (step < reach - 1e-15)
            reach[better], via[better] = step[better], last
            open_reach = np.where(done, np.inf, reach)
            column = int(open_reach.argmin())
            base, done[column] = reach[column], True
            if owner[column] < 0:
                break
            row, last = owner[column], column
        seen = done & (owner >= 0)
        row_price[start] += base
        row_price[owner[seen]] += base - reach[seen]
        column_price[seen] -= base - reach[seen]
        while column >= 0:
            before = via[column]
            owner[column] = owner[before] if before >= 0 else start
            column = before
    return [(int(owner[j]), j) for j in range(columns) if owner[j] >= 0]


#: Pairs of boxes up to which plain numbers are faster than arrays.
FEW_PAIRS = 256


def _cheapest_few(costs: list[list[float]]) -> list[tuple[int, int]]:
    """``_cheapest`` of a few listed costs, number by number, to the same last bit."""
    columns = len(costs[0])
    row_price, column_price, owner = [0.0] * len(costs), [0.0] * columns, [-1] * columns
    for start in range(len(costs)):
        reach, via, open_, seen = [np.inf] * columns, [-1] * columns, list(range(columns)), []
        row, last, base = start, -1, 0.0
        while True:
            cost, price = costs[row], row_price[row]
            least, column = np.inf, open_[0]
            for j in open_:
                step = base + cost[j] - price - column_price[j]
                r = reach[j]
                if step < r - 1e-15:
                    reach[j] = r = step
                    via[j] = last
                if r < least:
                    least, column = r, j
            base = least
            open_.remove(column)
            if owner[column] < 0:
                break
            seen.append(column)
            row, last = owner[column], column
        row_price[start] += base
        for j in seen:
            row_price[owner[j]] += base - reach[j]
            column_price[j] -= base - reach[j]
        while column >= 0:
            before = via[column]
            owner[column] = owner[before] if before >= 0 else start
            column = before
    return [(i, j) for j, i in enumerate(owner) if i >= 0]


def _iou_few(a: list[list[float]], b: list[list[float]]) -> list[list[float]]:
    """``iou_matrix`` of a few boxes of finite numbers."""
    sized = [(x, y, u, v, (u - x if u > x else 0.0) * (v - y if v > y else 0.0)) for x, y, u, v in b]
    out = []
    for x, y, u, v in a:
        own, row = (u - x if u > x else 0.0) * (v - y if v > y else 0.0), []
        for k, m, w, n, size in sized:
            wide = (u if u < w else w) - (x if x > k else k)
            high = (v if v < n else n) - (y if y > m else m)
            both = wide * high if wide > 0 and high > 0 else 0.0
            whole = own + size - both
            row.append(both / whole if whole > 0 else 0.0)
        out.append(row)
    return out


def gated_assignment(a: np.ndarray, b: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Cheapest assignment by 1 - IoU, then only pairs of at least ``least``."""
    if 0 < len(a) * len(b) <= FEW_PAIRS and np.isfinite(a).all() and np.isfinite(b).all():
        turned = len(a) > len(b)
        m = _iou_few(*((b.tolist(), a.tolist()) if turned else (a.tolist(), b.tolist())))
        pairs = [p for p in _cheapest_few([[1 - x for x in r] for r in m]) if m[p[0]][p[1]] >= least]
        return sorted((j, i) if turned else (i, j) for i, j in pairs)
    m = iou_matrix(a, b)
    return [(i, j) for i, j in minimum_cost_assignment(1 - m) if m[i, j] >= least]


def greedy_global(found: np.ndarray, truth: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs (found, true) in order of falling (IoU, true, found), each end once, down to ``least``."""
    m = iou_matrix(found, truth)
    order = sorted(((m[i, j], j, i) for i in range(m.shape[0]) for j in range(m.shape[1]) if m[i, j] >= least), reverse=True)
    used_i, used_j, out = set(), set(), []
    for _, j, i in order:
        if i not in used_i and j not in used_j:
            used_i.add(i)
            used_j.add(j)
            out.append((i, j))
    return out


def greedy_in_order(candidates: np.ndarray, reviewed: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Each candidate in turn takes its best free reviewed box, the later of equal ones."""
    m, free, out = iou_matrix(candidates, reviewed), list(range(len(reviewed))), []
    for i in range(len(candidates)):
        if free:
            j = max(free, key=lambda k: (m[i, k], k))
            if m[i, j] >= least:
                free.remove(j)
                out.append((i, j))
    return out


def perfect_match(a: np.ndarray, b: np.ndarray, least: float) -> float | None:
    """The smallest IoU of a one-to-one match of two equally long lists in which all pairs reach ``least``; None without one; 1 for empty lists."""
    if len(a) != len(b):
        return None
    m = iou_matrix(a, b)
    partner = [-1] * len(b)

    def place(i: int, seen: set[int]) -> bool:
        for j in range(len(b)):
            if m[i, j] >= least and j not in seen:
                seen.add(j)
                if partner[j] < 0 or place(partner[j], seen):
                    partner[j] = i
                    return True
        return False

    if not all(place(i, set()) for i in range(len(a))):
        return None
    return float(min((m[i, j] for j, i in enumerate(partner)), default=1.0))


def nearest_track(box: np.ndarray, tracks: np.ndarray, least: float = 0.05, reach: float = 1.0) -> int | None:
    """The track of the largest IoU - distance / (10 * size), to nine digits, of those that overlap by ``least`` or lie within ``reach`` sizes; the first of equal ones."""
    if not len(tracks):
        return None
    box, tracks = np.asarray(box, float), np.asarray(tracks, float).reshape(-1, 4)
    overlap = iou_matrix(box[None], tracks)[0]
    distance = np.hypot(*((tracks[:, :2] + tracks[:, 2:]) / 2 - (box[:2] + box[2:]) / 2).T)
    size = max(box[2] - box[0], box[3] - box[1], 1e-9)
    score = np.where((overlap >= least) | (distance <= reach * size), np.round(overlap - distance / (10 * size), 9), -np.inf)
    return int(score.argmax()) if np.isfinite(score).any() else None


def _apart_few(boxes: list[list[float]], contained: float, overlap: float) -> tuple[list[int], list[list[bool]]]:
    """Which of a few boxes lie in no larger one, and which two of them go together."""
    n = len(boxes)
    size = [(u - x if u > x else 0.0) * (v - y if v > y else 0.0) for x, y, u, v in boxes]
    apart, left = [[True] * n for _ in range(n)], [True] * n
    for i, (x, y, u, v) in enumerate(boxes):
        for j in range(i):
            k, m, w, z = boxes[j]
            wide = (u if u < w else w) - (x if x > k else k)
            high = (v if v < z else z) - (y if y > m else m)
            both = wide * high if wide > 0 and high > 0 else 0.0
            small, whole = size[i] if size[i] < size[j] else size[j], size[i] + size[j] - both
            inside = both / small if small > 0 else 0.0
            apart[i][j] = apart[j][i] = (both / whole if whole > 0 else 0.0) < overlap and inside < contained
            if inside >= contained and size[i] != size[j]:
                left[i if size[i] < size[j] else j] = False
    return [i for i in range(n) if left[i]], apart


def suppress_contained(boxes: np.ndarray, confidence: np.ndarray, contained: float = 0.85, overlap: float = 0.5) -> list[int]:
    """Kept places in input order: first the smaller of two boxes that lie in each other goes, then by falling confidence what overlaps a kept box."""
    boxes = np.asarray(boxes, float).reshape(-1, 4)
    if len(boxes) ** 2 <= FEW_PAIRS and np.isfinite(boxes).all():
        left, apart = _apart_few(boxes.tolist(), contained, overlap)
    else:
        size = _sizes(boxes)
        inside, over = ios_matrix(boxes), iou_matrix(boxes, boxes)
        apart = ((over < overlap) & (inside < contained)).tolist()
        left = np.nonzero(~((size[None, :] > size[:, None]) & (inside >= contained)).any(axis=1))[0].tolist()
    sure = np.asarray(confidence).tolist()
    kept: list[int] = []
    for i in sorted(left, key=lambda k: (-sure[k], k)):
        row = apart[i]
        if all(row[k] for k in kept):
            kept.append(i)
    return sorted(kept)


def suppress_tiles(boxes: np.ndarray, confidence: np.ndarray, overlap: float = 0.5) -> list[int]:
    """Kept places by falling (confidence, area)."""
    boxes = np.asarray(boxes, float).reshape(-1, 4)
    size = np.prod(np.clip(boxes[:, 2:] - boxes[:, :2], 0, None), axis=1)
    over, kept = iou_matrix(boxes, boxes), []
    for i in sorted(range(len(boxes)), key=lambda k: (-confidence[k], -size[k], k)):
        if all(over[i, k] < overlap for k in kept):
            kept.append(i)
    return kept


def overlap_labels(boxes: np.ndarray, least: float) -> list[str | None]:
    """``duplicate-k`` for boxes that overlap one another, directly or through others, numbered by their first; None for single ones."""
    n = len(boxes)
    over = iou_matrix(boxes, boxes) >= least
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i + 1, n):
            if over[i, j]:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    roots = [root(i) for i in range(n)]
    several = [r for r in dict.fromkeys(roots) if roots.count(r) > 1]
    return [f"duplicate-{several.index(r) + 1}" if r in several else None for r in roots]


def _overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For stacks of boxes [frames, n, 4] and [frames, m, 4]: intersections [frames, n, m] and the sizes of either side."""
    size = lambda x: np.clip(x[..., 2] - x[..., 0], 0, None) * np.clip(x[..., 3] - x[..., 1], 0, None)
    low, high = np.maximum(a[:, :, None, :2], b[:, None, :, :2]), np.minimum(a[:, :, None, 2:], b[:, None, :, 2:])
    return np.prod(np.clip(high - low, 0, None), axis=3), size(a), size(b)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros_like(part), where=whole > 0)


def _greedy_keep(order: np.ndarray, allowed: np.ndarray, clash: np.ndarray) -> np.ndarray:
    """Of each frame the boxes kept, one after the other in ``order``, where allowed and no kept box clashes."""
    rows, kept = np.arange(len(order)), np.zeros(allowed.shape, bool)
    for step in range(order.shape[1]):
        i = order[:, step]
        kept[rows, i] = allowed[rows, i] & ~(kept & clash[rows, i]).any(axis=1)
    return kept


def stacked_contained(boxes: np.ndarray, confidence: np.ndarray, contained: float = 0.85, overlap: float = 0.5) -> list[list[int]]:
    """``suppress_contained`` of frames with equally many boxes at once."""
    both, size, _ = _overlaps(boxes, boxes)
    inside = _share(both, np.minimum(size[:, :, None], size[:, None, :]))
    over = _share(both, size[:, :, None] + size[:, None, :] - both)
    left = ~((size[:, None, :] > size[:, :, None]) & (inside >= contained)).any(axis=2)
    kept = _greedy_keep(np.argsort(-confidence, axis=1, kind="stable"), left, (over >= overlap) | (inside >= contained))
    return [np.flatnonzero(k).tolist() for k in kept]


def stacked_tiles(boxes: np.ndarray, confidence: np.ndarray, overlap: float = 0.5) -> list[list[int]]:
    """``suppress_tiles`` of frames with equally many boxes at once."""
    both, size, _ = _overlaps(boxes, boxes)
    over = _share(both, size[:, :, None] + size[:, None, :] - both)
    order = np.lexsort((-size, -confidence), axis=1)
    kept = _greedy_keep(order, np.ones(size.shape, bool), over >= overlap)
    return [[i for i in o.tolist() if k[i]] for o, k in zip(order, kept, strict=True)]


def stacked_global(found: np.ndarray, truth: np.ndarray, least: float) -> np.ndarray:
    """How many pairs ``greedy_global`` makes in each of many frames with equally many boxes on each side."""
    both, a, b = _overlaps(found, truth)
    m = _share(both, a[:, :, None] + b[:, None, :] - both).transpose(0, 2, 1).copy()
    m[m < least] = -1.0
    rows, pairs = np.arange(len(m)), np.zeros(len(m), np.int64)
    for _ in range(min(m.shape[1:])):
        flat = m[:, ::-1, ::-1].reshape(len(m), -1)  # the last of equal ones
        at = flat.shape[1] - 1 - flat.argmax(axis=1)
        j, i = np.divmod(at, m.shape[2])
        pairs += m[rows, j, i] >= 0
        m[rows, j, :] = m[rows, :, i] = -1.0
    return pairs


def stacked_in_order(candidates: np.ndarray, reviewed: np.ndarray, least: float) -> np.ndarray:
    """How many pairs ``greedy_in_order`` makes in each of many frames with equally many boxes on each side."""
    both, a, b = _overlaps(candidates, reviewed)
    m = _share(both, a[:, :, None] + b[:, None, :] - both)
    rows, pairs = np.arange(len(m)), np.zeros(len(m), np.int64)
    if not m.shape[2]:
        return pairs
    free = np.ones((len(m), m.shape[2]), bool)
    for i in range(m.shape[1]):
        own = np.where(free, m[:, i], -1.0)
        j = own.shape[1] - 1 - own[:, ::-1].argmax(axis=1)  # the last of equal ones
        taken = free[rows, j] & (m[rows, i, j] >= least)
        free[rows[taken], j[taken]] = False
        pairs += taken
    return pairs


def stacked_assignment(found: np.ndarray, truth: np.ndarray, least: float) -> np.ndarray:
    """How many pairs ``gated_assignment`` makes in each of many frames with equally many boxes on each side: the steps of ``_cheapest``, in all frames at once."""
    both, a, b = _overlaps(found, truth)
    m = _share(both, a[:, :, None] + b[:, None, :] - both)
    if m.shape[1] > m.shape[2]:
        m = m.transpose(0, 2, 1)
    frames, rows, columns = m.shape
    if not rows:
        return np.zeros(frames, np.int64)
    costs, row_price, column_price = 1 - m, np.zeros((frames, rows)), np.zeros((frames, columns))
    owner, every = np.full((frames, columns), -1), np.arange(frames)
    for start in range(rows):
        reach, via, done = np.full((frames, columns), np.inf), np.full((frames, columns), -1), np.zeros((frames, columns), bool)
        end, base_of = np.zeros(frames, np.int64), np.zeros(frames)
        at, row, last, base = every, np.full(frames, start), np.full(frames, -1), np.zeros(frames)
        while len(at):  # the frames whose path has not met a free column
            step = base[:, None] + costs[at, row] - row_price[at, row][:, None] - column_price[at]
            own = reach[at]
            better = ~done[at] & (step < own - 1e-15)
            own = np.where(better, step, own)
            reach[at], via[at] = own, np.where(better, last[:, None], via[at])
            column = np.where(done[at], np.inf, own).argmin(axis=1)
            base = own[np.arange(len(at)), column]
            done[at, column] = True
            end[at], base_of[at] = column, base
            row = owner[at, column]
            go = row >= 0
            at, row, last, base = at[go], row[go], column[go], base[go]
        frame, column = np.nonzero(done & (owner >= 0))
        moved = base_of[frame] - reach[frame, column]
        row_price[:, start] += base_of
        row_price[frame, owner[frame, column]] += moved
        column_price[frame, column] -= moved
        at, column = every, end
        while len(at):
            before = via[at, column]
            owner[at, column] = np.where(before >= 0, owner[at, before], start)
            at, column = at[before >= 0], before[before >= 0]
    frame, column = np.nonzero(owner >= 0)
    return np.bincount(frame[m[frame, owner[frame, column], column] >= least], minlength=frames)


suppress_contained.stacked, suppress_tiles.stacked, greedy_global.stacked, greedy_in_order.stacked, gated_assignment.stacked = stacked_contained, stacked_tiles, stacked_global, stacked_in_order, stacked_assignment


def _by_shape(keys: list) -> list[np.ndarray]:
    """The places of equal keys together."""
    at: dict = {}
    for i, k in enumerate(keys):
        at.setdefault(k, []).append(i)
    return [np.array(v) for v in at.values()]


_BOX = ["x1", "y1", "x2", "y2"]


def _listed(boxes: DataFrame, order: list[str]) -> Column:
    """A frame's rows as one sorted array. A frame holds a bounded number of boxes, so it fits a row."""
    return F.array_sort(F.collect_list(F.struct(*order, *(c for c in boxes.columns if c not in order))))


def _flat(rows: Column) -> Column:
    """x1, y1, x2, y2 of all boxes in a row."""
    return F.flatten(F.transform(rows, lambda r: F.array(*(r[c].cast("double") for c in _BOX))))


def _boxes(flat: np.ndarray) -> np.ndarray:
    return np.asarray(flat, float).reshape(-1, 4)


def per_frame(boxes: DataFrame, frame: str, order: list[str], keep: Callable[[np.ndarray, np.ndarray], list[int]]) -> DataFrame:
    """The rows of each frame that ``keep`` (boxes, confidences) names, boxes in ``order``.

    Null frames are one frame; an empty table gives an empty one.
    """

    @F.pandas_udf("array<int>")
    def kept(flat: pd.Series, confidence: pd.Series) -> pd.Series:
        if not hasattr(keep, "stacked"):
            return pd.Series([keep(_boxes(f), np.asarray(c, float)) for f, c in zip(flat, confidence, strict=True)])
        out: list = [None] * len(flat)
        for at in _by_shape([len(c) for c in confidence]):  # frames of one size are one array
            rows = keep.stacked(np.stack([_boxes(flat.iloc[i]) for i in at]), np.stack([np.asarray(confidence.iloc[i], float) for i in at]))
            for i, own in zip(at, rows, strict=True):
                out[i] = own
        return pd.Series(out, dtype=object)

    rows = boxes.groupBy(frame).agg(_listed(boxes, order).alias("__rows"))
    rows = rows.withColumn("__kept", kept(_flat(F.col("__rows")), F.transform("__rows", lambda r: r["confidence"].cast("double"))))
    return rows.select(F.inline(F.filter("__rows", lambda r, i: F.array_contains(F.col("__kept"), i)))).select(*boxes.columns)


def label_overlaps(boxes: DataFrame, frame: str, order: list[str], least: float) -> DataFrame:
    """``boxes`` with duplicate_group, the label of ``overlap_labels`` inside its frame."""

    @F.pandas_udf("array<string>")
    def labels(flat: pd.Series) -> pd.Series:
        return pd.Series([overlap_labels(_boxes(f), least) for f in flat])

    rows = boxes.groupBy(frame).agg(_listed(boxes, order).alias("__rows")).withColumn("__labels", labels(_flat(F.col("__rows"))))
    return rows.select(F.inline(F.transform("__rows", lambda r, i: F.struct(*(r[c].alias(c) for c in boxes.columns), F.get("__labels", i).alias("duplicate_group")))))


def match_frames(truth: DataFrame, found: DataFrame, frame: str, order: list[str], match: Callable[[np.ndarray, np.ndarray, float], list[tuple[int, int]]], least: float, kind: str | None = None) -> DataFrame:
    """(frame, tp, fp, fn) of each frame that either side has; both sides meet in one shuffle.

    ``match`` gets the found boxes, then the true ones.  With ``kind`` only boxes of equal kind match.
    """
    keys = [frame, kind] if kind else [frame]

    @F.pandas_udf("long")
    def matched(a: pd.Series, b: pd.Series) -> pd.Series:
        if not hasattr(match, "stacked"):
            return pd.Series([len(match(_boxes(y), _boxes(x), least)) for x, y in zip(a, b, strict=True)], dtype="int64")
        out, sides = np.zeros(len(a), np.int64), []
        for side in (a, b):  # all numbers of a batch in one array, and where each frame's begin
            n = np.array([len(x) for x in side], np.int64)
            sides.append((np.concatenate([np.empty(0), *side]), n, np.cumsum(n) - n))

        def stack(flat: np.ndarray, n: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
            return flat[first[at, None] + np.arange(n[at[0]])].reshape(len(at), -1, 4) if n[at[0]] else np.empty((len(at), 0, 4))

        for at in _by_shape(list(zip(sides[0][1].tolist(), sides[1][1].tolist(), strict=True))):
            out[at] = match.stacked(stack(*sides[1], at), stack(*sides[0], at), least)
        return pd.Series(out)

    columns = list(dict.fromkeys([*keys, *order, *_BOX]))
    both = truth.select(*columns, F.lit(True).alias("__truth")).unionByName(found.select(*columns, F.lit(False).alias("__truth")))
    entry = F.struct(*order, *_BOX)
    sides = both.groupBy(*keys).agg(*(F.array_sort(F.collect_list(F.when(on, entry))).alias(n) for n, on in (("__a", F.col("__truth")), ("__b", ~F.col("__truth")))))
    counted = sides.withColumn("tp", matched(_flat(F.col("__a")), _flat(F.col("__b"))))
    counted = counted.select(frame, "tp", (F.size("__b") - F.col("tp")).alias("fp"), (F.size("__a") - F.col("tp")).alias("fn"))
    return counted.groupBy(frame).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))) if kind else counted


def iou_pairs(a: DataFrame, b: DataFrame, frame: str, least: float) -> DataFrame:
    """(frame, a_id, b_id, iou) of all pairs of a frame from ``least`` on; a(frame, a_id, box a), b(frame, b_id, box b) as structs x1 to y2."""
    from tessella.functions import geometry as g

    boxes = [tuple(F.col(f"{n}.{c}").cast("double") for c in _BOX) for n in ("a", "b")]
    return a.join(b, frame).select(frame, "a_id", "b_id", g.iou(*boxes).alias("iou")).where(F.col("iou") >= least)


def nearest_of(box: Column, tracks: Column) -> Column:
    """The place in ``tracks`` (flat boxes in a row) of ``nearest_track`` of a flat box; null for none."""

    @F.pandas_udf("int")
    def places(own: pd.Series, flat: pd.Series) -> pd.Series:
        return pd.Series([nearest_track(np.asarray(b, float), _boxes(f)) for b, f in zip(own, flat, strict=True)], dtype="Int32")

    return places(box, tracks)
