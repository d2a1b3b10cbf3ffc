"""Multi-object tracking of a camera's frames, as a step whose state can be handed from one stretch of frames to the next.

A track's filter has eight numbers (centre x and y, aspect, height and their speeds, in seconds) and their
covariance; those of all live tracks lie in two arrays, so a frame's prediction is one operation.
"""

from __future__ import annotations

import hashlib
from typing import Any

import numpy as np

from tessella.operators.matching import gated_assignment, suppress_contained
from tessella.streaming.hosts import Step

Row = dict[str, Any]
#: The weights of position and speed noise, shares of the height, and the longest step in seconds.
POSITION, SPEED, LONGEST = 1 / 20, 1 / 160, 1.0


def _xyah(box: np.ndarray) -> np.ndarray:
    """Centre, aspect and height of a box, or of each of several."""
    x1, y1, x2, y2 = box.T
    out = np.empty(box.shape)
    h = np.maximum(y2 - y1, 1e-6)
    out[..., 0], out[..., 1], out[..., 2], out[..., 3] = (x1 + x2) / 2, (y1 + y2) / 2, (x2 - x1) / h, h
    return out


class Motions:
    """Constant-velocity filters; their noise grows with the step and the height.

    No number of a filter has to do with another but its own speed, so of the covariance there are three for
    each of the four: ``var``, ``cross`` and ``speed``.
    """

    def __init__(self):
        self.mean = np.zeros((0, 8))
        self.var, self.cross, self.speed = (np.zeros((0, 4)) for _ in range(3))

    @property
    def cov(self) -> np.ndarray:
        out, i = np.zeros((len(self.mean), 8, 8)), np.arange(4)
        out[:, i, i], out[:, i, i + 4], out[:, i + 4, i], out[:, i + 4, i + 4] = self.var, self.cross, self.cross, self.speed
        return out

    def add(self, boxes: np.ndarray) -> None:
        """A filter for a box, or for each of several."""
        at = _xyah(boxes.reshape(-1, 4))
        h = np.maximum(at[:, 3], 1e-6)
        var, speed = np.empty(at.shape), np.empty(at.shape)
        var[:], speed[:] = (2 * (POSITION * h))[:, None], (10 * (SPEED * h))[:, None]
        var[:, 2], speed[:, 2] = 1e-2, 1e-5
        new = np.concatenate([at, np.zeros(at.shape)], axis=1), np.square(var), np.zeros(at.shape), np.square(speed)
        self.mean, self.var, self.cross, self.speed = (np.concatenate(x) for x in zip((self.mean, self.var, self.cross, self.speed), new, strict=True))

    def keep(self, alive: np.ndarray) -> None:
        self.mean, self.var, self.cross, self.speed = self.mean[alive], self.var[alive], self.cross[alive], self.speed[alive]

    def predict(self, seconds: np.ndarray) -> None:
        step = np.minimum(np.maximum(seconds, 0.0), LONGEST)
        if not step.any():
            return
        t = step[:, None]
        noise = np.empty((len(step), 8))
        h = np.maximum(self.mean[:, 3], 1e-6)[:, None]
        noise[:, :4], noise[:, 4:] = POSITION * h, SPEED * h
        noise[:, 2], noise[:, 6] = 1e-2, 1e-5
        noise *= t
        noise *= noise
        self.mean[:, :4] += t * self.mean[:, 4:]
        self.var += t * (self.cross + self.cross) + t * t * self.speed
        self.cross += t * self.speed
        self.var += noise[:, :4]
        self.speed += noise[:, 4:]

    def update(self, at: list[int], boxes: np.ndarray) -> None:
        """The filters at these places have seen these boxes."""
        mean, var, cross = self.mean[at], self.var[at], self.cross[at]
        own = np.empty(var.shape)
        own[:] = (POSITION * np.maximum(mean[:, 3], 1e-6))[:, None]
        own[:, 2] = 1e-1
        noise = var + own * own
        gain, drift, off = var / noise, cross / noise, _xyah(boxes) - mean[:, :4]
        mean[:, :4] += gain * off
        mean[:, 4:] += drift * off
        self.mean[at] = mean
        self.var[at] = var - gain * noise * gain
        self.cross[at] = cross - gain * noise * drift
        self.speed[at] -= drift * noise * drift

    @property
    def boxes(self) -> np.ndarray:
        x, y, a, h = self.mean[:, :4].T
        out = np.empty((len(self.mean), 4))
        wide, high = a * h / 2, h / 2
        out[:, 0], out[:, 1], out[:, 2], out[:, 3] = x - wide, y - high, x + wide, y + high
        return out


class Tracker(Step):
    """A row is a frame: frame, at (seconds), boxes (list of x1, y1, x2, y2, confidence).

    Confident boxes are assigned to predicted tracks by IoU, then weak boxes to the tracks left over;
    confident boxes without a track found one; a track unseen for more than ``buffer`` frames is removed.
    With ``lifecycle`` a track is TENTATIVE until it is seen again, and LOST while it is not.

    A track's id is the number of the stretch that it began in and its number there; ``births`` tells how
    many a stretch has had, which is all that is needed to number tracks through.
    """

    def __init__(self, high: float = 0.5, low: float = 0.1, new: float = 0.6, first: float = 0.3, second: float = 0.2, buffer: int = 30, kalman: bool = False, lifecycle: bool = False, suppress: bool = False):
        self.high, self.low, self.new, self.first, self.second = high, low, new, first, second
        self.buffer, self.kalman, self.lifecycle, self.suppress = buffer, kalman, lifecycle, suppress
        self.tracks: dict[tuple[int, int], dict] = {}  # in order of birth, as the filters are
        self.filters = Motions()
        self.stretch, self.births = 0, 0

    def begin(self, stretch: int) -> None:
        self.stretch, self.births = stretch, 0

    def digest(self) -> str:
        """Equal for equal live tracks, down to the last bit of every number."""
        known = [(i, t["box"].tolist(), t["at"], t["predicted"], t["speed"].tolist(), t["hits"], t["missed"], t["state"]) for i, t in self.tracks.items()]
        return hashlib.sha256(repr(known).encode() + b"".join(x.tobytes() for x in (self.filters.mean, self.filters.var, self.filters.cross, self.filters.speed))).hexdigest()

    def _see(self, at_filter: int, t: dict, box: np.ndarray, at: float) -> None:
        seconds = at - t["at"]
        if self.kalman:
            if t["hits"] == 1 and seconds > 1e-6:
                self.filters.mean[at_filter, 4:] = (_xyah(box) - _xyah(t["box"])) / seconds
        elif seconds > 1e-6:
            speed = (box - t["box"]) / seconds
            t["speed"] = speed if t["hits"] == 1 else 0.7 * t["speed"] + 0.3 * speed
        t.update(box=box, at=max(t["at"], at), hits=t["hits"] + 1, missed=0)

    def __call__(self, row: Row) -> list[Row]:
        at = float(row["at"])
        listed = [list(b) for b in row["boxes"]]
        boxes = np.array([b[:4] for b in listed], float).reshape(-1, 4)
        sure = np.array([b[4] for b in listed], float).tolist()
        kept = suppress_contained(boxes, sure) if self.suppress else range(len(boxes))
        ids, tracks = list(self.tracks), list(self.tracks.values())
        if self.kalman and tracks:
            self.filters.predict(np.array([at - t["predicted"] for t in tracks]))
            for t in tracks:
                t["predicted"] = max(t["predicted"], at)
            places = self.filters.boxes
        else:
            places = np.array([t["box"] + t["speed"] * max(0.0, at - t["at"]) for t in tracks]).reshape(-1, 4)
        moves, owner = [], {}

        def assign(open_: list[int], found: list[int], least: float) -> tuple[list[int], list[int]]:
            if not open_ or not found:
                return open_, found
            pairs = gated_assignment(places[open_], boxes[found], least)
            for i, j in pairs:
                k = open_[i]
                self._see(k, tracks[k], boxes[found[j]], at)
                if self.lifecycle and tracks[k]["state"] != "TRACKED":
                    moves.append((ids[k], tracks[k]["state"], "TRACKED"))
                    tracks[k]["state"] = "TRACKED"
                owner[found[j]] = ids[k]
            if self.kalman and pairs:
                self.filters.update([open_[i] for i, _ in pairs], boxes[[found[j] for _, j in pairs]])
            used = {i for i, _ in pairs}, {j for _, j in pairs}
            return [x for i, x in enumerate(open_) if i not in used[0]], [x for j, x in enumerate(found) if j not in used[1]]

        rest, free = assign(list(range(len(tracks))), [i for i in kept if sure[i] >= self.high], self.first)
        rest, _ = assign(rest, [i for i in kept if self.low <= sure[i] < self.high], self.second)
        for k in rest:
            t = tracks[k]
            t["missed"] += 1
            after = {"TENTATIVE": "REMOVED", "TRACKED": "LOST"}.get(t["state"])
            if self.lifecycle and after:
                moves.append((ids[k], t["state"], after))
                t["state"] = after
        born = [j for j in free if sure[j] >= self.new]
        if born:
            if self.kalman:
                self.filters.add(boxes[born])
            for j in born:
                self.births += 1
                own, state = (self.stretch, self.births), "TENTATIVE" if self.lifecycle else "TRACKED"
                self.tracks[own] = {"box": boxes[j], "at": at, "predicted": at, "speed": np.zeros(4), "hits": 1, "missed": 0, "state": state}
                owner[j] = own
                moves.append((own, None, state))
        gone = [i for i, t in self.tracks.items() if t["state"] == "REMOVED" or t["missed"] > self.buffer]
        out = [{"frame": row["frame"], "kind": "box", "box": int(j), "stretch": i[0], "number": i[1], "state": self.tracks[i]["state"]} for j, i in sorted(owner.items())]
        if gone:
            moves += [(i, self.tracks[i]["state"], "REMOVED") for i in gone if self.tracks[i]["state"] != "REMOVED"]
            if self.kalman:
                self.filters.keep(np.array([i not in set(gone) for i in self.tracks]))
            for i in gone:
                del self.tracks[i]
        return out + [{"frame": row["frame"], "kind": "move", "box": None, "stretch": i[0], "number": i[1], "state": b if a is None else f"{a}>{b}"} for i, a, b in moves]
