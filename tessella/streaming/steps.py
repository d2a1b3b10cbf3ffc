"""Steps of the stateful operators: each is a recurrence on its own earlier output, so no window expresses it."""

from __future__ import annotations

import heapq
from collections import deque
from datetime import timedelta
from typing import Any

import numpy as np

from tessella.streaming.hosts import Step

Row = dict[str, Any]


def _after(a, b) -> float:
    return (a - b).total_seconds()


class Throttled(Step):
    """Emits a row whose value differs from the last one emitted (0 at first), at least ``seconds`` after the last try."""

    def __init__(self, value: str, time: str, seconds: float):
        self.value, self.time, self.seconds, self.sent, self.tried = value, time, seconds, 0, None

    def __call__(self, row: Row) -> list[Row]:
        if row[self.value] == self.sent or (self.tried is not None and _after(row[self.time], self.tried) < self.seconds):
            return []
        self.sent, self.tried = row[self.value], row[self.time]
        return [row]


class Sessions(Step):
    """Sessions in order of start: an end not after its start is ``invalid``, a start over ``tolerance`` seconds before the end of the last accepted row ``overlap``; both are told and left out. A gap over ``gap`` seconds begins a new session."""

    def __init__(self, start: str, stop: str, gap: float = 60.0, tolerance: float = 2.0):
        self.start, self.stop, self.gap, self.tolerance, self.last, self.number = start, stop, gap, tolerance, None, 0

    def __call__(self, row: Row) -> list[Row]:
        a, b = row[self.start], row[self.stop]
        if b <= a:
            return [row | {"status": "invalid"}]
        wait = None if self.last is None else _after(a, self.last)
        if wait is not None and wait < -self.tolerance:
            return [row | {"status": "overlap"}]
        if wait is None or wait > self.gap:
            self.number, wait = self.number + 1, None
        self.last = b
        return [row | {"status": "ok", "session": self.number, "gap_seconds": wait}]


class Hold(Step):
    """A strong value is held ``seconds`` (that age included); while it is held, a fresh strong row does not renew it, nor does a late one move it back."""

    def __init__(self, time: str, value: str, least: float, seconds: float):
        self.time, self.value, self.least, self.seconds, self.at, self.held = time, value, least, seconds, None, None

    def __call__(self, row: Row) -> list[Row]:
        now, value = row[self.time], row[self.value]
        holding = self.at is not None and 0 <= _after(now, self.at) <= self.seconds
        strong = value is not None and value >= self.least
        out = "detected" if strong else "held" if holding else "weak" if value else "vacant"
        shown = value if strong else self.held if holding else value
        if strong and not holding and (self.at is None or now >= self.at):
            self.at, self.held = now, value
        return [row | {"source": out, "shown": shown}]


class Decision(Step):
    """A student's state from each frame's evidence, by six rules in order.

    A row has observed_at, seat_id and identity (where the student was identified in a seat), outside
    (identity confidence outside all seats), assigned_seat_id, seat_state (of the assigned seat) and
    held_state (of the seat the last decision names; null: not seen).  Late rows change nothing.
    """

    def __init__(self, hold: float = 15.0, grace: float = 300.0, least: float = 0.5):
        self.hold, self.grace, self.least = timedelta(seconds=hold), timedelta(seconds=grace), least
        self.state, self.seat, self.confidence, self.identified_at, self.vacant_since, self.at = None, None, None, None, None, None

    def __call__(self, row: Row) -> list[Row]:
        now = row["observed_at"]
        if self.at is not None and now < self.at:
            return []
        before = self.state
        state, reason, seat, confidence, identified, vacant = self._decide(row, now)
        self.state, self.seat, self.confidence, self.identified_at, self.vacant_since, self.at = state, seat, confidence, identified, vacant, now
        return [row | {"state": state, "reason": reason, "state_seat": seat, "confidence": confidence, "identified_at": identified, "vacant_since": vacant, "changed": state != (before or "UNKNOWN")}]

    def _decide(self, row: Row, now):
        own, seat, sure, outside = row["assigned_seat_id"], row["seat_id"], row["identity"], row["outside"]
        if seat is not None and sure is not None and sure >= self.least:
            if own is None:
                return "UNKNOWN", "NO_ASSIGNED_SEAT", seat, sure, now, None
            right = seat == own
            return ("PRESENT", "IDENTIFIED_AT_ASSIGNED_SEAT", seat, sure, now, None) if right else ("WRONG_SEAT", "IDENTIFIED_AT_OTHER_SEAT", seat, sure, now, None)
        if outside is not None and outside >= self.least:
            return "IN_CLASSROOM", "IDENTIFIED_OUTSIDE_SEATS", None, outside, now, None
        if self.state in ("PRESENT", "WRONG_SEAT") and self.identified_at is not None and now - self.identified_at <= self.hold and row["held_state"] != "VACANT":
            return self.state, "IDENTITY_HELD", self.seat, self.confidence, self.identified_at, None
        if own is None:
            return "UNKNOWN", "NO_ASSIGNED_SEAT", None, None, self.identified_at, None
        if row["seat_state"] in (None, "UNKNOWN"):
            return "UNKNOWN", "SEAT_NOT_OBSERVED", None, None, self.identified_at, None
        if row["seat_state"] == "OCCUPIED":
            return "UNKNOWN", "SEAT_OCCUPIED_BY_UNKNOWN", None, None, self.identified_at, None
        since = self.vacant_since or now
        gone = now - since >= self.grace
        return ("ABSENT" if gone else "UNKNOWN", "SEAT_VACANT_BEYOND_GRACE" if gone else "SEAT_VACANT_WITHIN_GRACE", None, None, self.identified_at, since)


class Accumulated(Step):
    """The last ``size`` usable vectors of a track; from ``least`` on their weighted mean, one unit long, is told. ``n`` is how many are held."""

    def __init__(self, vector: str, weight: str | None = None, size: int = 12, least: int = 4):
        self.vector, self.weight, self.least, self.held = vector, weight, least, deque(maxlen=size)

    def __call__(self, row: Row) -> list[Row]:
        if row[self.vector] is not None:
            v = np.asarray(row[self.vector], float)
            n = np.linalg.norm(v)
            if np.isfinite(n) and n > 1e-12:
                self.held.append((v / n, max(float(row[self.weight]), 1e-3) if self.weight else 1.0))
        mean = None
        if len(self.held) >= self.least:
            total = sum(v * w for v, w in self.held)
            mean = (total / np.linalg.norm(total)).tolist()
        return [row | {"n": len(self.held), "prototype": mean}]


class Consensus(Step):
    """An identity is confirmed with ``votes`` of the last ``size`` observations; ``switches`` counts changes of the confirmed one."""

    def __init__(self, value: str, size: int = 5, votes: int = 3):
        self.value, self.votes, self.seen, self.confirmed, self.switches = value, votes, deque(maxlen=size), None, 0

    def __call__(self, row: Row) -> list[Row]:
        self.seen.append(row[self.value])
        names = [v for v in self.seen if v is not None]
        best = max(dict.fromkeys(names), key=names.count, default=None)
        if best is not None and names.count(best) >= self.votes and best != self.confirmed:
            self.switches += self.confirmed is not None
            self.confirmed = best
        return [row | {"confirmed": self.confirmed, "switches": self.switches}]


class GlobalIds(Step):
    """Local tracks and their global ids: a match is taken over unless either end already has another; ids unseen for ``seconds`` are forgotten.

    A heap has each track by a time at which it was seen, and each camera has its ids counted, so a row goes
    through none of the tracks that live.
    """

    def __init__(self, time: str, seconds: float):
        self.time, self.seconds, self.ids, self.seen, self.next = time, seconds, {}, {}, 1
        self.held: dict[tuple[str, int], int] = {}  # tracks of a camera that have an id
        self.oldest: list[tuple[Any, str]] = []

    def __call__(self, row: Row) -> list[Row]:
        now, own, other = row[self.time], row["track"], row["matched"]
        while self.oldest and _after(now, self.oldest[0][0]) > self.seconds:
            k = self.oldest[0][1]
            if k in self.seen and not _after(now, self.seen[k]) > self.seconds:
                heapq.heapreplace(self.oldest, (self.seen[k], k))
                continue
            heapq.heappop(self.oldest)
            if self.seen.pop(k, None) is not None:
                self._leave(k, self.ids.pop(k))
        status, camera = "known", own.split(":")[0]
        if own not in self.ids:
            if other in self.ids and (camera, self.ids[other]) not in self.held:
                self.ids[own], status = self.ids[other], "propagated"
            else:
                self.ids[own], status = self.next, "registered"
                self.next += 1
            at = camera, self.ids[own]
            self.held[at] = self.held.get(at, 0) + 1
        elif other in self.ids and self.ids[other] != self.ids[own]:
            status = "blocked"
        if own not in self.seen or now < self.seen[own]:
            heapq.heappush(self.oldest, (now, own))
        self.seen[own] = now
        return [row | {"global_id": self.ids[own], "status": status}]

    def _leave(self, track: str, number: int) -> None:
        at = track.split(":")[0], number
        self.held[at] -= 1
        if not self.held[at]:
            del self.held[at]


class Quotas(Step):
    """Samples with a code of rejection are refused; others count for their pose until its quota is full, beyond it only when all quotas are."""

    def __init__(self, quotas: dict[str, int], required: int):
        self.quotas, self.required, self.have, self.n = quotas, required, dict.fromkeys(quotas, 0), 0

    def __call__(self, row: Row) -> list[Row]:
        full = all(self.have[k] >= q for k, q in self.quotas.items())
        open_ = row["pose"] in self.quotas and (self.have[row["pose"]] < self.quotas[row["pose"]] or full)
        ok = row["rejection"] is None and open_ and not (full and self.n >= self.required)
        if ok:
            self.have[row["pose"]] += 1
            self.n += 1
        full = all(self.have[k] >= q for k, q in self.quotas.items())
        return [row | {"accepted": ok, "complete": full and self.n >= self.required}]


class PollDiff(Step):
    """An event where a poll's state differs from the one before; the first poll gives none."""

    def __init__(self, state: str):
        self.state, self.last, self.first = state, None, True

    def __call__(self, row: Row) -> list[Row]:
        out = [] if self.first or row[self.state] == self.last else [row | {"from_state": self.last}]
        self.last, self.first = row[self.state], False
        return out


class Ema(Step):
    """Exponential smoothing of number columns: keep * old + (1 - keep) * new, from the first row's values on; rounded where asked."""

    def __init__(self, columns: list[str], keep: float, whole: bool = False):
        self.columns, self.keep, self.whole, self.value = columns, keep, whole, None

    def __call__(self, row: Row) -> list[Row]:
        new = [float(row[c]) for c in self.columns]
        mixed = new if self.value is None else [self.keep * a + (1 - self.keep) * b for a, b in zip(self.value, new, strict=True)]
        self.value = [float(round(x)) for x in mixed] if self.whole else mixed
        return [row | {f"smooth_{c}": v for c, v in zip(self.columns, self.value, strict=True)}]
