"""Identity handover from an entry camera to a room camera, as a timed step.

All times are microseconds.  The step's tables are dicts of plain tuples, so that a host can keep each as
a map of its own; the clock is the route's watermark, its largest event time.
"""

from __future__ import annotations

import heapq
from collections import Counter
from typing import Any

from tessella.streaming.hosts import Timed

Row = dict[str, Any]
SECOND = 1_000_000


class Handover(Timed):
    """Identities go to tracks where exactly one pair of a person and a track fits.

    A row has at, kind, and for a ``face``: face_track, student, similarity; for a ``track``: track,
    inside (is it in the entry zone).  A face waits ``delay`` seconds, a track that came into the zone
    ``skew`` longer; a pair fits if the track came from ``skew`` seconds before to ``delay`` seconds after
    the face was last seen.  What a route has not seen for ``stale`` seconds is forgotten.

    Every row gives one row back, with

    * entered: did the track just come into the zone (first seen there, or outside before);
    * status: of a face ``unknown`` (nobody, or not sure enough), ``held`` (a track has that identity),
      ``used`` (its identity was handed over), ``locked`` (it has another identity already) or
      ``pending``; of a track ``attached``, ``waiting`` or ``plain``;
    * student, similarity: the identity that is attached to the track, or that the face has;
    * waited: seconds from the face to the track's first row with its identity.

    A row of kind ``match`` follows where the change leaves one pair (outcome ``accepted``, with track and
    student) or several (``ambiguous``).  What expires may leave one pair as well: this is found when it
    expires, by a timer, not at the next row.
    """

    tables = {
        "faces": ("face string", "student string, similarity double, seen long"),
        "waiting": ("track string", "came long"),
        "used": ("face string", "seen long"),
        "inside": ("track string", "inside boolean, seen long"),
        "active": ("track string", "student string, similarity double, seen long, face_seen long, told boolean"),
    }

    def __init__(self, delay: float = 8.0, skew: float = 0.5, stale: float = 30.0, least: float = 0.5):
        super().__init__()
        self.delay, self.skew, self.stale, self.least = round(delay * SECOND), round(skew * SECOND), round(stale * SECOND), least
        self.faces: dict[str, tuple] = {}
        self.waiting: dict[str, tuple] = {}
        self.used: dict[str, tuple] = {}
        self.inside: dict[str, tuple] = {}
        self.active: dict[str, tuple] = {}
        self._index: tuple | None = None  # what follows from the tables, made from them when it is first needed

    def _known(self) -> tuple[list, dict[str, set[str]], dict[str, int]]:
        """Moments at which entries may be too old (a heap; an entry seen again stands there more than once), the faces of each pending student, and how many tracks hold each student."""
        if self._index is None:
            heap = [(v[at] + lasts + 1, n, k) for n, (rows, at, lasts) in enumerate(self._limits()) for k, v in rows.items()]
            heapq.heapify(heap)
            faces: dict[str, set[str]] = {}
            for face, v in self.faces.items():
                faces.setdefault(v[0], set()).add(face)
            self._index = heap, faces, Counter(a[0] for a in self.active.values())
        return self._index

    def _put(self, table: int, key: str, value: tuple) -> None:
        """Enter a value in a table (its place in ``_limits``); its time is told to the heap when it is new or moved on."""
        heap, faces, holders = self._known()
        rows, at, lasts = self._limits()[table]
        old = rows.get(key)
        rows[key] = value
        if old is None or old[at] != value[at]:
            heapq.heappush(heap, (value[at] + lasts + 1, table, key))
        if old is None and table == 0:
            faces.setdefault(value[0], set()).add(key)
        if old is None and table == 4:
            holders[value[0]] = holders.get(value[0], 0) + 1

    def _drop(self, table: int, key: str) -> tuple:
        _, faces, holders = self._known()
        value = self._limits()[table][0].pop(key)
        if table == 0:
            faces[value[0]].discard(key)
            if not faces[value[0]]:
                del faces[value[0]]
        if table == 4:
            holders[value[0]] -= 1
            if not holders[value[0]]:
                del holders[value[0]]
        return value

    @property
    def quiet(self) -> int:
        """After so many microseconds without a row nothing is left."""
        return max(self.delay + self.skew, self.stale) + 1

    def _limits(self):
        """(table, where its time stands, how long it lasts)."""
        return (self.faces, 2, self.delay), (self.waiting, 0, self.delay + self.skew), (self.used, 0, self.stale), (self.inside, 1, self.stale), (self.active, 2, self.stale)

    def due(self) -> int | None:
        """The first moment at which something is too old."""
        heap, limits = self._known()[0], self._limits()
        while heap:
            moment, n, k = heap[0]
            rows, at, lasts = limits[n]
            if k in rows and rows[k][at] + lasts + 1 == moment:
                return moment
            heapq.heappop(heap)
        return None

    def fire(self, now: int) -> list[Row]:
        self.clock = now if self.clock is None else max(self.clock, now)
        before = len(self.faces) + len(self.waiting)
        while (moment := self.due()) is not None and moment <= self.clock:
            self._drop(*heapq.heappop(self._known()[0])[1:])
        return self._match() if len(self.faces) + len(self.waiting) < before else []

    def __call__(self, row: Row) -> list[Row]:
        now = row["at"]
        self.clock = now if self.clock is None else max(self.clock, now)
        told = {"entered": None, "status": None, "outcome": None, "waited": None}
        if row["kind"] == "face":
            status, changed = self._face(row, now)
            told |= {"status": status, "track": None}
        else:
            entered, changed = self._track(row, now)
            told |= {"entered": entered, "student": None, "similarity": None}
        matches = self._match() if changed else []
        if row["kind"] == "track":
            told |= self._attached(row["track"], now)
        return [row | told, *matches]

    def _face(self, row: Row, now: int) -> tuple[str, bool]:
        face, student, sure = row["face_track"], row["student"], row["similarity"]
        if student is None or sure is None or sure < self.least:
            return "unknown", False
        if student in self._known()[2]:
            return "held", False
        if face in self.used:
            self._put(2, face, (max(self.used[face][0], now),))
            return "used", False
        known = self.faces.get(face)
        if known and known[0] != student:
            return "locked", False  # a face keeps the first identity it got
        self._put(0, face, (student, sure, max(known[2], now) if known else now))
        return "pending", True

    def _track(self, row: Row, now: int) -> tuple[bool, bool]:
        track, inside = row["track"], bool(row["inside"])
        was, seen = self.inside.get(track, (False, now))
        self._put(3, track, (inside, max(seen, now)))
        entered = inside and not was
        if track in self.active:
            a = self.active[track]
            self._put(4, track, (*a[:2], max(a[2], now), *a[3:]))
            return entered, False
        if entered and track not in self.waiting:
            self._put(1, track, (now,))
            return entered, True
        return entered, False

    def _attached(self, track: str, now: int) -> Row:
        if track not in self.active:
            return {"status": "waiting" if track in self.waiting else "plain"}
        student, sure, seen, face_seen, told = self.active[track]
        self.active[track] = (student, sure, seen, face_seen, True)
        return {"status": "attached", "student": student, "similarity": sure, "waited": None if told else (now - face_seen) / SECOND}

    def _match(self) -> list[Row]:
        """Two pairs are enough to know that it is ambiguous, so no more are sought."""
        _, faces, holders = self._known()
        for student in [s for s in faces if s in holders] if len(faces) < len(holders) else [s for s in holders if s in faces]:
            self._use(student)
        pairs: dict[tuple[str, str], tuple] = {}
        for student, sure, seen in self.faces.values():
            for track, (came,) in self.waiting.items():
                if -self.skew <= came - seen <= self.delay and ((student, track) not in pairs or seen > pairs[student, track][1]):
                    pairs[student, track] = (sure, seen)
                    if len(pairs) > 1:
                        return [{"at": self.clock, "kind": "match", "outcome": "ambiguous"}]
        if not pairs:
            return []
        (student, track), (sure, seen) = pairs.popitem()
        self._put(4, track, (student, sure, self._drop(1, track)[0], seen, False))
        self._use(student)
        return [{"at": self.clock, "kind": "match", "outcome": "accepted", "track": track, "student": student, "similarity": sure}]

    def _use(self, student: str) -> None:
        """The faces of a student whose identity was handed over."""
        own = self._known()[1].get(student, set())
        for face in sorted(own):
            self._put(2, face, (self._drop(0, face)[2],))
