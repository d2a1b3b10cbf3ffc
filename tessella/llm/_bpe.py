"""Byte-pair merging of many words at once, and flat token arrays for whole texts.

``Merges`` holds the pair table of one vocabulary.  ``WordEncoder`` turns lists of words into flat id
arrays: words seen before come from a bounded table, new ones are merged together, a column of a
matrix for each symbol, always the leftmost pair of the least rank in every row.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

import numpy as np

_NONE = np.int32(1 << 30)


class Merges:
    """The rank and the result of each pair of ids that merges."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        """pairs: (left, right) to (rank, merged id)."""
        keys = np.array([(a << 32) | b for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        values = np.array(list(pairs.values()), dtype=np.int32).reshape(-1, 2)[order]
        self.ranks = np.append(values[:, 0], _NONE)
        self.merged = np.append(values[:, 1], -1)
        self.pairs = pairs

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places in the table; the last place stands for no merge."""
        key = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1)

    def merge_rows(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids: a row of symbols for each word, -1 behind its end. Returns the merged rows and lengths."""
        ids, lengths = ids.copy(), lengths.copy()
        if ids.shape[1] < 2:
            return ids, lengths
        dead = len(self.keys) - 1
        at = self.find(ids[:, :-1], ids[:, 1:])
        at[(ids[:, 1:] < 0) | (ids[:, :-1] < 0)] = dead
        rows = np.arange(len(ids))
        columns = np.arange(ids.shape[1])
        while len(rows):
            rank = self.ranks[at[rows]]
            place = rank.argmin(axis=1)
            live = rank[np.arange(len(rows)), place] < _NONE
            rows, place = rows[live], place[live]
            if not len(rows):
                break
            made = self.merged[at[rows, place]]
            pick = columns[None, :] + (columns[None, :] > place[:, None])
            wide = np.concatenate([ids[rows], np.full((len(rows), 1), -1, ids.dtype)], axis=1)
            new = np.take_along_axis(wide, pick, axis=1)
            new[np.arange(len(rows)), place] = made
            ids[rows] = new
            lengths[rows] -= 1
            pick = columns[None, :-1] + (columns[None, :-1] > place[:, None])
            wide = np.concatenate([at[rows], np.full((len(rows), 1), dead, at.dtype)], axis=1)
            moved = np.take_along_axis(wide, pick, axis=1)
            for shift in (-1, 0):
                left = place + shift
                ok = (left >= 0) & (left < moved.shape[1])
                i, left = np.flatnonzero(ok), left[ok]
                right = new[i, left + 1]
                found = self.find(new[i, left], right)
                moved[i, left] = np.where(right < 0, dead, found)
            at[rows] = moved
        return ids, lengths

    def merge_long(self, ids: list[int]) -> list[int]:
        """One long word, with a heap of its pairs: n log n steps."""
        n = len(ids)
        left, right, ids = list(range(-1, n - 1)), list(range(1, n + 1)), list(ids)
        alive = [True] * n
        heap = []

        def push(i: int) -> None:
            j = right[i]
            if j < n and (hit := self.pairs.get((ids[i], ids[j]))):
                heapq.heappush(heap, (hit[0], i, ids[i], ids[j], hit[1]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], right[i] = made, False, right[j]
            if right[j] < n:
                left[right[j]] = i
            push(i)
            if left[i] >= 0:
                push(left[i])
        return [x for x, on in zip(ids, alive, strict=True) if on]


class _Places(dict):
    """Numbers words in the order in which they are met; ``fresh`` has those met since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        self.fresh.append(word)
        return place


class WordEncoder:
    """Ids of words, many at a time; keeps at most ``most`` words between calls.

    first: the id of each byte value; last: the same for a word's last byte, where the vocabulary marks
    word ends; whole: words (as bytes) that are tokens as they stand and are never merged up.
    """

    LONG, ROWS = 48, 16384

    def __init__(self, merges: Merges, first: np.ndarray, last: np.ndarray | None = None, whole: dict[bytes, int] | None = None, most: int = 600_000):
        self.merges, self.first, self.last, self.whole, self.most = merges, first.astype(np.int32), last, whole, most
        self._clear()

    def _clear(self) -> None:
        self.places = _Places()
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _learn(self, words: Sequence[str]) -> None:
        raw = [w.encode("utf-8", "replace") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(sizes)
        symbols = np.frombuffer(b"".join(raw), np.uint8)
        marks = symbols[ends - 1]
        symbols = self.first[symbols]
        if self.last is not None:
            symbols[ends - 1] = self.last[marks]
        starts, lengths = ends - sizes, sizes.copy()
        if self.whole is not None:
            known = np.fromiter((self.whole.get(w, -1) for w in raw), np.int32, len(raw))
            hit = np.flatnonzero(known >= 0)
            symbols[starts[hit]], lengths[hit] = known[hit], 1
        for i in np.flatnonzero(lengths > self.LONG):
            ids = self.merges.merge_long(symbols[starts[i] : ends[i]].tolist())
            symbols[starts[i] : starts[i] + len(ids)], lengths[i] = ids, len(ids)
        order = np.argsort(sizes, kind="stable")
        order = order[(sizes[order] <= self.LONG) & (lengths[order] > 1)]
        for k in range(0, len(order), self.ROWS):
            part = order[k : k + self.ROWS]
            columns = np.arange(int(sizes[part[-1]]))
            at = starts[part][:, None] + columns[None, :]
            mask = columns[None, :] < sizes[part][:, None]
            ids = np.where(mask, symbols[np.minimum(at, len(symbols) - 1)], -1).astype(np.int32)
            ids, lengths[part] = self.merges.merge_rows(ids, sizes[part])
            symbols[at[mask]] = ids[mask]  # the merged ids fill the front of each word's room
        flat = gather(symbols, starts, lengths)
        ends = np.cumsum(lengths) + len(self.flat)
        self.starts = np.concatenate([self.starts, ends - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each word has.

        Past ``most`` words the table no longer grows: further words are merged for the call alone.
        """
        places, known = self.places, len(self.places)
        index = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
        fresh, places.fresh = places.fresh, []
        if fresh:
            self._learn(fresh)
        lengths = self.lengths[index]
        out = gather(self.flat, self.starts[index], lengths)
        if len(places) > self.most and fresh:
            for w in fresh:
                del places[w]
            self.starts, self.lengths = self.starts[:known], self.lengths[:known]
            self.flat = self.flat[: int(self.starts[-1] + self.lengths[-1]) if known else 0]
        return out, lengths


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + length], one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]
