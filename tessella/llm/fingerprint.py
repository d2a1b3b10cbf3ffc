"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds sum(c_k * B**k) modulo a prime; the hash of any span is a difference of two
entries times an inverse power, so span equality costs one comparison and the longest common extension
of two positions a binary search.  Equality is decided under two primes at once.  A fingerprint is the whole
text's hash under both, then a sketch: the least span hash of each residue class over all spans of
``SPAN`` code points.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import cut_lineage, hash_bound, map_texts

PRIMES, BASE, SPAN, SLOTS = (2_147_483_647, 2_147_483_629), 131_071, 12, 64
#: Rows of a range, on average, and how many sampled places the driver sees for each.
RANGE_ROWS, PLACES = 20_000, 8
_EMPTY = 0xFFFFFFFF


class Powers:
    """Powers of the base and of its inverse, as many as were asked for so far."""

    def __init__(self, prime: int):
        self.prime, self.up, self.down = prime, np.ones(1, np.int64), np.ones(1, np.int64)

    def to(self, n: int) -> None:
        while len(self.up) < n + 1:
            for name, base in (("up", BASE), ("down", pow(BASE, -1, self.prime))):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, old * pow(base, len(old), self.prime) % self.prime]))


_POWERS = tuple(Powers(p) for p in PRIMES)


class Prefix:
    """The prefix arrays of one text, one for each prime; the second is made when it is asked for."""

    def __init__(self, text: str):
        # code points start at 1, so that leading NULs count
        self.points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64) + 1
        self.n = len(self.points)
        self._sums: list[np.ndarray | None] = [None] * len(PRIMES)

    def sums(self, which: int = 0) -> np.ndarray:
        if self._sums[which] is None:
            powers = _POWERS[which]
            powers.to(self.n)
            own = np.zeros(self.n + 1, np.int64)
            np.cumsum(self.points * powers.up[: self.n] % powers.prime, out=own[1:])
            self._sums[which] = own
        return self._sums[which]

    def span(self, start, stop, which: int = 0):
        """The hash of text[start:stop]; arrays of places are as good as single ones."""
        powers, sums = _POWERS[which], self.sums(which)
        return (sums[stop] - sums[start]) % powers.prime * powers.down[start] % powers.prime

    def spans(self, width: int) -> np.ndarray:
        """The hashes of all spans of so many code points, under the first prime."""
        powers, sums = _POWERS[0], self.sums()
        return (sums[width:] - sums[:-width]) % powers.prime * powers.down[: self.n - width + 1] % powers.prime

    def whole(self) -> str:
        return "".join(f"{int(self.sums(k)[-1] % prime):08x}" for k, prime in enumerate(PRIMES))


def same_span(a: Prefix, i: int, b: Prefix, j: int, length: int) -> bool:
    """Whether a[i:i + length] equals b[j:j + length], by their hashes under both primes; False where a text ends before."""
    if i + length > a.n or j + length > b.n:
        return False
    return all(bool(a.span(i, i + length, k) == b.span(j, j + length, k)) for k in range(len(PRIMES)))


def common_extension(a: Prefix, b: Prefix, i: int = 0, j: int = 0) -> int:
    """The most code points from place i of a and j of b that are equal, by binary search."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if same_span(a, i, b, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def sketch(a: Prefix) -> np.ndarray:
    slots = np.full(SLOTS, _EMPTY, np.int64)
    if a.n:
        h = a.spans(SPAN) if a.n >= SPAN else np.array([a.span(0, a.n)])
        h = (h * 2_654_435_761 & 0xFFFFFFFF) ^ (h >> 7)
        np.minimum.at(slots, h % SLOTS, h // SLOTS)
    return slots


def fingerprint(text: str, a: Prefix | None = None) -> str:
    """16 hexadecimal digits of the whole, then 8 for each slot; equal for equal texts."""
    a = a or Prefix(text)
    return a.whole() + sketch(a).astype(">u4").tobytes().hex()


def likeness(one: str, other: str) -> float:
    """The share of filled slots on which two fingerprints agree; 1 if all else is equal."""
    if one == other:
        return 1.0
    a, b = (np.frombuffer(bytes.fromhex(x[16:]), ">u4") for x in (one, other))
    filled = (a != _EMPTY) | (b != _EMPTY)
    return float((a == b)[filled].mean()) if filled.any() else 0.0


def edit(text: str, following: str) -> str:
    """The last quarter (rounded down) of the text replaced by as many code points from the start of the following one."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, carry, doc_id, key, tie, times, text), ordered in partitions so that each row's next in the table follows it.

    Rows go to ranges of (id, hash of the text); the first row of each range goes to the end of the range
    before as well (``carry``), the table's first row to the last one's end.  Null ids come first; equal
    ids are in the order of their texts' hashes.  Rows equal in id and text are counted (``times``) where
    they lie before anything is dealt out, so no number of copies fills a range.  The driver sees PLACES
    sampled places and one first row (numbers, no texts) for every RANGE_ROWS rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.xxhash64("text").alias("tie"), "text")
    places = cut_lineage(rows.select("key", "tie"))
    n = places.count()
    ranges = max(1, min(n // 100, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), n // RANGE_ROWS)
    # distinct places only: copies of one row are one place
    chosen = places.where(F.xxhash64("key", "tie", F.lit(5)) <= hash_bound(PLACES * ranges / max(1, n))) if ranges > 1 else places.limit(0)
    sample = sorted((r.key, r.tie) for r in chosen.distinct().collect())
    bounds = sample[len(sample) // ranges :: max(1, len(sample) // ranges)] if ranges > 1 else []

    def ranged(batches):
        for batch in batches:
            own = [bisect_right(bounds, p) for p in zip(batch.column("key").to_pylist(), batch.column("tie").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *batch.columns], ["bucket", *batch.schema.names])

    heads = places.mapInArrow(ranged, "bucket long, key long, tie long").groupBy("bucket").agg(F.min(F.struct("key", "tie")).alias("head")).orderBy("bucket").collect()
    before = {(r.head.key, r.head.tie): heads[i - 1].bucket for i, r in enumerate(heads)}

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            first: dict[tuple, int] = {}
            times: list[int] = []
            taken: list[int] = []
            texts = batch.column("text").to_pylist()
            for i, place in enumerate(zip(batch.column("key").to_pylist(), batch.column("tie").to_pylist(), texts, strict=True)):
                at = first.setdefault(place, len(times))
                if at == len(times):
                    times.append(0)
                    taken.append(i)
                times[at] += 1
            own = [bisect_right(bounds, p[:2]) for p in first]
            carried = [(i, before[p[:2]]) for i, p in enumerate(first) if p[:2] in before]
            rows = batch.take(pa.array(taken + [taken[i] for i, _ in carried], pa.int64()))
            bucket, carry = own + [b for _, b in carried], [False] * len(own) + [True] * len(carried)
            counts = times + [1] * len(carried)
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(carry, pa.bool_()), pa.array(counts, pa.int64()), *rows.columns], ["bucket", "carry", "times", *rows.schema.names])

        return step

    spread = map_texts(rows, make, "bucket long, carry boolean, times long, doc_id long, key long, tie long, text string")
    return spread.repartition(ranges, "bucket").sortWithinPartitions("bucket", "carry", "key", "tie", "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, same_edited.

    Null texts count as empty (length 0, an empty sketch).  same_edited is the longest common extension
    from the start of a text and its edited form, located by binary search.  A single row is its own
    next; of rows equal in id and text all but the last have their own text as next; an empty table gives
    an empty one.  No other column of ``docs`` is read.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "same_edited"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def pair(doc_id, text: str, own: Prefix, print_: str, following: str, next_print: str) -> tuple:
        changed = edit(text, following)
        other = Prefix(changed)
        changed_print = fingerprint(changed, other)
        sha = hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest()
        return doc_id, len(text), sha, print_, changed_print, likeness(print_, changed_print), likeness(print_, next_print), common_extension(own, other)

    def found(batches):
        """(row, how often): a held row is given out when its next is known."""
        held = None  # bucket, doc_id, text, prefix, fingerprint
        for batch in batches:
            for bucket, carry, times, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "carry", "times", "doc_id", "text")), strict=True):
                if held is not None and held[0] != bucket:
                    held = None
                if held is None and carry:
                    continue  # a further copy of the carried row
                own = Prefix(text)
                print_ = fingerprint(text, own)
                if held is not None:
                    yield pair(*held[1:], text, print_), 1
                if times > 1:
                    yield pair(doc_id, text, own, print_, text, print_), times - 1
                held = None if carry else (bucket, doc_id, text, own, print_)

    def run(batches):
        done: list[tuple] = []
        for row, times in found(batches):
            while times:
                take = min(times, 500 - len(done))
                done += [row] * take
                times -= take
                if len(done) == 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
                    done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same_edited long"
    return with_next(docs, id_col, text_col).mapInArrow(run, schema)
