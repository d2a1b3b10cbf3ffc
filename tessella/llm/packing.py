"""Best-fit packing of documents into training sequences, after Martello-Toth dominance reduction.

Documents are tokenised where they lie; only (row, length) travels.  The instance is the histogram of
piece lengths, at most ``capacity`` counts whatever the corpus holds, so the plan is made from it on the
driver.  A set with a length L dominates all others with L if nothing can fill a sequence better: a
piece that fills it exactly; the largest that fits, where no two others fit beside L; or a single piece
no smaller than any two that fit.  Such sets are fixed for good, as often as their pieces last, and the
shrunken instance goes to best-fit decreasing.  The plan speaks of runs of equally long pieces; a piece
finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm._bpe import Merges, WordEncoder
from tessella.llm._common import cut_lineage, map_texts

CAPACITY, END_ID = 4096, 1
#: Words that a worker keeps encoded.
WORDS_KEPT = 350_000

#: The vocabulary's own split, in re's classes; they agree on all texts without an _ODD character.
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: What may normalise or split in another way in the vocabulary's own library, and the marks of its added tokens.
_ODD = re.compile("[\x1c-\x1f\x85\xb2\xb3\xb9\xbc-\xbe\u0130ɐ-\U0010ffff]|<\\|")


class WordBpe:
    """Ids of a word-end BPE vocabulary file, as its library gives them without special tokens added.

    Texts of Latin letters and ASCII marks are split and merged here, many at a time, each word once.
    Whatever holds another character goes through the library itself, whose Unicode tables and added
    tokens (their strings in a text are those tokens) decide then.
    """

    def __init__(self, path: str):
        self.path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        pairs = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(shown))}
        ids = [np.array([vocab.get(letters[b] + end, -1) for b in range(256)]) for end in ("", suffix)]
        self.encoder = WordEncoder(Merges(pairs), ids[0], last=ids[1], most=WORDS_KEPT)

    @property
    def library(self) -> Tokenizer:
        if self._library is None:
            self._library = Tokenizer.from_file(self.path)
        return self._library

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        words, counts, odd = [], [], {}
        for i, t in enumerate(texts):
            if _ODD.search(t) is not None:
                odd[i] = np.array(self.library.encode(t, add_special_tokens=False).ids, np.int32)
                counts.append(0)
                continue
            own = _PLAIN.findall(t.lower())
            counts.append(len(own))
            words += own
        ids, per_word = self.encoder.encode(words)
        cuts = np.concatenate([[0], np.cumsum(per_word)])[np.cumsum([0, *counts])]
        return [odd[i] if i in odd else ids[a:b] for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


_HELD: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    if path not in _HELD:
        _HELD[path] = WordBpe(path)
    return _HELD[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, piece int, start, length, ids_crc32 long[, ids array<int>]): each document's ids and the end id, cut at ``capacity``.

    Null texts count as empty: a piece of nothing but the end id.  Null and repeated doc_ids stay rows
    of their own.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def make():
        bpe = tokenizer(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), bpe.encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                ids = np.append(ids, END_ID).astype("<u4")
                for k in range(0, len(ids), capacity):
                    part = ids[k : k + capacity]
                    rows.append((doc_id, k // capacity, k, len(part), zlib.crc32(part.tobytes()), *([part.astype(np.int32)] * with_ids)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * (5 + with_ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

        return step

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), make, schema)


class _Plan:
    """Runs (length, first rank, sequences, pieces in each, first sequence, offset) of a packing."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = {k: v for k, v in counts.items() if v}
        self.capacity, self.used, self.next, self.runs = capacity, dict.fromkeys(self.left, 0), 0, []

    def place(self, length: int, bins: int, each: int, first: int, offset: int) -> None:
        self.runs.append((length, self.used[length], bins, each, first, offset))
        self.used[length] += bins * each
        self.left[length] -= bins * each
        if not self.left[length]:
            del self.left[length]

    def fix(self, lengths: list[int], bins: int) -> None:
        at = 0
        for n in lengths:
            self.place(n, bins, 1, self.next, at)
            at += n
        self.next += bins


def dominating(lengths: list[int], counts: dict[int, int], length: int, room: int) -> list[int] | None:
    """What to put beside one piece of ``length`` so that the set dominates every other with it; None: not known.

    lengths: the lengths left, ascending; counts: how many of each, this piece included.
    """

    def spare(x: int, *held: int) -> int:
        return counts.get(x, 0) - (x == length) - sum(h == x for h in held)

    if spare(room) > 0:
        return [room]
    fits = lengths[: bisect_right(lengths, room)]
    while fits and spare(fits[-1]) <= 0:
        fits.pop()
    if not fits:
        return []
    smallest, need = [], 3
    for x in fits:
        take = min(need, spare(x))
        smallest += [x] * take
        need -= take
        if not need:
            break
    if len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return [fits[-1]]
    if len(smallest) < 3 or sum(smallest) > room:  # two more at most
        best, j = 0, len(fits) - 1
        for x in fits:
            while j >= 0 and (x + fits[j] > room or spare(fits[j], x) <= 0):
                j -= 1
            if j < 0:
                break
            best = max(best, x + fits[j])
        if best <= fits[-1]:
            return [fits[-1]]
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int, int]:
    """The runs of a packing of so many pieces of each length, its number of sequences, and how many of them dominance fixed."""
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("a length is not between 1 and the capacity")
    p = _Plan(counts, capacity)
    fixed = True
    while fixed:  # until nothing more is dominated
        fixed = False
        lengths = sorted(p.left)
        for n in reversed(lengths.copy()):
            while n in p.left and (beside := dominating(lengths, p.left, n, capacity - n)) is not None:
                bins = p.left[n] // 2 if n in beside else min(p.left[x] for x in [n, *beside])
                p.fix([n, *beside], bins)
                fixed = True
                for x in {n, *beside}:
                    if x not in p.left:
                        del lengths[bisect_left(lengths, x)]
    reduced = p.next
    rooms: list[int] = []  # of open sequences, ascending
    groups: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, how many)

    def keep(room: int, first: int, bins: int) -> None:
        if room and bins:
            if room not in groups:
                insort(rooms, room)
            groups.setdefault(room, []).append((first, bins))

    for n in sorted(p.left, reverse=True):
        while n in p.left:
            at = bisect_left(rooms, n)
            if at < len(rooms):
                room = rooms[at]
                first, bins = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, first, bins = capacity, p.next, max(1, p.left[n] // (capacity // n))
                p.next += bins
            each = min(room // n, p.left[n])
            take = min(bins, p.left[n] // each)
            p.place(n, take, each, first, capacity - room)
            keep(room - each * n, first, take)
            keep(room, first + take, bins - take)
    return p.runs, p.next, reduced


def place(sized: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """``sized`` with sequence_id and offset (long) of each row; lengths from 1 to ``capacity``.

    The rank of a row among the rows of its length is its number among those of its own partition plus
    the partitions before, so no length, however frequent, is sorted in one task.  Only the histogram,
    bounded by ``capacity``, reaches the driver; the runs of the plan go out with the tasks.
    """
    rows = cut_lineage(sized.withColumn("__row", F.monotonically_increasing_id()))
    histogram = rows.groupBy(F.col(length_col).alias("__n")).agg(F.count(F.lit(1)).alias("__count"))
    counts = {r[0]: r[1] for r in histogram.collect()}  # capacity rows at most
    runs, _, _ = plan(counts, capacity)
    rows = rows.withColumn("__group", F.shiftright("__row", 33))  # the partition that numbered the row
    sizes = rows.groupBy(length_col, "__group").agg(F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(Window.partitionBy(length_col).orderBy("__group")) - F.col("__size")
    sizes = sizes.select(length_col, "__group", before.alias("__before"))
    own = F.row_number().over(Window.partitionBy(length_col, "__group").orderBy("__row"))
    rows = rows.withColumn("__own", own).join(sizes, [length_col, "__group"]).withColumn("__rank", F.col("__own") + F.col("__before") - 1)
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 6)
    keys = table[:, 0] << 40 | table[:, 1]
    names = sized.columns
    schema = ", ".join([*(f"`{n}` {t}" for n, t in sized.dtypes), "sequence_id long", "`offset` long"])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (length_col, "__rank"))
            run = table[np.searchsorted(keys, length << 40 | rank, side="right") - 1]
            inside = rank - run[:, 1]
            sequence, offset = run[:, 4] + inside // run[:, 3], run[:, 5] + inside % run[:, 3] * length
            return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

        return step

    return map_texts(rows.select(*names, "__rank"), make, schema, text=None)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every row and its place.

    Pieces lie in their sequences without gaps.  An empty table gives an empty one; ``pieces`` gives the
    ids themselves, by the same doc_id and piece.
    """
    return place(pieces(docs, path, capacity, id_col, text_col, with_ids=False), capacity)
