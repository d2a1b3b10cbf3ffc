"""Vector code compression: product codes of integer vectors, their codebooks searched by ball trees.

Every component becomes floor(scale * x), a vector is cut into equal parts, and each part position has a
codebook of its own.  A part's nearest entry is found in a ball tree over the codebook: a ball is skipped
only if the least distance that its centre and radius leave possible is above the best one so far.
Radii are rounded up and distances to centres down, balls at the very bound are visited too, and what
decides is the squared distance in 64-bit integers, ties to the lower index.  So the result is that of a
search through all entries, whatever the floats did.

Spark carries the rows.  The driver sees the codebooks alone (``entries`` times the vector's length), and
of each round the sums and counts of every entry, which tasks add up before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import cut_lineage, finite, hot_keys, join_per_key, map_texts, slices

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries of a leaf; and the size of an integer component from which squared distances could leave 64 bits.
LEAF, LARGEST = 8, 1 << 27
#: How far floats may be off, relative to their size: well over what the sums here can lose.
SLACK = 1e-9


@dataclass
class _Ball:
    """Some entries of a codebook: a centre, a radius rounded up, and two balls inside or the entries' own indexes."""

    centre: np.ndarray
    radius: float
    own: np.ndarray
    inner: list[_Ball] = field(default_factory=list)


class BallTree:
    """The entries (n, width) of one part position, integers."""

    def __init__(self, entries: np.ndarray, leaf: int = LEAF):
        self.entries, self.leaf = np.asarray(entries, np.int64), leaf
        self.top = self._ball(np.arange(len(self.entries)))

    def _ball(self, own: np.ndarray) -> _Ball:
        points = self.entries[own].astype(float)
        centre = points.mean(axis=0)
        away = np.sqrt(((points - centre) ** 2).sum(axis=1))
        ball = _Ball(centre, float(away.max() * (1 + SLACK) + SLACK), own)
        if len(own) > self.leaf and away.max() > 0:
            a = points[away.argmax()]
            from_a = ((points - a) ** 2).sum(axis=1)
            from_b = ((points - points[from_a.argmax()]) ** 2).sum(axis=1)
            left = from_a <= from_b
            if left.any() and not left.all():
                ball.inner = [self._ball(own[left]), self._ball(own[~left])]
        return ball

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each of ``points`` (n, width), integers."""
        best, index = np.full(len(points), np.iinfo(np.int64).max), np.full(len(points), len(self.entries))
        floats = points.astype(float)

        def away(ball: _Ball, rows: np.ndarray) -> np.ndarray:
            return np.sqrt(((floats[rows] - ball.centre) ** 2).sum(axis=1))

        def may_hold(ball: _Ball, rows: np.ndarray, distance: np.ndarray) -> np.ndarray:
            least = np.maximum(distance * (1 - SLACK) - ball.radius, 0.0)
            return rows[least * least <= best[rows] * (1 + SLACK)]

        def visit(ball: _Ball, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if ball.inner:
                one, two = ball.inner
                to_one, to_two = away(one, rows), away(two, rows)
                first = to_one <= to_two
                for ball_now, now in ((one, first), (two, ~first), (two, first), (one, ~first)):
                    visit(ball_now, may_hold(ball_now, rows[now], (to_one if ball_now is one else to_two)[now]))
                return
            squares = ((points[rows, None, :] - self.entries[ball.own]) ** 2).sum(axis=2)
            at = squares.argmin(axis=1)  # the first of equal ones: own ascends
            square, own = squares[np.arange(len(rows)), at], ball.own[at]
            better = (square < best[rows]) | ((square == best[rows]) & (own < index[rows]))
            best[rows[better]], index[rows[better]] = square[better], own[better]

        visit(self.top, np.arange(len(points)))
        return index, best


@dataclass
class Codebooks:
    """entries: integers (parts, entries, width of a part); scale: what components are multiplied with."""

    entries: np.ndarray
    scale: int = SCALE

    def sha256(self) -> str:
        """Of all components in decimal by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    @property
    def length(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]


def _integers(column: pa.Array, scale: int, parts: int) -> np.ndarray:
    """(rows, parts, width) of a batch's vectors."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        scaled = np.floor(flat * scale)
    if len(scaled) and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"a component beyond {LARGEST / scale:g}: squared distances would leave 64 bits")
    return scaled.astype(np.int64).reshape(len(column), parts, -1)


def _kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None, parts: int) -> DataFrame:
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"), label.alias("label"))
    return rows.where(finite("v") & (F.size("v") > 0) & (F.size("v") % parts == 0))


def _seeds(kept: DataFrame, n: int) -> list[list[float]]:
    """The vectors of the ``n`` smallest ids, once each; the first one's length is everyone's.

    Each look takes the ``n`` first rows beyond the ids that are known, so copies of one id cost a look, not memory.
    """
    found, last, length = [], None, None
    while len(found) < n:
        rest = kept if last is None else kept.where(F.col("vec_id").isNull() | (F.col("vec_id") > last))
        rest = rest if length is None else rest.where(F.size("v") == length)
        rows = rest.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(n).select("vec_id", "v").collect()
        for r in rows:
            length = length or len(r.v)
            if len(r.v) == length and len(found) < n and (not found or r.vec_id != last):
                found.append(list(r.v))
                last = r.vec_id
        if len(rows) < n or last is None:
            break
    return found


def _sums(kept: DataFrame, books: Codebooks) -> DataFrame:
    """(slot, total): for each entry, flat by part and entry, the summed components of its parts and, last, their number."""
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [BallTree(e) for e in books.entries]
        totals = np.zeros((parts, entries, width + 1), np.int64)
        for batch in slices(batches, "v"):
            rows = _integers(batch.column("v"), books.scale, parts)
            for p, tree in enumerate(trees):
                own, _ = tree.nearest(rows[:, p])
                np.add.at(totals[p, :, :width], own, rows[:, p])
                totals[p, :, width] += np.bincount(own, minlength=entries)
        used = np.repeat(totals[:, :, width:] > 0, width + 1, axis=2).ravel().nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(totals.ravel()[used])], ["slot", "part"])

    return kept.select("v").mapInArrow(run, "slot long, part long").groupBy("slot").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks that start as the parts of the ``entries`` smallest ids and move ``rounds`` times to the floored means of all that is nearest to them.

    Vectors that are null or hold null or non-finite components take no part, nor do those whose length is
    no multiple of ``parts`` or differs from that of the smallest id left.  Of rows with one id the least
    vector is the seed; null ids count as one, behind all others.  With fewer ids the codebooks are
    shorter; with none they have no entries.  An unused entry stays as it is.
    """
    if entries > 256:
        raise ValueError("a code has two hexadecimal digits: at most 256 entries")
    kept = _kept(vectors, id_col, vector_col, None, parts)
    seeds = _seeds(kept, entries)
    if not seeds:
        return Codebooks(np.zeros((parts, 0, 0), np.int64), scale)
    seed = _integers(pa.array(seeds, pa.list_(pa.float64())), scale, parts)
    books, kept = Codebooks(seed.transpose(1, 0, 2).copy(), scale), kept.where(F.size("v") == len(seeds[0]))
    width = books.entries.shape[2]
    for _ in range(rounds):
        totals = np.zeros(books.entries.size // width * (width + 1), object)
        for slot, total in _sums(kept, books).collect():  # one row for each component of a codebook
            totals[slot] = int(total)
        totals = totals.reshape(*books.entries.shape[:2], width + 1)
        moved = books.entries.copy()
        for p, e in zip(*(totals[:, :, width] > 0).nonzero(), strict=True):
            moved[p, e] = [t // totals[p, e, width] for t in totals[p, e, :width]]
        books = Codebooks(moved, scale)
    return books


def encode(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, code, error, label_error) of each row that ``fit`` would take into account; repeated rows come back repeated.

    code: two hexadecimal digits for each part; error: the squared distances, summed; label_error: the
    errors of all rows of an equal label (nulls are one), summed.  A label that holds many rows is summed
    in every task first and its sum is sent to the rows, not they to it.  Other columns are not read.
    """
    parts, entries, _ = books.entries.shape

    def make():
        trees = [BallTree(e) for e in books.entries]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = _integers(batch.column("v"), books.scale, parts)
            codes, errors = np.zeros((len(rows), parts), np.uint8), np.zeros(len(rows), np.int64)
            for p, tree in enumerate(trees):
                codes[:, p], square = tree.nearest(rows[:, p])
                errors += square
            return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(errors)], ["vec_id", "label", "code", "error"])

        return step

    kept = _kept(vectors, id_col, vector_col, label_col, parts).where(F.size("v") == books.length if entries else F.lit(False))
    types = dict(kept.dtypes)
    coded = cut_lineage(map_texts(kept, make, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long", "v"))
    sums = cut_lineage(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"), F.count(F.lit(1)).alias("n")))
    return join_per_key(coded, sums.drop("n"), hot_keys(sums, "label"), "label")


def decode(codes: DataFrame, books: Codebooks, code_col: str = "code", into: str = "vector") -> DataFrame:
    """``codes`` with the vector (array of double) that a code stands for: the middle of each integer's span; null codes give null."""
    parts, entries, width = books.entries.shape
    values = F.array(*(F.lit(float((x + 0.5) / books.scale)) for x in books.entries.ravel().tolist())) if entries else F.array().cast("array<double>")
    own = lambda i: F.conv(F.substring(F.col(code_col), 2 * i + 1, 2), 16, 10).cast("int")
    pieces = [F.slice(values, (own(i) + i * entries) * width + 1, width) for i in range(parts)]
    return codes.withColumn(into, F.when(F.col(code_col).isNotNull(), F.concat(*pieces)))


def oracle_sql() -> str:
    """DuckDB SQL: every part against every entry, the rounds one after another."""
    assign = "select vec_id, p, k, c, d from (select vec_id, p, k, x, c, d, row_number() over (partition by vec_id, p order by d, k) as r from (select x.vec_id, x.p, b.k, x.x, b.c, list_sum(list_transform(range(1, len(x.x) + 1), lambda i: (x.x[i] - b.c[i]) * (x.x[i] - b.c[i]))) as d from x join {b} b on x.p = b.p)) where r = 1"
    step = """a{i} as ({assign}), m{i} as (select p, k, list(v order by i) as c from (select a.p, a.k, i, cast(floor(sum(x.x[i]) / count(*)) as bigint) as v from a{i} a join x using (vec_id, p), range(1, 1 + (select any_value(len(x)) from x)) t(i) group by all) group by all),
b{j} as (select b.p, b.k, coalesce(m.c, b.c) as c from b{i} b left join m{i} m using (p, k))"""
    rounds = ",\n".join(step.format(i=i, j=i + 1, assign=assign.format(b=f"b{i}")) for i in range(ROUNDS))
    return f"""with e as (select vec_id, label, list_transform(embedding, lambda v: cast(floor({SCALE} * cast(v as double)) as bigint)) as x from embeddings where embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0),
x as (select vec_id, p, x[p * (len(x) // {PARTS}) + 1:(p + 1) * (len(x) // {PARTS})] as x from e, range({PARTS}) t(p)),
b0 as (select p, row_number() over (partition by p order by vec_id) - 1 as k, x as c from x where vec_id in (select vec_id from e order by vec_id limit {ENTRIES})),
{rounds},
z as ({assign.format(b=f'b{ROUNDS}')}),
f as (select vec_id, string_agg(lpad(to_hex(k), 2, '0'), '' order by p) as code, cast(sum(d) as bigint) as error from z group by 1),
h as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, k)) as codebooks_sha256 from b{ROUNDS})
select vec_id, lower(code) as code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from f join e using (vec_id), h"""
