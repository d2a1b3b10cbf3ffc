"""Approximate nearest neighbours by an inverted multi-index, searched until nothing nearer can be left.

A vector's two halves are quantised by a codebook each; a cell is a pair of centroids, and the index files
every vector under its cell.  A query goes through the pairs of centroids with a heap, in order of their
summed distance, until the cells hold ``first`` vectors: these are reranked by their true distances, and
the last of the nearest is a bound.  Then the heap goes on by the least distance that a cell can have (a
centroid's distance less the reach of its members, in each half), and stops where that is over the bound.
So recall is 1 whatever the data are: where vectors lie in clumps few cells are visited, where they have
no structure all are.

Equal vectors are one entry with its ``k + 1`` least ids (more can't be among ``k`` nearest); that bound is
taken before anything is shuffled.  Entries of a cell and queries that visit it meet in pieces of bounded
size, at matrix products; only the nearest of each piece leave it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm._common import cut_lineage, fetch, finite, hot_keys, join_per_key, map_texts, pick_keys, slices

#: Vectors that the codebooks are fitted on, at most, and rounds of the fit; entries and queries that meet in one piece, about.
SAMPLE, FIT_ROUNDS, ENTRIES, QUERIES = 8192, 12, 2048, 512
#: Vectors that the first look at a query's nearest cells reaches; how far a float may be off, relative to its size.
FIRST, SLACK = 64, 1e-9


def centroids_for(n: int) -> int:
    """Centroids of a half for ``n`` vectors: their fourth root, so that a cell holds about the square root; from 4 to 256."""
    return int(min(256, max(4, round(n**0.25))))


def _clusters(points: np.ndarray, k: int) -> np.ndarray:
    """Centroids (k, width) of points by Lloyd's rounds; the starts are points far from each other, so no seed is needed."""
    centres = [points[0]]
    near = ((points - centres[0]) ** 2).sum(axis=1)
    while len(centres) < min(k, len(points)) and near.max() > 0:
        centres.append(points[near.argmax()])
        near = np.minimum(near, ((points - centres[-1]) ** 2).sum(axis=1))
    centres = np.array(centres)
    for _ in range(FIT_ROUNDS):
        own = _squares(points, centres).argmin(axis=1)
        for c in np.unique(own):
            centres[c] = points[own == c].mean(axis=0)
    return centres


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b, nearly."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0.0)


class Cells:
    """What the index knows of its cells: two codebooks, each centroid's reach (the largest and least distance of its members), and each cell's number of entries."""

    def __init__(self, halves: tuple[np.ndarray, np.ndarray], reach: list[np.ndarray], counts: dict[int, int]):
        self.halves, self.reach, self.counts = halves, reach, counts

    def distances(self, vectors: np.ndarray) -> list[np.ndarray]:
        """The distances of all vectors' halves to all centroids, one centroid after another: no array is larger than the vectors, or their distances."""
        cut = self.halves[0].shape[1]
        return [np.sqrt(np.stack([((part - one) ** 2).sum(axis=1) for one in c], axis=1)) for part, c in zip((vectors[:, :cut], vectors[:, cut:]), self.halves, strict=True)]

    def walk(self, one: np.ndarray, two: np.ndarray) -> Iterator[tuple[float, int]]:
        """(sum, cell) in ascending order of the sum of a value of each half: a heap over the two sorted lists."""
        a, b = one.argsort(kind="stable"), two.argsort(kind="stable")
        heap, ready = [(one[a[0]] + two[b[0]], 0, 0)], {(0, 0)}
        while heap:
            total, i, j = heapq.heappop(heap)
            yield float(total), int(a[i]) * len(b) + int(b[j])
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(a) and y < len(b) and (x, y) not in ready:
                    ready.add((x, y))
                    heapq.heappush(heap, (one[a[x]] + two[b[y]], x, y))

    def first(self, one: np.ndarray, two: np.ndarray, least: int) -> list[int]:
        """Cells in order of the summed squared distance of their centroids until they hold ``least`` entries; empty ones are left out."""
        out, n = [], 0
        for _, cell in self.walk(one * one, two * two):
            if cell in self.counts:
                out.append(cell)
                n += self.counts[cell]
                if n >= least:
                    break
        return out

    def within(self, one: np.ndarray, two: np.ndarray, bound: float) -> list[int]:
        """All cells that may have a member at a squared distance of ``bound`` or less; empty ones are left out."""
        low = [np.maximum(np.maximum(d * (1 - SLACK) - r[0], r[1] - d * (1 + SLACK)), 0.0) for d, r in zip((one, two), self.reach, strict=True)]
        out = []
        for total, cell in self.walk(low[0] ** 2, low[1] ** 2):
            if total > bound * (1 + SLACK):
                break
            if cell in self.counts:
                out.append(cell)
        return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    return rows.where(F.col("id").isNotNull() & finite("v") & F.exists("v", lambda x: x != 0))


class MultiIndex:
    """The index over a table's vectors: ``entries`` (node, ids, v, cell, d1, d2), written, and ``cells``."""

    def __init__(self, entries: DataFrame, cells: Cells, width: int, k: int):
        self.entries, self.cells, self.width, self.k = entries, cells, width, k

    def _meet(self, probes: DataFrame) -> DataFrame:
        """(query, square, ids): for each piece of a cell and each query that visits it, the nearest ``k + 1`` entries with their ids.

        probes: (query, q, bound, cell).  What lies beyond ``bound`` (a squared distance) is left out.
        """
        k, width = self.k + 1, self.width
        visits = probes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("blocks"))
        pieces = self.entries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / ENTRIES).cast("int").alias("pieces"))
        plan = F.broadcast(cut_lineage(visits.join(pieces, "cell")))  # a row for each cell
        of = lambda name, count: F.pmod(F.xxhash64(name), F.col(count)).cast("int")
        every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
        left = self.entries.join(plan, "cell").select("cell", of("node", "pieces").alias("piece"), every("blocks").alias("block"), "ids", "v")
        right = probes.join(plan, "cell").select("cell", every("pieces").alias("piece"), of("query", "blocks").alias("block"), "query", "q", "bound")

        def nearest(entries: pa.Table, queries: pa.Table) -> pa.Table:
            if not entries.num_rows or not queries.num_rows:
                return pa.table([pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.list_(pa.int64()))], ["query", "square", "ids"])
            x, q = (_matrix(t.column(c).combine_chunks(), width) for t, c in ((entries, "v"), (queries, "q")))
            rough = _squares(q, x)
            slack = SLACK * ((q * q).sum(axis=1) + (x * x).sum(axis=1).max())  # rounding in rough is far below
            limit = queries.column("bound").to_numpy()
            if rough.shape[1] > k:
                limit = np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, k - 1] + slack)
            i, j = (rough <= (limit + slack)[:, None]).nonzero()
            square = np.zeros(len(i))
            for at in range(width):  # one component after another, so that the sum is the same wherever it is made
                step = q[i, at] - x[j, at]
                square += step * step
            keep = square <= queries.column("bound").to_numpy()[i]
            i, j, square = i[keep], j[keep], square[keep]
            lists = entries.column("ids").combine_chunks()
            return pa.table([queries.column("query").take(pa.array(i)), pa.array(square), lists.take(pa.array(j))], ["query", "square", "ids"])

        keys = ["cell", "piece", "block"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(nearest, "query long, square double, ids array<long>")

    def search(self, queries: DataFrame) -> DataFrame:
        """(query, found): the ``k + 1`` nearest (square, id) of each of ``queries`` (query, q), ascending, ties to smaller ids."""
        cells, k, width = self.cells, self.k + 1, self.width

        def probe(first: bool):
            def make():
                def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                    one, two = cells.distances(_matrix(batch.column("q"), width))
                    lists = []
                    for a, b, bound in zip(one, two, batch.column("bound").to_pylist(), strict=True):
                        seen = cells.first(a, b, max(FIRST, 4 * k))
                        lists.append(seen if first else sorted(set(cells.within(a, b, bound)) - set(seen)))
                    at = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
                    flat = pa.array([c for x in lists for c in x], pa.int32())
                    return pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("query", "q", "bound")), flat], ["query", "q", "bound", "cell"])

                return step

            return make

        def best(found: DataFrame) -> DataFrame:
            w = Window.partitionBy("query").orderBy("square", F.get("ids", F.lit(0)))
            return found.withColumn("at", F.row_number().over(w)).where(F.col("at") <= k)

        kind = f"query long, q {dict(queries.dtypes)['q']}, bound double, cell int"
        queries = queries.withColumn("bound", F.lit(float("inf")))
        near = cut_lineage(best(self._meet(cut_lineage(map_texts(queries, probe(True), kind, "q")))).select("query", "square", "ids"))
        bounds = near.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("far"))
        queries = queries.drop("bound").join(bounds, "query").select("query", "q", F.when(F.col("n") >= k, F.col("far")).otherwise(F.lit(float("inf"))).alias("bound"))
        rest = cut_lineage(map_texts(queries, probe(False), kind, "q"))
        found = best(near.unionByName(self._meet(rest)))
        ids = found.select("query", "square", F.explode("ids").alias("id"))  # k + 1 entries with k + 1 ids at most
        ids = ids.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy("square", "id"))).where(F.col("at") <= k)
        return ids.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("square", "id"))).alias("found"))


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, centroids: int | None = None) -> MultiIndex | None:
    """The index over all usable rows: not null, finite, not zero, with an id, and of the length of the first one in order of id. None if there is none.

    Only the codebooks are fitted on a sample (SAMPLE vectors at most, those of the least hashed ids);
    every vector is filed.  ``centroids`` of a half: ``centroids_for`` the number of distinct vectors, or as given.
    """
    rows = _usable(vectors, id_col, vector_col)
    one = rows.orderBy("id", "v").select(F.size("v").alias("n")).first()
    if one is None:
        return None
    rows, width = rows.where(F.size("v") == one.n), one.n
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))  # Spark takes the first k + 1 in each task before it shuffles
    distinct = rows.distinct().withColumn("at", place).where(F.col("at") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = cut_lineage(distinct.withColumn("node", F.monotonically_increasing_id()))
    hashed = classes.select(F.xxhash64(F.get("ids", F.lit(0))).alias("h"), "v")
    sample = np.array([list(r.v) for r in fetch(hashed, "h", pick_keys(hashed, "h", SAMPLE), "v")], np.float64)
    number, cut = centroids or centroids_for(classes.count()), width // 2
    halves = _clusters(sample[:, :cut], number), _clusters(sample[:, cut:], number)
    bare = Cells(halves, [], {})

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            one, two = bare.distances(_matrix(batch.column("v"), width))
            a, b = one.argmin(axis=1), two.argmin(axis=1)
            rows = np.arange(len(a))
            columns = [batch.column(c) for c in ("node", "ids", "v")] + [pa.array((a * two.shape[1] + b).astype(np.int32)), pa.array(one[rows, a]), pa.array(two[rows, b])]
            return pa.RecordBatch.from_arrays(columns, ["node", "ids", "v", "cell", "d1", "d2"])

        return step

    kind = f"node long, ids array<long>, v {dict(classes.dtypes)['v']}, cell int, d1 double, d2 double"
    entries = cut_lineage(map_texts(classes, make, kind, "v"))
    told = entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *(f(d).alias(f"{f.__name__}_{d}") for f in (F.max, F.min) for d in ("d1", "d2"))).collect()  # a row for each cell
    reach, size = [np.array([[0.0] * len(h), [np.inf] * len(h)]) for h in halves], len(halves[1])
    for r in told:
        for h, c, d in ((0, r.cell // size, "d1"), (1, r.cell % size, "d2")):
            reach[h][0, c] = max(reach[h][0, c], r[f"max_{d}"] * (1 + SLACK))
            reach[h][1, c] = min(reach[h][1, c], r[f"min_{d}"] * (1 - SLACK))
    return MultiIndex(entries, Cells(halves, reach, {r.cell: r.n for r in told}), width, k)


def neighbours(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", centroids: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest others of each vector whose id ``every`` divides, nearest first, ties to smaller ids.

    score: the Euclidean distance of the original vectors in double precision.  Null, zero and non-finite
    vectors, null ids and vectors of another length than the first take no part; rows equal in id and
    vector count once.  Of one id's different vectors each is a candidate and a query of its own, with
    ranks from 1, and none is a neighbour of its id.  Queries with equal vectors are searched once.
    Other columns are not read.
    """
    spark = vectors.sparkSession
    index = build(vectors, id_col, vector_col, k, centroids)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = _usable(vectors, id_col, vector_col).where((F.size("v") == index.width) & (F.col("id") % every == 0)).distinct()
    counts = cut_lineage(asked.groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    nodes = index.entries.select("node", "v").join(counts.select(F.col("v").alias("q")), F.col("v") == F.col("q"), "left_semi")
    found = index.search(cut_lineage(nodes.select(F.col("node").alias("query"), F.col("v").alias("q"))))
    per_vector = cut_lineage(nodes.join(found, F.col("node") == F.col("query")).select("v", "found"))
    rows = join_per_key(asked, per_vector, hot_keys(counts, "v"), "v").select(F.col("id").alias("query_id"), "found")
    others = F.filter("found", lambda f: f["id"] != F.col("query_id"))
    rows = rows.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "f"))
    return rows.select("query_id", (F.col("at") + 1).alias("rank"), F.col("f.id").alias("vec_id"), F.sqrt("f.square").alias("score"))


def oracle_sql(every: int = 100, k: int = 10) -> str:
    """DuckDB SQL: every query against every row."""
    return f"""with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
d as (select q.vec_id as query_id, e.vec_id, sqrt(list_reduce(list_prepend(0.0::double, list_transform(q.v, lambda x, i: (x - e.v[i]) * (x - e.v[i]))), lambda a, b: a + b)) as score from e q join e on q.vec_id <> e.vec_id where q.vec_id % {every} = 0),
r as (select *, row_number() over (partition by query_id order by score, vec_id) as r from d)
select query_id, cast(r as integer) as rank, vec_id, score from r where r <= {k}"""
