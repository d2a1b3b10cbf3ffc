"""Vector codes, Merkle manifest and multi-index against plain loops, on tables with all that may go wrong."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessella.llm import merkle, multi_index, vector_codes
from tessella.operators import skew

VECTORS = "vec_id long, embedding array<float>, label int, v string, key int, cell int, n long, ids string, slot int"


def vectors(n: int, width: int, seed: int) -> list[tuple]:
    """Random vectors with copies, near copies, repeated rows, and ones that take no part."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)).astype(np.float32)
    x[n // 2 :] = np.round(x[n // 2 :])  # many ties
    x[: n // 3] = x[0]
    x[n // 3 : n // 2] = x[1] + rng.normal(size=(n // 2 - n // 3, width)).astype(np.float32) * 1e-3
    rows = [(i, v.tolist(), None if i % 7 == 0 else i % 5) for i, v in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    rows += [(n, None, 1), (n + 1, [nan] * width, 1), (n + 2, [inf] + [0.0] * (width - 1), 2), (n + 3, [None] + [1.0] * (width - 1), 2), (n + 4, [0.0] * width, 3), rows[0], rows[5]]
    return [(*r, "a", 1, 2, 3, "b", 4) for r in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, VECTORS).repartition(5)


def usable(rows: list[tuple]) -> list[tuple]:
    return [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def plain_codes(rows: list[tuple], parts: int, entries: int, rounds: int):
    kept = [(r[0], np.floor(np.array(r[1], np.float32).astype(float) * 256).astype(int).reshape(parts, -1), r[2]) for r in usable(rows)]
    first = {i: x for i, x, _ in sorted(kept, key=lambda k: k[0])}
    books = [[first[i][p].tolist() for i in sorted(first)[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        sums = defaultdict(list)
        for _, x, _ in kept:
            for p in range(parts):
                sums[p, nearest(p, x[p].tolist())[1]].append(x[p].tolist())
        for (p, k), own in sums.items():
            books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    coded = [(i, label, [nearest(p, x[p].tolist()) for p in range(parts)]) for i, x, label in kept]
    per_label = defaultdict(int)
    for _, label, found in coded:
        per_label[label] += sum(d for d, _ in found)
    return books, sorted((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), per_label[label]) for i, label, f in coded)


@pytest.mark.parametrize("entries", [3, 40])
def test_codes_are_those_of_a_plain_search(spark, entries):
    rows = vectors(90, 8, 1)
    df = frame(spark, rows)
    books = vector_codes.fit(df, parts=4, entries=entries)
    want_books, want = plain_codes(rows, 4, entries, 2)
    assert books.entries.tolist() == want_books
    assert books.sha256() == hashlib.sha256(",".join(str(c) for p in want_books for e in p for c in e).encode()).hexdigest()
    coded = vector_codes.encode(df, books)
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in coded.collect()) == want
    back = {r.code: r.vector for r in vector_codes.decode(coded, books).collect()}
    for code, vector in back.items():
        own = [want_books[p][int(code[2 * p : 2 * p + 2], 16)] for p in range(4)]
        assert np.allclose(np.array(vector) * 256 - 0.5, np.ravel(own))


def test_ball_tree_finds_the_first_of_the_nearest():
    rng = np.random.default_rng(4)
    for width, spread in ((1, 5), (4, 3), (4, 1 << 26), (3, 200)):
        entries, points = (rng.integers(-spread, spread, (n, width)) for n in (64, 500))
        entries[10] = entries[3]
        points[:64] = entries
        index, square = vector_codes.BallTree(entries).nearest(points)
        all_ = ((points[:, None, :] - entries) ** 2).sum(axis=2)
        assert (square == all_.min(axis=1)).all() and (index == all_.argmin(axis=1)).all()
    same = np.full((20, 2), 7)
    assert vector_codes.BallTree(same).nearest(np.array([[7, 7], [0, 0]]))[0].tolist() == [0, 0]


def test_codes_of_odd_tables(spark):
    none = frame(spark, vectors(12, 8, 2)).limit(0)
    books = vector_codes.fit(none, parts=4)
    assert books.entries.shape == (4, 0, 0) and vector_codes.encode(none, books).count() == 0
    nulls = spark.createDataFrame([(None, [1.0] * 4, 1), (2, [0.5] * 4, None), (2, [0.25] * 4, 1), (3, [], 1), (4, [1.0], 1), (5, [1.0] * 8, 1)], "vec_id long, embedding array<double>, label int")
    books = vector_codes.fit(nulls, parts=4, rounds=0)
    assert books.entries[0].tolist() == [[64], [256]]  # of the id 2 the lesser, the null id last; other lengths take no part
    assert sorted((r.vec_id or 0, r.code, r.error) for r in vector_codes.encode(nulls, books).collect()) == [(0, "01010101", 0), (2, "00000000", 0), (2, "00000000", 4 * 64**2)]
    with pytest.raises(Exception, match="beyond"):
        vector_codes.fit(spark.createDataFrame([(1, [1e30] * 4, 1)], nulls.schema), parts=4)


def test_no_label_is_gathered(spark, monkeypatch):
    rows = vectors(90, 8, 1)
    monkeypatch.setattr(skew.hot_keys, "__defaults__", (3,))
    df = frame(spark, rows)
    coded = vector_codes.encode(df, vector_codes.fit(df, parts=4, entries=8))
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in coded.collect()) == plain_codes(rows, 4, 8, 2)[1]


def h(*values: str) -> str:
    return hashlib.sha256("".join(values).encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes: list[str]) -> tuple[str, list[list[str]]]:
    """The root of a list of nodes, and each one's siblings with their places, level by level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // 3 * 3 : i // 3 * 3 + 3]
            ways[k].append((i % 3, run))
            at[k] = i // 3
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], ways


def plain_manifest(rows: list[tuple]) -> list[tuple]:
    of = lambda r, text: h(*(field(v) for v in (r[0], r[3], r[2], r[4], text)))
    groups = defaultdict(list)
    for r in rows:
        changed = r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        groups[r[3]].append((r[0], of(r, r[1]), of(r, r[1].replace("\n", "")) if changed else None))
    first = lambda v: (v is not None, v if v is not None else 0)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    ways = {}
    for g in groups:
        groups[g].sort(key=lambda x: (first(x[0]), x[1]))
        ways[g] = climb([x[1] for x in groups[g]])
    root, tops = climb([ways[g][0] for g in order])
    out = []
    for g, top in zip(order, tops, strict=True):
        for (key, leaf, changed), way in zip(groups[g], ways[g][1], strict=True):
            node = changed or leaf
            for place, run in way + top:
                node = h(*(node if j == place else x for j, x in enumerate(run)))
            proof = h(*(x for place, run in way + top for j, x in enumerate(run) if j != place))
            out.append((key, leaf, ways[g][0], root, proof, node, node == root))
    return sorted(out, key=repr)


def texts(n: int) -> list[tuple]:
    """More than one block of rows in one source, single rows in others, nulls everywhere, and repeated rows."""
    rows = [(i, f"line {i}\nnext é東\n" if i % 3 else f"plain {i}", "en", "hot", i) for i in range(n)]
    rows += [(1000 + i, "a\nb", None if i % 2 else "de", f"s{i % 9}", None) for i in range(20)]
    rows += [(2000, None, None, None, None), (None, "x\ny", "en", None, 3), (2001, "", "en", "", 0), (2002, "\n" * 3000, "en", "long", 3000), (2003, "one row", "en", "alone", 7), rows[4], rows[4]]
    return [(*r, "g", 1, "k") for r in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, at int, key string"


@pytest.mark.parametrize(("levels", "n"), [(1, 40), (2, 100), (6, 60)])
def test_manifest_is_that_of_plain_lists(spark, monkeypatch, levels, n):
    monkeypatch.setattr(merkle.manifest, "__defaults__", (3, levels))
    rows = texts(n)
    got = merkle.document_manifest(spark.createDataFrame(rows, SCHEMA).repartition(6))
    found = sorted(((r.key, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got.collect()), key=repr)
    assert found == plain_manifest(rows)
    assert {r[-1] for r in found} == {True, False}


def test_manifest_of_few_rows(spark):
    assert merkle.document_manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    one = [(1, "a", "en", "s", 1, "g", 1, "k")]
    r = merkle.document_manifest(spark.createDataFrame(one, SCHEMA)).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.verified and r.proof_sha256 == h()


def plain_neighbours(rows: list[tuple], every: int, k: int) -> list[tuple]:
    kept = sorted({(r[0], tuple(np.array(r[1], np.float32).astype(float))) for r in usable(rows) if any(r[1])})
    out = []
    for i, q in kept:
        if i % every == 0:
            near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(q, x, strict=True))), j) for j, x in kept if j != i)[:k]
            out += [(i, at + 1, j, d) for at, (d, j) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "k", "centroids", "pieces"), [(1, 10, None, 2048), (2, 3, 5, 4), (3, 200, 2, 2048)])
def test_neighbours_are_those_of_all_pairs(spark, monkeypatch, seed, k, centroids, pieces):
    monkeypatch.setattr(multi_index, "ENTRIES", pieces)
    monkeypatch.setattr(multi_index, "QUERIES", pieces)
    monkeypatch.setattr(multi_index, "FIRST", 8)
    rows = vectors(150, 6, seed)
    got = multi_index.neighbours(frame(spark, rows), every=10, k=k, centroids=centroids)
    found, want = sorted(tuple(r) for r in got.collect()), plain_neighbours(rows, 10, k)
    assert [f[:3] for f in found] == [w[:3] for w in want] and np.allclose([f[3] for f in found], [w[3] for w in want], rtol=1e-12)


def test_cells_come_in_order_and_clumps_are_searched_in_part(spark):
    rng = np.random.default_rng(5)
    one, two = rng.random(7), rng.random(9)
    walk = list(multi_index.Cells((np.zeros((7, 1)), np.zeros((9, 1))), [], {}).walk(one, two))
    assert sorted(c for _, c in walk) == list(range(63)) and [t for t, _ in walk] == sorted(t for t, _ in walk)
    assert all(abs(t - one[c // 9] - two[c % 9]) < 1e-12 for t, c in walk)
    centres = rng.normal(size=(20, 8)) * 10
    clumps = [(i, (centres[i % 20] + rng.normal(size=8) * 0.1).tolist(), 1) for i in range(600)]
    index = multi_index.build(spark.createDataFrame(clumps, "vec_id long, embedding array<double>, label int"), centroids=20)
    q = np.array([clumps[0][1]])
    a, b = (d[0] for d in index.cells.distances(q))
    assert len(index.cells.within(a, b, 1.0)) <= 3 < len(index.cells.counts)


def test_neighbours_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    of = lambda rows: sorted(tuple(r) for r in multi_index.neighbours(spark.createDataFrame(rows, schema)).collect())
    assert of([]) == [] and of([(0, [0.0, 0.0], 1), (100, None, 1)]) == [] and of([(0, [1.0], 1)]) == []
    assert of([(0, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (7, [1.0, 1.0], None), (None, [1.0, 0.0], 1), (9, [1.0], 1)]) == [(0, 1, 100, 0.0), (0, 2, 7, 1.0), (100, 1, 0, 0.0), (100, 2, 7, 1.0)]
    # one id with two vectors is two queries and no neighbour of itself
    assert of([(0, [1.0, 0.0], 1), (0, [0.0, 1.0], 1), (1, [1.0, 0.0], 1)]) == [(0, 1, 1, 0.0), (0, 1, 1, math.sqrt(2))]
