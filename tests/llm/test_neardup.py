"""The pipeline's near-duplicate stage against brute-force Jaccard similarity, with planted near copies."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from tessella.llm import neardup


def jaccard(a: str, b: str) -> float:
    x, y = (set(zip(*(t.lower().split()[i:] for i in range(5)), strict=False)) for t in (a, b))
    return len(x & y) / len(x | y)


def planted() -> list[str]:
    """40 texts with near copies of one to nine changed words, a hot group of 150 copies with a chain away from it, and texts that share a passage."""
    rng = np.random.default_rng(8)
    fresh = lambda n: [f"w{k}" for k in rng.integers(0, 4000, n)]

    def changed(words: list[str], n: int) -> list[str]:
        out = list(words)
        for at in rng.choice(len(words), n, replace=False):
            out[at] = f"x{rng.integers(0, 1 << 30)}"
        return out

    texts = []
    for _ in range(40):
        base = fresh(int(rng.integers(60, 400)))
        texts += [base, *(changed(base, int(n)) for n in rng.integers(1, 10, 3))]
    hot, passage = fresh(200), fresh(100)
    texts += [changed(hot, 1) for _ in range(150)]
    for _ in range(6):
        hot = changed(hot, 3)
        texts.append(hot)
    texts += [passage + fresh(60) for _ in range(60)]
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("small", [False, True])
def test_classes_are_those_of_all_pairs_at_the_bound(spark, monkeypatch, small):
    """The same whatever tasks know of frequencies, and however lists and pairs are dealt out."""
    if small:
        for name, value in {"FREQUENT": 20, "HELD": 3000, "STRETCH": 1000, "TOGETHER": 3, "BLOCK": 4, "BROADCAST_KEYS": 0}.items():
            monkeypatch.setattr(neardup, name, value)
    texts = planted()
    parent = list(range(len(texts)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    linked = 0
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                linked += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert linked > 10_000 and got == {root(i) for i in range(len(texts))}


def test_order_knows_what_repeats(spark):
    texts = planted()[:60]
    known = neardup.rarity(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), 60 * 300)
    sets = [neardup.shingles(t) for t in texts]
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    assert (known.level(values[counts > 1]) >= 2).all() and (known.level(values[counts > 1]) == (2 * np.log2(counts[counts > 1])).astype(int)).all()
    assert (known.level(values[counts == 1]) < 2).all() and (known.level(values[counts == 1]) == 0).mean() > 0.98
    key, place = known.prefix(sets[0])
    assert len(key) == len(place) and max(place, default=0) <= len(sets[0]) // 5


def test_odd_rows(spark):
    rows = [(None, "a b c d e f g"), (2, "A b C d e f g"), (3, None), (4, ""), (5, "one"), (6, "ONE"), (2, "another text"), (7, "x"), (7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in neardup.keep_one(docs).select("doc_id", "text").na.fill("<null>").collect())
    assert got == [(2, "A b C d e f g"), (2, "another text"), (3, "<null>"), (5, "one"), (7, "x")]
    assert neardup.keep_one(docs.limit(0)).count() == 0
