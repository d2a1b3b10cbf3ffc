"""Percentiles by selection against sorted lists: a group with most rows, ties, infinities, and values of all sizes."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tessella.operators import selection

WANTED = {"low": 0.0, "p10": 0.1, "median": 0.5, "p95": 0.95, "high": 1.0}


def plain(values: list[float], q: float) -> float:
    own = sorted(values)
    at = q * (len(own) - 1)
    a, b = own[math.floor(at)], own[math.ceil(at)]
    return a if a == b else (math.ceil(at) - at) * a + (at - math.floor(at)) * b


def table() -> list[tuple]:
    rng = np.random.default_rng(9)
    rows = [("hot", float(v)) for v in rng.normal(size=400)] + [("ties", float(v)) for v in rng.integers(0, 3, 90)]
    rows += [("sizes", float(v)) for v in 10.0 ** rng.uniform(-300, 300, 60)] + [("sizes", -1e308), ("sizes", 1e308)]
    rows += [("endless", v) for v in (float("inf"), float("-inf"), float("inf"), 1.0, 2.0, 3.0, 4.0)] + [("tiny", 5e-324), ("tiny", 0.0), ("tiny", 0.0)] * 4
    rows += [(None, 3.0), (None, 1.0), ("one", 7.0), ("none", None), ("none", float("nan")), ("hot", None), ("hot", float("nan"))]
    return rows


@pytest.mark.parametrize(("bins", "few"), [(1024, 4096), (4, 2)])
def test_percentiles_are_those_of_sorted_lists(spark, monkeypatch, bins, few):
    monkeypatch.setattr(selection, "BINS", bins)
    monkeypatch.setattr(selection, "FEW", few)
    keep = [(g, v) for g, v in table() if g != "sizes" or bins > 4]
    df = spark.createDataFrame(keep, "g string, v double").repartition(5)
    got = {r.g: r for r in selection.percentiles(df, "g", "v", WANTED).collect()}
    groups: dict = {}
    for g, v in keep:
        if v is not None and v == v:
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, own in groups.items():
        assert got[g].n == len(own)
        for c, q in WANTED.items():
            assert got[g][c] == pytest.approx(plain(own, q), rel=1e-12), (g, c)


def test_without_groups(spark):
    rows = [v for g, v in table() if g == "hot"]
    df = spark.createDataFrame([(v,) for v in rows], "v double")
    r = selection.percentiles(df, None, "v", {"p95": 0.95}).first()
    assert r.asDict() == {"n": 400, "p95": pytest.approx(plain([v for v in rows if v is not None and v == v], 0.95))}
    assert selection.percentiles(df.limit(0), None, "v", {"p95": 0.95}).count() == 0
