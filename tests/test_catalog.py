"""Every registered query with a DuckDB counterpart gives that counterpart's rows."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal

import pytest

from tessella.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
#: No cell of the smallest tables holds enough points for a cluster; tests/test_operators.py has a denser fixture.
MAY_BE_EMPTY = {"density_clusters"}


def plain(value):
    """One form for both engines' values."""
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return tuple(sorted((k, plain(v)) for k, v in value.items())) if isinstance(value, dict) else value


def bag(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(repr(plain(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_duckdb(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(r.asDict(recursive=True).values()) for r in df.collect()]
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert bag(df.columns, got) == bag(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_and_repeats(name, spark, sf_dir):
    """Without a counterpart: two runs over differently partitioned tasks agree."""
    df = QUERIES[name](spark, sf_dir)
    first = bag(df.columns, [tuple(r.asDict(recursive=True).values()) for r in df.collect()])
    again = bag(df.columns, [tuple(r.asDict(recursive=True).values()) for r in QUERIES[name](spark, sf_dir).collect()])
    assert (first or name in MAY_BE_EMPTY) and first == again


def test_entry_module():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert catalog.FLAGSHIP in QUERIES
