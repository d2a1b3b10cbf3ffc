"""Joins and order statistics that hold where one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import cut_lineage

#: A key with more than one row in so many counts as hot; there are fewer than this of them, whatever the table's size.
HOT_PARTS = 1024
#: How many counts, and how many distinct values at last, the driver looks at in a search for a place in an order.
BINS, FEW = 1024, 4096


def hot_keys(counts: DataFrame, key: str, parts: int = HOT_PARTS) -> DataFrame:
    """(__hot): the keys of ``counts`` (key, n) that hold over one row in ``parts`` of all; fewer than ``parts`` of them."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return cut_lineage(counts.where(F.col("n") > total / parts).select(F.col(key).alias("__hot")))


def join_per_key(rows: DataFrame, per_key: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """Inner join of many ``rows`` with ``per_key`` (one row for each key), no key of which lands in one task.

    What belongs to the hot keys, fewer than HOT_PARTS, is broadcast and their rows stay where they lie;
    all other rows are shuffled by key.  Null keys match each other.
    """
    is_hot = F.col(key).eqNullSafe(F.col("__hot"))
    same = F.col(key).eqNullSafe(F.col("__key"))
    theirs = per_key.join(F.broadcast(hot), is_hot, "left_semi").withColumnRenamed(key, "__key")
    at_home = rows.join(F.broadcast(theirs), same).drop("__key")
    dealt = rows.join(F.broadcast(hot), is_hot, "left_anti").join(per_key.withColumnRenamed(key, "__key"), same).drop("__key")
    return at_home.union(dealt)


def highest_beyond(values: DataFrame, value: str, allowed: int) -> tuple[float | None, int]:
    """(the highest value v with more than ``allowed`` rows at v or above, how many rows lie above v); (None, all rows) if there is none.

    Found by counting rows in BINS equal stretches of the range that is left, until few distinct values
    are: nothing is sorted whole and nothing meets in one task.  Nulls and NaNs do not count.
    """
    counts = values.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(F.col(value).cast("double").alias("s")).agg(F.count(F.lit(1)).alias("c"))
    counts = cut_lineage(counts)
    above, part = 0, counts
    while True:
        low, high, distinct, n = part.agg(F.min("s"), F.max("s"), F.count(F.lit(1)), F.sum("c")).first()
        if not n or above + n <= allowed:
            return None, above + (n or 0)
        if distinct <= FEW:
            for s, c in sorted(map(tuple, part.collect()), reverse=True):
                if above + c > allowed:
                    return s, above
                above += c
        stretch = F.least(F.floor((F.col("s") - low) / (high - low) * BINS), F.lit(BINS - 1))
        bins = part.groupBy(stretch.alias("b")).agg(F.sum("c").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).collect()
        for b in sorted(bins, key=lambda r: -r.low):
            if above + b.n > allowed:
                part = counts.where(F.col("s").between(b.low, b.high))
                break
            above += b.n


def least_text(rows: DataFrame, key: Column, k: int, digits: int = 3) -> str | None:
    """The k-th least distinct text of a hexadecimal ``key`` (None if there are fewer), by counting prefixes a few digits longer each time."""
    keys = cut_lineage(rows.select(key.alias("k")).distinct())
    prefix, left = "", k
    while True:
        part = keys.where(F.col("k").startswith(prefix)) if prefix else keys
        if part.limit(FEW + 1).count() <= FEW:
            few = sorted(r.k for r in part.collect())
            return few[left - 1] if 0 < left <= len(few) else None
        counts = part.groupBy(F.substring("k", len(prefix) + 1, digits).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        for r in sorted(counts, key=lambda r: r.p):
            if left <= r.n:
                prefix += r.p
                break
            left -= r.n
        else:
            return None
