"""Sorting, limits and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import cut_lineage


def range_scan(rows: DataFrame, key: str, value, time_col: str, start, stop) -> DataFrame:
    """``key = value`` and time in [start, stop): both reach the scan."""
    return rows.where((F.col(key) == value) & (F.col(time_col) >= F.lit(start)) & (F.col(time_col) < F.lit(stop)))


def newest(rows: DataFrame, time_col: str, id_col: str, limit: int) -> DataFrame:
    return rows.orderBy(F.desc(time_col), F.asc(id_col)).limit(limit)


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def keyset_page(rows: DataFrame, time_col: str, id_col: str, limit: int, after=None) -> DataFrame:
    """Newest first, after the row (time, id) ``after``: rows of the same time are not lost. One row more than ``limit`` tells that there is another page."""
    if after is not None:
        t, i = F.lit(after[0]), F.lit(after[1])
        rows = rows.where((F.col(time_col) < t) | ((F.col(time_col) == t) & (F.col(id_col) < i)))
    return rows.orderBy(F.desc(time_col), F.desc(id_col)).limit(limit + 1)


def keyset_after(rows: DataFrame, time_col: str, id_col: str, limit: int, cursor: int) -> DataFrame:
    """The page after the row with the id ``cursor``; an unknown cursor gives an empty page."""
    at = rows.where(F.col(id_col) == cursor).select(F.col(time_col).alias("__t"), F.col(id_col).alias("__i")).limit(1)
    joined = rows.join(F.broadcast(at), (F.col(time_col) < F.col("__t")) | ((F.col(time_col) == F.col("__t")) & (F.col(id_col) < F.col("__i"))))  # one row
    return joined.drop("__t", "__i").orderBy(F.desc(time_col), F.desc(id_col)).limit(limit)


def natural_order(code: Column, prefix: str = "S") -> list[Column]:
    """Codes of prefix and digits by number, all others after them."""
    digits = F.regexp_extract(code, rf"^{prefix}#?(\d+)$", 1)
    return [F.when(digits != "", 0).otherwise(1), F.when(digits != "", digits.cast("long")), code]


def top_per_group(rows: DataFrame, group: list[str], order: list, k: int = 1, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark cuts each partition to k a group before the shuffle."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by partial aggregation: no sort, no group held."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__best"))
    return best.select(*key, *[F.col(f"__best.{c}").alias(c) for c in rest]).select(*rows.columns)


def between(rows: DataFrame, time_col: str, start: str, stop: str) -> DataFrame:
    """Rows from start on and before stop (times as text); an empty or reversed range is an error."""
    if start >= stop:
        raise ValueError("start has to lie before stop")
    return rows.where((F.col(time_col) >= F.lit(start).cast("timestamp")) & (F.col(time_col) < F.lit(stop).cast("timestamp")))


def placed(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with place, their number from 0 in the order.

    Spark deals rows out in order; a row's place is its place in its partition and the rows of the
    partitions before, whose counts are all that the driver sees.
    """
    dealt = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    counts = dealt.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()  # one row for each partition
    before, total = [], 0
    for r in counts:
        before.append((r.p, total))
        total += r.n
    starts = rows.sparkSession.createDataFrame(before, "__p long, __before long")
    inside = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.join(F.broadcast(starts), part == F.col("__p")).withColumn("place", F.col("__before") + inside).drop("__id", "__p", "__before")


def accumulated(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """All rows with page, the number from 1 of the page of ``size`` rows that holds them: what reading page after page comes to."""
    return placed(rows, order).withColumn("page", F.floor(F.col("place") / size) + 1).drop("place")


def ranks(rows: DataFrame, value: str, tie: str, parts: int = 4) -> DataFrame:
    """``rows`` with r, dr and q: rank and dense rank by falling value, and the part, of ``parts`` as equal ones as can be, by falling value and rising tie.

    Ranks come from counts by value, parts from places, so no order is made in one task but that of the distinct values.
    """
    counts = rows.groupBy(value).agg(F.count(F.lit(1)).alias("__c"))
    falling = Window.orderBy(F.desc(value))  # one row for each distinct value
    ranked = counts.select(value, (F.sum("__c").over(falling) - F.col("__c") + 1).alias("r"), F.row_number().over(falling).alias("dr"))
    n = rows.count()
    small, large = n // parts, n % parts
    at = F.col("place")
    q = F.when(at < large * (small + 1), F.floor(at / (small + 1)) + 1).otherwise(F.floor((at - large * (small + 1)) / max(1, small)) + large + 1)
    return placed(rows, [F.desc(value), F.asc(tie)]).join(ranked, value).withColumn("q", q.cast("int")).drop("place")
