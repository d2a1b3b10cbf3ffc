"""Frozen sets of rows: a tree of digests over hash ranges, by which two sets are compared and their differing rows found.

A row's place is the beginning of its id's hash, so the same id lies in the same range in every set.  A
range's digest is the sum of its rows' hashes, so it depends neither on their order nor on their files,
and a range's digest is the sum of its parts'.  A comparison goes down the tree from the root and reads
the rows of the ranges alone that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import cut_lineage

#: Hexadecimal digits of a range's name at the lowest level, so 256 ranges (more for larger tables); and digits of a piece of a hash.
DIGITS, PIECE, PIECES = 2, 14, 4


def _hashes(rows: DataFrame, id_col: str, digits: int) -> DataFrame:
    """``rows`` with range (of the id) and h, four pieces of the row's hash; nulls and empty texts differ, and so do columns' bounds."""
    value = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    pieces = F.array(*(F.conv(F.substring(value, 1 + PIECE * i, PIECE), 16, 10).cast("decimal(38,0)") for i in range(PIECES)))
    place = F.substring(F.sha2(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), 256), 1, digits)
    return rows.withColumns({"range": place, "h": pieces})


def _sums() -> list[Column]:
    return [F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(PIECES))]


def _tree(lowest: DataFrame, digits: int) -> DataFrame:
    """(level, range, n, digest) of all levels, from the root (level 0, the empty name) to the lowest ranges."""
    level, out = lowest, None
    for k in range(digits, -1, -1):
        level = level.groupBy(F.substring("range", 1, k).alias("range")).agg(*_sums()) if k < digits else level
        told = level.select(F.lit(k).alias("level"), "range", "n", F.sha2(F.concat_ws(":", "n", *(f"s{i}" for i in range(PIECES))), 256).alias("digest"))
        out = told if out is None else out.unionByName(told)
    return out


def tree(rows: DataFrame, id_col: str, digits: int = DIGITS) -> DataFrame:
    """The tree of digests of a table; what is shuffled is a row for each task and range."""
    hashed = _hashes(rows, id_col, digits).select("range", F.lit(1).cast("decimal(38,0)").alias("n"), *(F.get("h", F.lit(i)).alias(f"s{i}") for i in range(PIECES)))
    return _tree(cut_lineage(hashed.groupBy("range").agg(*_sums())), digits)


def freeze(rows: DataFrame, id_col: str, path: str, digits: int = DIGITS) -> str:
    """Write the rows, by range, and their tree below ``path``; returns the root's digest. An empty table has no root: the digest is empty."""
    tree(rows, id_col, digits).write.parquet(f"{path}/tree")
    _hashes(rows, id_col, digits).select(*rows.columns, "range").repartition(F.xxhash64("range")).write.partitionBy("range").parquet(f"{path}/rows")
    root = rows.sparkSession.read.parquet(f"{path}/tree").where("level = 0").first()
    return root.digest if root else ""


def differing_ranges(spark: SparkSession, one: str, other: str, digits: int = DIGITS) -> list[str]:
    """The lowest ranges in which two frozen sets differ, found level by level: a range whose digests agree is not looked into."""
    a, b = (spark.read.parquet(f"{p}/tree").select("level", "range", F.col("digest").alias(n)) for p, n in ((one, "a"), (other, "b")))
    both = a.join(b, ["level", "range"], "full").where(~F.col("a").eqNullSafe(F.col("b")))
    open_ = [""] if both.where("level = 0").count() else []
    for k in range(1, digits + 1):
        if open_:
            open_ = [r.range for r in both.where(F.col("level") == k).where(F.substring("range", 1, k - 1).isin(open_)).select("range").collect()]  # 16 ** digits at most
    return sorted(open_)


def differences(spark: SparkSession, one: str, other: str, id_col: str, digits: int = DIGITS) -> DataFrame:
    """(id, change) of rows that were ``added``, are ``missing`` or were ``changed`` from one frozen set to the other; only files of differing ranges are read."""
    ranges = differing_ranges(spark, one, other, digits)
    a, b = (_hashes(spark.read.parquet(f"{p}/rows").where(F.col("range").isin(ranges)).drop("range"), id_col, digits).groupBy(id_col).agg(F.array_sort(F.collect_list("h")).alias(n)) for p, n in ((one, "a"), (other, "b")))
    met = a.join(b.withColumnRenamed(id_col, "__id"), F.col(id_col).eqNullSafe(F.col("__id")), "full").where(~F.col("a").eqNullSafe(F.col("b")))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "missing").otherwise("changed")
    return met.select(F.coalesce(id_col, "__id").alias("id"), change.alias("change"))
