"""Set comparisons and integrity checks. Each returns the offending rows or one row of counts, nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cover(whole: DataFrame, parts: list[DataFrame], id_col: str) -> DataFrame:
    """One row: missing (in no part), unknown (in no whole) and shared (in several parts) ids."""
    sides = whole.select(id_col).distinct().withColumns({"__in": F.lit(1), "__parts": F.lit(0)})
    for p in parts:
        sides = sides.union(p.select(id_col).distinct().withColumns({"__in": F.lit(0), "__parts": F.lit(1)}))
    each = sides.groupBy(id_col).agg(F.sum("__in").alias("w"), F.sum("__parts").alias("p"))
    return each.agg(F.count_if((F.col("w") > 0) & (F.col("p") == 0)).alias("missing"), F.count_if(F.col("w") == 0).alias("unknown"), F.count_if(F.col("p") > 1).alias("shared"))


def coverage(left: DataFrame, right: DataFrame, id_col: str) -> DataFrame:
    """(id, side): ids that only the left or only the right side has."""
    a, b = left.select(id_col).distinct().withColumn("__l", F.lit(1)), right.select(id_col).distinct().withColumn("__r", F.lit(1))
    return a.join(b, id_col, "full").where("__l is null or __r is null").select(id_col, F.when(F.col("__r").isNull(), "left").otherwise("right").alias("side"))


def in_several_roles(rows: DataFrame, id_col: str, role_col: str) -> DataFrame:
    return rows.groupBy(id_col).agg(F.count_distinct(role_col).alias("roles")).where("roles > 1")


def not_in(left: DataFrame, right: DataFrame, left_col: str, right_col: str) -> DataFrame:
    return left.join(right.select(F.col(right_col).alias("__r")).distinct(), F.col(left_col) == F.col("__r"), "left_anti")


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def checksum(rows: DataFrame) -> DataFrame:
    """n and checksum of a table, whatever the order of its rows: a SHA-256 over sums of the rows' SHA-256 halves, so no row list is gathered."""
    digest = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
    parts = [F.sum(F.conv(F.substring(digest, i, 12), 16, 10).cast("decimal(38,0)")).cast("string") for i in (1, 13, 25, 37, 49)]
    return rows.agg(F.count(F.lit(1)).alias("n"), *[p.alias(f"p{i}") for i, p in enumerate(parts)]).select("n", F.sha2(F.concat_ws(":", "n", *[f"p{i}" for i in range(5)]), 256).alias("checksum"))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only, repeated rows counted, with ``side``."""
    right = right.select(*left.columns)
    return left.exceptAll(right).withColumn("side", F.lit("left")).union(right.exceptAll(left).withColumn("side", F.lit("right")))


def extend_without_collision(base: DataFrame, extra: DataFrame, id_col: str) -> DataFrame:
    """The union, rows of ``extra`` with an id of ``base`` left out."""
    return base.unionByName(extra.join(base.select(id_col).distinct(), id_col, "left_anti").select(*base.columns))


def union_of_keys(keys: list[str], *tables: DataFrame) -> DataFrame:
    """The distinct keys of all tables."""
    first, *rest = (t.select(*keys).distinct() for t in tables)
    for t in rest:
        first = first.union(t)
    return first.distinct()


def resolution_problems(inventory: DataFrame, report: DataFrame, width: int, height: int) -> DataFrame:
    """(source_id, problem) of sources that the report lacks, has in another size, or has though the inventory does not."""
    a = inventory.select("source_id", F.lit(True).alias("__in")).distinct()
    rows = a.join(report, "source_id", "full")
    problem = F.when(F.col("width").isNull(), "MISSING").when((F.col("width") != width) | (F.col("height") != height), "WRONG_SIZE").when(F.col("__in").isNull(), "UNEXPECTED")
    return rows.withColumn("problem", problem).where("problem is not null").select("source_id", "problem")


def group_problems(members: DataFrame) -> DataFrame:
    """(group_id, problem) of duplicate groups (group_id, id, kept) that have one member, a member twice, or not just one that is kept."""
    each = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.count_if("kept").alias("kept"))
    problem = F.when(F.col("n") < 2, "ALONE").when(F.col("ids") < F.col("n"), "MEMBER_TWICE").when(F.col("kept") != 1, "NOT_ONE_KEPT")
    return each.withColumn("problem", problem).where("problem is not null").select("group_id", "problem")


def unreported_periods(periods: DataFrame, ledger: DataFrame, watched: DataFrame, now, catch_up_minutes: int = 60) -> DataFrame:
    """(day, name, status) of ended periods that the ledger does not know: ``due`` up to ``catch_up_minutes`` after their end (that minute included), ``missed`` later.

    periods(day, name, ends), ledger(day, name), watched(day, since).  A period is missed only on a day
    that was watched when it ended; what is told is to be written to the ledger, so it is told once.
    """
    ended = periods.where(F.col("ends") <= now).join(ledger.select("day", "name"), ["day", "name"], "left_anti")
    late = F.unix_micros(now) - F.unix_micros("ends") > catch_up_minutes * 60_000_000
    told = ended.join(watched.select("day", "since"), "day", "left").withColumn("status", F.when(~late, "due").when(F.col("since") <= F.col("ends"), "missed"))
    return told.where("status is not null").select("day", "name", "status")
