"""Writers and maintenance: idempotent sinks, retention, archives and exports as tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_json(rows: DataFrame, path: str, partitions: int | None = None) -> None:
    """JSON lines with sorted keys; Spark's commit makes the whole folder appear at once."""
    out = rows.select(*sorted(rows.columns))
    (out.coalesce(partitions) if partitions else out).write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def label_lines(boxes: DataFrame) -> DataFrame:
    """(frame, value): label lines with eight digits, a box of a frame once."""
    line = F.format_string("%d %.8f %.8f %.8f %.8f", F.col("class"), *[F.col(c).cast("double") for c in ("cx", "cy", "w", "h")])
    return boxes.select("frame", line.alias("value")).distinct()


def archive_days(rows: DataFrame, path: str, day: str) -> None:
    """Write each day's partition whole; days that do not occur stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def insert_if_absent(stored: DataFrame, new: DataFrame, id_col: str, ignore: tuple[str, ...] = ("received_at",)) -> DataFrame:
    """(id, status): inserted, same (equal but for ignored columns) or conflict for each id of ``new``; several bodies of one new id are a conflict."""
    body = F.sha2(F.to_json(F.struct(*sorted(c for c in new.columns if c not in (*ignore, id_col)))), 256)
    a = new.groupBy(id_col).agg(F.min(body).alias("low"), F.max(body).alias("high"))
    b = stored.select(id_col, body.alias("old"))
    status = F.when((F.col("low") != F.col("high")) | (F.col("old") != F.col("low")), "conflict").when(F.col("old").isNull(), "inserted").otherwise("same")
    return a.join(b, id_col, "left").select(id_col, status.alias("status"))


def append_history(stored: DataFrame, new: DataFrame, id_col: str) -> DataFrame:
    """Stored rows and those new ones whose id is not stored, an id once."""
    fresh = new.dropDuplicates([id_col]).join(stored.select(id_col), id_col, "left_anti")
    return stored.unionByName(fresh.select(*stored.columns))


def latest_time(rows: DataFrame, key: str, time_col: str) -> DataFrame:
    """The largest time of each key: what a last-seen mark that only moves forward comes to."""
    return rows.groupBy(key).agg(F.max(time_col).alias(time_col))


def assignments(log: DataFrame, seat: str, person: str, order: list[str]) -> DataFrame:
    """Replay of assign-or-move: the latest assignment of each person, then the latest of each seat."""
    w = lambda key: Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    last = log.withColumn("__p", F.row_number().over(w(person))).where("__p = 1")
    return last.withColumn("__s", F.row_number().over(w(seat))).where("__s = 1").drop("__p", "__s")


def without_deleted(rows: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    return rows.join(deleted.select(key).distinct(), key, "left_anti")


def retained(rows: DataFrame, time_col: str, now: Column, days: int) -> DataFrame:
    """Rows younger than so many days."""
    return rows.where(F.col(time_col) > now - F.make_interval(days=F.lit(days)))


def purge_report(files: DataFrame, time_col: str, now: Column, days: int) -> DataFrame:
    """removed (as old as that or older) and inspected counts."""
    return files.agg(F.count_if(F.col(time_col) <= now - F.make_interval(days=F.lit(days))).alias("removed"), F.count(F.lit(1)).alias("inspected"))


def complete_segments(files: DataFrame, camera: str, time_col: str, now: Column, stale_seconds: float, everything: bool = False) -> DataFrame:
    """All files but each camera's newest; that one, too, once it is stale or everything is asked for."""
    newest = files.groupBy(camera).agg(F.max(time_col).alias("__newest"))
    age = F.unix_micros(now) - F.unix_micros(time_col)
    return files.join(newest, camera).where((F.col(time_col) < F.col("__newest")) | (age >= stale_seconds * 1e6) | F.lit(everything)).drop("__newest")


def run_log(rows: DataFrame, allowed: list[str]) -> DataFrame:
    """Only the allowed columns, as JSON lines."""
    return rows.select(F.to_json(F.struct(*[c for c in allowed if c in rows.columns])).alias("value"))


def anonymised(rows: DataFrame, key: str, order: list[str], columns: list[str], most: int, salt: str) -> DataFrame:
    """The first ``most`` rows of each key, allowed columns only, the key by an alias from a hash with the caller's secret ``salt``."""
    if not salt:
        raise ValueError("without a salt anyone can list the aliases")
    w = Window.partitionBy(key).orderBy(*order)
    kept = rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most)
    return kept.select(F.concat(F.lit("source-"), F.substring(F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256), 1, 8)).alias("alias"), *columns)


def report_page(rows: DataFrame, title: str, columns: list[str], most: int = 10_000) -> DataFrame:
    """One row with a self-contained page that embeds all rows as JSON, in order.

    A page is one text, so it is for reports; over ``most`` rows it is an error, never a page with some of them.
    """
    n = F.count(F.lit(1))
    fits = F.when(n > most, F.raise_error(F.lit(f"a page holds at most {most} rows")).cast("string"))
    body = rows.limit(most + 1).select(F.struct(*columns).alias("r"))
    data = body.agg(F.coalesce(fits, F.to_json(F.array_sort(F.collect_list("r")))).alias("j")).select(F.replace(F.col("j"), F.lit("</"), F.lit("<\\/")).alias("j"))
    return data.select(F.concat(F.lit(f"<!doctype html><meta charset='utf-8'><title>{title}</title><script type='application/json' id='rows'>"), "j", F.lit("</script>")).alias("html"))


def applied(stored: DataFrame, changes: DataFrame, key: str, version: str, expected: str, order: str) -> DataFrame:
    """``stored`` after a batch of changes (key, expected version, columns, order): of each row the last change whose expected version is the stored one; others change nothing.

    A change that is taken raises the version by one, so applying a batch twice is applying it once.
    """
    values = [c for c in changes.columns if c not in (key, expected, order)]
    fitting = changes.join(stored.select(key, F.col(version).alias("__v")), key).where(F.col(expected) == F.col("__v"))
    last = fitting.groupBy(key).agg(F.max_by(F.struct(*values), F.col(order)).alias("__new"))
    rows = stored.join(last, key, "left")
    taken = F.col("__new").isNotNull()
    return rows.select(*[F.when(taken, F.col("__new")[c]).otherwise(F.col(c)).alias(c) if c in values else (F.col(c) + taken.cast("int")).alias(c) if c == version else F.col(c) for c in stored.columns])


def replaced(rows: DataFrame, out: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``rows`` without the keys of ``out`` and with those of ``new`` that they do not have."""
    left = rows.join(out.select(key).distinct(), key, "left_anti")
    return left.unionByName(new.join(left.select(key), key, "left_anti").dropDuplicates([key]).select(*left.columns))


def merged_back(rows: DataFrame, audited: DataFrame, key: str, value: str = "label") -> DataFrame:
    """``rows`` with the audited value where there is one, and ``audited``; an audit of a key that is not there, or of one twice, is an error."""
    bad = audited.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(rows.select(key, F.lit(1).alias("__r")), key, "left").where("n > 1 or __r is null")
    if not bad.isEmpty():
        raise ValueError("an audit names a row that is not there, or one twice")
    joined = rows.join(audited.select(key, F.col(value).alias("__new")), key, "left")
    return joined.withColumn("audited", F.col("__new").isNotNull()).withColumn(value, F.coalesce("__new", value)).drop("__new")


def publish(rows: DataFrame, root: str, fingerprint: str) -> int:
    """Write ``rows`` as the next version under ``root`` and return its number; a fingerprint that is there already gives that version, and nothing is written.

    A version is a folder ``version=N`` with its rows and a one-row manifest.  The manifest is written last,
    so a version that was not finished is not found.
    """
    spark = rows.sparkSession
    known = published(spark, root)
    for r in known:
        if r["fingerprint"] == fingerprint:
            return r["version"]
    version = max((r["version"] for r in known), default=0) + 1
    rows.write.mode("overwrite").parquet(f"{root}/data/version={version}")
    spark.createDataFrame([(version, fingerprint)], "version int, fingerprint string").write.mode("append").parquet(f"{root}/manifest")
    return version


def published(spark, root: str) -> list:
    """(version, fingerprint) of all finished versions."""
    try:
        found = spark.read.schema("version int, fingerprint string").parquet(f"{root}/manifest")
        return sorted(found.collect(), key=lambda r: r["version"])
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise
