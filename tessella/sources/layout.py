"""Tables laid out for scans by key and time, and a zone map that a scan asks which files to open.

Rows are dealt into ranges of (key, time) and sorted, so a key's rows of a period lie in one file or in
neighbouring ones, however many rows a key has.  The zone map has one row for each file: the bounds of its
keys, and of its times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(rows: DataFrame, key: str, time_col: str, path: str, files: int) -> None:
    """Write ``rows`` in about ``files`` files below ``path``/rows, and their bounds below ``path``/zones.

    Null keys come first; rows without a time are in no scan's period and are kept all the same.
    """
    placed = rows.repartitionByRange(files, F.col(key), F.col(time_col)).sortWithinPartitions(key, time_col)
    placed.write.parquet(f"{path}/rows")
    written = rows.sparkSession.read.parquet(f"{path}/rows").select(F.input_file_name().alias("file"), F.col(key).alias("k"), F.col(time_col).alias("t"))
    zones = written.groupBy("file").agg(F.min("k").alias("least_key"), F.max("k").alias("most_key"), F.min("t").alias("first"), F.max("t").alias("last"), F.count(F.lit(1)).alias("n"))
    zones.coalesce(1).write.parquet(f"{path}/zones")  # a row for each file


def files_for(spark: SparkSession, path: str, key_value, start, stop) -> list[str]:
    """The files that may hold rows of the key in [start, stop)."""
    zones = spark.read.parquet(f"{path}/zones")
    holds = (F.col("least_key") <= key_value) & (F.col("most_key") >= key_value)
    meets = (F.col("first") < stop) & (F.col("last") >= start)
    return sorted(r.file for r in zones.where(holds & meets).select("file").collect())


def scan(spark: SparkSession, path: str, key: str, time_col: str, key_value, start, stop) -> DataFrame:
    """Rows of ``key_value`` with a time in [start, stop): only the files that the zone map names are opened."""
    files = files_for(spark, path, key_value, start, stop)
    rows = spark.read.parquet(*files) if files else spark.read.parquet(f"{path}/rows").limit(0)
    return rows.where((F.col(key) == key_value) & (F.col(time_col) >= start) & (F.col(time_col) < stop))
