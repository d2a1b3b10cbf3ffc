"""Stateless and watermark-based operators that take tables and streams alike, and sinks for micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_PROVIDER, _ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start here keep their state in RocksDB, as timed steps need it; the session's own setting comes back after."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType | None = None, files_per_trigger: int | None = 1) -> DataFrame:
    """Files of a folder as a stream, so many in a batch (None: all that are there); without a schema that of what lies there now."""
    schema = schema or spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def json_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).option("mode", "PERMISSIVE").json(path)


def once_per_id(rows: DataFrame, id_col: str, time_col: str, delay: str) -> DataFrame:
    """The first row of each id within the watermark."""
    return rows.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col]) if rows.isStreaming else rows.dropDuplicates([id_col])


def session_counts(rows: DataFrame, key: str, time_col: str, gap: str, delay: str) -> DataFrame:
    out = rows.withWatermark(time_col, delay).groupBy(key, F.session_window(time_col, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "n")


def window_counts(rows: DataFrame, keys: list[str], time_col: str, window: str, delay: str) -> DataFrame:
    out = rows.withWatermark(time_col, delay).groupBy(*keys, F.window(time_col, window).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("w.start").alias("window_start"), "n")


def upsert_latest(path: str, key: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the latest row of each key, to be read by ``current``.

    Each batch writes its own latest rows under its number, in place of what an earlier try left there: the
    cost is the batch's, not the table's, and a batch that runs twice gives the same.  ``compact`` folds
    what has gathered into one table.
    """
    from tessella.operators.paging import latest

    def sink(batch: DataFrame, epoch: int) -> None:
        latest(batch, key, order).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return sink


def current(spark: SparkSession, path: str, key: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key over all batches, later batches first among equal ones."""
    from tessella.operators.paging import latest

    return latest(spark.read.parquet(path), key, [*order, "epoch"]).drop("epoch")


def compact(spark: SparkSession, path: str, to: str, key: list[str], order: list[str]) -> None:
    """What ``current`` gives, written as the first batch of a new folder, which a sink may go on with."""
    current(spark, path, key, order).write.mode("overwrite").parquet(f"{to}/epoch=0")


def enrich_each_batch(dimension: Callable[[SparkSession], DataFrame], key: str, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that reads the dimension anew for each batch; where that fails the last good one serves."""
    last: dict[str, DataFrame] = {}

    def sink(batch: DataFrame, epoch: int) -> None:
        try:
            last["d"] = dimension(batch.sparkSession)
        except Exception:
            if "d" not in last:
                raise
        write(batch.join(last["d"], key, "left"), epoch)

    return sink
