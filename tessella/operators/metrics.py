"""Queries over metric and log tables: quantiles from buckets, rates, and counts by label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.geometry import ratio


def bucket_quantile(buckets: DataFrame, keys: list[str], q: float) -> DataFrame:
    """(keys, quantile): linear inside the bucket where the rank q * total falls; its lower bound where the bucket is the infinite one, null without counts."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    o = w.orderBy("le")
    rows = buckets.withColumns({"__before": F.coalesce(F.lag("n").over(o), F.lit(0)), "__low": F.coalesce(F.lag("le").over(o), F.lit(0.0)), "__rank": q * F.max("n").over(w)})
    hit = rows.where((F.col("n") >= F.col("__rank")) & (F.col("__rank") > 0))
    inside = F.when(F.col("le") == float("inf"), F.col("__low")).otherwise(F.col("__low") + (F.col("le") - F.col("__low")) * ratio(F.col("__rank") - F.col("__before"), F.col("n") - F.col("__before")))
    return hit.groupBy(*keys).agg(F.min_by(inside, "le").alias("quantile"))


def rate(samples: DataFrame, keys: list[str], time_col: str, value: str, window: str) -> DataFrame:
    """(keys, window_start, rate): increase of a counter a second in each tumbling window; a fall is a reset and counts from 0."""
    w = Window.partitionBy(*keys).orderBy(time_col)
    before = F.lag(value).over(w)
    up = F.when(before.isNull(), 0.0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    span = F.window(time_col, window)
    out = samples.withColumn("__up", up).groupBy(*keys, span.alias("__w")).agg(F.sum("__up").alias("__sum"))
    return out.select(*keys, F.col("__w.start").alias("window_start"), (F.col("__sum") / (F.unix_seconds("__w.end") - F.unix_seconds("__w.start"))).alias("rate"))


def event_rate(rows: DataFrame, keys: list[str], time_col: str, window: str, slide: str | None = None) -> DataFrame:
    """(keys, window_start, n, per_second) of rows in tumbling or sliding windows."""
    out = rows.groupBy(*keys, F.window(time_col, window, slide).alias("__w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("__w.start").alias("window_start"), "n", (F.col("n") / (F.unix_seconds("__w.end") - F.unix_seconds("__w.start"))).alias("per_second"))


def ratio_of_rates(rows: DataFrame, keys: list[str], time_col: str, window: str, part) -> DataFrame:
    """(keys, window_start, part, total, share)."""
    out = rows.groupBy(*keys, F.window(time_col, window).alias("__w")).agg(F.count_if(part).alias("part"), F.count(F.lit(1)).alias("total"))
    return out.select(*keys, F.col("__w.start").alias("window_start"), "part", "total", ratio(F.col("part"), F.col("total")).alias("share"))


def active_labels(rows: DataFrame, label: str, time_col: str, window: str) -> DataFrame:
    """(window_start, n): distinct labels with a row in each window."""
    out = rows.groupBy(F.window(time_col, window).alias("__w")).agg(F.count_distinct(label).alias("n"))
    return out.select(F.col("__w.start").alias("window_start"), "n")


def matching_lines(rows: DataFrame, label: str, text: str, pattern: str, time_col: str, window: str) -> DataFrame:
    """(label, window_start, n, per_second) of log lines that match."""
    return event_rate(rows.where(F.col(text).rlike(pattern)), [label], time_col, window)


def instant_up(rows: DataFrame, series: str, time_col: str, since: Column) -> DataFrame:
    """(series, up): 1 for series whose latest sample is not older than ``since``, else 0."""
    return rows.groupBy(series).agg(F.max(time_col).alias("__last")).select(series, (F.col("__last") >= since).cast("int").alias("up"))


def log_lines(rows: DataFrame, line: str, pattern: str) -> DataFrame:
    """The raw rows whose line matches."""
    return rows.where(F.col(line).rlike(pattern))
