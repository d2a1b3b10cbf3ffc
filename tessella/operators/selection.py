"""Exact percentiles of all groups at once, by selection: no group is sorted, and none is held in one task.

Every wanted place in a group's order is a target with the bounds that it lies between.  A round counts
the values between each target's bounds in BINS equal stretches, in every task first, and keeps the
stretch that holds the place, narrowed to the values in it; few rounds leave FEW values, which are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.skew import hot_keys, join_per_key
from tessella.session import cut_lineage

#: Stretches of a round, and how many values of a target are sorted at last.
BINS, FEW = 1024, 4096


def _placed(values: DataFrame, targets: DataFrame, hot: DataFrame) -> DataFrame:
    """(target, v, t): the values between the bounds of each of their group's targets."""
    per_group = targets.groupBy("g").agg(F.collect_list(F.struct("target", "low", "high")).alias("ts"))  # a few for each group
    met = join_per_key(values, per_group, hot, "g")
    inside = F.filter("ts", lambda t: (F.col("v") >= t["low"]) & (F.col("v") <= t["high"]))
    return met.select("v", F.explode(inside).alias("t")).select("v", "t.*")


def percentiles(rows: DataFrame, group: str | None, value: str, wanted: dict[str, float]) -> DataFrame:
    """(group, n, a column for each of ``wanted``): percentiles from 0 to 1, interpolated between the two nearest values.

    Nulls and NaNs do not count; a group without a value has no row, nor has an empty table without groups.
    Without ``group`` all rows are one.  Null groups are one.
    """
    name = F.lit(0) if group is None else F.col(group)
    values = rows.select(name.alias("g"), F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    sizes = cut_lineage(values.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))
    hot = hot_keys(sizes, "g")
    at = {c: F.lit(q) * (F.col("n") - 1) for c, q in wanted.items()}
    ranks = F.explode(F.array_distinct(F.flatten(F.array(*(F.array(F.floor(p), F.ceil(p)) for p in at.values())))))
    targets = sizes.select("g", ranks.alias("rank"), F.lit(0).cast("long").alias("before"), "low", "high", F.col("n").alias("left"))
    targets = cut_lineage(targets.withColumn("target", F.xxhash64("g", "rank")))
    closed = None
    while True:
        done = targets.where((F.col("left") <= FEW) | (F.col("low") == F.col("high")))
        closed = done if closed is None else cut_lineage(closed.unionByName(done))
        targets = targets.where(~((F.col("left") <= FEW) | (F.col("low") == F.col("high"))))
        if targets.isEmpty():
            break
        wide = F.col("high") / 2 - F.col("low") / 2  # the range itself may be beyond a double
        share = F.when(wide > 0, (F.col("v") / 2 - F.col("low") / 2) / F.when(wide > 0, wide).otherwise(1.0)).otherwise((F.col("v") > F.col("low")).cast("double"))
        endless = (F.abs("low") == float("inf")) | (F.abs("high") == float("inf"))
        stretch = F.when(endless, F.when(F.abs("v") == float("inf"), F.signum("v")).otherwise(0.0)).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1)))
        bins = _placed(values, targets, hot).groupBy("target", stretch.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("b_low"), F.max("v").alias("b_high"))
        run = F.sum("c").over(Window.partitionBy("target").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))  # BINS rows
        bins = bins.withColumn("run", run).withColumnRenamed("target", "t_bin")
        found = targets.join(bins, F.col("target") == F.col("t_bin")).where((F.col("before") + F.col("run") > F.col("rank")) & (F.col("before") + F.col("run") - F.col("c") <= F.col("rank")))
        targets = cut_lineage(found.select("g", "rank", (F.col("before") + F.col("run") - F.col("c")).alias("before"), F.col("b_low").alias("low"), F.col("b_high").alias("high"), F.col("c").alias("left"), "target"))
    easy = closed.where("low = high").select("g", "rank", F.col("low").alias("x"))
    open_ = closed.where("low < high")
    listed = _placed(values, open_, hot).groupBy(F.col("target").alias("t_all")).agg(F.array_sort(F.collect_list("v")).alias("all"))  # FEW at most
    sorted_ = open_.join(listed, F.col("target") == F.col("t_all")).select("g", "rank", F.get("all", (F.col("rank") - F.col("before")).cast("int")).alias("x"))
    found = easy.unionByName(sorted_).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("x")).withColumnRenamed("g", "__g")
    both = sizes.select("g", "n").join(found, F.col("g").eqNullSafe(F.col("__g")))
    out = []
    for c, p in at.items():
        a, b = F.element_at("x", F.floor(p)), F.element_at("x", F.ceil(p))
        out.append(F.when(a == b, a).otherwise((F.ceil(p) - p) * a + (p - F.floor(p)) * b).alias(c))
    return both.select(*([] if group is None else [F.col("g").alias(group)]), "n", *out)
