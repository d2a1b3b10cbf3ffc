"""Aggregations: reports, rates, evaluation metrics, thresholds and vector representatives."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import vectors as v
from tessella.functions.geometry import ratio
from tessella.operators.selection import percentiles
from tessella.operators.skew import highest_beyond
from tessella.session import cut_lineage


def percent(part: Column, whole: Column) -> Column:
    """Percent to two digits, half to even; 0 of nothing."""
    return F.bround(ratio(part * 100, whole), 2)


def state_counts(rows: DataFrame, state: str, states: list[str]) -> DataFrame:
    """One row for each of the listed states, in their order, zeros included."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame(list(enumerate(states)), f"position int, {state} string")
    counts = rows.groupBy(state).agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(counts, state, "left").select("position", state, F.coalesce("n", F.lit(0)).alias("n"))


def rollup_by(rows: DataFrame, keys: list[str], leaves: Column, **more: Column) -> DataFrame:
    """total, leaves and rate of each group, and whatever else is asked for."""
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(leaves).alias("leaves"), *[c.alias(k) for k, c in more.items()])
    return out.withColumn("rate", percent(F.col("leaves"), F.col("total")))


def calendar(rows: DataFrame, day: str, start: str, stop: str, most_days: int = 62) -> DataFrame:
    """Counts of each day from ``start`` to ``stop``; recorded tells a day without rows from one that was not recorded, n is null there."""
    spark = rows.sparkSession
    days = spark.sql(f"select explode(sequence(date'{start}', date'{stop}')) as {day}")
    if days.count() > most_days:
        raise ValueError(f"a calendar spans at most {most_days} days")
    counts = rows.groupBy(day).agg(F.count(F.lit(1)).alias("n"))
    return days.join(counts, day, "left").withColumn("recorded", F.col("n").isNotNull())


def precision_recall(rows: DataFrame, keys: list[str], tp: str = "tp", fp: str = "fp", fn: str = "fn") -> DataFrame:
    """Sums of the three counts, precision, recall and F1; 0 over 0 is 0."""
    s = rows.groupBy(*keys).agg(*[F.sum(c).alias(n) for c, n in ((tp, "tp"), (fp, "fp"), (fn, "fn"))])
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return s.withColumns({"precision": p, "recall": r}).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def threshold_sweep(scored: DataFrame, score: str, truth: Column, thresholds: list[float]) -> DataFrame:
    """Precision, recall and F1 at each of a short list of thresholds: one pass of conditional sums, the list unfolded afterwards."""
    hit = [(F.count_if((F.col(score) >= t) & truth), F.count_if((F.col(score) >= t) & ~truth), F.count_if((F.col(score) < t) & truth)) for t in thresholds]
    one = scored.agg(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), a.alias("tp"), b.alias("fp"), c.alias("fn")) for t, (a, b, c) in zip(thresholds, hit, strict=True)]).alias("all"))
    return precision_recall(one.select(F.inline("all")), ["threshold"])


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row of the largest F1, the lowest threshold of equal ones."""
    return sweep.agg(F.max_by(F.struct(*sweep.columns), F.struct("f1", -F.col("threshold"))).alias("b")).select("b.*")


def first_calibrated(sweep: DataFrame, precision: float = 0.99, recall: float = 0.99) -> DataFrame:
    """The lowest threshold that reaches both, null if none does."""
    return sweep.agg(F.min(F.when((F.col("precision") >= precision) & (F.col("recall") >= recall), F.col("threshold"))).alias("threshold"))


def far_threshold(scores: DataFrame, score: str, target: float, most: float = 1.0) -> DataFrame:
    """(n, allowed, threshold, accepted): the lowest threshold at which at most floor(target * n) scores are accepted (score >= threshold).

    It is just above the first score too many, or -1 where all may be accepted; never over ``most``.  The
    place is found by counts, so no order of all scores is made.
    """
    n = scores.where(F.col(score).isNotNull()).count()
    allowed = math.floor(target * n)
    beyond, accepted = highest_beyond(scores, score, allowed)
    threshold = min(-1.0 if beyond is None else math.nextafter(beyond, math.inf), most)
    return scores.sparkSession.createDataFrame([(n, allowed, threshold, accepted)], "n long, allowed long, threshold double, accepted long")


def identification_rates(rows: DataFrame, known: Column, detected: Column, accepted: Column, right: Column, millis: str) -> DataFrame:
    """success, false reject, false accept and correct reject rates, mean and p95 time of the detected."""
    seen = detected
    late = percentiles(rows.where(seen), None, millis, {"p95_ms": 0.95}).select("p95_ms")
    rates = rows.agg(
        F.count_if(known & seen).alias("known"), F.count_if(~known & seen).alias("unknown"), F.count_if(~seen).alias("not_detected"),
        ratio(F.count_if(known & seen & accepted & right), F.count_if(known & seen)).alias("success_rate"),
        ratio(F.count_if(known & seen & ~accepted), F.count_if(known & seen)).alias("false_reject_rate"),
        ratio(F.count_if(~known & seen & accepted), F.count_if(~known & seen)).alias("far"),
        ratio(F.count_if(~known & seen & ~accepted), F.count_if(~known & seen)).alias("correct_reject_rate"),
        F.avg(F.when(seen, F.col(millis))).alias("mean_ms"),
    )
    return rates.join(F.broadcast(late), F.lit(True), "left")  # one row each


def count_errors(rows: DataFrame, expected: str, found: str, millis: str, seconds: Column) -> DataFrame:
    """Mean absolute count error, surplus finds an hour (an hour fraction of 1/3600 at least), mean and p95 latency."""
    hours = F.greatest(F.sum(seconds) / 3600, F.lit(1 / 3600))
    means = rows.agg(F.avg(F.abs(F.col(found) - F.col(expected))).alias("count_mae"), (F.sum(F.greatest(F.col(found) - F.col(expected), F.lit(0))) / hours).alias("fp_per_hour"), F.avg(millis).alias("mean_ms"))
    return means.join(F.broadcast(percentiles(rows, None, millis, {"p95_ms": 0.95}).select("p95_ms")), F.lit(True), "left")  # one row each


def _mean_vector(rows: DataFrame, key: list[str], vector: str, size: int) -> DataFrame:
    """Sum of the key's vectors by dimension, as partial aggregates, made one unit long."""
    total = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get(F.col(vector), F.lit(i)).cast("double")).alias(f"__{i}") for i in range(size)])
    return total.select(*key, "n", v.normalised(F.array(*[F.col(f"__{i}") for i in range(size)])).alias("centroid"))


def robust_centroid(rows: DataFrame, key: str, vector: str, size: int, floor: float = 0.15, slack: float = 0.15, least: int = 1) -> DataFrame:
    """(key, n, kept, centroid): the mean direction, without vectors less alike than max(floor, median - slack), once more; keys that keep under ``least`` go."""
    unit = rows.select(key, v.normalised(F.col(vector)).alias("__v")).where("__v is not null")
    first = _mean_vector(unit, [key], "__v", size).withColumnRenamed("n", "all")
    scored = unit.join(first, key).withColumn("__s", v.dot(F.col("__v"), F.col("centroid"))).drop("centroid")
    scored = cut_lineage(scored)
    cut = percentiles(scored, key, "__s", {"median": 0.5}).select(key, F.greatest(F.lit(floor), F.col("median") - slack).alias("__cut"))
    kept = scored.join(cut, key).where("__s >= __cut")
    return _mean_vector(kept, [key, "all"], "__v", size).where(F.col("n") >= least).select(key, F.col("all").alias("n"), F.col("n").alias("kept"), "centroid")


def pair_similarities(rows: DataFrame, id_col: str, key: str, vector: str, block_rows: int = 2_000, widest: int = 16_000) -> DataFrame:
    """(same, n, mean, max): cosines of all pairs a < b, told apart by equal keys; without a known key same is null, without a usable vector a pair only counts.

    All pairs are the point here; rows are dealt into blocks that meet pairwise once, in matrix products:
    eight of ``block_rows`` or more, and of ``widest`` rows about where there are many, so no task holds
    more than two of those, and rows are sent as seldom as that allows.
    """
    n = rows.count()
    blocks = max(2, min(-(-n // block_rows), max(8, -(-n // widest))))
    u = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(key).alias("k"), v.normalised(F.col(vector)).alias("u"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).alias("b"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    both = u.withColumn("o", other).select("i", "k", "u", F.least("b", "o").cast("int").alias("x"), F.greatest("b", "o").cast("int").alias("y"), (F.col("b") > F.col("o")).alias("right"))

    def meet(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        sides = block.column("right").to_numpy(zero_copy_only=False)
        x = block.column("x")[0].as_py() != block.column("y")[0].as_py()
        codes = {c: block.column(c).combine_chunks().dictionary_encode().indices for c in "ik"}
        ids, keys = (codes[c].fill_null(-1).to_numpy(zero_copy_only=False) for c in "ik")
        listed = block.column("u").combine_chunks()
        usable = ~listed.is_null().to_numpy(zero_copy_only=False)
        sizes = listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        wide = int(sizes.max(initial=0))
        vectors = np.zeros((len(ids), wide))
        vectors[np.arange(wide) < sizes[:, None]] = listed.flatten().to_numpy(zero_copy_only=False)
        a, b = (np.nonzero(~sides)[0], np.nonzero(sides)[0]) if x else (np.arange(len(ids)),) * 2
        told = {s: [0, 0, 0.0, -np.inf] for s in (None, False, True)}
        for at in range(0, len(a), 512):  # a slice of the products at a time
            one = a[at : at + 512]
            pair = ids[one][:, None] != ids[b][None]
            if not x:
                pair &= one[:, None] < b[None]
            s, whole = vectors[one] @ vectors[b].T, usable[one][:, None] & usable[b][None] & (sizes[one][:, None] == sizes[b][None])
            known, same = (keys[one] >= 0)[:, None] & (keys[b] >= 0)[None], keys[one][:, None] == keys[b][None]
            for kind, kept in ((None, pair & ~known), (True, pair & known & same), (False, pair & known & ~same)):
                values, t = s[kept & whole], told[kind]
                t[0], t[1], t[2] = t[0] + int(kept.sum()), t[1] + len(values), t[2] + float(values.sum())
                t[3] = max(t[3], float(values.max(initial=-np.inf)))
        out = [(k, n, m, total, top if m else None) for k, (n, m, total, top) in told.items() if n]
        kinds = {"same": pa.bool_(), "n": pa.int64(), "m": pa.int64(), "total": pa.float64(), "top": pa.float64()}
        return pa.table([pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds.values())], list(kinds))

    met = both.groupBy("x", "y").applyInArrow(meet, "same boolean, n long, m long, total double, top double")
    return met.groupBy("same").agg(F.sum("n").alias("n"), F.try_divide(F.sum("total"), F.sum("m")).alias("mean"), F.max("top").alias("max"))


def quality_score(size: Column, blur: Column, brightness: Column, detection: Column) -> Column:
    """Weighted mean of four shares, each clamped to 0 to 1."""
    #: The weights of size, blur, brightness and detection.
    weights = (0.35, 0.35, 0.15, 0.15)
    return sum((w * F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0)) for w, c in zip(weights, (size, blur, brightness, detection), strict=True)), F.lit(0.0))


def density_grid(points: DataFrame, x: str = "x", y: str = "y", columns: int = 64, rows: int = 96) -> DataFrame:
    """Counts by cell of the unit square; places at or over the border belong to the cells at it."""
    def cell(c: Column, n: int) -> Column:
        return F.greatest(F.least(F.floor(c * n), F.lit(n - 1)), F.lit(0)).cast("int")

    return points.groupBy(cell(F.col(x), columns).alias("bin_x"), cell(F.col(y), rows).alias("bin_y")).agg(F.count(F.lit(1)).alias("n"))


def smoothed(grid: DataFrame, value: str = "n", columns: int = 64, rows: int = 96) -> DataFrame:
    """Mean over the 3 by 3 neighbourhood of each cell that has a value near it; cells outside the grid do not count, empty cells count 0."""
    offsets = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = grid.select("bin_x", "bin_y", F.col(value).cast("double").alias("v"), F.explode(offsets).alias("o"))
    spread = spread.select((F.col("bin_x") + F.col("o.dx")).alias("bin_x"), (F.col("bin_y") + F.col("o.dy")).alias("bin_y"), "v")
    spread = spread.where(F.col("bin_x").between(0, columns - 1) & F.col("bin_y").between(0, rows - 1))
    wide = 3 - (F.col("bin_x") == 0).cast("int") - (F.col("bin_x") == columns - 1).cast("int")
    high = 3 - (F.col("bin_y") == 0).cast("int") - (F.col("bin_y") == rows - 1).cast("int")
    return spread.groupBy("bin_x", "bin_y").agg(F.sum("v").alias("v")).select("bin_x", "bin_y", (F.col("v") / (wide * high)).alias(value))


def same_conditions(rows: DataFrame, fields: list[str]) -> DataFrame:
    """For each field the number of its values, and whether all runs share it."""
    one = rows.agg(*[F.count_distinct(f).alias(f) for f in fields])
    return one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n_values"), (F.col(f) == 1).alias("shared")) for f in fields])))


def cumulative_buckets(rows: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """(keys, le, n): how many values are at most each bound, the last one infinite."""
    every = [*bounds, float("inf")]
    one = rows.groupBy(*keys).agg(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.count_if(F.col(value) <= b).alias("n")) for b in every]).alias("all"))
    return one.select(*keys, F.inline("all"))


def nullable_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def sample_gate(rows: DataFrame, most: float = 0.01) -> DataFrame:
    """(tp, fp, fn, error_rate, passed) of counted rows: no miss at all and at most so large a share of errors; an empty sample passes."""
    sums = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))
    out = sums.withColumn("error_rate", ratio(F.col("fp") + F.col("fn"), F.col("tp") + F.col("fp") + F.col("fn")))
    return out.withColumn("passed", (F.col("fn") == 0) & (F.col("error_rate") <= most))


def calibrations(rows: DataFrame, camera: str, threshold: str, eligible: Column) -> DataFrame:
    """(camera, threshold, conflict): the threshold of each camera's eligible rows; conflict where they name several."""
    found = rows.where(eligible).groupBy(camera)
    return found.agg(F.max(threshold).alias(threshold), (F.count_distinct(threshold) > 1).alias("conflict"))


def comparison_passes(far: Column, unknown: Column, most: float = 0.001, least: int = 1_000) -> Column:
    """Whether a model's summary may be compared: a low enough false accept rate over enough unknown probes."""
    return F.coalesce((far <= most) & (unknown >= least), F.lit(False))
