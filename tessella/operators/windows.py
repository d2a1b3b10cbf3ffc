"""Order-dependent operators that plain windows express; each key's order has a unique tiebreak."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def change_points(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The first row of each key and every row whose value differs from the one before."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
    return rows.withColumn("__keep", first | ~F.col(value).eqNullSafe(before)).where("__keep").drop("__keep")


def transitions(rows: DataFrame, key: str, order: list[str], state: str, initial: str = "UNKNOWN") -> DataFrame:
    """Rows whose state differs from the one before, which is ``initial`` at first, with it in ``from_state``."""
    before = F.coalesce(F.lag(state).over(Window.partitionBy(key).orderBy(*order)), F.lit(initial))
    return rows.withColumn("from_state", before).where(~F.col(state).eqNullSafe(F.col("from_state")))


def on_time(rows: DataFrame, key: str, arrival: list[str], time_col: str) -> DataFrame:
    """Rows that, in order of arrival, are no older than any of their key before them; late rows go."""
    newest = F.max(time_col).over(Window.partitionBy(key).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("__newest", newest).where(F.col("__newest").isNull() | (F.col(time_col) >= F.col("__newest"))).drop("__newest")


def sessions(rows: DataFrame, key: str, order: list[str], start: str, stop: str, gap_seconds: float) -> DataFrame:
    """``rows`` with session (long, from 1 in each key), gap_seconds to the row before and starts (the first of a session).

    A gap over ``gap_seconds`` (strictly) begins a new session.  Overlaps are no errors here; see
    ``tessella.streaming.steps.Sessions`` for the form that rejects them.
    """
    w = Window.partitionBy(key).orderBy(*order)
    gap = (F.unix_micros(start) - F.unix_micros(F.lag(stop).over(w))) / 1e6
    rows = rows.withColumn("gap_seconds", gap).withColumn("starts", F.coalesce(F.col("gap_seconds") > gap_seconds, F.lit(True)))
    return rows.withColumn("session", F.sum(F.col("starts").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def session_rollup(rows: DataFrame, key: str, start: str, stop: str, id_col: str, duration: str | None = None) -> DataFrame:
    """One row for each session: first start, last stop, count, summed length rounded to 3, gaps and ids in order."""
    length = F.col(duration) if duration else (F.unix_micros(stop) - F.unix_micros(start)) / 1e6
    ordered = F.array_sort(F.collect_list(F.struct(F.col(start).alias("t"), F.col(id_col).alias("id"), F.when(~F.col("starts"), F.col("gap_seconds")).alias("gap"))))
    out = rows.groupBy(key, "session").agg(F.min(start).alias("started_at"), F.max(stop).alias("ended_at"), F.count(F.lit(1)).alias("n"), F.bround(F.sum(length), 3).alias("duration"), ordered.alias("__all"))
    gaps = F.filter(F.transform("__all", lambda e: e["gap"]), lambda x: x.isNotNull())
    return out.withColumns({"gaps": gaps, "ids": F.transform("__all", lambda e: e["id"])}).drop("__all")


def merge_sessions(rows: DataFrame, overrides: DataFrame, id_col: str, key: str) -> DataFrame:
    """``rows`` with the session that ``overrides`` (id, session) names where it does; ``mixed`` tells that a named session has several keys."""
    named = overrides.select(F.col("id").alias(id_col), F.col("session").cast("string").alias("__named"))
    rows = rows.join(named, id_col, "left").withColumn("merged_session", F.coalesce("__named", F.concat_ws("-", F.col(key).cast("string"), F.col("session").cast("string")))).drop("__named")
    mixed = rows.groupBy("merged_session").agg((F.count_distinct(key) > 1).alias("mixed"))
    return rows.join(mixed, "merged_session")


def stationary(rows: DataFrame, key: str, time_col: str, values: list[str], seconds: float, limit: float, id_col: str) -> DataFrame:
    """Rows whose distance to every row of their key within ``seconds`` before and after is at most ``limit``.

    With one value the extremes of the frame decide; with several the frame's points are compared.
    """
    at = F.unix_micros(time_col)
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-int(seconds * 1e6), int(seconds * 1e6))
    if len(values) == 1:
        v = F.col(values[0])
        far = F.greatest(F.max(v).over(w) - v, v - F.min(v).over(w))
    else:
        points = F.collect_list(F.struct(*values)).over(w)
        far = F.array_max(F.transform(points, lambda p: F.sqrt(sum(((p[c] - F.col(c)) * (p[c] - F.col(c)) for c in values), F.lit(0.0)))))
    return rows.withColumn("__far", far).where(F.col("__far") <= limit).drop("__far")


def append_ordinals(rows: DataFrame, group: str, order: list, target: str, active) -> DataFrame:
    """Active rows without a number get the numbers after their group's largest, in order; the others keep theirs."""
    need = active & F.col(target).isNull()
    w = Window.partitionBy(group)
    ordinal = F.row_number().over(Window.partitionBy(group, need).orderBy(*order))
    return rows.withColumn("assigned", F.when(need, F.coalesce(F.max(target).over(w), F.lit(0)) + ordinal).otherwise(F.col(target)))


def newest_of_each(rows: DataFrame, key: str, order: list[str], every: int) -> DataFrame:
    """The last of each ``every`` rows of a key, with ``batch``, its number from 1: what a consumer that comes by so often gets."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("__at", at).where(F.col("__at") % every == 0).withColumn("batch", F.floor(F.col("__at") / every)).drop("__at")


def poll_differences(rows: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Rows whose state differs from the one before, with ``from_state``; a key's first row gives none."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumns({"from_state": F.lag(state).over(w), "__first": F.row_number().over(w) == 1})
    return marked.where(~F.col("__first") & ~F.col("from_state").eqNullSafe(F.col(state))).drop("__first")


def consensus(rows: DataFrame, key: str, order: list[str], value: str, size: int = 5, votes: int = 3) -> DataFrame:
    """``rows`` with confirmed, the last value that had ``votes`` of ``size`` rows in a row (over half of them), and switches, how often it changed."""
    if 2 * votes <= size:
        raise ValueError("votes have to be over half of size")
    w = Window.partitionBy(key).orderBy(*order)
    seen = F.collect_list(value).over(w.rowsBetween(1 - size, 0))
    won = F.filter(F.array_distinct(seen), lambda v: F.size(F.filter(seen, lambda x: x == v)) >= votes)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__won", F.get(won, F.lit(0))).withColumn("confirmed", F.last("__won", ignorenulls=True).over(so_far))
    before = F.lag("confirmed").over(w)
    rows = rows.withColumn("__switch", F.coalesce(before != F.col("confirmed"), F.lit(False)).cast("long"))
    return rows.withColumn("switches", F.sum("__switch").over(so_far)).drop("__won", "__switch")


def grid_places(rows: DataFrame, group: str, order: list, columns: int = 4) -> DataFrame:
    """grid_row and grid_column, both from 1, by the order in each group."""
    i = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    return rows.withColumns({"grid_row": (i / columns).cast("int") + 1, "grid_column": i % columns + 1})


def motion(rows: DataFrame, key: str, time_col: str, values: list[str], tie: str) -> DataFrame:
    """speed: the largest change of the values against the row before, a second (at least a millisecond apart); null at first."""
    w = Window.partitionBy(key).orderBy(time_col, tie)
    seconds = F.greatest((F.unix_micros(time_col) - F.unix_micros(F.lag(time_col).over(w))) / 1e6, F.lit(1e-3))
    deltas = [F.abs(F.col(v) - F.lag(v).over(w)) for v in values]
    return rows.withColumn("speed", (F.greatest(*deltas) if len(deltas) > 1 else deltas[0]) / seconds)


def most_alike(rows: DataFrame, key: str, order: list[str], bits: str, back: int = 120) -> DataFrame:
    """likeness: the largest share of equal bits with one of the ``back`` rows before; null at first."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-back, -1)
    return rows.withColumn("likeness", F.array_max(F.transform(F.collect_list(bits).over(w), lambda b: 1 - F.bit_count(b.bitwiseXOR(F.col(bits))) / 64)))


def numbered(rows: DataFrame, order: list, partition: list[str], name: str = "index") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


def attach_latency(attached: DataFrame, entered: DataFrame, key: str, time_col: str = "ts") -> DataFrame:
    """Seconds from each key's first entry to its first attachment: n, mean, negative (left out) and missing (no entry)."""
    first = entered.groupBy(key).agg(F.min(time_col).alias("__in"))
    last = attached.groupBy(key).agg(F.min(time_col).alias("__at")).join(first, key, "left")
    wait = (F.unix_micros("__at") - F.unix_micros("__in")) / 1e6
    return last.agg(F.count_if(wait >= 0).alias("n"), F.avg(F.when(wait >= 0, wait)).alias("mean"), F.count_if(wait < 0).alias("negative"), F.count_if(wait.isNull()).alias("missing"))


def asof(left: DataFrame, right: DataFrame, key: str, time_col: str, value: str) -> DataFrame:
    """``left`` with the value that ``right`` had for the key at the time or last before it: one sort of both together, no range join."""
    names = left.columns
    a = left.withColumns({"__side": F.lit(1), "__value": F.lit(None).cast(dict(right.dtypes)[value])})
    b = right.select(*[(F.col(c) if c in (key, time_col) else F.lit(None).cast(t)).alias(c) for c, t in left.dtypes], F.lit(0).alias("__side"), F.col(value).alias("__value"))
    w = Window.partitionBy(key).orderBy(time_col, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("asof_value", F.last("__value", ignorenulls=True).over(w))
    return both.where("__side = 1").select(*names, "asof_value")


def diagnostics(rows: DataFrame, key: str, order: list[str], counted: dict, value: str) -> DataFrame:
    """``rows`` with running figures of their key: frames, one count for each condition, and the mean of ``value`` (null while there is none)."""
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counts = {n: F.sum(F.coalesce(c, F.lit(False)).cast("long")).over(so_far) for n, c in counted.items()}
    return rows.withColumns({"frames": F.count(F.lit(1)).over(so_far), **counts, "mean": F.avg(value).over(so_far)})


def applied(rows: DataFrame, key: str, arrival: list[str], time_col: str, state: str, initial: str = "UNKNOWN") -> DataFrame:
    """``rows`` with applied (no older than any row of the key before it, in order of arrival), from_state (what was applied last) and changed (applied, to another state)."""
    before = Window.partitionBy(key).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("applied", F.coalesce(F.col(time_col) >= F.max(time_col).over(before), F.lit(True)))
    last = F.last(F.when(F.col("applied"), F.struct(F.col(state).alias("s"))), ignorenulls=True).over(before)
    rows = rows.withColumn("__last", last).withColumn("from_state", F.when(F.col("__last").isNull(), F.lit(initial)).otherwise(F.col("__last.s"))).drop("__last")
    return rows.withColumn("changed", F.col("applied") & ~F.col(state).eqNullSafe(F.col("from_state")))
