"""Recurrences as a segmented parallel prefix scan: no key is folded, sorted or numbered in one task.

A row is an affine map of its key's state: ``y = a * y + b``, ``b`` one number or several.  Rows are put in
order by range partitions and numbered in their key; blocks of a fixed number of rows are composed to one
map each; the maps are scanned in the same way until a key is one block; and each block is then folded
from the state that comes in.  A hot key costs as many tasks as its rows need, and each level is smaller
by the size of a block.

Smoothing, running sums, the last value that was set and the value before are all such maps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import cut_lineage

BLOCK = 128


def _same(a: list[str], b: list[str]) -> Column:
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & F.col(x).eqNullSafe(F.col(y))
    return out


def numbered(rows: DataFrame, key: list[str], order: list[str], into: str = "__at") -> DataFrame:
    """``rows``, written, with each row's place (long, from 0) in its key by ``order``, which has to be unique in a key.

    A row's place is its place in its range partition less that of its key's first row there, and the
    key's rows in the partitions before.  Null keys are one key.
    """
    columns = [*key, *order]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *columns).sortWithinPartitions(*columns)
    placed = cut_lineage(placed.withColumns({"__part": F.spark_partition_id(), "__seat": F.monotonically_increasing_id()}))
    names = [f"__k{i}" for i in range(len(key))]
    runs = placed.groupBy(F.col("__part").alias("__p"), *(F.col(k).alias(n) for k, n in zip(key, names, strict=True))).agg(F.min("__seat").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*names).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition that a key is in
    runs = runs.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    joined = placed.join(runs, (F.col("__part") == F.col("__p")) & _same(key, names))
    return joined.withColumn(into, F.col("__seat") - F.col("__first") + F.col("__before")).drop("__part", "__seat", "__p", "__first", "__before", *names)


def _step(y: Column, a: Column, b: Column) -> Column:
    """``a * y + b`` for each number; 0 * anything is nothing, so a map of a = 0 starts anew after nulls and NaNs, too."""
    return F.when(a == 0, b).otherwise(F.zip_with(y, b, lambda s, t: a * s + t))


def _blocks(maps: DataFrame, key: list[str], at: str, block: int, payload: list[str]) -> DataFrame:
    """A row for each block of a key: its number, its maps in order, and what they come to."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), "__a", "__b", *payload)))
    out = maps.groupBy(*key, F.floor(F.col(at) / block).alias("__block")).agg(listed.alias("__maps"))
    one = F.get("__maps", F.lit(0))
    whole = F.aggregate(F.slice("__maps", 2, block), F.struct(one["__a"].alias("a"), one["__b"].alias("b")), lambda m, r: F.struct((r["__a"] * m["a"]).alias("a"), _step(m["b"], r["__a"], r["__b"]).alias("b")))
    return cut_lineage(out.withColumn("__whole", whole))


def _incoming(blocks: DataFrame, key: list[str], numbers: int, block: int) -> DataFrame:
    """``blocks`` with __in, the state before each block."""
    zero = F.array_repeat(F.lit(0.0), numbers)
    last = blocks.agg(F.max("__block")).first()[0]
    if not last:
        return blocks.withColumn("__in", zero)
    maps = blocks.select(*key, F.col("__block").alias("__upper_at"), F.col("__whole.a").alias("__a"), F.col("__whole.b").alias("__b"))
    upper = _incoming(_blocks(maps, key, "__upper_at", block, []), key, numbers, block)
    states = F.aggregate("__maps", F.struct(F.col("__in").alias("y"), F.array().cast("array<array<double>>").alias("out")), lambda s, m: F.struct(_step(s["y"], m["__a"], m["__b"]).alias("y"), F.concat(s["out"], F.array(s["y"])).alias("out")))
    spread = upper.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(key)), F.explode(F.arrays_zip(F.transform("__maps", lambda m: m["at"]).alias("at"), states["out"].alias("y"))).alias("s"))
    spread = spread.select(*(f"__k{i}" for i in range(len(key))), F.col("s.at").alias("__b_at"), F.col("s.y").alias("__in"))
    return blocks.join(spread, _same(key, [f"__k{i}" for i in range(len(key))]) & (F.col("__block") == F.col("__b_at"))).drop("__b_at", *(f"__k{i}" for i in range(len(key))))


def scan(rows: DataFrame, key: list[str], at: str, a: Column, b: dict[str, Column], before: bool = False, block: int = BLOCK) -> DataFrame:
    """``rows``, which ``numbered`` has numbered in ``at``, with a column (double) for each of ``b``: the state ``y = a * y + b`` after the row, or before it.

    The state before a key's first row is 0; a first row of a = 0 sets it.  A null or NaN stays until a
    row of a = 0.  With ``before`` a key's first row has 0.
    """
    payload = rows.columns
    maps = rows.withColumns({"__a": a.cast("double"), "__b": F.array(*(c.cast("double") for c in b.values()))})
    maps = maps.select(*key, "__a", "__b", F.col(at).alias("__number"), F.struct(*payload).alias("__row"))
    blocks = _incoming(_blocks(maps, key, "__number", block, ["__row"]), key, len(b), block)
    fold = F.aggregate(
        "__maps", F.struct(F.col("__in").alias("y"), F.array().cast("array<array<double>>").alias("out")),
        lambda s, m: F.transform(F.array(_step(s["y"], m["__a"], m["__b"])), lambda y: F.struct(y.alias("y"), F.concat(s["out"], F.array(s["y"] if before else y)).alias("out")))[0],
    )
    each = blocks.select(F.explode(F.arrays_zip(F.transform("__maps", lambda m: m["__row"]).alias("r"), fold["out"].alias("y"))).alias("z"))
    return each.select("z.r.*", *(F.get("z.y", F.lit(i)).alias(n) for i, n in enumerate(b)))


def smoothed(rows: DataFrame, key: list[str], order: list[str], values: dict[str, Column], keep: float, block: int = BLOCK) -> DataFrame:
    """``rows`` with exponentially smoothed values: keep * old + (1 - keep) * new, from a key's first row on."""
    own = numbered(rows, key, order)
    first = F.col("__at") == 0
    return scan(own, key, "__at", F.when(first, 0.0).otherwise(keep), {n: F.when(first, v).otherwise((1 - keep) * v) for n, v in values.items()}, block=block).drop("__at")


def velocity(rows: DataFrame, key: list[str], order: list[str], time_col: str, value: str, keep: float = 0.7, block: int = BLOCK) -> DataFrame:
    """``rows`` with velocity: the first is the change against the row before, a second (at least a millisecond apart); then keep * old + (1 - keep) * new; null at first."""
    own = numbered(rows, key, order)
    own = scan(own, key, "__at", F.lit(0.0), {"__t": F.unix_micros(time_col), "__x": F.col(value)}, before=True, block=block)
    seconds = F.greatest((F.unix_micros(time_col) - F.col("__t")) / 1e6, F.lit(1e-3))
    change = (F.col(value) - F.col("__x")) / seconds
    first = F.col("__at") <= 1
    out = scan(own, key, "__at", F.when(first, 0.0).otherwise(keep), {"velocity": F.when(F.col("__at") == 0, F.lit(0.0)).when(first, change).otherwise((1 - keep) * change)}, block=block)
    return out.withColumn("velocity", F.when(F.col("__at") > 0, F.col("velocity"))).drop("__at", "__t", "__x")


def held(rows: DataFrame, key: list[str], order: list[str], time_col: str, strong: Column, seconds: float, value: str, block: int = BLOCK) -> DataFrame:
    """``rows`` with held_value: the last strong value of the key no older than ``seconds`` (that age included); only strong rows refresh what is held."""
    own = numbered(rows, key, order)
    is_strong = F.coalesce(strong, F.lit(False))
    out = scan(own, key, "__at", F.when(is_strong, 0.0).otherwise(1.0), {n: F.when(is_strong, c).otherwise(0.0) for n, c in (("__t", F.unix_micros(time_col)), ("__v", F.col(value)), ("__any", F.lit(1.0)))}, block=block)
    fresh = (F.col("__any") > 0) & (F.unix_micros(time_col) - F.col("__t") <= int(seconds * 1e6))
    return out.withColumn("held_value", F.when(fresh, F.col("__v"))).drop("__at", "__t", "__v", "__any")


def absence_runs(rows: DataFrame, key: list[str], order: list[str], time_col: str, absent: Column, seconds: float, block: int = BLOCK) -> DataFrame:
    """Runs of absent rows: key, run, vacant_since, last_seen, n, is_long (from ``seconds`` on, that length included); a run's number is how many rows that are not absent came before."""
    own = scan(numbered(rows, key, order), key, "__at", F.lit(1.0), {"__run": F.when(absent, 0.0).otherwise(1.0)}, block=block)
    out = own.where(absent).groupBy(*key, F.col("__run").cast("long").alias("run")).agg(F.min(time_col).alias("vacant_since"), F.max(time_col).alias("last_seen"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("is_long", (F.unix_micros("last_seen") - F.unix_micros("vacant_since")) >= int(seconds * 1e6))
