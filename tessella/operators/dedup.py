"""Duplicates by content hash, near-duplicates by perceptual hash, and split isolation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.vectors import hamming
from tessella.operators.matching import perfect_match
from tessella.operators.scan import numbered
from tessella.operators.skew import hot_keys, join_per_key
from tessella.session import cut_lineage


def exact_duplicates(rows: DataFrame, content: Column, id_col: str) -> DataFrame:
    """``rows`` with sha256 and duplicate_of: the first id of equal content, null for that first one.

    The first id is a partial minimum joined back by hash; rows of a frequent content get it where they
    lie.  Null contents count as equal; their sha256 is null.
    """
    keyed = rows.withColumn("sha256", F.sha2(content, 256))
    first = cut_lineage(keyed.groupBy("sha256").agg(F.min(id_col).alias("__first"), F.count(F.lit(1)).alias("n")))
    joined = join_per_key(keyed, first.drop("n"), hot_keys(first, "sha256"), "sha256")
    return joined.withColumn("duplicate_of", F.when(F.col(id_col) != F.col("__first"), F.col("__first"))).drop("__first")


def bands(bits: Column, radius: int, joined: int = 3) -> Column:
    """Keys such that two 64-bit hashes within ``radius`` bits share one: of radius + joined stretches, any ``joined`` are untouched, and each such choice is a key."""
    n = radius + joined
    edges = [64 * i // n for i in range(n + 1)]
    part = [F.shiftrightunsigned(F.shiftleft(bits, 64 - b), 64 - b + a) for a, b in zip(edges, edges[1:], strict=False)]
    return F.array(*[F.struct(F.lit(i).alias("band"), *(part[p].alias(f"b{k}") for k, p in enumerate(chosen))) for i, chosen in enumerate(combinations(range(n), joined))])


#: Hashes by band that one task of a join gets, about.
BANDED = 1 << 19


def within(left: DataFrame, right: DataFrame, left_id: str, right_id: str, bits: str, radius: int, beside: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """(left id, right id, distance) of all pairs within ``radius`` bits (and of equal ``beside`` columns): an equi-join by band, each pair once, then verified.

    Give distinct hashes on either side: a hash that many rows have makes that many times as many pairs.
    ``parts``: tasks of the join, where the number of hashes is known; else as many as Spark's setting has.
    """
    a = left.select(*beside, left_id, F.col(bits).alias("__a"), F.explode(bands(F.col(bits), radius)).alias("__band"))
    b = right.select(*beside, right_id, F.col(bits).alias("__b"), F.explode(bands(F.col(bits), radius)).alias("__band"))
    if parts:
        a, b = (x.repartition(parts, *beside, "__band") for x in (a, b))
    pairs = a.join(b, [*beside, "__band"]).withColumn("distance", hamming(F.col("__a"), F.col("__b"))).where(F.col("distance") <= radius)
    return pairs.select(left_id, right_id, "distance").distinct()


def _join_parts(rows: DataFrame, hashes: int, radius: int) -> int | None:
    """Tasks of a join by band, of which each gets about BANDED; None where Spark's setting has as many."""
    parts = -(-hashes * comb(radius + 3, 3) // BANDED)  # a task's share of the join is as large for any number of rows
    return parts if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def near_pairs(rows: DataFrame, id_col: str, bits: str, radius: int = 4) -> DataFrame:
    """(id, other, distance), id < other: pairs of the least ids of different hashes within ``radius`` bits, and each least id with the others of its own hash (distance 0).

    So a third of all rows with one hash gives as many rows, not their square; rows with null bits are in no pair.
    """
    known = rows.where(F.col(bits).isNotNull() & F.col(id_col).isNotNull()).select(id_col, bits)
    first = cut_lineage(known.groupBy(bits).agg(F.min(id_col).alias("__first"), F.count(F.lit(1)).alias("n")))
    heads = first.select(bits, F.col("__first").alias(id_col))
    near = within(heads, heads.withColumnRenamed(id_col, "other"), id_col, "other", bits, radius, parts=_join_parts(heads, heads.count(), radius)).where(F.col(id_col) < F.col("other"))
    members = join_per_key(known, first.drop("n"), hot_keys(first, bits), bits).where(F.col(id_col) > F.col("__first"))
    return near.union(members.select(F.col("__first").alias(id_col), F.col(id_col).alias("other"), F.lit(0).alias("distance")))


def least_iou(a: Column, b: Column, least: float) -> Column:
    """``perfect_match`` of two lists of flat boxes (x1, y1, x2, y2, x1, ...); null for none."""

    @F.pandas_udf("double")
    def matched(one: pd.Series, other: pd.Series) -> pd.Series:
        flat = lambda x: np.asarray(x, float).reshape(-1, 4)
        return pd.Series([perfect_match(flat(x), flat(y), least) for x, y in zip(one, other, strict=True)], dtype=object)

    return matched(a, b)


#: Heads whose leaders are found first, by how much all later batches of heads grow, and pairs that one task settles in their order.
FIRST, GROWTH, OPEN_PAIRS = 4096, 4, 1 << 20


def _near_heads(one: DataFrame, other: DataFrame, radius: int, box_iou: float | None, parts: int | None) -> DataFrame:
    """(n, m, distance, iou): places of heads and others of a camera within ``radius`` bits whose boxes match; ``box_iou`` None: nothing has boxes."""
    near = within(one.select("camera", F.col("at").alias("n"), "bits"), other.select("camera", F.col("at").alias("m"), "bits"), "n", "m", "bits", radius, ("camera",), parts)
    if box_iou is None:
        return near.withColumn("iou", F.lit(1.0))
    met = near.join(one.select(F.col("at").alias("n"), F.col("boxes").alias("__a")), "n").join(other.select(F.col("at").alias("m"), F.col("boxes").alias("__b")), "m")
    return met.withColumn("iou", least_iou(F.col("__a"), F.col("__b"), box_iou)).where("iou is not null").drop("__a", "__b")


def _led(pairs: DataFrame) -> DataFrame:
    """(n): of pairs (n, m), m before n, the n that are no leaders, as one of their m is one.

    A round takes the m with nothing before them as leaders, and all that has one of these goes; so it needs
    no more rounds than leaders stand in one another's way, however many pairs there are, and OPEN_PAIRS
    that are left are settled in one task.
    """
    pairs, led = cut_lineage(pairs), []
    while pairs.count() > OPEN_PAIRS:
        leaders = pairs.select("m").join(pairs.select(F.col("n").alias("m")), "m", "left_anti").distinct()
        led.append(cut_lineage(pairs.join(leaders, "m", "left_semi").select("n").distinct()))
        pairs = cut_lineage(pairs.join(led[-1], "n", "left_anti").join(led[-1].withColumnRenamed("n", "m"), "m", "left_anti"))

    def settle(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lost = set()
        for pdf in pdfs:
            for n, m in zip(pdf["n"].tolist(), pdf["m"].tolist(), strict=True):
                if m not in lost:
                    lost.add(n)
        yield pd.DataFrame({"n": sorted(lost)}, dtype="int64")

    return reduce(DataFrame.union, led, pairs.coalesce(1).sortWithinPartitions("n", "m").mapInPandas(settle, "n long"))


def leader_groups(rows: DataFrame, camera: str, radius: int = 4, box_iou: float = 0.9) -> DataFrame:
    """``rows`` with group_id (the leader's id), reason and distance, camera by camera in order of priority.

    rows(camera, id, sha256, bits, label, reviewed, sharpness[, boxes array<double>]): reviewed rows lead,
    then the sharpest, then the lowest id.  A row of the content and label of an earlier one joins its
    group; else the nearest earlier leader within ``radius`` bits whose boxes match one to one with an IoU
    of ``box_iou``, by (distance, -IoU, id); else it leads a group of its own.

    Contents are settled first.  Of those with one hash and the same boxes only the first, their head, can
    lead: the others have it before them, or what leads it.  Heads go in batches in their order, each a few
    times as large as all before: what is near a leader of the batches before is led, and pairs are made of
    the rest alone, so the pairs of a crowd are never all made.  In the end each row looks among the leaders
    near its head for the best of those before it.  Neither a camera nor a group is gathered anywhere.
    """
    order = F.struct((~F.col("reviewed")).alias("later"), (-F.col("sharpness")).alias("dull"), F.col("id").alias("id"))
    boxed = "boxes" in rows.columns
    whole = rows if boxed else rows.withColumn("boxes", F.array().cast("array<double>"))
    content = [camera, "sha256", "label"]
    firsts = cut_lineage(whole.groupBy(*content).agg(F.min_by(F.struct("id", "bits", "boxes", order.alias("order")), order).alias("f")).select(*content, "f.*"))
    # boxes that do not match themselves make no class
    alone = F.when(least_iou(F.col("boxes"), F.col("boxes"), box_iou).isNull(), F.col("id")) if boxed else F.lit(None).cast(dict(rows.dtypes)["id"])
    known = firsts.where(F.col("bits").isNotNull() & F.col(camera).isNotNull()).withColumn("alone", alone)
    known = cut_lineage(known.select("id", "order", F.struct(F.col(camera).alias("camera"), "bits", "boxes", "alone").alias("class")))
    classes = known.groupBy("class").agg(F.min("order").alias("order"), F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(0))
    heads = cut_lineage(numbered(classes, ["all"], ["order"], "at").select("at", "order", "n", "class", "class.camera", "class.bits", "class.boxes"))
    size = heads.count()
    near = lambda one, other: _near_heads(one, other, radius, box_iou if boxed else None, _join_parts(heads, size, radius))
    leaders, low, high = heads.limit(0), 0, FIRST
    while low < size:
        batch = heads.where(F.col("at").between(low, high - 1))
        if low:
            batch = cut_lineage(batch.join(near(batch, leaders).select(F.col("n").alias("at")).distinct(), "at", "left_anti"))
        led = _led(near(batch, batch).where("m < n").select("n", "m"))
        leaders = cut_lineage(leaders.union(batch.join(led.withColumnRenamed("n", "at"), "at", "left_anti")))
        low, high = high, high * GROWTH
    who = leaders.select(F.col("at").alias("m"), F.col("order").alias("o"))
    best = F.struct("distance", (-F.col("iou")).alias("iou"), F.col("o.id").alias("id"), "o")
    listed = near(heads, leaders).join(who, "m").groupBy(F.col("n").alias("at")).agg(F.collect_list(best).alias("near"))
    listed = cut_lineage(heads.select("at", "class").join(listed, "at").select("class", "near"))
    met = join_per_key(known, listed, hot_keys(heads.select("class", "n"), "class"), "class")
    met = met.select("id", F.array_min(F.filter("near", lambda x: x["o"] < F.col("order"))).alias("best")).where("best is not null")
    settled = firsts.select(*[F.col(c).alias(f"__{c}") for c in content], F.col("id").alias("__first")).join(met.withColumnRenamed("id", "__first"), "__first", "left")
    settled = settled.select(*[f"__{c}" for c in content], "__first", F.coalesce("best.id", "__first").alias("group_id"), F.when(F.col("best").isNull(), "leader").otherwise("near").alias("__reason"), F.coalesce("best.distance", F.lit(0)).alias("__distance"))
    joined = rows.join(settled, [rows[c].eqNullSafe(settled[f"__{c}"]) for c in content])
    own = F.col("id") == F.col("__first")
    out = joined.withColumn("reason", F.when(own, F.col("__reason")).otherwise("same_content")).withColumn("distance", F.when(own, F.col("__distance")).otherwise(0))
    return out.select(*rows.columns, "group_id", "reason", "distance")


def group_report(groups: DataFrame, group: str = "group_id", id_col: str = "id") -> DataFrame:
    """One row for each member of a group of several, with n, the group's size; a group of any size is counted in every task first and gathered nowhere."""
    sizes = cut_lineage(groups.groupBy(group).agg(F.count(F.lit(1)).alias("n")))
    return join_per_key(groups.select(group, id_col, "reason", "distance"), sizes.where("n > 1"), hot_keys(sizes, group), group)


def isolation(candidates: DataFrame, reference: DataFrame, id_col: str, content: str, bits: str, radius: int = 4) -> DataFrame:
    """(id, verdict, other): candidates whose content or, within ``radius`` bits, whose hash a reference row has: exact before near, the nearest, then the lowest id."""
    known = reference.groupBy(F.col(content).alias("__c")).agg(F.min(id_col).alias("other"))
    exact = candidates.select(id_col, F.col(content).alias("__c")).join(known, "__c").select(id_col, F.lit("exact").alias("verdict"), "other", F.lit(-1).alias("distance"))
    # the least reference id of each hash, and each hash of the candidates once
    heads = reference.where(F.col(bits).isNotNull()).groupBy(bits).agg(F.min(id_col).alias("other"))
    asked = candidates.where(F.col(bits).isNotNull()).select(bits).distinct().withColumn("__asked", F.col(bits))
    met = cut_lineage(within(asked, heads, "__asked", "other", bits, radius)).groupBy("__asked").agg(F.min(F.struct("distance", "other")).alias("__m"))
    near = candidates.join(met, F.col(bits) == F.col("__asked")).select(id_col, F.lit("near").alias("verdict"), F.col("__m.other").alias("other"), F.col("__m.distance").alias("distance"))
    return exact.union(near).groupBy(id_col).agg(F.min_by(F.struct("verdict", "other", "distance"), F.struct("distance", "other")).alias("b")).select(id_col, "b.verdict", "b.other", F.greatest("b.distance", F.lit(0)).alias("distance"))


def with_text_bits(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, bits) of each id: a bit is set where over half of the text's words' hashes have it.

    Words are split at white space.  The tallies are sums over exploded words, two bits to a sum, taken
    where the text lies before they are shuffled.  Rows of one id count as one text; a null text has
    null bits, an empty one those of its single empty word.
    """
    words = rows.select(F.col(id_col), F.explode_outer(F.split(text_col, r"\s+")).alias("__w")).withColumn("__h", F.xxhash64("__w"))
    pair = F.lit(1 << 32 | 1)
    tallies = [F.sum(F.shiftrightunsigned("__h", b).bitwiseAND(pair)).alias(f"__t{b}") for b in range(32)]
    summed = words.groupBy(id_col).agg(F.count("__w").alias("__n"), *tallies)
    low = F.lit((1 << 32) - 1)
    bits = F.lit(0).cast("long")
    for b in range(32):
        for at, tally in ((b, F.col(f"__t{b}").bitwiseAND(low)), (b + 32, F.shiftrightunsigned(f"__t{b}", 32))):
            bits = bits.bitwiseOR(F.when(2 * tally > F.col("__n"), F.shiftleft(F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long")))
    return summed.select(id_col, F.when(F.col("__n") > 0, bits).alias("bits"))


def priority(reviewed: str, sharpness: str, id_col: str) -> list[Column]:
    return [F.desc(reviewed), F.desc(sharpness), F.asc(id_col)]


def representatives(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
