"""Connected components over an edge table, by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.skew import hot_keys, join_per_key
from tessella.session import cut_lineage


#: So many edges may meet in one task: a hub of them is no burden, and a window needs neither a job of its own nor a broadcast.
FEW_EDGES = 1 << 18


def _small_star(pairs: DataFrame) -> DataFrame:
    """``_star`` of few pairs, those of a node in one place."""
    return pairs.select("u", "v", F.least("u", F.min("v").over(Window.partitionBy("u"))).alias("m"))


def _star(pairs: DataFrame) -> DataFrame:
    """For (u, v): attach the least node among u and all its v. A partial minimum, then a join that leaves the pairs of a hub where they lie."""
    least = cut_lineage(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
    met = join_per_key(pairs, least.drop("n"), hot_keys(least, "u"), "u")
    return met.select("u", "v", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Return (node, component) for every node of an edge; component is the smallest node reachable.

    Null ends and self-loops are ignored (a node that has nothing but a self-loop gives no row);
    repeated and reversed edges count once; an empty table gives an empty one.  Each round is a partial
    minimum and a join on the node, in which the minima of hubs are broadcast and their edges neither
    shuffled by the hub nor sorted, so no task holds more than its share of all edges, however large a component is.
    Up to FEW_EDGES edges a round is a window instead: the driver keeps each broadcast until it collects its garbage.
    The rounds end when the edge set no longer changes, which takes about log(n) of them.
    """
    now = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    now = cut_lineage(now.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        digest = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if digest == before:
            break
        before, star = digest, _small_star if digest[0] <= FEW_EDGES else _star
        both = now.union(now.select("v", "u"))
        large = cut_lineage(star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        small = star(large)
        now = cut_lineage(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m"))).where("u <> v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
