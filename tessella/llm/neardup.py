"""Near-duplicate texts of the pipeline: exact Jaccard similarity of 0.8 of their five-word shingles.

A text's shingles have a SimHash, and the operator's positional-byte index (``simhash.links``) links those
at two bits or fewer; the members of each such class are verified against its first.  That finds the nearest
copies; at 0.8 itself fingerprints differ in about ten bits, so the rest comes from a second index.

That one has a prefix filter.  All texts order their shingles alike, rare ones first; two sets at 0.8 or more then share one of the first ``n - ceil(0.8 n) + 1`` of each, so only
those are filed.  A shingle that occurs in one text alone is not filed, but takes its place in the order,
and where two texts' first common shingle stands bounds what they can have in common: a pair is met in a
list only if that bound and the two sizes allow 0.8.  No pair at 0.8 is missed, and none is sampled.

The order needs to know what is frequent.  All shingles of all texts are counted, in stretches of the hash
range whose number follows the corpus.  What every task gets of that has a fixed size: a map of 2^26 bits
that tells which beginnings of hashes occur twice, and the FREQUENT most frequent shingles.  Order and
filing depend on a shingle's hash alone, so a full map or a longer tail of frequent ones costs time, not pairs.

A list of texts that share a shingle is not paired up.  Its member with the most still before it is held
against all others first; what that links is one component, and only members of different components of a
list are then paired, the largest component on one side alone.  Nothing is capped: what is left out is
linked already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import simhash
from tessella.llm._common import cut_lineage, hot_keys, join_per_key, lower_ascii, map_texts, row_keys, rows_of, slices, with_keys
from tessella.llm.simhash import _BIT, _WORD
from tessella.operators.graph import connected_components

SHINGLE = 5
#: Shingles whose frequency every task knows; bits of the map of repeated ones; shingles that a task holds, and a stretch of hashes, about.
FREQUENT, MAP_BITS, HELD, STRETCH = 1 << 20, 26, 1 << 19, 1 << 19
#: Pairs of one text that are verified together; members of a list that the others are held against in one place; texts fetched by a broadcast list of them.
TOGETHER, BLOCK, BROADCAST_KEYS = 256, 1024, 100_000
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of all runs of five words; of all words, where there are fewer."""
    words = _WORD.findall(lower_ascii(text)) if text else []
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    own = np.array([digest(w.encode("utf-8", "replace"), 42) for w in words], np.uint64)
    k = min(SHINGLE, len(own))
    out = np.full(len(own) - k + 1, k, np.uint64)
    for j in range(k):
        out = out * _STEP + own[j : len(own) - k + 1 + j]
    for _ in range(2):
        out = (out ^ (out >> np.uint64(32))) * _MIX
    return np.unique(out ^ (out >> np.uint64(32)))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))


def _prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, node, n, fp) of each row, n the number of shingles, fp their SimHash; texts of equal sets share both, and a node."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = [shingles(t) for t in batch.column("text").to_pylist()]
            nodes = pa.array([_node(s) for s in own], pa.int64())
            sizes, prints = pa.array([len(s) for s in own], pa.int32()), pa.array([_simhash(s) for s in own], pa.int64())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), nodes, sizes, prints], ["doc_id", "text_key", "node", "n", "fp"])

        return step

    return map_texts(_texts(docs, id_col, text_col), make, "doc_id long, text_key long, node long, n int, fp long")


def _node(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63)


def _simhash(own: np.ndarray) -> int:
    """A bit is set where over half of a set's shingles have it; no shingles: 0."""
    ones = sum((np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for part in np.array_split(own, len(own) // 4096 + 1)), np.zeros(64, np.int64))
    return int(_BIT[2 * ones > len(own)].sum())


def _classed(classes: DataFrame) -> DataFrame:
    """(src, dst): the first node of each class that the SimHash index links, and every other of it."""
    groups = connected_components(simhash.links(classes.select("fp").distinct())).withColumnRenamed("node", "fp")
    placed = classes.select("node", "fp").join(groups, "fp", "left").select("node", F.coalesce("component", "fp").alias("class"))
    first = cut_lineage(placed.groupBy("class").agg(F.min("node").alias("src"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    joined = join_per_key(placed, first, hot_keys(first, "class"), "class")
    return cut_lineage(joined.where("node <> src").select("src", F.col("node").alias("dst")))


class Rarity:
    """The order of shingles: what occurs once, then what the map calls repeated, then the frequent ones by their level (twice the logarithm of their number).

    bits: how many leading bits of a hash name its stretch; a frequent shingle's code is these and 32 more.
    """

    def __init__(self, bits: int, repeated: np.ndarray, codes: np.ndarray, levels: np.ndarray):
        self.bits, self.repeated, self.codes, self.levels = bits, repeated, codes, levels

    def level(self, own: np.ndarray) -> np.ndarray:
        place = (own >> np.uint64(64 - MAP_BITS)).astype(np.int64)
        out = (self.repeated[place >> 3] >> (place & 7) & 1).astype(np.int32)
        if len(self.codes):
            code = (own >> np.uint64(32 - self.bits)).astype(np.int64)
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            out = np.where(self.codes[at] == code, self.levels[at], out)
        return out

    def prefix(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shingles of a set's prefix that may occur elsewhere, and their places in the order."""
        level = self.level(own)
        order = np.lexsort((own, level))[: len(own) // 5 + 1]  # n - ceil(0.8 n) + 1
        place = np.nonzero(level[order])[0]
        return own[order[place]], place


def rarity(texts: DataFrame, total: int) -> Rarity:
    """Count all shingles of ``texts`` (text), ``total`` of them, and keep what a task needs to know.

    Tasks send sorted runs of 32-bit remainders, one for each stretch of the hash range, and counts beside
    them; a stretch's runs meet in one place, about STRETCH shingles.  A shingle that a third of all texts
    share comes once from each run.
    """
    bits = int(min(20, max(4, np.ceil(np.log2(max(total, 1) / STRETCH)))))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def run() -> pa.RecordBatch:
            codes, counts = np.unique(np.concatenate(held) >> np.uint64(32 - bits), return_counts=True)
            cuts = np.searchsorted(codes, np.arange(1 << bits, dtype=np.uint64) << np.uint64(32)).tolist() + [len(codes)]
            low, counts = codes.astype(np.uint32), counts.astype(np.uint32)
            rows = [(r, low[a:b].tobytes(), counts[a:b].tobytes()) for r, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["stretch", "low", "counts"])

        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                own = shingles(text)
                held.append(own)
                n += len(own)
                if n >= HELD:
                    yield run()
                    held, n = [], 0
        if n:
            yield run()

    def meet(runs: pa.Table) -> pa.Table:
        low, counts = (np.frombuffer(b"".join(runs.column(c).to_pylist()), np.uint32) for c in ("low", "counts"))
        own, at = np.unique(low, return_inverse=True)
        n = np.bincount(at, weights=counts)
        own, n = own[n > 1].astype(np.int64), n[n > 1]
        stretch = runs.column("stretch")[0].as_py()
        seen = np.zeros(1 << (MAP_BITS - bits), bool)
        seen[own >> (32 - MAP_BITS + bits)] = True
        levels = (2 * np.log2(n)).astype(np.uint8)
        columns = [pa.array([stretch], pa.int32()), pa.array([np.packbits(seen, bitorder="little").tobytes()], pa.binary()), pa.array([own.astype(np.uint32).tobytes()], pa.binary()), pa.array([levels.tobytes()], pa.binary()), pa.array([np.bincount(levels, minlength=128).tolist()], pa.list_(pa.int64()))]
        return pa.table(columns, ["stretch", "seen", "low", "levels", "tally"])

    sent = texts.select("text").mapInArrow(send, "stretch int, low binary, counts binary")
    told = cut_lineage(sent.groupBy("stretch").applyInArrow(meet, "stretch int, seen binary, low binary, levels binary, tally array<long>"))
    tally = dict(told.select(F.posexplode("tally")).groupBy("pos").agg(F.sum("col")).collect())  # 128 levels
    least, n = 128, 0
    while least > 2 and n + tally.get(least - 1, 0) <= FREQUENT:
        least -= 1
        n += tally.get(least, 0)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stretch, low, levels in zip(*(batch.column(c).to_pylist() for c in ("stretch", "low", "levels")), strict=True):
                level = np.frombuffer(levels, np.uint8)
                code = np.frombuffer(low, np.uint32)[level >= least].astype(np.int64) + (stretch << 32)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(level[level >= least].astype(np.int32))], ["code", "level"])

    most = told.select("stretch", "low", "levels").mapInArrow(frequent, "code long, level int").toArrow()  # FREQUENT rows at most
    codes, levels = most.column("code").to_numpy(), most.column("level").to_numpy()
    order = codes.argsort()
    repeated = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    size = 1 << max(0, MAP_BITS - 3 - bits)
    for stretch, seen in told.select("stretch", "seen").toLocalIterator():  # 2^(MAP_BITS - 3) bytes in all
        repeated[stretch * size : (stretch + 1) * size] = np.frombuffer(seen, np.uint8)
    return Rarity(bits, repeated, codes[order], levels[order])


def _posts(texts: DataFrame, known: Rarity) -> DataFrame:
    """(key, node, n, pos): each set's prefix."""
    shared = texts.sparkSession.sparkContext.broadcast((known.bits, known.repeated, known.codes, known.levels))

    def make():
        order = Rarity(*shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, nodes, sizes, places = [np.empty(0, np.uint64)], [], [], [np.empty(0, np.int64)]
            for text in batch.column("text").to_pylist():
                own = shingles(text)
                key, place = order.prefix(own)
                keys.append(key)
                places.append(place)
                nodes += [_node(own)] * len(key)
                sizes += [len(own)] * len(key)
            columns = [pa.array(np.concatenate(keys).view(np.int64)), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(np.concatenate(places).astype(np.int32))]
            return pa.RecordBatch.from_arrays(columns, ["key", "node", "n", "pos"])

        return step

    return map_texts(texts.select("text"), make, "key long, node long, n int, pos int").distinct()


def _fits(a: str, b: str) -> F.Column:
    """May two sets, the first common shingle of which is this one, be alike at 0.8: 9 x common >= 4 x (sum of sizes)."""
    left = F.least(F.col(f"{a}n") - F.col(f"{a}pos"), F.col(f"{b}n") - F.col(f"{b}pos"))
    return 9 * left >= 4 * (F.col(f"{a}n") + F.col(f"{b}n"))


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (src, dst) of nodes whose sets have a Jaccard similarity of 0.8 or more; only texts of candidates are fetched.

    The pairs of one src are dealt in parts of about TOGETHER, and its text goes once to each part.
    """
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    keys = cut_lineage(nodes.join(classes, "node").select("node", *row_keys("k")))
    near = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    rows = with_keys(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")
    texts = cut_lineage(rows.join(near, ["id", "no_id", "text_key"]).select("node", F.col("c1").alias("text")).dropDuplicates(["node"]))
    counts = cut_lineage(pairs.groupBy("src").agg(F.count(F.lit(1)).alias("n")))
    parts = cut_lineage(join_per_key(pairs, counts, hot_keys(counts, "src"), "src").select("src", "dst", F.pmod(F.xxhash64("dst"), F.ceil(F.col("n") / TOGETHER)).alias("part")))
    left = parts.join(texts.withColumnRenamed("node", "dst"), "dst").select("src", "part", "dst", "text")
    right = parts.select("src", "part").distinct().join(texts.withColumnRenamed("node", "src"), "src").select(F.col("src").alias("one"), F.col("part").alias("of"), F.col("text").alias("whole"))

    def alike(those: pa.Table, one: pa.Table) -> pa.Table:
        keep = []
        if one.num_rows:
            own = shingles(one.column("whole")[0].as_py())
            for text in those.column("text").to_pylist():
                other = shingles(text)
                common = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(9 * common >= 4 * (len(own) + len(other)))  # 5 x common >= 4 x union
        return those.select(["src", "dst"]).filter(pa.array(keep, pa.bool_())) if keep else those.select(["src", "dst"]).slice(0, 0)

    both = left.groupBy("src", "part").cogroup(right.groupBy("one", "of"))
    return cut_lineage(both.applyInArrow(alike, "src long, dst long"))


def _links(posts: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Edges (src, dst) between nodes at 0.8 or more, whose components are those of all such pairs."""
    first = F.min(F.struct("pos", "node", "n")).alias("first")
    lists = cut_lineage(posts.groupBy("key").agg(first, F.min("n").alias("least"), F.count(F.lit(1)).alias("size")).where("size > 1"))
    hot = hot_keys(lists.select("key", F.col("size").alias("n")), "key")
    filed = join_per_key(posts, lists, hot, "key")
    # who can't reach 0.8 with the smallest set that the list and its own size allow meets nobody here
    filed = cut_lineage(filed.where(9 * (F.col("n") - F.col("pos")) >= 4 * (F.col("n") + F.greatest(F.ceil(F.col("n") * 4 / 5), "least"))))
    stars = filed.where(F.col("node") != F.col("first.node")).withColumns({"first_n": F.col("first.n"), "first_pos": F.col("first.pos")})
    stars = stars.where(_fits("", "first_")).select(F.col("first.node").alias("src"), F.col("node").alias("dst"))
    stars = cut_lineage(stars.union(_classed(classes)).distinct())
    linked = _verified(stars, classes, docs, id_col, text_col)
    groups = connected_components(linked).withColumnRenamed("node", "member")
    placed = cut_lineage(filed.join(groups, F.col("node") == F.col("member"), "left").select("key", "node", "n", "pos", F.coalesce("component", "node").alias("group")))
    shares = placed.groupBy("key", "group").agg(F.count(F.lit(1)).alias("size"))
    mixed = cut_lineage(shares.groupBy("key").agg(F.max_by("group", F.struct("size", "group")).alias("largest"), F.count(F.lit(1)).alias("groups"), F.sum("size").alias("n")).where("groups > 1"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")
    several = join_per_key(placed.withColumnRenamed("n", "size"), mixed, hot_keys(mixed, "key"), "key").select("key", "node", F.col("size").alias("n"), "pos", "group", "largest", blocks)
    several = cut_lineage(several)
    minor = several.where(F.col("group") != F.col("largest")).select(*(F.col(c).alias(f"x_{c}") for c in ("key", "node", "n", "pos", "group")), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x_block"))
    others = several.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    once = (F.col("group") == F.col("largest")) | (F.col("x_node") < F.col("node"))
    pairs = minor.join(others, (F.col("x_key") == F.col("key")) & (F.col("x_block") == F.col("block")) & (F.col("x_group") != F.col("group")) & once & _fits("", "x_"))
    pairs = cut_lineage(pairs.select(F.col("x_node").alias("src"), F.col("node").alias("dst")).distinct())
    known = stars.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    pairs = pairs.join(known, (F.least("src", "dst") == F.col("a")) & (F.greatest("src", "dst") == F.col("b")), "left_anti")
    return linked.union(_verified(cut_lineage(pairs), classes, docs, id_col, text_col))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of texts linked at 0.8 or more, directly or through others: the one with the least id (null ids last, then by the text's hash).

    Texts without words are one class; rows equal in id and text are one row afterwards.  The table's
    columns come back as they were, whatever they are called.
    """
    prints = cut_lineage(_prints(docs, id_col, text_col))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    classes = cut_lineage(prints.groupBy("node").agg(F.min(order).alias("k"), F.min("fp").alias("fp")))
    texts = _texts(docs, id_col, text_col)
    posts = cut_lineage(_posts(texts, rarity(texts, prints.agg(F.sum("n")).first()[0] or 0)))
    groups = connected_components(_links(posts, classes, docs, id_col, text_col)).withColumnRenamed("node", "member")
    kept = classes.join(groups, F.col("node") == F.col("member"), "left").groupBy(F.coalesce("component", "node").alias("class")).agg(F.min("k").alias("k"))
    return rows_of(docs, kept.select(*row_keys("k")).distinct(), id_col, text_col)
