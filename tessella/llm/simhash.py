"""SimHash near-duplicate classes: a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most two bits agree in at least 6 of their 8 bytes.  A list
per single byte would hold 1/256 of all fingerprints and its pairs would grow with the square of the
corpus, so a posting is the intersection of four positional lists: a quadruple of byte positions and its
four bytes.  The 14 quadruples are such that any three positions lie in exactly one of them.  Hence a
pair that shares 8, 7 or 6 positional bytes shares 14, 7 or 3 postings, and one that shares 5 or fewer
shares one at most: the postings of each pair are tallied over all lists, pairs under three are dropped
(they cannot qualify), and the rest are verified bit by bit.

Lists over ``list_cap`` members are not paired up, as near copies by the thousand would give pairs by the
million.  There every member is filed under itself and under its one-bit neighbours outside the key: two
members at most two bits apart meet at a fingerprint between them, and everything that meets at one
fingerprint is at most two bits apart, so linking each meeting to its smallest member is exact and linear
in the list.  A pair at two bits has a long list among its three or more, and is linked there, or has only
short ones, and its tally is complete.  So the edges' components are those of all qualifying pairs
whatever the cap is; the edges are a part of those pairs that spans them.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import cut_lineage, hot_keys, join_per_key, lower_ascii, map_texts, row_keys, rows_of
from tessella.operators.graph import connected_components

BITS, MAX_BITS, MIN_POSTINGS, LIST_CAP = 64, 2, 3, 48
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Quadruples of byte positions whose numbers cancel out bit by bit: any three positions lie in just one.
_QUADS = [q for q in combinations(range(8), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0]
_BIT = np.array([1 << b for b in range(63)] + [-(1 << 63)], dtype=np.int64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash: a bit is set if over half of the shingles' XXH64 (seed 42) have it; no words: 0."""
    words = _WORD.findall(lower_ascii(text)) if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(" ".join(words).encode("utf-8", "replace"), 42)]
    else:
        joined = zip(*(words[i:] for i in range(shingle)), strict=False)
        hashes = [digest(s, 42) for s in map(" ".join, joined)]
    ones = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_BIT[2 * ones > len(hashes)].sum())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fp) of each row, all long; null and empty texts have fingerprint 0."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            prints = pa.array([fingerprint(t) for t in batch.column("text").to_pylist()], pa.int64())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), prints], ["doc_id", "text_key", "fp"])

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return map_texts(rows, make, "doc_id long, text_key long, fp long")


def _keys(fp: F.Column) -> F.Column:
    """The postings of a fingerprint: for each quadruple of positions its number, then its four bytes."""
    byte = [F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(0xFF)) for i in range(8)]

    def key(n: int, quad: tuple[int, ...]) -> F.Column:
        out = F.lit(n).cast("long")
        for i in quad:
            out = F.shiftleft(out, 8).bitwiseOR(byte[i])
        return out

    return F.array(*(key(n, q) for n, q in enumerate(_QUADS)))


def _free_masks() -> F.Column:
    """For each quadruple: 0 and the single bits of the other four bytes."""
    rows = []
    for quad in _QUADS:
        rows.append(F.array(*(F.lit(int(x)).cast("long") for x in [0, *(_BIT[b] for b in range(64) if b // 8 not in quad)])))
    return F.array(*rows)


def links(prints: DataFrame, list_cap: int = LIST_CAP) -> DataFrame:
    """Edges (src, dst), src < dst, between distinct fingerprints at two bits or fewer whose components equal those of all such pairs.

    ``prints``: distinct non-null ``fp``.
    """
    posts = prints.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    sizes = posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    posts = cut_lineage(join_per_key(posts, sizes, hot_keys(sizes, "key"), "key"))
    short = posts.where(F.col("n") <= list_cap)
    a, b = short.select("key", F.col("fp").alias("src")), short.select("key", F.col("fp").alias("dst"))
    tallied = a.join(b, "key").where("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("shared"))
    pairs = tallied.where(F.col("shared") >= MIN_POSTINGS).where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= MAX_BITS).select("src", "dst")
    long = posts.where(F.col("n") > list_cap).withColumn("mask", F.explode(F.element_at(_free_masks(), (F.shiftright("key", 32) + 1).cast("int"))))
    met = long.groupBy("key", F.col("fp").bitwiseXOR(F.col("mask")).alias("middle")).agg(F.collect_list("fp").alias("all"))  # 33 at most
    met = met.where(F.size("all") > 1).select(F.array_min("all").alias("src"), F.explode("all").alias("dst")).where("src <> dst")
    met = met.where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= MAX_BITS)
    return pairs.union(met).distinct()


def _with_classes(prints: DataFrame, list_cap: int) -> DataFrame:
    """``prints`` with class_fp and component_id; rows of a frequent fingerprint get theirs where they lie."""
    first = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    classes = cut_lineage(_classes(first.select("fp", "first_id"), list_cap))
    return join_per_key(prints, classes, hot_keys(first, "fp"), "fp")


def _classes(first: DataFrame, list_cap: int) -> DataFrame:
    """(fp, class_fp, component_id) of each distinct fingerprint (fp, first_id)."""
    groups = cut_lineage(connected_components(links(first.select("fp"), list_cap)).withColumnRenamed("node", "fp"))
    least = first.join(groups, "fp").groupBy("component").agg(F.min("first_id").alias("least_id"))
    linked = groups.join(least, "component")
    return first.join(linked, "fp", "left").select("fp", F.coalesce("component", "fp").alias("class_fp"), F.when(F.col("component").isNull(), F.col("first_id")).otherwise(F.col("least_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", list_cap: int = LIST_CAP) -> DataFrame:
    """(doc_id, fp long, component_id long): one row for each row of ``docs``.

    component_id is the smallest id reachable over links of at most two bits, the row's own included.
    Rows without words share fingerprint 0 and link like any others; repeated rows fall together; null
    ids take no part in the minimum (a component of nothing else has a null id).  No other column of
    ``docs`` is read.  Texts with equal fingerprints are merged before anything is paired, so a third
    of all rows being copies costs one row.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col))
    return _with_classes(prints, list_cap).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", list_cap: int = LIST_CAP) -> DataFrame:
    """One row of each near-duplicate class: the one with the least id (null ids last, then by the text's hash).

    Rows equal in id and text are one row afterwards.  The table's columns come back as they were.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    kept = _with_classes(prints, list_cap).groupBy("class_fp").agg(F.min(order).alias("k"))
    return rows_of(docs, kept.select(*row_keys("k")).distinct(), id_col, text_col)
