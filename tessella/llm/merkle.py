"""Merkle manifest of a table: one root over all groups, a proof for each row, and what a changed row leads to.

A group's leaves, in order, are cut into blocks of ``fan ** levels`` leaves, a fixed size.  A block is one
array, and higher-order functions collapse it level by level (sequence, transform and slice make the next
level, aggregate goes through the levels).  Block roots are the leaves of the next recursion, until each
group is one block; then the groups' roots are collapsed in the same way.  On the way back every block
gets what stands above it, and makes its rows' proofs from that and its own levels.

No array is longer than a block.  A row's place is found from its position in a range partition and the
counts of the ranges before, so a group with a third of all rows is never sorted or numbered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm._common import cut_lineage

FAN, LEVELS = 3, 6
_ABOVE = "array<struct<run:array<string>,place:int>>"


def digest(*values: Column) -> Column:
    """Lowercase hex sha256 of the values one after another (nulls are left out)."""
    return F.sha2(F.concat_ws("", *values).cast("binary"), 256)


def leaf(*values: Column) -> Column:
    """The digest of a row: each value's UTF-8 byte count, a colon and the value; a dash for null."""
    return digest(*(F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string"))) for v in values))


def _bind(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))




def _numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with at (long, from 0 in each group, in the order) and n, the group's size.

    Rows are sorted in range partitions and written; a row's number is its place behind its range's first
    row of the group plus the group's rows in the ranges before.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group), *(F.col(c) for c in order)]
    placed = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = cut_lineage(placed.withColumns({"__part": F.spark_partition_id(), "__seat": F.monotonically_increasing_id()}))
    runs = placed.groupBy(F.col("__part").alias("__p"), F.col(group).alias("__g")).agg(F.min("__seat").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a group
    total = Window.partitionBy("__g")
    runs = cut_lineage(runs.withColumns({"__before": F.coalesce(F.sum("__n").over(before), F.lit(0)), "n": F.sum("__n").over(total)}).drop("__n"))
    joined = placed.join(runs, (F.col("__part") == F.col("__p")) & (F.col(group) == F.col("__g")))
    return joined.withColumn("at", F.col("__seat") - F.col("__first") + F.col("__before")).drop("__part", "__seat", "__p", "__g", "__first", "__before")


def _next_level(nodes: Column, fan: int) -> Column:
    runs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / fan).cast("int") - 1)
    return F.transform(runs, lambda i: digest(F.slice(nodes, i * fan + 1, fan)))


def _levels(nodes: Column, whole: Column, fan: int, levels: int) -> Column:
    """All levels of a block, its nodes first and its root last: as many as needed, or ``levels`` where the block isn't the whole group."""
    step = lambda done, _: F.when(whole & (F.size(F.element_at(done, -1)) == 1), done).otherwise(F.concat(done, F.array(_next_level(F.element_at(done, -1), fan))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.array(nodes), step)


def _path(levels: Column, place: Column, fan: int) -> Column:
    """The runs that a block's node at ``place`` (from 0) is in, level by level, and its place in each."""

    def one(i: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(fan), i)).cast("int")
        return F.struct(F.slice(F.element_at(levels, i + 1), at - at % fan + 1, fan).alias("run"), (at % fan).cast("int").alias("place"))

    return F.transform(F.when(F.size(levels) > 1, F.sequence(F.lit(0), F.size(levels) - 2)).otherwise(F.array().cast("array<int>")), one)


def _siblings(path: Column) -> Column:
    """All other members of the runs, level by level, one text."""
    return F.concat_ws("", F.flatten(F.transform(path, lambda r: F.filter(r["run"], lambda _, j: j != r["place"]))))


def _fold(node: Column, path: Column) -> Column:
    """The root that a node and its siblings lead to."""
    return F.aggregate(path, node, lambda h, r: digest(F.transform(r["run"], lambda x, j: F.when(j == r["place"], h).otherwise(x))))


def _blocks(nodes: DataFrame, payload: list[str], fan: int, levels: int) -> DataFrame:
    """(grp, block, n, rows, levels): one row for each block of ``nodes`` (grp, at, n, hash, payload)."""
    size = fan**levels
    rows = F.array_sort(F.collect_list(F.struct("at", "hash", *payload)))  # a block's, no more
    blocks = nodes.groupBy("grp", F.floor(F.col("at") / size).alias("block")).agg(F.first("n").alias("n"), rows.alias("rows"))
    return cut_lineage(blocks.withColumn("levels", _levels(F.transform("rows", lambda r: r["hash"]), F.col("n") <= size, fan, levels)))


def _above(blocks: DataFrame, tops: DataFrame | None, fan: int, levels: int) -> DataFrame:
    """(grp, block, above, subroot, root) of each block: the runs over it, from its root upwards.

    tops: what stands above each group's root (grp, above, root); None where the groups' roots are roots.
    """
    size = fan**levels
    top = F.get(F.element_at("levels", -1), F.lit(0))
    roots = blocks.select("grp", "block", F.col("n"), top.alias("hash"))
    ready = roots.where(F.col("n") <= size).select("grp", "block", F.col("hash").alias("subroot"))
    if tops is None:
        done = ready.select("grp", "block", F.array().cast(_ABOVE).alias("above"), "subroot", F.col("subroot").alias("root"))
    else:
        own = tops.select(F.col("grp").alias("__g"), "above", "root")
        done = ready.join(own, F.col("grp") == F.col("__g")).select("grp", "block", "above", "subroot", "root")
    rest = roots.where(F.col("n") > size)
    if rest.isEmpty():
        return done
    nodes = rest.select("grp", F.col("block").alias("at"), F.ceil(F.col("n") / size).cast("long").alias("n"), "hash")
    upper = _blocks(nodes, [], fan, levels)
    over = _above(upper, tops, fan, levels)
    return done.unionByName(_spread(upper, over, fan, lambda r, path, b: F.struct(r["at"].alias("block"), path.alias("above"), b["subroot"].alias("subroot"), b["root"].alias("root"))))


def _spread(blocks: DataFrame, above: DataFrame, fan: int, row) -> DataFrame:
    """(grp, row(...)'s fields) of each node: its whole path is its block's own and what is above the block."""
    over = above.select(F.col("grp").alias("__g"), F.col("block").alias("__b"), F.struct("above", "subroot", "root").alias("over"))
    both = blocks.join(over, (F.col("grp") == F.col("__g")) & (F.col("block") == F.col("__b")))

    def each(levels: Column) -> Column:
        return F.transform("rows", lambda r, i: _bind(F.concat(_path(levels, i, fan), F.col("over.above")), lambda path: row(r, path, F.col("over"))))

    return both.select("grp", F.explode(_bind(F.col("levels"), each)).alias("__row")).select("grp", "__row.*")


def manifest(rows: DataFrame, group: Column, order: Column, hashes: Column, tampered: Column, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(key, group_key, leaf, subroot, root, proof_sha256, folded_root, verified) of each row.

    rows: any table; ``group`` and ``order`` say which tree a row is in and where (nulls first, equal
    places by leaf, so repeated rows stand side by side), ``hashes`` is its leaf, ``tampered`` the leaf it
    is verified with (null: its own).  A group's nodes become the digest of each ``fan`` consecutive ones,
    the last run being what is left, until one is left; so do the groups' roots in the groups' order.  An
    empty table gives an empty manifest.
    """
    text = group.cast("string")
    leaves = rows.select(F.when(text.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), text)).alias("grp"), order.alias("key"), hashes.alias("hash"), tampered.alias("tampered"))
    nodes = _numbered(cut_lineage(leaves), "grp", ["key", "hash", "tampered"])
    blocks = _blocks(nodes, ["key", "tampered"], fan, levels)
    # the groups' own tree: its leaves are the groups' roots, which the recursion below works out anew from the written blocks
    subroots = _above(blocks, None, fan, levels).groupBy("grp").agg(F.first("subroot").alias("hash"))
    groups = _numbered(cut_lineage(subroots.select(F.lit("").alias("all"), "grp", "hash")), "all", ["grp"])
    tree = _blocks(groups.select(F.col("all").alias("grp"), F.col("grp").alias("member"), "at", "n", "hash"), ["member"], fan, levels)
    tops = _spread(tree, _above(tree, None, fan, levels), fan, lambda r, path, b: F.struct(r["member"].alias("member"), path.alias("above"), b["root"].alias("root")))
    above = cut_lineage(_above(blocks, cut_lineage(tops.select(F.col("member").alias("grp"), "above", "root")), fan, levels))

    def row(r: Column, path: Column, over: Column) -> Column:
        folded = _fold(F.coalesce(r["tampered"], r["hash"]), path)
        return F.struct(r["key"].alias("key"), r["hash"].alias("leaf"), over["subroot"].alias("subroot"), over["root"].alias("root"), F.sha2(_siblings(path).cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"))

    out = _spread(blocks, above, fan, row)
    return out.select("key", F.when(F.col("grp") != "0", F.substring("grp", 2, 1 << 30)).alias("group_key"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents``: leaves of (doc_id, source, lang, n_chars, text), a tree for each source, in order of doc_id.

    Rows whose doc_id has an even crc32 in decimal are verified with their line feeds taken out of the
    text.  Null ids come first and are not tampered with; a null source is a group of its own, before all
    others.  Columns beyond these five are not read.
    """
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.when(even & F.contains(F.col("text"), F.lit("\n")), leaf(*own, F.translate("text", "\n", "")))
    return manifest(docs, F.col("source"), F.col("doc_id"), leaf(*own, F.col("text")), changed)


def oracle_sql() -> str:
    """DuckDB SQL: lists of whole levels, and each row's way up through them."""
    field = lambda c: f"case when {c} is null then '-' else octet_length(encode(cast({c} as varchar))) || ':' || cast({c} as varchar) end"
    whole = lambda text: "sha256(" + " || ".join([*(field(c) for c in ("doc_id", "source", "lang", "n_chars")), field(text)]) + ")"
    crc = "list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c))), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))"
    up = "list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], '')))"
    return f"""with recursive d as (select row_number() over (partition by source order by doc_id) - 1 as place, *, coalesce('1' || source, '0') as grp, {whole('text')} as leaf, case when xor({crc}, 4294967295) % 2 = 0 then {whole("replace(text, chr(10), '')")} else {whole('text')} end as tampered from documents),
t as (select grp, 0 as lvl, list(leaf order by place) as nodes from d group by 1 union all select grp, lvl + 1, {up} from t where len(nodes) > 1),
s as (select grp, nodes[1] as subroot, row_number() over (order by grp) - 1 as place from t where len(nodes) = 1),
u as (select 0 as lvl, list(subroot order by place) as nodes from s union all select lvl + 1, {up} from u where len(nodes) > 1),
top as (select nodes[1] as root from u where len(nodes) = 1),
height as (select grp, max(lvl) as h from t group by 1),
p as (select d.doc_id, t.lvl as lvl, t.nodes[(d.place // cast(pow(3, t.lvl) as bigint)) // 3 * 3 + 1:(d.place // cast(pow(3, t.lvl) as bigint)) // 3 * 3 + 3] as run, (d.place // cast(pow(3, t.lvl) as bigint)) % 3 as own from d join t using (grp) join height using (grp) where t.lvl < h
  union all select d.doc_id, h + u.lvl, u.nodes[(s.place // cast(pow(3, u.lvl) as bigint)) // 3 * 3 + 1:(s.place // cast(pow(3, u.lvl) as bigint)) // 3 * 3 + 3], (s.place // cast(pow(3, u.lvl) as bigint)) % 3 from d join s using (grp) join height using (grp), u where u.lvl < (select max(lvl) from u)),
proof as (select doc_id, sha256(string_agg(array_to_string(list_filter(run, lambda x, i: i <> own + 1), ''), '' order by lvl)) as proof_sha256 from p group by 1),
f as (select doc_id, 0 as lvl, tampered as h from d union all select f.doc_id, f.lvl + 1, sha256(array_to_string(list_transform(run, lambda x, i: case when i = own + 1 then f.h else x end), '')) from f join p on f.doc_id = p.doc_id and f.lvl = p.lvl),
folded as (select doc_id, max_by(h, lvl) as folded_root from f group by 1)
select doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) as proof_sha256, folded_root, folded_root = root as verified from d join s using (grp) join folded using (doc_id) left join proof using (doc_id), top"""
