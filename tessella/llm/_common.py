"""Shared pieces of the training-data operators: table access, lineage cuts and Arrow row streams."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.skew import hot_keys, join_per_key  # noqa: F401  (re-exported for the operators)
from tessella.session import cut_lineage  # noqa: F401

#: Bytes of text (or of ids) that one slice of an Arrow batch may hold; bounds a worker's memory.
SLICE_CHARS = 1 << 20

#: The white space that separates words: space and the ASCII controls 9 to 13.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered_columns(docs: DataFrame) -> DataFrame:
    """The table with its columns called c0, c1, ...: whatever the caller's names are, none is one of ours."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def lower_ascii(text: str) -> str:
    """A-Z to lower case; every other character as it is."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def slices(batches: Iterator[pa.RecordBatch], text: str | None = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows of at most SLICE_CHARS bytes (one row at least)."""
    for batch in batches:
        if text is None or batch.num_rows <= 1:
            yield batch
            continue
        column = batch.column(text)
        sizes = pc.fill_null(pc.multiply(pc.list_value_length(column), 4) if pa.types.is_list(column.type) else pc.binary_length(column), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > SLICE_CHARS:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def map_texts(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | T.StructType, text: str | None = "text") -> DataFrame:
    """Run ``make()`` once in each task and its result on every bounded slice of the task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for piece in slices(batches, text):
            yield step(piece)

    return df.mapInArrow(run, schema)


def with_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs``, its columns c0, c1, ..., with what tells its rows apart: id (0 for null), no_id and text_key."""
    plain = numbered_columns(docs)
    id_value, text = F.col(f"c{docs.columns.index(id_col)}").cast("long"), f"c{docs.columns.index(text_col)}"
    return plain.withColumns({"id": F.coalesce(id_value, F.lit(0)), "no_id": id_value.isNull(), "text_key": F.xxhash64(text)})


def row_keys(k: str) -> list[F.Column]:
    """The same three columns of a struct (no_id, doc_id, text_key)."""
    return [F.coalesce(f"{k}.doc_id", F.lit(0)).alias("id"), F.col(f"{k}.no_id").alias("no_id"), F.col(f"{k}.text_key").alias("text_key")]


def rows_of(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``keys`` (id, no_id, text_key, once each) names, one for each key, with their columns as they were."""
    found = with_keys(docs, id_col, text_col).join(keys, ["id", "no_id", "text_key"]).dropDuplicates(["id", "no_id", "text_key"])
    return found.select(*(f"c{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)


def hash_bound(share: float) -> int:
    """The 64-bit hash that so large a share of all hashes does not pass."""
    return min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))


def pick_keys(rows: DataFrame, key: str, n: int) -> list:
    """At most ``n`` distinct keys of ``rows``, those of the least hash; the driver and each task see few more than ``n``.

    key: a column that is a hash already (long, spread evenly).  A bound on the key, from the number of
    rows, leaves about 1.5 ``n`` of them before anything is sorted.
    """
    total = rows.count()
    if total > 2 * n:
        rows = rows.where(F.col(key) <= hash_bound(1.5 * n / total))
    return [r[0] for r in rows.select(key).distinct().orderBy(key).limit(n).collect()]


def fetch(rows: DataFrame, key: str, keys: list, *columns: str) -> list:
    """(key, columns...) once for each of ``keys``, in the order of the keys; where rows of a key differ, the least."""
    chosen = rows.sparkSession.createDataFrame([(k,) for k in keys], f"{key} long")
    one = rows.join(F.broadcast(chosen), key).groupBy(key).agg(F.min(F.struct(*columns)).alias("one"))
    return one.select(key, "one.*").orderBy(key).collect()  # one row for each of the keys


def give_back() -> None:
    """Memory that Python has freed goes back to the system, where the C library can do so: the driver shares its limit with the JVM."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def held_out(doc_id) -> F.Column:
    """True where crc32 of the decimal doc_id leaves no rest modulo 5; null ids count as not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def finite(vector: str) -> F.Column:
    """True where an array of numbers is not null and holds neither nulls nor NaNs nor infinities."""
    whole = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(whole, F.lit(False))
