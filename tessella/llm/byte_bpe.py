"""Byte-level BPE encoding and decoding by overlapping chunks.

A text longer than one chunk is cut into chunks that overlap; each is pre-tokenised by itself, as a row
of its own.  A match of the pattern depends only on what follows its start, so from the first place
where a token begins in both of two neighbours their tokens are the same: there the chunks are stitched,
but never behind white space, since a run of it looks at the character after it.  The pieces between
the stitches are then encoded, each in its row, and put in order.  Where an overlap has no such place
(a single token longer than it), the rest of that text is encoded as one piece.
Decoding puts the tokens' raw bytes one after the other.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm._bpe import Merges, WordEncoder, gather
from tessella.llm._common import map_texts

CHUNK, OVERLAP = 32_768, 1_024
#: Words that a worker keeps encoded.
WORDS_KEPT = 200_000
#: Characters that a match may look at beyond its end.
LOOKAHEAD = 3

#: The same tokens as public_tokenizers.PATTERN for texts without an _ODD character, in re's faster classes.
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_ODD = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbeɐ-\U0010ffff]")


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a rank file: base64, blank, number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Pretokens:
    """Splits a text by a pattern; the pattern this module knows by heart takes the fast way where that is the same."""

    def __init__(self, pattern: str, known: str | None = None):
        # \s of the rank files' own engine is Unicode's White_Space
        self.exact = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.fast = _PLAIN if pattern == known else None

    def words(self, text: str) -> list[str]:
        return (self.fast if self.fast is not None and _ODD.search(text) is None else self.exact).findall(text)

    def starts(self, text: str) -> np.ndarray:
        """Where tokens begin, and the end of the last."""
        return np.cumsum([0, *map(len, self.words(text))])


class ByteBpe:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str, pattern: str):
        import public_tokenizers

        ranks = load_ranks(path)
        splits = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    splits[a, b] = (rank, rank)
        self.pretokens = Pretokens(pattern, public_tokenizers.PATTERN)
        self.encoder = WordEncoder(Merges(splits), np.array([ranks[bytes([i])] for i in range(256)]), whole=ranks, most=WORDS_KEPT)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        words, counts = [], []
        for t in texts:
            own = self.pretokens.words(t)
            counts.append(len(own))
            words += own
        ids, per_word = self.encoder.encode(words)
        cuts = np.concatenate([[0], np.cumsum(per_word)])[np.cumsum([0, *counts])]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class TokenBytes:
    """The bytes of every token, for decoding; without the encoder's tables."""

    def __init__(self, path: str):
        ranks = load_ranks(path)
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.at = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.bytes, self.at[ids], self.lengths[ids]).tobytes()


_HELD: dict[tuple[str, str], ByteBpe] = {}


def tokenizer(path: str, pattern: str) -> ByteBpe:
    """One instance for each Python worker, kept between its tasks."""
    if (path, pattern) not in _HELD:
        _HELD[path, pattern] = ByteBpe(path, pattern)
    return _HELD[path, pattern]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32), pa.int32()))


def _encode_pieces(rows: DataFrame, keys: str, path: str, pattern: str) -> DataFrame:
    names = [k.split()[0] for k in keys.split(",")]

    def make():
        bpe = tokenizer(path, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = bpe.encode([t or "" for t in batch.column("text").to_pylist()])
            return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), _lists(ids)], [*names, "ids"])

        return step

    return map_texts(rows.select(*names, "text"), make, f"{keys}, ids array<int>")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id long, ids array<int>): one row for each row of ``docs``, in no order.

    A null text encodes like an empty one, to no ids; null and repeated doc_ids stay rows of their own;
    an empty table gives an empty one; other columns are not read.  Only texts over ``chunk`` characters
    are shuffled, chunk by chunk.
    """
    if not 0 < overlap <= chunk:
        raise ValueError("overlap has to be over 0 and at most chunk")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = F.coalesce(F.length("text"), F.lit(0))
    short = _encode_pieces(rows.where(size <= chunk), "doc_id long", path, pattern)

    long = rows.where(size > chunk).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", size.alias("n"))

    def cut(batches):
        for batch in batches:
            for row, doc_id, text, n in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text", "n")), strict=True):
                places = range(0, n, chunk)
                columns = [[row] * len(places), [doc_id] * len(places), [n] * len(places), list(range(len(places))), [text[p : p + chunk + overlap] for p in places]]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["row", "doc_id", "n", "k", "text"])

    parts = long.mapInArrow(cut, "row long, doc_id long, n int, k int, text string")

    def make():
        pretokens = tokenizer(path, pattern).pretokens

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            heads, tails = [], []
            for text, k, n in zip(*(batch.column(c).to_pylist() for c in ("text", "k", "n")), strict=True):
                at = pretokens.starts(text) + k * chunk
                stop = n + 1 if k * chunk + len(text) >= n else k * chunk + len(text) - LOOKAHEAD
                heads.append(at[at < k * chunk + overlap])
                near = at[(at >= (k + 1) * chunk) & (at <= stop)]
                tails.append(near[[not text[p - k * chunk - 1].isspace() for p in near.tolist()]] if len(near) else near)
            return pa.RecordBatch.from_arrays([*batch.columns, _lists(heads), _lists(tails)], [*batch.schema.names, "heads", "tails"])

        return step

    parts = map_texts(parts, make, "row long, doc_id long, n int, k int, text string, heads array<int>, tails array<int>")
    in_order = Window.partitionBy("row").orderBy("k")
    stitched = parts.withColumn("start", F.when(F.col("k") == 0, 0).otherwise(F.array_min(F.array_intersect("heads", F.lag("tails").over(in_order)))))
    # after the first overlap without a stitch, the rest of the text is one piece
    stitched = stitched.withColumn("sound", F.min(F.col("start").isNotNull()).over(in_order))
    stitched = stitched.withColumn("piece", F.sum(F.col("sound").cast("int")).over(in_order)).withColumn("core", F.expr(f"substring(text, 1, {chunk})"))
    pieces = stitched.groupBy("row", "piece").agg(
        F.first("doc_id").alias("doc_id"), F.min("k").alias("k"), F.max("k").alias("last"), F.max("n").alias("n"), F.min_by("start", "k").alias("start"),
        F.array_sort(F.collect_list(F.struct("k", "core"))).alias("cores"), F.max_by("text", "k").alias("tail"),
    )
    stop = F.coalesce(F.lead("start").over(Window.partitionBy("row").orderBy("piece")), F.col("n"))
    whole = F.concat(F.array_join(F.transform("cores", lambda c: c["core"]), ""), F.expr(f"substring(tail, {chunk + 1})"))
    pieces = pieces.select("row", "piece", "doc_id", F.substring(whole, F.col("start") - F.col("k") * chunk + 1, stop - F.col("start")).alias("text"))
    done = _encode_pieces(pieces, "row long, piece long, doc_id long", path, pattern)
    done = done.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("all"))
    return short.union(done.select("doc_id", F.flatten(F.transform("all", lambda p: p["ids"])).alias("ids")))


def decode(rows: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the raw bytes of its id lists (null: none) in ``out_col``. An id outside the vocabulary is an error."""
    schema = f"{', '.join(f'`{n}` {t}' for n, t in rows.dtypes)}, `{out_col}` binary"

    def make():
        tokens = TokenBytes(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column(ids_col)
            texts = [tokens.decode(np.asarray(x.values, dtype=np.int64)) if x.is_valid else b"" for x in ids]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, out_col])

        return step

    return map_texts(rows, make, schema, ids_col)
