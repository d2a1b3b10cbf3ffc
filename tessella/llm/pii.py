"""Personal data: seed patterns, then bootstrapped contextual extraction.

Four fixed patterns give the seed entities, and so do tokens whose shape alone gives them away (32
letters and digits or more, at least eight of each).  Every other token that looks like an identifier is
a candidate; the words around seeds and candidates are lexical patterns.  Spark scores the graph of
patterns and instances round by round: a pattern is as good as the mean score of the instances it
meets, shrunk towards zero while it has met few; an instance that is no seed is as good as its patterns
make it (noisy or).  Candidates and seeds by shape that a pattern of high confidence and enough distinct
seeds meets become spans of kind ``context``.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import cut_lineage, hot_keys, join_per_key, lower_ascii, map_texts, numbered_columns

KINDS = ("email", "ip", "card", "phone")
ROUNDS, SHRINK, MIN_SEEDS, MIN_CONFIDENCE = 3, 2.0, 5, 0.6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match that fails from the start of a run of digits fails from inside it, too
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
#: A candidate: a whole token of identifier characters that holds four digits at least.
_CANDIDATE = re.compile(r"[A-Za-z0-9._%+@-]{6,}")
#: A seed by its shape: so long, with so many letters and so many digits.
SHAPE_CHARS, SHAPE_EACH = 32, 8
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping: found from their @, so a long run of letters is read once."""
    spans, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            spans.append((start, match.end()))
            done = match.end()
        else:
            done = max(done, start)
        at = text.find("@", max(at + 1, done))
    return spans


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of each kind in code points, ends exclusive; a match that fails its check is dropped whole."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = emails(text)
    if _DIGIT.search(text):
        found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return found


def joined(kind: str, spans: list[tuple[int, int]]) -> list[str]:
    return [f"{kind}:{a}:{b}" for a, b in spans]


def contexts(text: str, spans: list[tuple[int, int]]) -> list[list[str]]:
    """The lexical patterns around each span: its two words before (L), and its word before with what follows (B).

    Words are whole, however long.  What stands between a span and the start of its own word is glued to
    the words before it; behind another span in the same word, that span (``<id>``) stands for them.  So a
    word is part of a bounded number of patterns.
    """
    if not spans:
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    starts = [a for a, _ in words]
    firsts, lasts = sorted(a for a, _ in spans), sorted(b for _, b in spans)

    def piece(a: int, b: int) -> str:
        return lower_ascii(text[a:b])

    out = []
    for start, stop in spans:
        own = bisect_right(starts, start) - 1
        last = bisect_right(starts, stop - 1) - 1
        k = bisect_right(lasts, start)
        edge = lasts[k - 1] if k else 0  # the end of the nearest span before
        if edge > words[own][0]:
            before = ["<id>" + piece(edge, start)]
        else:
            glued = piece(words[own][0], start)
            before = [piece(*words[i]) for i in range(max(0, own - 2), own)]
            if glued and before:
                before[-1] += " " + glued
            elif glued:
                before = [glued]
        k = bisect_left(firsts, stop)
        follows = firsts[k] if k < len(firsts) else len(text)
        if stop < words[last][1]:
            after = piece(stop, min(words[last][1], follows))
        elif last + 1 < len(words):
            after = piece(words[last + 1][0], min(words[last + 1][1], max(follows, words[last + 1][0]))) or "<id>"
        else:
            after = ""
        own_patterns = []
        if len(before) == 2 or (before and before[0].startswith("<id>")):
            own_patterns.append("L " + " ".join(before))
        if before and after:
            own_patterns.append(f"B {before[-1]} _ {after}")
        out.append(own_patterns)
    return out


def is_shaped(token: str) -> bool:
    digits = sum("0" <= c <= "9" for c in token)
    return len(token) >= SHAPE_CHARS and digits >= SHAPE_EACH and sum(c.isalpha() for c in token) >= SHAPE_EACH and token.isalnum()


def mentions(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, bool, bool, int, int]]:
    """(text of the instance, is it a seed, is it a base span, start, end) of all seeds and candidates; candidates touch no base span."""
    taken = sorted(s for spans in base.values() for s in spans)
    out = [(text[a:b], True, True, a, b) for a, b in taken]
    if _DIGIT.search(text):
        starts = [a for a, _ in taken]
        furthest, high = [], 0
        for _, b in taken:
            high = max(high, b)
            furthest.append(high)
        for m in _CANDIDATE.finditer(text):
            a, b = m.span()
            if sum("0" <= c <= "9" for c in m[0]) >= 4:
                i = bisect_right(starts, b - 1)
                if i == 0 or furthest[i - 1] <= a:
                    out.append((m[0], is_shaped(m[0]), False, a, b))
    return out


_SCAN = "row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base array<string>, mentions array<struct<instance:string,seed:boolean,base:boolean,start:int,stop:int,patterns:array<string>>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Base spans and mentions of each row; null texts have none. ``row`` is a number of its own for each row, or as ``row_col`` says."""
    kind = pa.list_(pa.struct([("instance", pa.string()), ("seed", pa.bool_()), ("base", pa.bool_()), ("start", pa.int32()), ("stop", pa.int32()), ("patterns", pa.list_(pa.string()))]))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, lists, found = [[] for _ in KINDS], [], []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text or "")
                for c, k in zip(counts, KINDS, strict=True):
                    c.append(len(spans[k]))
                lists.append([s for k in KINDS for s in joined(k, spans[k])])
                met = mentions(text or "", spans)
                around = contexts(text or "", [m[3:] for m in met])
                found.append([{"instance": x, "seed": seed, "base": fixed, "start": a, "stop": b, "patterns": p} for (x, seed, fixed, a, b), p in zip(met, around, strict=True)])
            columns = [batch.column("row"), batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(lists, pa.list_(pa.string())), pa.array(found, kind)]
            return pa.RecordBatch.from_arrays(columns, ["row", "doc_id", *(f"n_{k}" for k in KINDS), "base", "mentions"])

        return step

    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    return map_texts(docs.select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), make, _SCAN)


def score_patterns(edges: DataFrame, rounds: int = ROUNDS, shrink: float = SHRINK) -> DataFrame:
    """(pattern, confidence, seeds) from distinct (pattern, instance, seed) edges, by ``rounds`` of scoring.

    Both sums of a round are partial aggregates and both joins leave hot keys where they lie, so a pattern
    or an instance with a third of all edges is never gathered.  Null patterns and instances are to be
    filtered out before.
    """
    scores = edges.withColumn("score", F.col("seed").cast("double"))
    open_edges = edges.where("not seed")
    hot_patterns, hot_instances = (hot_keys(open_edges.groupBy(k).agg(F.count(F.lit(1)).alias("n")), k) for k in ("pattern", "instance"))
    for k in range(rounds):
        patterns = scores.groupBy("pattern").agg(F.sum("score").alias("total"), F.count(F.lit(1)).alias("n"), F.sum(F.col("seed").cast("long")).alias("seeds"))
        patterns = patterns.select("pattern", (F.col("total") / (F.col("n") + shrink)).alias("confidence"), "seeds")
        if k == rounds - 1:
            return patterns
        met = join_per_key(open_edges, patterns, hot_patterns, "pattern")
        instances = met.groupBy("instance").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("better"))
        better = join_per_key(open_edges, instances, hot_instances, "instance").select("pattern", "instance", "seed", F.col("better").alias("score"))
        scores = cut_lineage(edges.where("seed").withColumn("score", F.lit(1.0)).union(better))
    raise ValueError("at least one round is needed")


def discovered(scanned: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(row, found array<struct<start, stop>>): what high-confidence patterns meet beside the base spans, for each row that has any."""
    every = scanned.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    every = every.withColumn("pattern", F.explode("patterns"))
    edges = cut_lineage(every.select("pattern", "instance", "seed").distinct())
    good = score_patterns(edges, rounds).where((F.col("seeds") >= min_seeds) & (F.col("confidence") >= min_confidence)).select("pattern")
    open_mentions = every.where("not base")
    hot = hot_keys(open_mentions.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), "pattern")
    hits = join_per_key(open_mentions, good, hot, "pattern").select("row", "start", "stop").distinct()
    return hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("found"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base and spans (array<string> of kind:start:end).

    Null and empty texts have no spans; null and repeated doc_ids stay rows of their own; equal texts
    have equal spans.  Rows are joined on a number of their own, so copies never meet in one task.
    """
    scanned = cut_lineage(scan(docs, id_col, text_col))
    rows = scanned.drop("mentions").join(discovered(scanned), "row", "left")
    more = F.transform(F.coalesce("found", F.array().cast("array<struct<start:int,stop:int>>")), lambda s: F.concat(F.lit("context:"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string")))
    return rows.select("doc_id", *(f"n_{k}" for k in KINDS), "base", F.concat("base", more).alias("spans"))


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each union of overlapping (start, end, kind) spans replaced by the kind of its first."""
    parts, at = [], 0
    for a, b, k in sorted(spans, key=lambda s: s[0]):
        if a >= at:
            parts += [text[at:a], f"[{k}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every found span of its texts replaced by ``[kind]``; all columns and rows stay.

    Spans that overlap are masked as one, with the kind of the first: nothing that belongs to any span is
    left.  Null and empty texts stay as they are.
    """
    plain = numbered_columns(docs)
    names, text_at = plain.columns, f"c{docs.columns.index(text_col)}"
    numbered = cut_lineage(plain.withColumn("row", F.monotonically_increasing_id()))
    found = discovered(cut_lineage(scan(numbered.withColumn("doc_id", F.lit(None)), "doc_id", text_at, "row")))
    rows = numbered.join(found, "row", "left").drop("row")
    schema = ", ".join(f"{n} {t}" for n, t in plain.dtypes)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text, more in zip(batch.column(text_at).to_pylist(), batch.column("found").to_pylist(), strict=True):
                if text:
                    spans = [(a, b, k) for k, each in base_spans(text).items() for a, b in each] + [(s["start"], s["stop"], "context") for s in more or []]
                    text = masked(text, spans)
                out.append(text)
            return pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == text_at else batch.column(n) for n in names], names)

        return step

    return map_texts(rows, make, schema, text_at).toDF(*docs.columns)
