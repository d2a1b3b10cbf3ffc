"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

A word enters as the embedding of the word itself (zero where training has not met it) beside the mean
of its hashed byte n-grams' embeddings.  Forward and backward gated recurrent units read a window of
words, attention pools their states, a linear layer gives the window's logit.  Training, in numpy on a
bounded sample, first gives every window its document's label, then keeps from label 1 only the windows
that look it and draws half of the others from those most like them; a logistic layer on the largest window
logits and the number of windows, fitted on documents kept out of that, gives the document's score.
Scoring reads all overlapping windows of the whole text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import cut_lineage, fetch, give_back, held_out, map_texts, pick_keys

WINDOW, STRIDE = 12, 8
WORDS, CHARS, HIDDEN, ATTEND = 8, 12, 8, 8
GRAMS, BUCKETS = (3, 4, 5), 1 << 16
#: The bound of the training sample: so many rows of label 1 and CLEAN_ROWS as many of label 0, none longer than so many characters.
TRAIN_ROWS, CLEAN_ROWS, TRAIN_CHARS = 1_200, 2, 20_000
BATCH, STEPS, SEED = 256, 700, 11
#: The share of the sample that the document's logistic layer is fitted on, and how many of a document's windows enter as a mean.
KEPT_OUT, BEST = 0.15, 4
#: A missed toxic document counts as much as so many clean ones lost; the scores are shifted so that 0.5 is the place to decide.
MISS_WEIGHT = 8.0
#: Words whose n-grams are spread out at a time.
PART = 8_192
#: Words that a worker keeps projected at most.
CACHE = 80_000
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' byte n-grams with their ends marked, one after the other, and how many each word has."""
    raw = [b"<" + w.encode("utf-8", "replace") + b">" for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))  # bytes to the word's end
    ids, owners = [], []
    for n in GRAMS:
        if len(flat) < n:
            continue
        h = np.full(len(flat) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ flat[k : len(flat) - n + 1 + k]) * np.uint64(1099511628211)
        ok = left[: len(h)] >= n
        h = h[ok]
        ids.append(((h ^ (h >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[: len(ok)][ok])
    ids, owners = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, owners))
    order = np.argsort(owners, kind="stable")
    return ids[order].astype(np.int32), np.bincount(owners, minlength=len(raw))


def grams_by_part(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``grams`` of a long list, PART words at a time."""
    parts = [grams(words[k : k + PART]) for k in range(0, len(words), PART)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64))


def mean_rows(table: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each word the mean of its buckets' rows; each word has one n-gram at least."""
    return np.add.reduceat(table[ids], np.cumsum(counts) - counts, axis=0) / counts[:, None]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def windows(n: int) -> list[tuple[int, int]]:
    """All overlapping windows of n words; the last one ends with the text. One empty window if there is no word."""
    if n <= WINDOW:
        return [(0, n)]
    starts = list(range(0, n - WINDOW, STRIDE))
    return [(s, s + WINDOW) for s in [*starts, n - WINDOW]]


def cut(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' words (as numbers) in windows that do not overlap: their words, which of these are words, and the text of each window."""
    counts = np.array([-(-len(d) // WINDOW) for d in docs], np.int64)
    ends = np.cumsum(counts)
    index = np.zeros((counts.sum(), WINDOW), np.int32)  # filled in place: an array for each window would take several times as much
    mask = np.zeros(index.shape, bool)
    for d, n, end in zip(docs, counts, ends, strict=True):
        index[end - n : end].reshape(-1)[: len(d)] = d
        mask[end - n : end].reshape(-1)[: len(d)] = True
    return index, mask, np.repeat(np.arange(len(docs)), counts)


@dataclass
class Model:
    vocab: dict[str, int] = field(default_factory=dict)
    p: dict[str, np.ndarray] = field(default_factory=dict)
    platt: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0, 0.0, 0.0]))

    def inputs(self, words: list[str]) -> np.ndarray:
        ids, counts = grams(words)
        known = np.fromiter((self.vocab.get(w, 0) for w in words), np.int64, len(words))
        return np.concatenate([self.p["word"][known], mean_rows(self.p["char"], ids, counts)], axis=1)

    def projected(self, words: list[str]) -> np.ndarray:
        """What both directions take in for each word, PART words at a time."""
        out = np.empty((len(words), 6 * HIDDEN), np.float32)  # filled in place: parts that are joined later would be held twice
        for k in range(0, len(words), PART):
            out[k : k + PART] = self.project(self.inputs(words[k : k + PART]).astype(np.float32))
        return out

    def project(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ self.p["wf"] + self.p["bf"], x @ self.p["wb"] + self.p["bb"]], axis=1)

    def logits(self, table: np.ndarray, index: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Of windows given as rows of places in the table of projected words, by time first."""
        states = _read(table[:, : 3 * HIDDEN], index, mask, self.p["uf"]), _read(table[:, 3 * HIDDEN :], index[::-1], mask[::-1], self.p["ub"])[::-1]
        h = np.concatenate(states, axis=2)
        return _pool(h, mask, self.p)[0]

    def score(self, evidence: np.ndarray) -> np.ndarray:
        """Of documents given as rows of their largest window logit, the mean of their BEST largest and the log of their number of windows."""
        return sigmoid(evidence @ self.platt[:-1] + self.platt[-1])


def _read(table: np.ndarray, index: np.ndarray, mask: np.ndarray, u: np.ndarray) -> np.ndarray:
    """States of one direction, [time, windows, HIDDEN]."""
    h = np.zeros((index.shape[1], HIDDEN), np.float32)
    out = np.empty((*index.shape, HIDDEN), np.float32)
    full = mask.all()
    for t in range(len(index)):
        a, r = table[index[t]], h @ u
        gates = sigmoid(a[:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN])
        n = np.tanh(a[:, 2 * HIDDEN :] + gates[:, :HIDDEN] * r[:, 2 * HIDDEN :])
        new = n + gates[:, HIDDEN:] * (h - n)
        h = new if full else np.where(mask[t][:, None], new, h)
        out[t] = h
    return out


def _pool(h: np.ndarray, mask: np.ndarray, p: dict[str, np.ndarray]):
    e = np.tanh(h @ p["wa"] + p["ba"])
    s = np.where(mask, e @ p["v"], np.float32(-1e4))
    w = np.exp(s - s.max(axis=0))
    w *= mask
    w /= np.maximum(w.sum(axis=0), 1e-9)
    c = np.einsum("tb,tbh->bh", w, h)
    return c @ p["wo"] + p["bo"][0], e, w, c


def _forward(x: np.ndarray, mask: np.ndarray, u: np.ndarray):
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    kept, out = [], np.empty((*x.shape[:2], HIDDEN), np.float32)
    for t in range(len(x)):
        r = h @ u
        g = sigmoid(x[t][:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN])
        n = np.tanh(x[t][:, 2 * HIDDEN :] + g[:, :HIDDEN] * r[:, 2 * HIDDEN :])
        new = np.where(mask[t][:, None], n + g[:, HIDDEN:] * (h - n), h)
        kept.append((h, g, n, r))
        h = out[t] = new
    return out, kept


def _backward(dout: np.ndarray, mask: np.ndarray, u: np.ndarray, kept: list):
    dx, du, dh = np.zeros((*dout.shape[:2], 3 * HIDDEN), np.float32), np.zeros_like(u), np.zeros(dout.shape[1:], np.float32)
    for t in range(len(dout) - 1, -1, -1):
        h, g, n, r = kept[t]
        dh = dh + dout[t]
        live = dh * mask[t][:, None]
        reset, keep = g[:, :HIDDEN], g[:, HIDDEN:]
        dn = live * (1 - keep) * (1 - n * n)
        dk = live * (h - n) * keep * (1 - keep)
        dr = dn * r[:, 2 * HIDDEN :] * reset * (1 - reset)
        dx[t] = np.concatenate([dr, dk, dn], axis=1)
        back = np.concatenate([dr, dk, dn * reset], axis=1)
        du += h.T @ back
        dh = dh * (1 - mask[t][:, None]) + live * keep + back @ u.T
    return dx, du


def _loss_and_gradients(p: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, y: np.ndarray):
    """Mean log loss of windows, and its gradients by parameter and by input."""
    hf, kf = _forward(x @ p["wf"] + p["bf"], mask, p["uf"])
    hb, kb = _forward((x @ p["wb"] + p["bb"])[::-1], mask[::-1], p["ub"])
    h = np.concatenate([hf, hb[::-1]], axis=2)
    z, e, w, c = _pool(h, mask, p)
    prob = sigmoid(z)
    loss = -np.mean(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7))
    dz = ((prob - y) / len(y)).astype(np.float32)
    g = {"wo": c.T @ dz, "bo": dz.sum(keepdims=True)}
    dc = dz[:, None] * p["wo"]
    dh = w[:, :, None] * dc
    dw = np.einsum("bh,tbh->tb", dc, h)
    ds = w * (dw - (w * dw).sum(axis=0))
    g["v"] = np.einsum("tb,tba->a", ds, e)
    de = ds[:, :, None] * p["v"] * (1 - e * e)
    g["wa"], g["ba"] = np.einsum("tbh,tba->ha", h, de), de.sum(axis=(0, 1))
    dh = dh + de @ p["wa"].T
    dxf, g["uf"] = _backward(dh[:, :, :HIDDEN], mask, p["uf"], kf)
    dxb, g["ub"] = _backward(dh[::-1, :, HIDDEN:], mask[::-1], p["ub"], kb)
    dxb = dxb[::-1]
    g["wf"], g["bf"] = np.einsum("tbi,tbo->io", x, dxf), dxf.sum(axis=(0, 1))
    g["wb"], g["bb"] = np.einsum("tbi,tbo->io", x, dxb), dxb.sum(axis=(0, 1))
    return loss, g, dxf @ p["wf"].T + dxb @ p["wb"].T


def _start(vocabulary: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    def draw(*shape: int, scale: float = 0.3) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    n, h = WORDS + CHARS, HIDDEN
    p = {"word": draw(vocabulary, WORDS, scale=0.05), "char": draw(BUCKETS, CHARS, scale=0.05)}
    for d in "fb":
        p |= {f"w{d}": draw(n, 3 * h), f"u{d}": draw(h, 3 * h), f"b{d}": np.zeros(3 * h, np.float32)}
    p |= {"wa": draw(2 * h, ATTEND), "ba": np.zeros(ATTEND, np.float32), "v": draw(ATTEND), "wo": draw(2 * h), "bo": np.zeros(1, np.float32)}
    p["word"][0] = 0
    return p


def train(texts: list[str], labels: list[int], steps: int = STEPS, seed: int = SEED, prior: float | None = None) -> Model:
    """The network of labelled texts. Without both labels it has no evidence and scores the share of label 1, with one more row of label 0 (a quarter without rows, so all stay).

    prior: the share of label 1 where the model will be used, if the sample has another one.
    """
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    places, docs = _Places(0), []
    for t in texts:  # words as numbers at once: a list of strings for each text would not fit
        docs.append(np.array([places[w] for w in words_of(t)], np.int32))
    words = list(places)
    counts = np.zeros(len(words), np.int64)
    for d in docs:
        counts[np.unique(d)] += 1
    model = Model({w: i + 1 for i, w in enumerate(sorted(w for w, c in zip(words, counts, strict=True) if c >= 3))})
    model.p = _start(len(model.vocab) + 1, rng)
    share = float((y.sum() + 0.5) / (len(y) + 2))
    if len(set(labels)) < 2:
        model.platt = np.array([0.0, 0.0, 0.0, np.log(share / (1 - share))])
        return model
    kept_out = rng.random(len(docs)) < KEPT_OUT
    gram_ids, gram_counts = grams_by_part(words)
    gram_ends = np.cumsum(gram_counts)
    known = np.array([model.vocab.get(w, 0) for w in words], np.int32)
    index, mask, source = cut([docs[k] for k in np.flatnonzero(~kept_out)])
    source = np.flatnonzero(~kept_out)[source]
    target = y[source]
    if len(index):
        ones, zeros = np.flatnonzero(target == 1), np.flatnonzero(target == 0)
        squares = {k: np.full(v.shape, 1e-6, np.float32) for k, v in model.p.items()}
        hard = zeros
        for step in range(steps if len(ones) and len(zeros) else 0):
            if step in (steps // 3, 2 * steps // 3):
                scores = Scorer(model).window_logits(words, index, mask)
                best = np.full(len(docs), -np.inf, np.float32)
                np.maximum.at(best, source, scores)
                ones = ones[(scores[ones] > 0) | (scores[ones] == best[source[ones]])]
                hard = zeros[np.argsort(-scores[zeros])[: max(BATCH, len(zeros) // 20)]]
            pick = np.concatenate([rng.choice(ones, BATCH // 2), rng.choice(zeros, BATCH // 4), rng.choice(hard, BATCH // 4)])
            m = mask[pick].T
            used, inverse = np.unique(index[pick].T, return_inverse=True)
            lengths = gram_counts[used]
            ends = np.cumsum(lengths)
            gi = gram_ids[np.repeat(gram_ends[used] - lengths - (ends - lengths), lengths) + np.arange(ends[-1])]
            x = np.concatenate([model.p["word"][known[used]], mean_rows(model.p["char"], gi, lengths)], axis=1).astype(np.float32)
            _, g, dx = _loss_and_gradients(model.p, x[inverse.reshape(m.shape)], m, target[pick])
            flat = dx.reshape(-1, dx.shape[2])
            order = np.argsort(inverse.reshape(-1), kind="stable")
            dwords = np.add.reduceat(flat[order], np.searchsorted(inverse.reshape(-1)[order], np.arange(len(used))), axis=0)
            rate = 0.08 * (1 - 0.9 * step / steps)
            for k, v in g.items():
                squares[k] += v * v
                model.p[k] -= rate * v / np.sqrt(squares[k])
            for k, rows, v in (("word", known[used], dwords[:, :WORDS]), ("char", gi, np.repeat(dwords[:, WORDS:] / lengths[:, None], lengths, axis=0))):
                order = np.argsort(rows, kind="stable")
                which, first = np.unique(rows[order], return_index=True)
                v = np.add.reduceat(v[order], first, axis=0)
                squares[k][which] += v * v
                model.p[k][which] -= rate * v / np.sqrt(squares[k][which])
            model.p["word"][0] = 0
    held = np.flatnonzero(kept_out) if kept_out.any() and len(set(y[kept_out])) == 2 else np.arange(len(docs))
    scorer = Scorer(model)
    seen = [scorer.evidence([[words[i] for i in docs[h]] for h in held[k : k + 100]]) for k in range(0, len(held), 100)]
    model.platt = _platt(np.concatenate(seen), y[held])
    share = float(y[held].mean())
    if prior and 0 < prior < 1:
        model.platt[-1] += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    model.platt[-1] += np.log(MISS_WEIGHT)
    return model


def _platt(evidence: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method for a logistic layer on the evidence, with a light ridge."""
    x = np.concatenate([evidence, np.ones((len(y), 1))], axis=1)
    beta, ridge = np.zeros(4), np.diag([1e-2, 1e-2, 1e-1, 1e-3])
    for _ in range(50):
        p = sigmoid(x @ beta)
        beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
    return beta


class _Places(dict):
    """Numbers words in the order in which they are met; ``fresh`` has those met since it was last emptied."""

    def __init__(self, first: int):
        super().__init__()
        self.next, self.fresh = first, []

    def __missing__(self, word: str) -> int:
        self[word] = place = self.next
        self.next += 1
        self.fresh.append(word)
        return place


class Scorer:
    """A model with the projections of words it has met, CACHE of them at most between calls."""

    def __init__(self, model: Model):
        self.model, self.places = model, _Places(1)
        self.table = model.project(np.zeros((1, WORDS + CHARS), np.float32)).astype(np.float32)

    def _index(self, words: list[str]) -> np.ndarray:
        places = self.places
        first = places.next
        out = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
        fresh, places.fresh = places.fresh, []
        if fresh:
            if places.next > len(self.table):
                more = np.zeros((places.next + places.next // 2, self.table.shape[1]), np.float32)
                more[:first] = self.table[:first]
                self.table = more
            self.table[first : places.next] = self.model.projected(fresh)
        if len(places) > CACHE:  # the table is full: these were for this call alone
            for w in fresh:
                del places[w]
            places.next = first
        return out

    def window_logits(self, words: list[str], index: np.ndarray, mask: np.ndarray, rows: int = 4096) -> np.ndarray:
        """Logits of windows given as rows of places in ``words``."""
        table = self.model.projected(words)
        parts = [self.model.logits(table, index[k : k + rows].T, mask[k : k + rows].T) for k in range(0, len(index), rows)]
        return np.concatenate(parts)

    def evidence(self, docs: list[list[str]], rows: int = 4096) -> np.ndarray:
        """For each text its largest window logit, the mean of its BEST largest (of all, where it has fewer) and the log of its number of windows."""
        flat = self._index([w for d in docs for w in d])
        starts, lengths, owner, at = [], [], [], 0
        for k, d in enumerate(docs):
            for a, b in windows(len(d)):
                starts.append(at + a)
                lengths.append(b - a)
                owner.append(k)
            at += len(d)
        starts, lengths, owner = np.array(starts, np.int64), np.array(lengths, np.int64), np.array(owner, np.int64)
        flat = np.append(flat, 0)
        logits = np.empty(len(starts), np.float32)
        order = np.argsort(lengths < WINDOW, kind="stable")  # full windows together, so that they need no mask
        steps = np.arange(WINDOW)[:, None]
        for k in range(0, len(order), rows):
            part = order[k : k + rows]
            mask = steps < lengths[part]
            index = np.where(mask, flat[np.minimum(starts[part] + steps, len(flat) - 1)], 0)
            logits[part] = self.model.logits(self.table, index, mask)
        order = np.lexsort((-logits, owner))
        ranked = logits[order].astype(np.float64)
        count = np.bincount(owner, minlength=len(docs))
        first = np.cumsum(count) - count
        taken = np.minimum(count, BEST)
        sums = np.concatenate([[0.0], np.cumsum(ranked)])
        return np.stack([ranked[first], (sums[first + taken] - sums[first]) / taken, np.log(count)], axis=1)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return self.model.score(self.evidence([words_of(t) for t in texts])) if texts else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """Train on at most ``rows`` texts of label 1 and CLEAN_ROWS times as many of label 0, of at most ``chars`` characters, picked by a hash of text and id, none held out.

    Where an id has several labels, 1 counts; labels without an id and other values than 0 and 1 do not.
    Rows equal in id and text are one.  Keys are picked first, then the picked texts alone are fetched.
    """
    marks = labels.where(~held_out("doc_id") & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = cut_lineage(marks.where("__id is not null"))
    counts = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    id_value = F.col(id_col).cast("long")
    usable = docs.where(F.col(text_col).isNotNull() & (F.length(text_col) <= chars)).select(id_value.alias("__id"), F.xxhash64(text_col, id_value).alias("key"), F.col(text_col).alias("text"))
    keys = cut_lineage(usable.select("__id", "key").join(marks, "__id"))
    kind = {k: mark for mark, n in ((0, CLEAN_ROWS * rows), (1, rows)) for k in pick_keys(keys.where(F.col("toxic") == mark), "key", n)}
    got = fetch(usable, "key", list(kind), "text")
    texts, marked = [r.text for r in got], [kind[r.key] for r in got]
    del got, keys, kind
    model = train(texts, marked, prior=counts.get(1, 0) / max(1, sum(counts.values())))
    del texts
    give_back()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row.

    Null, empty and wordless texts are one empty window and get the network's score for it.  Null and
    repeated doc_ids stay rows of their own; nothing but the text goes into a score.
    """

    def make():
        scorer = Scorer(model)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = np.clip(scorer.scores(batch.column("text").to_pylist()), 0, 1)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return map_texts(rows, make, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, with their columns."""
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)

    def make():
        scorer = Scorer(model)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array(scorer.scores(batch.column(text_col).to_pylist()) < threshold))

        return step

    return map_texts(docs, make, schema, text_col)
