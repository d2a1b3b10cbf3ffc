"""Language identification: averaged hashed subword embeddings under a linear softmax.

Character pairs and triples of the folded text are hashed into buckets; a text is the mean of its
buckets' embeddings.  Embeddings and the softmax layer are trained by stochastic gradient descent in
numpy on a bounded sample of labelled rows, the temperature and the rejection threshold on a part of
the sample that is kept out of the descent.  As the layer is linear, scoring adds up one row of class
scores for each subword of the whole text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import cut_lineage, fetch, held_out, map_texts, pick_keys

BUCKETS, WIDTH, EPOCHS, RATE = 1 << 15, 16, 6, 4.0
#: The bound of the training sample: so many rows, none longer than so many characters.
TRAIN_ROWS, TRAIN_CHARS = 4_000, 20_000
#: Accepted predictions are to be right this often on the calibration part.
TARGET = 0.99
UNDETERMINED = "und"
_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of the pairs and triples of all texts, and where each text's begin; each text has one at least."""
    points = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "replace"), np.uint32) for t in texts]
    flat = np.concatenate(points).astype(np.uint32)
    flat = np.where(flat < 65, np.uint32(32), flat)  # digits, blanks and most marks are one boundary
    ends = np.cumsum([len(p) for p in points])
    pair = flat[:-1] * np.uint32(2654435761) + flat[1:] * np.uint32(2246822519)
    triple = pair[:-1] * np.uint32(3266489917) + flat[2:] * np.uint32(668265263) + np.uint32(1)
    ids = np.empty(2 * len(flat), np.int32)
    ids[0:-2:2] = (pair ^ (pair >> np.uint32(15))) % np.uint32(BUCKETS)
    ids[-2:] = 0
    ids[1:-4:2] = (triple ^ (triple >> np.uint32(15))) % np.uint32(BUCKETS)
    ids[-3] = 0
    ends2 = 2 * ends
    # what would reach over a text's end counts as bucket 0
    for back in (1, 2, 3):
        ids[ends2 - back] = 0
    return ids, np.concatenate([[0], ends2[:-1]])


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # class scores of each bucket
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, texts: list[str]) -> np.ndarray:
        ids, starts = subwords(texts)
        counts = np.diff(np.append(starts, len(ids)))[:, None]
        return np.add.reduceat(self.table[ids], starts, axis=0, dtype=np.float64) / counts + self.bias

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return softmax(self.logits(texts) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], seed: int = 7) -> Model | None:
    """The model of the labelled texts; None if there is no label at all."""
    kinds = sorted(set(langs))
    if not kinds:
        return None
    rng = np.random.default_rng(seed)
    index = {k: i for i, k in enumerate(kinds)}
    target = np.array([index[x] for x in langs])
    bags = []
    for t in texts:
        ids, _ = subwords([t])
        which, counts = np.unique(ids, return_counts=True)
        bags.append((which, (counts / counts.sum()).astype(np.float32)))
    order = rng.permutation(len(texts))
    kept_out = order[: len(order) // 5]
    order = order[len(order) // 5 :]
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    weight, bias = rng.normal(0, 0.1, (WIDTH, len(kinds))).astype(np.float32), np.zeros(len(kinds), np.float32)
    steps = 0
    total = max(1, EPOCHS * -(-len(order) // 16))
    for _ in range(EPOCHS):
        order = rng.permutation(order)
        for k in range(0, len(order), 16):
            part = order[k : k + 16]
            rate = RATE * (1 - steps / total)
            steps += 1
            mean = np.stack([bags[i][1] @ embed[bags[i][0]] for i in part])
            error = softmax(mean @ weight + bias)
            error[np.arange(len(part)), target[part]] -= 1
            error /= len(part)
            back = error @ weight.T
            weight -= rate * mean.T @ error
            bias -= rate * error.sum(axis=0)
            for i, g in zip(part, back, strict=True):
                embed[bags[i][0]] -= rate * np.outer(bags[i][1], g)
    model = Model(kinds, (embed @ weight).astype(np.float32), bias.astype(np.float64), 1.0, 0.0)
    if len(kept_out) >= 20:
        z, y = np.concatenate([model.logits([texts[i]]) for i in kept_out]), target[kept_out]
        rows = np.arange(len(y))
        loss = {t: -np.log(softmax(z / t)[rows, y] + 1e-12).mean() for t in np.geomspace(0.02, 5, 60)}
        model.temperature = float(min(loss, key=loss.get))
        p = softmax(z / model.temperature)
        top, right = p.max(axis=1), p.argmax(axis=1) == y
        rank = np.argsort(-top)
        good = np.cumsum(right[rank]) / np.arange(1, len(y) + 1) >= TARGET
        model.threshold = float(top[rank][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model | None:
    """Train on at most ``rows`` labelled texts of at most ``chars`` characters, picked by a hash of text and id, none held out.

    Null ids may be picked; rows equal in id and text count once, the least of their languages with them.
    Keys are picked first, then the picked texts alone are fetched.
    """
    usable = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) <= chars))
    usable = usable.select(F.xxhash64(text_col, F.col(id_col).cast("long")).alias("key"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    got = fetch(usable, "key", pick_keys(cut_lineage(usable.select("key")), "key", rows), "lang", "text")
    got = [r for r in got if has_letter(r.text)]
    return train([r.text for r in got], [r.lang for r in got])


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) of each row.

    ``und`` with score 0, not accepted, for null texts, texts without a letter, and without a model.
    accepted tells whether the calibrated score reaches the rejection threshold; lang_pred is the
    likeliest language either way.  Repeated and null ids stay rows of their own.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column("text").to_pylist()
            live = [i for i, t in enumerate(texts) if model and has_letter(t)]
            langs, scores, accepted = [UNDETERMINED] * len(texts), [0.0] * len(texts), [False] * len(texts)
            if live:
                p = model.probabilities([texts[i] for i in live])
                for i, k, s in zip(live, p.argmax(axis=1), p.max(axis=1), strict=True):
                    langs[i], scores[i], accepted[i] = model.langs[k], float(min(1.0, s)), bool(s >= model.threshold)
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "accepted"],
            )

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return map_texts(rows, make, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
