"""Operators that give the caller's rows back, on tables whose other columns have the operators' own names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessella.llm import neardup, pii, quality, simhash, toxicity

#: What the operators call their columns, now or once.
NAMES = [
    "row", "id", "no_id", "text_key", "node", "found", "member", "class", "k", "n", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed", "host", "rate",
    "c0", "c1", "c2", "key", "fp", "class_fp", "component", "component_id", "score", "predicted", "held_out", "label", "__row", "__id", "__no", "__key", "__found", "__m_failed", "__m_host", "__m_rate",
    "__m_base_failed", "__words", "__n", "__hashes", "__windows", "__hot", "a b",
]
_WORDS = "the quick brown fox jumps over a lazy dog while seven wise owls watch from an old oak tree near the quiet river bank".split()


def _rows() -> list[tuple]:
    texts = [" ".join(_WORDS[(i * k + i) % len(_WORDS)] + str(i * k % 7) for k in range(70)) for i in range(12)]
    texts += [f"{texts[3]} token = \"a1b2c3d4e5f6a7b8c9d0e1f2a3b4c5d{i}\" mail bob{i}@example.com" for i in range(4)]
    return [(i, t, "en", f"s{i % 2}") for i, t in enumerate([*texts, texts[0], texts[1], None, "nothing here", "short"])]


def _outcomes(docs, spark):
    model = toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int"))
    steps = {
        "near": neardup.keep_one, "simhash": simhash.keep_one, "quality": quality.keep_good, "mask": pii.mask,
        "toxic": lambda d: toxicity.keep_clean(d, model),
    }
    return {name: step(docs) for name, step in steps.items()}


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(_rows(), "doc_id long, text string, lang string, source string")


def test_no_name_of_a_column_changes_what_is_kept(spark, plain):
    ours = ("doc_id", "text", "lang", "source")
    more = plain.select("*", *(F.lit(f"own {n}").alias(n) for n in NAMES))
    for (name, want), got in zip(_outcomes(plain, spark).items(), _outcomes(more, spark).values(), strict=True):
        assert got.columns == more.columns, name
        rows = got.collect()
        assert sorted((tuple(r[c] for c in ours) for r in rows), key=repr) == sorted(map(tuple, want.collect()), key=repr), name
        assert all(r[n] == f"own {n}" for r in rows for n in NAMES), name


def test_no_name_changes_what_is_found(spark, plain):
    more = plain.select("*", *(F.lit(7).alias(n) for n in NAMES))
    for of in (pii.personal_data, quality.judge, simhash.near_duplicates):
        assert sorted(map(tuple, of(more).collect()), key=repr) == sorted(map(tuple, of(plain).collect()), key=repr)
