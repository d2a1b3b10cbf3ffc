"""The corpus pipeline's stages, one after the other, each held against its own input."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
from tessella.llm import packing, pii, quality


def first_of_each_class(texts: dict[int, str]) -> set[int]:
    """The least ids of the classes of texts that all pairs with a Jaccard similarity of 0.8 of their five-word shingles link."""
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    sets, least = {}, {i: i for i in texts}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}

    def root(i: int) -> int:
        while least[i] != i:
            i = least[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                least[max(a, b)] = min(a, b)
    return {root(i) for i in texts}


ODD = [(None, None, None, None), (None, "text without an id " * 20, "en", "s"), (1, "", "en", None), (1, "word " * 5000, "en", "s"), (2, " ".join(f"w{i}" for i in range(80)) + " a@b.org", "en", "t"), (2, " ".join(f"w{i}" for i in range(80)) + " a@b.org", "en", "t")]
ODD += [(j, " ".join(f"v{i}x{j}" for i in range(60)), "en", "t") for j in range(10, 30)]


def test_stages_stand_odd_and_empty_tables(spark, tmp_path):
    """Null ids and texts, repeated rows, and columns whose names clash with the operators' own."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (ODD, []):
        docs = spark.createDataFrame([(*r, 1, "k", 5, True) for r in rows], "doc_id long, text string, lang string, source string, n_words int, key string, row long, failed boolean")
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, str(tmp_path))
            got = Counter(r.doc_id for r in after.collect())
            assert set(got) <= {r[0] for r in rows} and (name == "packing" or (after.columns == docs.columns and sum(got.values()) <= len(rows)))
            if name in ("toxicity", "personal_data"):
                assert sum(got.values()) == len(rows)
            if name == "quality":
                assert got == ({2: 2} | dict.fromkeys(range(10, 30), 1) if rows else {})
            if name == "near_duplicates" and rows:
                assert got[2] == 1
    masked = Counter(r.text for r in corpus_pipeline.mask_personal_data(spark, spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string"), "").collect())
    assert masked[pii.masked(ODD[4][1], [(len(ODD[4][1]) - 7, len(ODD[4][1]), "email")])] == 2


def test_stages_and_their_decisions(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if name != "packing":
            assert docs.columns == before.columns and 0 < docs.count() <= before.count()
    ids = {k: {r.doc_id for r in v.select("doc_id").collect()} for k, v in seen.items()}
    assert ids["toxicity"] <= ids[""] and len(ids["toxicity"]) > 0.8 * len(ids[""])
    assert ids["quality"] == {r.doc_id for r in quality.judge(seen["toxicity"]).where("kept").collect()}
    assert ids["near_duplicates"] == first_of_each_class({r.doc_id: r.text for r in seen["quality"].collect()})
    assert ids["personal_data"] == ids["near_duplicates"] == ids["packing"]
    assert seen["personal_data"].where(r"text rlike '[A-Za-z0-9]@[A-Za-z0-9-]+\\.[a-z]'").count() == 0
    filled = {r[0]: r[1] for r in docs.groupBy("sequence_id").sum("length").collect()}
    assert max(filled.values()) <= packing.CAPACITY
