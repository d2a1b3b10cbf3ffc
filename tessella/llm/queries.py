"""The registered queries of the training-data operators: each applies its operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import byte_bpe, fingerprint, langid, licenses, merkle, multi_index, packing, pii, quality, simhash, toxicity, urls, vector_codes
from tessella.llm._common import table

BYTE_RANKS, WORD_VOCABULARY = "byte_bpe_50k.tiktoken", "word_bpe_49k.json"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    path, pattern = public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN
    done = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), path, pattern), path)
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' figures and the verdict of every document."""
    return quality.judge(table(spark, sf_dir, "documents")).drop("host_rate")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and labels of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return urls.judge(table(spark, sf_dir, "pages")).drop("trust", "distrust")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every document."""
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every vector, its error and its label's."""
    vectors = table(spark, sf_dir, "embeddings")
    books = vector_codes.fit(vectors)
    return vector_codes.encode(vectors, books).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, the roots over it, its proof, and the root that it leads to where it was tampered with."""
    return merkle.document_manifest(table(spark, sf_dir, "documents")).select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest others of every hundredth vector."""
    return multi_index.neighbours(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    every = (op1_simhash, op2_byte_bpe, op3_toxicity, op4_quality, op5_licenses, op6_urls, op7_pii, op8_packing, op9_langid, op10_fingerprint, op11_vector_codes, op12_merkle, op13_neighbours)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_quality": quality.oracle_sql(), "op6_urls": urls.oracle_sql(), "op11_vector_codes": vector_codes.oracle_sql(),
        "op12_merkle": merkle.oracle_sql(), "op13_neighbours": multi_index.oracle_sql(),
    }
