"""The queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loamline.llm import decontam, exact, html, pack, pii, quality, shard, simhash, toxicity, wordpiece
from loamline.llm.common import table

SHARDS = 40
SEQUENCE_TOKENS = 4096


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_block_tree_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1, cap=pack.Capacity(tokens=SEQUENCE_TOKENS), keep_ids=False)


def op4_simhash_byte_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), k=3, max_bits=3)


def op5_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


def op6_linear_wordpiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), wordpiece.read_vocabulary(tokenizer("byte_bpe_50k.tiktoken")))


def op7_weighted_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_documents(table(spark, sf_dir, "documents"), shard.even_forest(SHARDS), shard.even_forest(SHARDS + 1))


def op8_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op9_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op10_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_block_tree_extraction": op1_block_tree_extraction,
    "op2_spaced_seed_decontamination": op2_spaced_seed_decontamination,
    "op3_vector_best_fit": op3_vector_best_fit,
    "op4_simhash_byte_index": op4_simhash_byte_index,
    "op5_factorisation_machine": op5_factorisation_machine,
    "op6_linear_wordpiece": op6_linear_wordpiece,
    "op7_weighted_hash_tree": op7_weighted_hash_tree,
    "op8_compression_toxicity": op8_compression_toxicity,
    "op9_grace_dedup": op9_grace_dedup,
    "op10_bootstrapped_pii": op10_bootstrapped_pii,
}

ORACLES: dict[str, str] = {
    "op2_spaced_seed_decontamination": decontam.oracle_sql(),
    "op9_grace_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY norm)
    """,
}
