"""A corpus pipeline of five stages; each is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamline.llm import decontam, exact, pack, simhash, toxicity
from loamline.llm.common import dropped, stored, table
from loamline.llm.queries import SEQUENCE_TOKENS, tokenizer


# Of every stage: null texts count as empty, rows with null or repeated ids are rows like any other, columns of the operators' own names pass through, and an empty table gives an empty one.


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more by compression distance go. Equal texts have equal scores."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest doc_id stays (null last; of equal ids, one)."""
    return exact.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.8), the one with the smallest doc_id stays (null last; of equal ids, one)."""
    return simhash.near_dedup(docs, k=5, similarity=0.8)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go. Items with null or empty texts overlap nothing."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences; an empty text is one piece."""
    return pack.pack_documents(docs, tokenizer("word_bpe_49k.json"), end_id=1, cap=pack.Capacity(tokens=SEQUENCE_TOKENS), keep_ids=False)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("best_fit_packing", pack_sequences),
]

#: Trained scores, fingerprints and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if held is not None:  # what a stage has read is needed no more
            dropped(held)
        held = docs
    return docs
