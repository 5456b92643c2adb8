"""A training corpus out of ``documents``: identify, deduplicate, redact, mix, pack.

Every stage takes all that the one before it kept, written as a table. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilewright.llm import findings, hyperdim, mixing, packing, simhash
from tilewright.llm.common import drop_folder, shared_folder
from tilewright.llm.queries import vocabulary
from tilewright.session import ship_code


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or far from every language, go."""
    ship_code(spark)
    return hyperdim.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id."""
    ship_code(spark)
    return simhash.keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays."""
    ship_code(spark)
    return findings.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come in the order of the mix: files, and rows in them, follow the schedule."""
    ship_code(spark)
    return mixing.mixed_order(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences of 2048, which follow the order
    in which ``source_mix`` has stored them."""
    ship_code(spark)
    return packing.pack_stored(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("source_mix", source_mix), ("best_fit_packing", best_fit_packing),
]

#: Hashes of shingles, a forest and a tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``. Tables between them are kept in the shared folder until the next
    one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        folder = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            drop_folder(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
