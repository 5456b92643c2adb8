"""The registered queries of this folder."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tilewright.llm import additive, archives, divergence, extraction, findings, huffman, hyperdim, mixing, multiindex, negatives, packing, phrases, simhash
from tilewright.llm.common import shared_folder
from tilewright.session import ship_code


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; every worker has the same installation."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_multi_index(spark, sf_dir):
    """Nearest neighbours of every twentieth vector among all."""
    return multiindex.search(table(spark, sf_dir, "embeddings"))


def op2_divergence(spark, sf_dir):
    """Quality rules on all documents."""
    return divergence.judge(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def op3_secrets(spark, sf_dir):
    """Secret candidates of all documents, judged by the forest."""
    return findings.report(table(spark, sf_dir, "documents"))


def op4_arc_to_warc(spark, sf_dir):
    """All pages through legacy archives into WARC files, and read back."""
    return archives.archive_pages(table(spark, sf_dir, "pages"), shared_folder(spark, "warc"))


def op5_hyperdimensional(spark, sf_dir):
    """Language of all documents."""
    return hyperdim.predict_documents(table(spark, sf_dir, "documents"))


def op6_tree_scoring(spark, sf_dir):
    """Main text of all pages."""
    return extraction.extract(table(spark, sf_dir, "pages"))


def op7_pfair(spark, sf_dir):
    """All documents' places in a mix of their sources."""
    return mixing.report(table(spark, sf_dir, "documents"))


def op8_huffman(spark, sf_dir):
    """All documents' ids written as Huffman block files, and read back."""
    folder = shared_folder(spark, "huffman")
    return huffman.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), folder)


def op9_simhash(spark, sf_dir):
    """Near-duplicate components of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_best_two_fit(spark, sf_dir):
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_additive_model(spark, sf_dir):
    """Quality of all documents, learned from the labels outside the held-out fifth."""
    return additive.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_l2ap_negatives(spark, sf_dir):
    """Hard negatives of every hundredth vector among all."""
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_suffix_phrases(spark, sf_dir):
    """Collocations of all documents, per language."""
    return phrases.mine(table(spark, sf_dir, "documents"))


def _ready(fn):
    """The query, with the package shipped to the workers first."""

    @wraps(fn)
    def run(spark, sf_dir):
        ship_code(spark)
        return fn(spark, sf_dir)

    return run


QUERIES = {
    f.__name__: _ready(f)
    for f in (
        op1_multi_index, op2_divergence, op3_secrets, op4_arc_to_warc, op5_hyperdimensional, op6_tree_scoring, op7_pfair, op8_huffman, op9_simhash,
        op10_best_two_fit, op11_additive_model, op12_l2ap_negatives, op13_suffix_phrases,
    )
}
ORACLES: dict[str, str] = {
    "op2_divergence": divergence.ORACLE, "op4_arc_to_warc": archives.ORACLE, "op12_l2ap_negatives": negatives.ORACLE,
    "op13_suffix_phrases": phrases.ORACLE,
}
