"""The registered queries of the operators: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fundlake.llm import (
    boilerplate, conversations, decontaminate, hard_negatives, minhash, mixing, pseudonyms, quality, secrets, simhash, suffixes, toxicity, vamana,
)
from fundlake.llm.common import table


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of at least 85 % on 3-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of all documents with the forest's verdict."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth embedding among all others."""
    return vamana.search_embeddings(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes that occur more than once in all documents, removed."""
    found = suffixes.without_repeats(table(spark, sf_dir, "documents"), window=400)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten words of the benchmark in all documents."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms in place of personal values, under a key for tests."""
    return pseudonyms.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)


def op6_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from the labels outside fold 0 of 5."""
    return quality.learned_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by the weights 5, 2, 1."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels outside fold 2 of 4."""
    found = toxicity.learned_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", "n_hits", "n_words")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return boilerplate.extract(table(spark, sf_dir, "pages"))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles of all documents, linked at three differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3).select("doc_id", "fingerprint", "component_id")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by rule and repaired by the least cheapest edits."""
    return conversations.repair(table(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hard negatives for each of the five positives of every hundredth embedding, among all rows."""
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


#: Not a secret: real runs pass their own key.
KEY = "check-key"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_secret_scan, op2_graph_neighbours, op3_suffix_dedup, op4_decontamination, op5_pii_pseudonyms, op6_quality_trees, op7_source_mixing, op8_minhash_near_dedup, op9_toxicity_lexicon,
        op10_html_extraction, op11_simhash_near_dedup, op12_conversation_repair, op13_hard_negatives)
}
ORACLES: dict[str, str] = {"op4_decontamination": decontaminate.ORACLE, "op7_source_mixing": mixing.ORACLE}
