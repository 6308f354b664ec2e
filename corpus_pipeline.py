"""The corpus pipeline: each stage is written as Parquet and read again as the next one's documents.

A stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. Clean documents pass every
filtering stage unchanged. All but the last return the columns of documents; the last adds size and repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlake.llm import decontaminate, minhash, mixing, pseudonyms, toxicity
from fundlake.llm.catalog import KEY
from fundlake.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned lexicon scores 0.3 or more go."""
    return toxicity.without_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, a similarity of 0.8."""
    return minhash.without_near_duplicates(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return decontaminate.without_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become pseudonyms; n_chars follows where the text changes."""
    masked = pseudonyms.pseudonymised(docs.select(*COLUMNS, F.col("text").alias("before")), KEY)
    length = F.when(F.col("text").eqNullSafe(F.col("before")), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return masked.withColumn("n_chars", length).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by the weights 5, 2, 1: the documents taken, and how often."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


STAGES = [
    ("toxicity", reject_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
    ("personal_data", replace_personal_data), ("mixing", mix_sources),
]
#: SQL cannot express the learned lexicon, the components and the keyed permutations; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
