"""Labelled rows to learn from, and the split by the checksum of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 20_000  # labelled rows a model is fitted on, at most about so many


def checksum_mod(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


def training_rows(docs: DataFrame, labels: DataFrame, column: str, modulus: int, held_out: int,
                  most: int = MOST_ROWS) -> DataFrame:
    """(doc_id, text, y): texts with a label of 0 or 1, without held-out rows; about `most` of them by a hash of the id.

    The ids and labels are at most a few more than `most`, so they may be broadcast. Of several labels of one id the
    largest counts, of several documents of one id the one with the first text: no id, however frequent, gives more than
    one row.
    """
    rows = (labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & (checksum_mod("doc_id", modulus) != held_out))
            .groupBy("doc_id").agg(F.max(F.col(column)).cast("int").alias("y")))
    n = rows.count()
    # the share of all hashes taken as an exact fraction of 2**62, which no number of labels rounds to nothing
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62)) < F.lit(min(1 << 62, (most << 62) // max(n, 1))))
    if chosen.limit(2 * most).count() == 2 * most:
        raise ValueError("the sample of labels is larger than its bound")
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
