"""Helpers of the operators: tables, shared scratch folders, connected components, Arrow columns."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir; a local session without that setting gets a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fundlake-"))
        base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, free: bool = False) -> DataFrame:
    """The rows written to the shared folder and read back: later steps start from files, not from lineage.

    With `free` the shuffle files of the write go as soon as it has ended, since nothing reads them again.
    """
    path, spark = scratch(df.sparkSession), df.sparkSession
    before = spark.conf.get(_FREE, None)
    if free:
        spark.conf.set(_FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*stores: DataFrame) -> None:
    """Delete stores of `stored` that nothing reads any more: what was made from them is stored itself."""
    for df in stores:
        context = df.sparkSession.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(df.__dict__["stored_at"])
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def row_key(id_column: str, text_column: str) -> Column:
    """128 bits that stand for a row's id and whole text, nulls told apart: the same on every read of the table.

    Rows equal in both share the key, which is harmless where they get the same result.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col(id_column).cast("string"), F.lit("null")), text)))


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings one after another, and the n + 1 offsets of the strings; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) else column.type)
    if pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about `size` bytes; a longer row stands alone."""
    data, offsets = flat_bytes(column)
    n, row = len(offsets) - 1, 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def split_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", merge: bool = False) -> DataFrame:
    """An equi-join on a column of both sides for which both sides are shuffled anew.

    A side that comes from an aggregation would keep that aggregation's partitions, and adaptive execution can split
    a hot key only where each side of the join is a shuffle of its own. A side that turns out small is broadcast by
    Spark's own measure; merge keeps to the shuffled join where the right side grows with the input, so that the plan
    is the same at every size.
    """
    right = right.withColumnRenamed(key, "_key")
    right = right.hint("merge") if merge else right
    joined = left.join(right, F.struct(F.col(key).alias("k")) == F.struct(F.col("_key").alias("k")), how)
    return joined if how in ("left_semi", "left_anti") else joined.drop("_key")


def components(links: DataFrame) -> DataFrame:
    """(node, component) with the smallest node reachable over the links (a, b), for every node of a link.

    Rounds of large-star and small-star on stored links: only minima per node are taken, and the edges of a hub
    are joined to its minimum by a join that may be split, so that no node's neighbours are gathered.
    Both columns are long and not null.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = stored(split_join(both.where("b > a"), low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = split_join(large, low, "a").select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = stored(tied.select("e.a", "e.b").where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
