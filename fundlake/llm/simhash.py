"""Near-duplicate documents by SimHash: pigeonhole blocks of the fingerprint, a join on blocks, Hamming verification.

A fingerprint has 64 bits, cut into six blocks. Fingerprints that differ in at most three bits differ in at most three
blocks, so they agree on three whole blocks: each fingerprint goes into the 20 cells of its block triples (30 to 33
fixed bits each), and two close ones meet in at least one of them. What a cell holds is verified:

1. equal fingerprints become one row first, so a group of copies of any size is a single member of a cell;
2. cells are counted on the map side. A cell of two is verified from its least and greatest member without moving a row;
3. the members of a cell of up to CELL are compared in one task, which gives the cell's components, not its pairs;
4. a larger cell is cut again in the same way: three of six blocks of the bits that its key leaves open. The open bits
   fall to half with each round, so after three rounds a cell cannot hold more than CELL fingerprints.

Links give the components. No pair of documents is ever listed, only fingerprints that are linked.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; a text of fewer words than
a shingle is one shingle; repeated rows and ids give a row each, and each belongs to its own text's component; a row
with a null id takes part, is returned with a null doc_id, and never names a component (which is null if it has no
other id). A very long text is hashed in slices. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlake.llm.common import components, split_join, stored

BITS, BLOCKS, CLOSE = 64, 6, 3
CELL = 1024  # fingerprints that one task compares with each other
SEED = 42
SLICE = 1 << 16  # shingles hashed at once
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str, size: int) -> int:
    """The bits that are set in over half of the shingles' hashes."""
    import xxhash

    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    first = np.concatenate([[0], ends[:-1] + 1])
    size = min(size, len(words))
    starts, ends = first[:len(words) - size + 1].tolist(), ends[size - 1:].tolist()
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), SLICE):
        digests = b"".join(xxhash.xxh64_digest(joined[a:b], SEED) for a, b in zip(starts[at:at + SLICE], ends[at:at + SLICE], strict=True))
        total += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, BITS // 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(starts)).tobytes(), "big", signed=True)


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py() or "", size) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return run


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def triples(fixed: int) -> list[int]:
    """The masks that fix three of six blocks of the bits that are open in `fixed`, those of `fixed` included."""
    free = [b for b in range(BITS) if not fixed >> b & 1]
    blocks = [sum(1 << int(b) for b in part) for part in np.array_split(np.array(free, np.int64), BLOCKS)]
    return [fixed | a | b | c for a, b, c in itertools.combinations(blocks, BLOCKS - CLOSE)]


def _close(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= CLOSE


def _cell_links(group: pd.DataFrame) -> pd.DataFrame:
    """A spanning set of links of one cell: every member with the least member of its component."""
    fp = np.unique(group["fp"].to_numpy())
    differing = np.bitwise_count(fp.view(np.uint64)[:, None] ^ fp.view(np.uint64)[None, :])
    near, label = differing <= CLOSE, np.arange(len(fp))
    while True:
        lower = np.where(near, label[None, :], len(fp)).min(1)
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    member = label != np.arange(len(fp))
    return pd.DataFrame({"a": fp[member], "b": fp[label[member]]})


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) of distinct fingerprints (fp long) such that close ones are connected."""
    spark: SparkSession = prints.sparkSession
    masks, links = [0], []
    members = prints.select("fp", F.lit(0).cast("long").alias("mask"))
    while True:
        # the masks are constants of the method: 20, 400 and 8,000 of them
        steps = {m: [_signed(x) for x in triples(m)] for m in masks}
        if len(masks) == 1:
            cut = members.select("fp", F.explode(F.lit(steps[0])).alias("mask"))  # distinct, as the fingerprints are
        else:
            table = spark.createDataFrame([(_signed(m), s) for m, s in steps.items()], "mask long, next array<long>")
            cut = members.join(F.broadcast(table), "mask").select("fp", F.explode("next").alias("mask")).distinct()
        cells = cut.select(F.struct("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key")).alias("cell"), "fp")
        counted = stored(cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
        links.append(counted.where((F.col("n") == 2) & _close(F.col("a"), F.col("b"))).select("a", "b"))
        placed = stored(split_join(cells, counted.where("n > 2").select("cell", "n"), "cell"))
        links.append(placed.where(F.col("n") <= CELL).groupBy("cell").applyInPandas(_cell_links, "a long, b long"))
        members = placed.where(F.col("n") > CELL).select("fp", "cell.mask").distinct()
        if members.isEmpty():
            break
        masks = sorted({x for m in masks for x in triples(m)})
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out.distinct()


def near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest id linked to it by a chain), kept."""
    prints = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints(words), "doc_id long, fp long"))
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = stored(components(fingerprint_links(classes.select("fp"))))
    grouped = split_join(classes, found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    named = split_join(grouped, least, "component").select("fp", "component_id")
    return split_join(prints, named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), BITS // 4, "0")).alias("fingerprint"), "component_id",
        (F.col("doc_id") == F.col("component_id")).alias("kept"))
