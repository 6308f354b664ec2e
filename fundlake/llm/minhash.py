"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations of the 32-bit universe make every coordinate of a signature: the first places a shingle, the second,
shifted circularly by k, ranks it for coordinate k. Bands of the signature collect candidates. Nothing is compared
pair by pair inside a bucket:

1. documents with the same shingle set become one class, its smallest id stands for it;
2. every class of a bucket meets the bucket's hub (its smallest id). A sketch (one byte of each coordinate) tells
   whether they can belong to one family at all; those that cannot choose hubs among themselves by their sketches,
   in pairs of blocks of a bounded size. Family members are compared with their hub on whole sets, which gives each
   member's difference from the hub;
3. two members that the hub does not already link can only be similar if they share a token of their prefixes, in the
   order "tokens outside the hub's set first". Members of a family larger than a block are grouped by such tokens,
   large groups are cut into pairs of blocks, and the similarity follows exactly from the differences.

Shingles are held as 64-bit hashes of hashed words; two different ones are equal with a chance of about 5e-20. A pair at the
threshold shares no band with a chance of at most 3e-7 (`bands_for`).

Defined results: a null or blank text has an empty set and no link; repeated rows are copies of each other; of several
texts with one id each counts and links on its own, so its rows may have different components; ids may be of any type that
has an order; a row with a null id takes no part (component_id and kept are null). Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from fundlake.llm import hashing as H
from fundlake.llm.common import components, flat_bytes, slices, split_join, stored

MISS = 3e-7  # greatest chance that a pair at the threshold meets in no band
MOST_COORDINATES = 200
FAMILY_GAP = 2.5  # a hub's family reaches to so many times the distance of a link
BLOCK = 1024  # members of a group that one task compares with as many others
_FACTORS = np.random.default_rng(77).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands_for(percent: int) -> tuple[int, int]:
    """(bands, rows per band): the longest rows that keep the chance of a miss below MISS within the signature's size."""
    for rows in range(10, 0, -1):
        p = (percent / 100) ** rows
        bands = 1 if p >= 1 else math.ceil(math.log(MISS) / math.log1p(-p))
        if bands * rows <= MOST_COORDINATES or rows == 1:
            return bands, rows
    raise AssertionError


def family_matches(percent: int, coordinates: int) -> int:
    """The least number of equal sketch bytes within a family.

    Two linked documents lie at most one link apart in Jaccard distance, which is a metric: if one of them is beyond
    FAMILY_GAP links from the hub, the other is beyond FAMILY_GAP - 1. The bound is set five deviations below the
    share expected at that distance, so a linked pair is not parted by its hub.
    """
    near = max(0.0, 1 - FAMILY_GAP * (1 - percent / 100))
    return max(0, math.floor(coordinates * near - 5 * math.sqrt(coordinates * near * (1 - near))))


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order."""
    for _, _, data, offsets in slices(column):
        data = H.LOWER[data]
        start, end, first = H.words(data, offsets, H.SPACED)
        word = H.tokens(data, start, end)
        runs = len(word) - size + 1
        if runs > 0:
            grams = word[:runs] * _FACTORS[0]
            for k in range(1, size):
                grams = grams + word[k:k + runs] * _FACTORS[k]
            grams = H.mix(grams)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= size:
                yield np.unique(grams[a:b - size + 1])
            elif b > a:
                yield H.mix((word[a:b] * _FACTORS[:b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def _permuted(x: np.ndarray) -> np.ndarray:
    """The second permutation of the 32-bit universe."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x85EBCA6B)
    x = x ^ (x >> np.uint32(13))
    x = x * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def _signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """One row per non-empty set. The shingle hashes are already a permutation's output; their low half is its place."""
    places = np.concatenate(sets).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    out = np.empty((len(sets), coordinates), np.uint32)
    for k in range(coordinates):
        out[:, k] = np.minimum.reduceat(_permuted(places - np.uint32(k)), starts)
    return out


def _described(size: int, bands: int, rows: int):
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = list(shingle_sets(part.column("text"), size))
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = np.zeros((len(full), bands), np.int64)
                sketches: list[bytes | None] = [None] * len(sets)
                if full:
                    signed = _signatures([sets[i] for i in full], bands * rows).astype(np.uint64).reshape(len(full), bands, rows)
                    for i, row in zip(full, signed.reshape(len(full), -1).astype(np.uint8), strict=True):
                        sketches[i] = row.tobytes()
                    keys = H.mix((signed * _FACTORS[:rows]).sum(2) + _FACTORS[None, :bands]).view(np.int64)
                ends = np.zeros(len(sets) + 1, np.int32)
                ends[np.array(full, np.int64) + 1] = bands
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(keys.reshape(-1))),
                    pa.array(sketches, pa.binary()),
                ], ["doc_id", "n_shingles", "digest", "bands", "sketch"])

    return run


def _gathered(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [s.tobytes() for s in shingle_sets(part.column("text"), size)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "tokens"])

    return run


def _tokens(column: pa.Array) -> list[np.ndarray]:
    data, offsets = flat_bytes(column)
    return [np.frombuffer(data[a:b].tobytes(), np.uint64) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _related(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ours, hub = (flat_bytes(batch.column(c))[0].reshape(batch.num_rows, -1) for c in ("sketch", "hub_sketch"))
            near = (ours == hub).sum(1) >= least
            yield pa.RecordBatch.from_arrays([batch.column("hub"), batch.column("member"), pa.array(near)], ["hub", "member", "near"])

    return run


def _dealt(least: int):
    """Hubs and their families within one cell of a bucket; every two rows that may be linked get a hub in common."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("member").sort_values("member")
        member = group["member"].to_numpy()
        sketch = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(len(group), -1)
        hubs, members = [], []
        while len(member) > 1:
            near = (sketch[1:] == sketch[0]).sum(1) >= least
            members.append(member[1:][near])
            hubs.append(np.full(len(members[-1]), member[0]))
            member, sketch = member[1:][~near], sketch[1:][~near]
        nothing = [np.zeros(0, np.int64)]
        return pd.DataFrame({"hub": np.concatenate(hubs or nothing), "member": np.concatenate(members or nothing)})

    return run


def _cells(rows: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """Rows (group, member, ...) in cells of at most two blocks such that every two rows of a group share a cell.

    groups: (group, n) with the number of rows of each group.
    """
    parts = groups.select(group, F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    rows = split_join(rows, parts, group).withColumn("part", F.pmod(F.hash("member"), "parts"))
    return rows.withColumn("cell", F.explode(F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda other: F.struct(F.least("part", other).alias("i"), F.greatest("part", other).alias("j"))))).drop("part", "parts")


def _families(banded: DataFrame, sketches: DataFrame, least: int) -> DataFrame:
    """Distinct (hub, member): every two classes of a bucket that can be linked have a hub in common."""
    hubs = banded.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    placed = stored(split_join(banded, hubs, "bucket").where("doc_id <> hub").select("bucket", "hub", F.col("doc_id").alias("member")))
    pairs = placed.select("hub", "member").distinct()
    pairs = split_join(pairs, sketches.select(F.col("doc_id").alias("member"), "sketch"), "member")
    pairs = split_join(pairs, sketches.select(F.col("doc_id").alias("hub"), F.col("sketch").alias("hub_sketch")), "hub")
    judged = stored(pairs.mapInArrow(_related(least), "hub long, member long, near boolean"))
    far = judged.where("not near").select(F.struct("hub", "member").alias("pair"))
    rest = stored(split_join(placed.withColumn("pair", F.struct("hub", "member")), far, "pair", "left_semi").select("bucket", "member"))
    open_buckets = rest.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    cells = split_join(_cells(rest, open_buckets, "bucket"), sketches.withColumnRenamed("doc_id", "member"), "member")
    dealt = cells.groupBy("bucket", "cell").applyInPandas(_dealt(least), "hub long, member long")
    return judged.where("near").select("hub", "member").unionByName(dealt).distinct()


def _compared(percent: int):
    """Each member against its hub: whether they link, and how the member differs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_hub", "n", "linked", "light", "added", "missing", "prefix")}
            for ours, hub in zip(_tokens(batch.column("tokens")), _tokens(batch.column("hub_tokens")), strict=True):
                added = np.setdiff1d(ours, hub, assume_unique=True)
                missing = np.flatnonzero(~np.isin(hub, ours, assume_unique=True)).astype(np.int32)
                both = len(hub) - len(missing)
                # a partner shares at least percent % of the tokens, so one of the first `length`
                length = len(ours) - -(-percent * len(ours) // 100) + 1
                out["n_hub"].append(len(hub))
                out["n"].append(len(ours))
                out["linked"].append(100 * both >= percent * (len(hub) + len(added)))
                out["light"].append(len(added) < length)
                out["added"].append(added.tobytes())
                out["missing"].append(missing.tobytes())
                out["prefix"].append(added[:length].view(np.int64))
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("hub"), batch.column("member"), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))],
                ["hub", "member", *out])

    return run


def _linked_in_block(percent: int):
    """Links between members of one group of a hub that do not both link to the hub; a spanning set of them."""
    def shared(columns: list[np.ndarray], rows: int) -> np.ndarray:
        """rows x rows: how many tokens each two rows share; tokens of a single row are left out first."""
        lengths = [len(c) for c in columns]
        flat = np.concatenate(columns) if columns else np.zeros(0, np.uint64)
        _, at, many = np.unique(flat, return_inverse=True, return_counts=True)
        keep = many[at] > 1
        row, col = np.repeat(np.arange(rows), lengths)[keep], at[keep]
        if len(col):
            _, col = np.unique(col, return_inverse=True)
        total = np.zeros((rows, rows), np.float32)
        width = int(col.max()) + 1 if len(col) else 0
        for a in range(0, width, 4096):
            now = (col >= a) & (col < a + 4096)
            dense = np.zeros((rows, min(4096, width - a)), np.float32)
            dense[row[now], col[now] - a] = 1
            total += dense @ dense.T
        return total

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("member").sort_values("member")
        hub, n_hub = int(group["hub"].iloc[0]), int(group["n_hub"].iloc[0])
        member, n, linked = group["member"].to_numpy(), group["n"].to_numpy(), group["linked"].to_numpy(bool)
        missing = [np.frombuffer(b, np.int32).astype(np.uint64) for b in group["missing"]]
        added = [np.frombuffer(b, np.uint64) for b in group["added"]]
        lost = np.array([len(m) for m in missing])
        common = n_hub - (lost[:, None] + lost[None, :] - shared(missing, len(group))) + shared(added, len(group))
        similar = 100 * common >= percent * (n[:, None] + n[None, :] - common)
        similar &= ~(linked[:, None] & linked[None, :])
        root = np.where(linked, -1, np.arange(len(group)))
        found = []
        for i in np.flatnonzero(~linked):
            for j in np.flatnonzero(similar[i]):
                if root[i] != root[j]:
                    found.append((member[i], member[j]))
                    root[root == max(root[i], root[j])] = min(root[i], root[j])
        return pd.DataFrame({"a": [int(a) for a, _ in found], "b": [int(b) for _, b in found]}, columns=["a", "b"]).astype("int64")

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id linked to it by a chain), kept.

    Two documents link if 100 * intersection >= percent * union of their sets of distinct runs of `words` words;
    a text of fewer words has its whole sequence as its one shingle.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    whole = isinstance(docs.schema["doc_id"].dataType, IntegralType)
    if whole and docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return _near_duplicates(docs.withColumn("doc_id", F.col("doc_id").cast("long")), words, percent)
    # ids that do not tell rows apart, or are no numbers: stored numbers of the rows stand for them
    numbered = stored(docs.withColumn("row", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())))
    found = stored(_near_duplicates(numbered.select(F.col("row").alias("doc_id"), "text"), words, percent)
                   .select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("component")))
    named = stored(split_join(found.where("row is not null"), numbered.where("row is not null").select("row", "doc_id"), "row"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    result = split_join(named, least, "component").select("doc_id", "n_shingles", "component_id").unionByName(
        found.where("row is null").select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_shingles",
                                          F.lit(None).cast(docs.schema["doc_id"].dataType).alias("component_id")))
    return result.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _near_duplicates(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The same for (doc_id, text) whose ids are long and different, or null."""
    bands, rows = bands_for(percent)
    described = stored(docs.mapInArrow(_described(words, bands, rows),
                                       "doc_id long, n_shingles long, digest binary, bands array<long>, sketch binary"))
    classes = stored(described.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")))
    ids = classes.select("doc_id").distinct()
    banded = split_join(described, ids, "doc_id", "left_semi", merge=True).select("doc_id", F.explode("bands").alias("bucket")).distinct()
    sketches = described.where("sketch is not null").select("doc_id", "sketch").dropDuplicates(["doc_id"])
    pairs = stored(_families(banded, sketches, family_matches(percent, bands * rows)))

    wanted = pairs.select(F.col("hub").alias("doc_id")).union(pairs.select("member")).distinct()
    sets = (split_join(docs.where("doc_id is not null"), wanted, "doc_id", "left_semi", merge=True)
            .mapInArrow(_gathered(words), "doc_id long, tokens binary"))
    sets = stored(sets.dropDuplicates(["doc_id"]))
    ours = split_join(pairs, sets.select(F.col("doc_id").alias("member"), "tokens"), "member")
    both = split_join(ours, sets.select(F.col("doc_id").alias("hub"), F.col("tokens").alias("hub_tokens")), "hub")
    compared = stored(both.mapInArrow(
        _compared(percent), "hub long, member long, n_hub long, n long, linked boolean, light boolean, "
                            "added binary, missing binary, prefix array<long>"))

    families = (compared.groupBy("hub").agg(F.count("*").alias("family"), F.count_if(~F.col("linked")).alias("n_open"))
                .where("family > 1 and n_open > 0").drop("n_open"))
    # a family that fits in a block is one group; in a larger one, members that can be similar share a token
    tokens = F.concat(F.transform("prefix", lambda t: F.struct(F.lit(0).alias("kind"), t.alias("token"))),
                      F.when(F.col("light"), F.array(F.struct(F.lit(1).alias("kind"), F.lit(0).cast("long").alias("token"))))
                      .otherwise(F.array()))
    whole = F.array(F.struct(F.lit(2).alias("kind"), F.lit(0).cast("long").alias("token")))
    grouped = split_join(compared.drop("added", "missing"), families, "hub").select(
        "hub", "member", "linked", F.explode(F.when(F.col("family") <= BLOCK, whole).otherwise(tokens)).alias("t"))
    grouped = grouped.select(F.struct("hub", "t.kind", "t.token").alias("place"), "member", "linked")
    open_groups = (grouped.groupBy("place").agg(F.count("*").alias("n"), F.count_if(~F.col("linked")).alias("n_open"))
                   .where("n > 1 and n_open > 0"))
    placed = _cells(grouped.drop("linked"), open_groups, "place")
    # the differences are joined by (hub, member), which no hub's size can skew
    placed = placed.withColumn("pair", F.struct("place.hub", "member")).drop("member")
    differing = compared.select(F.struct("hub", "member").alias("pair"), "member", "n_hub", "n", "linked", "added", "missing")
    cells = split_join(placed, differing, "pair").select("place.hub", "place", "cell", "member", "n_hub", "n", "linked", "added", "missing")
    further = cells.groupBy("place", "cell").applyInPandas(_linked_in_block(percent), "a long, b long")

    links = compared.where("linked").select(F.col("hub").alias("a"), F.col("member").alias("b")).unionByName(further)
    found = components(links)
    labelled = split_join(classes, found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "digest", F.coalesce("component", "doc_id").alias("component_id"))
    result = split_join(described.select("doc_id", "n_shingles", "digest"), labelled, "digest", "left")
    result = result.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id"))
                               .when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return result.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one row of each component left, all columns as they are.

    Documents without words link with nothing and stay. Of repeated rows with one id the one with the first text
    stays; rows with a null id take no part and stay.
    """
    kept = near_duplicates(docs, words, percent).where("kept").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").withColumn("_place", F.row_number().over(Window.partitionBy("doc_id").orderBy("text")))
    return named.where("_place = 1").select(*docs.columns).unionByName(docs.where("doc_id is null"))
