"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are told apart only through their first `window` bytes, most significant digits first, and only as far as they are
still equal to another one: equal groups at full depth are exactly the windows that occur more than once. What is dealt
out is not each of the suffixes but one in about 160, chosen by content: a window's anchor is the least of the
hashed grams that start in its first `reach` bytes, so equal windows have their anchor at the same offset. The windows of an
anchor are cut into blocks, and each pass deals out blocks by two digits:

* the core, which all windows of the block contain: if it occurs once, none of the windows is repeated;
* the extent, which contains all of them: if it occurs more than once, all of them are.

A pass's digits are longer stretches than those of the pass before (for 400 bytes: cores of 241, 361, 393 and 400). Blocks with a
repeated core and a single extent are cut into smaller blocks for the next pass, down to one window. Blocks with equal
extents take part in the next pass as one, so a passage that a third of all documents share is counted, never gathered.

A core's digit is a 64-bit hash that only proposes: a collision costs work. What is removed is decided by extents alone,
and these are told by 128-bit BLAKE2 digests of their bytes.

Defined results: a null text has no bytes; texts shorter than the window lose nothing; repeated rows are copies of
each other and lose all of their windows; rows with a null id keep their row; a very long text is worked on in
stretches of STRETCH bytes; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundlake.llm import hashing as H
from fundlake.llm.common import discard, flat_bytes, slices, split_join, stored

WINDOW = 400
STRETCH = 1 << 24  # bytes of a long text whose anchors are sought at once
_PLACE_BITS = np.uint64(28)  # of the position in a stretch with its margins


def reach_of(window: int) -> int:
    """Number of grams that can be a window's anchor: nearly the window, and so that blocks divide each other."""
    most = int(window * 0.88)
    return most // 40 * 40 if most >= 40 else 1 << max(0, most.bit_length() - 1)


def _blocks(reach: int) -> list[int]:
    """Windows per block in each pass: few enough new blocks for each one that is cut."""
    return sorted({reach // 2, reach // 8, reach // 40, 1} if reach >= 40 else {1}, reverse=True)


def _keys(id_column: str, text_column: str) -> Column:
    """128 bits that stand for a row's id and whole text: the same on every read of the table.

    Rows equal in both share the key, which is harmless as they get the same result; a null id is told from any other.
    """
    name = F.col(id_column).cast("string")
    told = F.concat(F.coalesce(F.length(name).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(name, F.lit("")),
                    F.coalesce(F.col(text_column), F.lit("")))
    return F.unhex(F.md5(told))


def anchors(sums: np.ndarray, offsets: np.ndarray, window: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, gram hashes) of all anchors of the texts that lie one after another."""
    gram = window - reach + 1
    n = int(offsets[-1])
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - gram + 1)
    hashes = H.stretch(sums, at, at + gram)
    # the least hash first, then the leftmost place
    least = (hashes >> _PLACE_BITS << _PLACE_BITS) | at.astype(np.uint64)
    span = 1
    while 2 * span <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < reach:  # two overlapping spans reach as far
        least = np.minimum(least[:span - reach], least[reach - span:])
    valid = np.ones(n, bool)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        valid[max(a, b - window + 1):b] = False
    found = np.zeros(n, bool)
    found[(least & np.uint64((1 << 28) - 1))[valid[:len(least)]].astype(np.int64)] = True
    at = np.flatnonzero(found)
    return at, hashes[at]


def _extent_keys(data: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Digests of data[low:high] together with where the anchor stands in it, 16 bytes each."""
    flat, digest = data.tobytes(), hashlib.blake2b
    found = b"".join([digest(flat[a:b], digest_size=16).digest() for a, b in zip(low.tolist(), high.tolist(), strict=True)])
    told = np.frombuffer(found, np.uint64).reshape(-1, 2).copy()
    told[:, 0] ^= H.mix((at - low).astype(np.uint64))
    return told.view("V16").reshape(-1)


def _as_binary(digests: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(digests), [None, pa.py_buffer(digests.tobytes())]).cast(pa.binary())


def _cut(sums: np.ndarray, data: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, start: np.ndarray, block: int,
         window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which blocks are real, cores, extents): the block of windows that start at - d, start <= d < start + block, within
    the text first to last."""
    low, high = np.maximum(first, at - start - block + 1), np.minimum(at - start, last - window)
    real = low <= high
    at, start, low, high, first, last = (x[real] for x in (at, start, low, high, first, last))
    # what all windows of the block contain, those beyond the text's ends too: it lies within every real one
    core = H.stretch(sums, at - start, at - start - block + 1 + window)
    # the offset belongs to the core's digit: equal strings at other offsets are another anchor's
    core = H.mix(core + start.astype(np.uint64))
    return real, core, _extent_keys(data, at, low, high + window)


def _stretches(column: pa.Array, window: int, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, int, int]]:
    """(first row, bytes, offsets, base, from, to): runs of short texts, or stretches of a long one with margins; windows
    that start at from to `to` - 1 are this stretch's, base is the place of its first byte in the text."""
    margin = window + reach
    for row, _, data, offsets in slices(column):
        if len(data) <= STRETCH + 2 * margin:
            yield row, data, offsets, 0, 0, len(data)
            continue
        for begin in range(0, len(data), STRETCH):
            a, b = max(0, begin - margin), min(len(data), begin + STRETCH + margin)
            yield row, data[a:b], np.array([0, b - a]), a, begin - a, min(begin + STRETCH, len(data)) - a


def _anchored(window: int, reach: int, block: int):
    """One row for each block of an anchor; blocks of one text that are equal are one row with several places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets, base, begin, end in _stretches(batch.column("text"), window, reach):
                sums = H.prefix(data)
                at, _ = anchors(sums, offsets, window, reach)
                at = at[(at >= begin) & (at < end)]
                if not len(at):
                    continue
                many = reach // block
                at, start = np.repeat(at, many), np.tile(np.arange(many) * block, len(at))
                of = np.searchsorted(offsets, at, "right") - 1
                real, core, extent = _cut(sums, data, at, offsets[of], offsets[of + 1], start, block, window)
                of, at, start = of[real], at[real], start[real]
                told = extent.view(np.uint64).reshape(-1, 2)
                order = np.lexsort((at, told[:, 1], told[:, 0], core, of))
                of, at, start, core, extent, told = (x[order] for x in (of, at, start, core, extent, told))
                new = np.concatenate([[True], (of[1:] != of[:-1]) | (core[1:] != core[:-1]) | (told[1:] != told[:-1]).any(1)])
                heads = np.flatnonzero(new)
                places = pa.ListArray.from_arrays(pa.array(np.append(heads, len(at)).astype(np.int32)),
                                                  pa.array((at - offsets[of] + base).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_key").take(pa.array(of[heads] + row)), pa.array(start[heads].astype(np.int32)),
                    pa.array(core[heads].view(np.int64)), _as_binary(extent[heads]), places], ["doc_key", "start", "core", "extent", "places"])

    return run


def _packed(window: int):
    """Texts for the joins: those long enough to lose something are compressed, of the others only the hash goes on."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, offsets = flat_bytes(batch.column("text"))
            packed, plain, size = [], [], np.diff(offsets)
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                text = data[a:b].tobytes()
                packed.append(pack.compress(text) if b - a >= window else None)
                plain.append(None if b - a >= window else hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_key"), batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(packed, pa.binary()),
                pa.array(plain, pa.string())], ["doc_key", "doc_id", "n_bytes", "packed", "sha256"])

    return run


def _contexts(window: int, reach: int):
    """What the windows of the marked anchors can contain, and how much of it stands before the anchor."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            keys, places, todo, before, after, around = [], [], [], [], [], []
            for key, packed, marks in zip(batch.column("doc_key"), batch.column("packed"), batch.column("marks").to_pylist(), strict=True):
                text = unpack.decompress(packed.as_py())
                for mark in marks:
                    at = mark["place"]
                    keys.append(key.as_py())
                    places.append(at)
                    todo.append(mark["todo"])
                    before.append(min(at, reach - 1))
                    after.append(min(len(text) - at, window))
                    around.append(text[max(0, at - reach + 1):at + window])
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, pa.binary()), pa.array(places, pa.int32()), pa.array(todo, pa.list_(pa.int32())), pa.array(before, pa.int32()),
                pa.array(after, pa.int32()), pa.array(around, pa.binary())], ["doc_key", "place", "todo", "before", "after", "around"])

    return run


def _digits(window: int, reach: int, block: int):
    """Core and extent of each block of `block` windows inside the blocks still to be done."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in slices(batch.column("around")):
                part = batch.slice(row, end - row)
                sums = H.prefix(data)
                first, last = offsets[:-1], offsets[1:]
                at = first + part.column("before").to_numpy()
                todo = part.column("todo")
                owner = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(todo).to_numpy())
                start = todo.flatten().to_numpy().astype(np.int64)
                outer = part.column("outer").to_numpy()[owner]
                many = outer // block
                owner, start = np.repeat(owner, many), np.repeat(start, many)
                start = start + block * (np.arange(len(start)) - np.repeat(np.cumsum(many) - many, many))
                real, core, extent = _cut(sums, data, at[owner], first[owner], last[owner], start, block, window)
                yield pa.RecordBatch.from_arrays([
                    part.column("context").take(pa.array(owner[real])), pa.array(start[real].astype(np.int32)),
                    pa.array(core.view(np.int64)), _as_binary(extent)], ["context", "start", "core", "extent"])

    return run


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The measures of each document without its spans."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        removed, many, digests, spans = [], [], [], []
        rows = zip(batch.column("n_bytes").to_pylist(), batch.column("packed"), batch.column("sha256").to_pylist(),
                   batch.column("spans").to_pylist(), strict=True)
        for size, packed, digest, found in rows:
            runs: list[list[int]] = []
            for span in sorted((max(0, s["a"]), min(size, s["b"])) for s in found or ()):
                if runs and span[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], span[1])
                else:
                    runs.append(list(span))
            if digest is None:
                text, at = unpack.decompress(packed.as_py()), 0
                kept = hashlib.sha256()
                for a, b in runs:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                digest = kept.hexdigest()
            removed.append(sum(b - a for a, b in runs))
            many.append(len(runs))
            digests.append(digest)
            spans.append([{"a": a, "b": b} for a, b in runs])
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(many, pa.int64()),
            pa.array(digests, pa.string()), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def _dealt(rows: DataFrame, n: Column, item: Column) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """One pass over rows (core, extent, ...), each of which stands for n blocks and is named by its item: (rows whose extent
    is repeated, (item) of one row for each class of a core that has several classes, stores that these two read)."""
    twice = rows.groupBy("core").agg(F.sum(n).alias("m")).where("m > 1").select("core")
    rows = stored(split_join(rows, twice, "core", "left_semi", merge=True), free=True)
    classes = stored(rows.groupBy("core", "extent").agg(F.sum(n).alias("m"), F.min(item).alias("item")), free=True)
    again = classes.where("m > 1").select(F.struct("core", "extent").alias("whole"))
    several = classes.groupBy("core").agg(F.count("*").alias("k")).where("k > 1").select("core")
    rest = split_join(classes.select("core", "item"), several, "core", "left_semi")
    return split_join(rows.withColumn("whole", F.struct("core", "extent")), again, "whole", "left_semi"), rest.select("item"), [rows, classes]


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_key, a, b): spans of bytes, overlapping ones too, that repeated windows cover. docs: doc_key, doc_id, text."""
    reach = reach_of(window)
    outer, *blocks = _blocks(reach)
    found = docs.select("doc_key", "text").where(F.octet_length("text") >= window).mapInArrow(
        _anchored(window, reach, outer), "doc_key binary, start int, core long, extent binary, places array<int>")
    found = stored(found, free=True)
    repeated, rest, done = _dealt(found, F.size("places"), F.struct("doc_key", F.col("places")[0].alias("place"), "start"))
    # a block's windows start `start` to `start + block - 1` bytes before the anchor; beyond the text's ends they are cut later
    spans = [stored(repeated.select("doc_key", "start", F.explode("places").alias("place")).select(
        "doc_key", F.greatest(F.lit(0), F.col("place") - F.col("start") - outer + 1).cast("long").alias("a"),
        (F.col("place") - F.col("start") + window).cast("long").alias("b")), free=True)]
    if not blocks:
        return spans[0]

    marks = (rest.groupBy("item.doc_key", "item.place").agg(F.collect_set("item.start").alias("todo"))
             .groupBy("doc_key").agg(F.collect_list(F.struct("place", "todo")).alias("marks")))
    # a repeated row brings its contexts twice; as all of its windows are repeated, that marks nothing wrongly
    texts = docs.mapInArrow(_packed(window), _packed_schema(docs)).where("packed is not null").select("doc_key", "packed")
    contexts = split_join(texts, marks, "doc_key", merge=True).mapInArrow(
        _contexts(window, reach), "doc_key binary, place int, todo array<int>, before int, after int, around binary")
    contexts = stored(contexts.withColumn("context", F.monotonically_increasing_id()), free=True)  # from here on read from files
    discard(found, *done)
    todo = contexts
    for block in blocks:
        digits = stored(todo.select("context", "before", "around", "todo", F.lit(outer).alias("outer")).mapInArrow(
            _digits(window, reach, block), "context long, start int, core long, extent binary"), free=True)
        repeated, rest, done = _dealt(digits, F.lit(1), F.struct("context", "start"))
        # the windows of a block start `start` to `start + block - 1` bytes before the anchor, within the text
        spans.append(stored(split_join(repeated.select("context", "start"), contexts.select("context", "doc_key", "place", "before", "after"), "context").select(
            "doc_key", (F.col("place") - F.least(F.col("before"), F.col("start") + block - 1)).cast("long").alias("a"),
            (F.col("place") + F.least(F.col("after"), window - F.col("start"))).cast("long").alias("b")), free=True))
        if block > 1:
            where = stored(rest.groupBy("item.context").agg(F.collect_set("item.start").alias("todo")), free=True)
            todo = split_join(contexts.drop("todo"), where, "context")
            outer = block
        discard(digits, *done)
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out


def _packed_schema(docs: DataFrame) -> str:
    return f"doc_key binary, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, packed binary, sha256 string"


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (the removed runs of bytes)."""
    keyed = docs.select(_keys("doc_id", "text").alias("doc_key"), "doc_id", "text")
    spans = repeated_spans(keyed, window).groupBy("doc_key").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    texts = keyed.mapInArrow(_packed(window), _packed_schema(keyed))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return split_join(texts, spans, "doc_key", "left", merge=True).mapInArrow(
        _removed, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a: long, b: long>>")
