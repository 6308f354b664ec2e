"""Benchmark decontamination by a prefix-filtered join on whole texts.

A window is `size` consecutive words of a benchmark item (a shorter item is one window). Its shingles (runs of
`SHINGLE` words) are ordered by rarity over all documents. A document that contains the window contains every shingle
of it, so the necessary prefix is the rarest one: only document positions that hold it are candidates. The window's
place around that position must lie in the document (positional and length bound), and then its words are compared
one by one.

The benchmark is taken in blocks of a bounded number of words. Each block is sent to all tasks, and every block runs
over all documents, so a benchmark of any size costs more passes and no more memory.

Defined results: a null or wordless text has no words and no hit; a null or wordless item has no window; an item with
a null id marks words but is not counted among the items; repeated rows each get their own result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundlake.llm import hashing as H
from fundlake.llm.common import row_key, slices

SHINGLE = 3
BLOCK_WORDS = 200_000  # of benchmark text in one block: some 25 MB on each worker
PIECE_WORDS = 2_000  # new words in one piece of a long item
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FACTORS = np.random.default_rng(41).integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    """The words of one text as lower-case bytes."""
    data = H.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    start, end, _ = H.words(data, np.array([0, len(data)]), H.ALNUM)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(start, end, strict=True)]


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return H.stretch(H.prefix(data), start, end)


def _shingles(word: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words, runs across two texts included."""
    runs = len(word) - size + 1
    if runs <= 0:
        return np.zeros(0, np.uint64)
    out = word[:runs] * _FACTORS[0]
    for k in range(1, size):
        out = out + word[k:k + runs] * _FACTORS[k]
    return H.mix(out + np.uint64(size))


class Windows:
    """The distinct windows of a block of items, ready to be looked up."""

    def __init__(self, items: list[tuple[object, str | None]], size: int):
        found: dict[tuple[bytes, ...], set[str]] = {}
        for item_id, text in items:
            item = words_of(text)
            width = min(size, len(item))
            for at in range(len(item) - width + 1 if width else 0):
                found.setdefault(tuple(item[at:at + width]), set()).update([] if item_id is None else [str(item_id)])
        self.windows = list(found)
        self.items = [sorted(x) for x in found.values()]
        #: Every window's shingle hashes in order, by the shingle's length.
        self.keys = [self._hashes(w) for w in self.windows]

    @staticmethod
    def _hashes(window: tuple[bytes, ...]) -> np.ndarray:
        data = np.frombuffer(b"".join(window), np.uint8)
        ends = np.cumsum([len(w) for w in window])
        return _shingles(_word_hashes(data, ends - [len(w) for w in window], ends), min(SHINGLE, len(window)))

    def counted(self) -> dict[int, np.ndarray]:
        """The distinct shingle hashes by shingle length."""
        out = {}
        for n in range(1, SHINGLE + 1):
            some = [k for w, k in zip(self.windows, self.keys, strict=True) if min(SHINGLE, len(w)) == n]
            out[n] = np.unique(np.concatenate(some)) if some else np.zeros(0, np.uint64)
        return out

    def choose(self, frequency: dict[int, int]) -> None:
        """Take each window's rarest shingle (ties: the smaller hash) as the one to look for."""
        chosen = {n: [] for n in range(1, SHINGLE + 1)}
        for i, (window, keys) in enumerate(zip(self.windows, self.keys, strict=True)):
            at = min(range(len(keys)), key=lambda k: (frequency.get(int(keys[k]), 0), int(keys[k])))
            chosen[min(SHINGLE, len(window))].append((int(keys[at]), at, i))
        self.chosen = {}
        for n, rows in chosen.items():
            rows.sort()
            self.chosen[n] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64),
                              np.array([r[2] for r in rows], np.int64))


def _counts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value.counted()
        seen = {n: np.zeros(len(keys), np.int64) for n, keys in wanted.items()}
        for batch in batches:
            for _, _, data, offsets in slices(batch.column("text")):
                data = H.LOWER[data]
                start, end, first = H.words(data, offsets, H.ALNUM)
                word = _word_hashes(data, start, end)
                left = np.repeat(first[1:], np.diff(first)) - np.arange(len(start))
                for n, keys in wanted.items():
                    if len(keys):
                        got = _shingles(word, n)[left[:max(0, len(word) - n + 1)] >= n]
                        at = np.searchsorted(keys, got)
                        at = at[keys[np.minimum(at, len(keys) - 1)] == got]
                        seen[n] += np.bincount(at, minlength=len(keys))
        for n, keys in wanted.items():
            now = seen[n] > 0
            yield pa.RecordBatch.from_arrays([pa.array(keys[now].view(np.int64)), pa.array(seen[n][now])], ["shingle", "n"])

    return run


def _hits(shared, every_row: bool):
    kinds = [pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            rows, n_words, spans, items = [], [], [], []
            for row, _, data, offsets in slices(batch.column("text")):
                data = H.LOWER[data]
                start, end, first = H.words(data, offsets, H.ALNUM)
                word = _word_hashes(data, start, end)
                found: dict[int, tuple[list, set]] = {}
                for n, (keys, places, windows) in block.chosen.items():
                    if not len(keys):
                        continue
                    got = _shingles(word, n)
                    low = np.searchsorted(keys, got, "left")
                    for p in np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == got):
                        of = int(np.searchsorted(first, p, "right")) - 1
                        for k in range(low[p], int(np.searchsorted(keys, got[p], "right"))):
                            window = block.windows[windows[k]]
                            a = p - places[k]
                            b = a + len(window)
                            if a < first[of] or b > first[of + 1]:
                                continue
                            if all(data[start[a + j]:end[a + j]].tobytes() == w for j, w in enumerate(window)):
                                own = found.setdefault(of, ([], set()))
                                own[0].append((int(a - first[of]), int(b - first[of])))
                                own[1].update(block.items[windows[k]])
                counts = np.diff(first)
                for of in range(len(counts)) if every_row else sorted(found):
                    own = found.get(of, ((), ()))
                    rows.append(row + of)
                    n_words.append(int(counts[of]))
                    spans.append([{"a": a, "b": b} for a, b in own[0]])
                    items.append(sorted(own[1]))
            picked = batch.select(["doc_key", "doc_id"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*picked.columns, *(pa.array(v, t) for v, t in zip((n_words, spans, items), kinds, strict=True))],
                ["doc_key", "doc_id", "n_words", "spans", "items"])

    return run


def blocks_of(benchmark: DataFrame, size: int) -> Iterator[Windows]:
    """The benchmark in blocks of about BLOCK_WORDS words, dealt by a hash of the piece.

    Repeated items count once, and items of more than PIECE_WORDS words are cut into pieces that overlap by all words of a
    window but one, so that every window lies in a piece and neither copies nor one long item fill a block.
    """
    words = F.regexp_extract_all(F.translate("text", ascii_uppercase, ascii_lowercase), F.lit(WORD), F.lit(0))
    items = (benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").distinct()
             .select("item_id", words.alias("words")).where(F.size("words") > 0))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)), F.lit(PIECE_WORDS))
    pieces = items.select("item_id", F.explode(F.transform(starts, lambda at: F.array_join(
        F.slice("words", at + 1, PIECE_WORDS + size - 1), " "))).alias("text")).distinct()
    total = pieces.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // (4 * BLOCK_WORDS)))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for part in range(n):
        yield Windows([(r.item_id, r.text) for r in dealt.where(F.col("part") == part).collect()], size)


def _covered(spans: Column) -> Column:
    """How many positions the spans cover together."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(F.array_sort(spans), zero, lambda s, x: F.struct(
        (s["n"] + F.greatest(F.lit(0).cast("long"), x["b"] - F.greatest(s["end"], x["a"]))).alias("n"),
        F.greatest(s["end"], x["b"]).alias("end")), lambda s: s["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items."""
    spark = docs.sparkSession
    texts = docs.select(row_key("doc_id", "text").alias("doc_key"), "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = []
    for block in blocks_of(benchmark, size):
        seen = (docs.select("text").mapInArrow(_counts(spark.sparkContext.broadcast(block)), "shingle long, n long")
                .groupBy("shingle").agg(F.sum("n").alias("n")).collect())  # at most one row per shingle of the block
        block.choose({r.shingle % (1 << 64): r.n for r in seen})
        parts.append(texts.mapInArrow(
            _hits(spark.sparkContext.broadcast(block), not parts),
            f"doc_key binary, doc_id {kind}, n_words long, spans array<struct<a: long, b: long>>, items array<string>")
            .withColumn("first", F.lit(not parts)))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    # one row per distinct document and block at most; repeated rows are counted and given back
    merged = rows.groupBy("doc_key", "doc_id", "n_words").agg(
        F.count_if("first").alias("copies"),
        F.flatten(F.collect_set("spans")).alias("spans"),
        F.flatten(F.collect_set("items")).alias("items"))
    merged = merged.withColumn("items", F.array_sort(F.array_distinct("items")))
    return merged.select(
        "doc_id", "n_words", _covered(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"), "items", "doc_key",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy")).drop("_copy")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The documents without any hit, all columns as they are."""
    bad = contamination(docs, benchmark, size).where("contaminated").select("doc_key").distinct()
    keyed = docs.withColumn("_doc_key", row_key("doc_id", "text"))
    return keyed.join(bad.withColumnRenamed("doc_key", "_doc_key"), "_doc_key", "left_anti").select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, w, least(len(w), 10) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS q FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS i FROM b)),
own AS (SELECT r, n, i, list_slice(w, i, i + n - 1) AS q
        FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM win))),
hit AS (SELECT own.r, own.n, own.i, win.item_id FROM own JOIN win USING (n, q)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
          FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""
