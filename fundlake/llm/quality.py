"""Quality by histogram gradient-boosted trees over statistics of a document.

Statistics are counted over whole texts with numpy on the bytes of many documents at once. A model is boosted on a
bounded sample of labelled rows: values are cut into at most BINS bins by quantiles, each level of a tree picks the
best cut of every node from histograms of gradients, and all trees of one depth are laid out in arrays, so that a
batch of documents walks through all trees with a few numpy steps a level.

Defined results: a null or empty text has the statistics of an empty text and gets their score; labels other than 0
and 1 are left out; without labels of both kinds every text gets the same score (the share of 1 among the labels,
0.5 without labels); repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundlake.llm import hashing as H
from fundlake.llm.common import slices
from fundlake.llm.labelled import MOST_ROWS, checksum_mod, training_rows

BINS = 64
_KINDS = ("lower", "upper", "digit", "space", "newline", "stop", "comma", "pipe", "mark", "symbol", "bracket", "control", "high", "follow")


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, _KINDS.index("symbol"), np.int64)
    for name, members in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("control", range(32)),
                          ("space", b" \t"), ("newline", b"\n\r"), ("stop", b"."), ("comma", b",;:"), ("pipe", b"|"), ("mark", b"!?"),
                          ("bracket", b"()[]{}<>\"'"), ("high", range(192, 256)), ("follow", range(128, 192))):
        kinds[list(members)] = _KINDS.index(name)
    return kinds


_KIND_OF = _byte_kinds()
FEATURES = (*(f"share_{k}" for k in _KINDS), "log_bytes", "log_words", "word_length", "word_length_spread", "short_words",
            "distinct_words", "top_word", "repeated_pairs", "lines", "line_length", "repeated_lines", "ends_in_symbol", "all_upper",
            "stops_per_word")


def statistics(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    parts = [_slice_statistics(data, offsets) for _, _, data, offsets in slices(column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def _repeated(keys: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of distinct keys, count of the most frequent key) of each of n documents."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    head = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])]))
    many = np.diff(np.concatenate([head, [len(keys)]]))
    top = np.zeros(n)
    np.maximum.at(top, of[head], many)
    return np.bincount(of[head], minlength=n).astype(float), top


def _slice_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    kinds = _KIND_OF[data]
    counts = np.bincount(owner * len(_KINDS) + kinds, minlength=n * len(_KINDS)).reshape(n, -1).astype(float)
    start, end, first = H.words(data, offsets, H.SPACED)
    words = np.diff(first).astype(float)
    of = np.repeat(np.arange(n), np.diff(first))
    length = (end - start).astype(float)
    sums = H.prefix(data)
    hashes = H.stretch(sums, start, end)
    distinct, top = _repeated(hashes, of, n)
    inner = np.flatnonzero(of[1:] == of[:-1]) if len(of) else np.zeros(0, np.int64)
    pairs = H.mix(hashes[inner] * np.uint64(3) + hashes[inner + 1]) if len(inner) else hashes[:0]
    distinct_pairs, _ = _repeated(pairs, of[inner] if len(inner) else of[:0], n)
    is_text = np.ones(256, bool)
    is_text[[10, 13]] = False
    line_start, line_end, line_first = H.words(data, offsets, is_text)
    line_of = np.repeat(np.arange(n), np.diff(line_first))
    lines = np.diff(line_first).astype(float)
    distinct_lines, _ = _repeated(H.stretch(sums, line_start, line_end), line_of, n)
    last = kinds[end - 1] if len(end) else kinds[:0]
    odd = np.isin(last, [_KINDS.index(k) for k in ("symbol", "mark", "pipe", "bracket")])
    upper_until = np.concatenate([[0], np.cumsum(kinds == _KINDS.index("upper"))])
    lower_until = np.concatenate([[0], np.cumsum(kinds == _KINDS.index("lower"))])
    shouted = (upper_until[end] - upper_until[start] > 1) & (lower_until[end] == lower_until[start])

    def mean(values: np.ndarray, owners: np.ndarray, total: np.ndarray) -> np.ndarray:
        return np.bincount(owners, weights=values, minlength=n) / np.maximum(total, 1)

    average = mean(length, of, words)
    return np.column_stack([
        counts / np.maximum(size, 1)[:, None], np.log1p(size), np.log1p(words), average,
        np.sqrt(np.maximum(mean(length * length, of, words) - average * average, 0)), mean(length <= 3, of, words),
        distinct / np.maximum(words, 1), top / np.maximum(words, 1), 1 - distinct_pairs / np.maximum(words - 1, 1),
        np.log1p(lines), np.log1p(mean(line_end - line_start, line_of, lines)), 1 - distinct_lines / np.maximum(lines, 1),
        mean(odd, of, words), mean(shouted, of, words), counts[:, _KINDS.index("stop")] / np.maximum(words, 1)])


@dataclass
class Trees:
    """Boosted trees of one depth in arrays: inner nodes by tree in heap order, then leaf values."""

    feature: np.ndarray  # trees x (2**depth - 1)
    cut: np.ndarray
    leaf: np.ndarray  # trees x 2**depth
    base: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 for each row."""
        trees, inner = self.feature.shape
        node = np.zeros((len(x), trees), np.int64)
        every = np.arange(trees)[None, :]
        rows = np.arange(len(x))[:, None]
        for _ in range((inner + 1).bit_length() - 1):
            node = 2 * node + 1 + (x[rows, self.feature[every, node]] > self.cut[every, node])
        return 1 / (1 + np.exp(-np.clip(self.base + self.leaf[every, node - inner].sum(1), -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, penalty: float = 2.0,
          least: float = 1.0) -> Trees:
    """Fit by gradients and curvatures of the logistic loss. Ties between cuts go to the first feature and lowest cut."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    inner, width = 2 ** depth - 1, x.shape[1]
    model = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), base)
    if len(np.unique(y)) < 2:
        model.leaf[:] = 0
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(width)]
    bins = np.column_stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(width)])
    columns = np.arange(width)[None, :] * BINS + bins
    score = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            many, start = 2 ** level, 2 ** level - 1
            key = (node[:, None] * (width * BINS) + columns).ravel()
            size = many * width * BINS
            hist_g = np.bincount(key, np.repeat(g, width), size).reshape(many, width, BINS).cumsum(2)
            hist_h = np.bincount(key, np.repeat(h, width), size).reshape(many, width, BINS).cumsum(2)
            all_g, all_h = hist_g[:, :, -1:], hist_h[:, :, -1:]
            gain = (hist_g ** 2 / (hist_h + penalty) + (all_g - hist_g) ** 2 / (all_h - hist_h + penalty)
                    - all_g ** 2 / (all_h + penalty))
            gain[(hist_h < least) | (all_h - hist_h < least)] = -np.inf
            best = gain.reshape(many, -1).argmax(1)
            for k in range(many):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-9 and b < len(cuts[f]):
                    model.feature[t, start + k], model.cut[t, start + k] = f, cuts[f][b]
            # a node without a cut sends all rows to the left
            own = start + node
            node = 2 * node + (x[np.arange(len(y)), model.feature[t, own]] > model.cut[t, own])
        sum_g, sum_h = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
        model.leaf[t] = rate * sum_g / (sum_h + penalty)
        score = score + model.leaf[t, node]
    return model


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch.column("text"))
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.reshape(-1)))
        yield pa.RecordBatch.from_arrays([rows, batch.column("y")], ["x", "y"])


def learn(rows: DataFrame) -> Trees:
    """A model from (text, y). The rows are the bounded sample; only their statistics come to the driver."""
    found = (rows.select("text", F.col("y").cast("int").alias("y"), F.xxhash64("text").alias("h"))
             .mapInArrow(_described, "x array<double>, y int").toArrow())
    x = found["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if len(found) else np.zeros((0, len(FEATURES)))
    y = found["y"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the rows come in any order; the sums of a fit must not depend on it
    return boost(x[order], y[order])


def _scored(model: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 1024):
                part = batch.slice(at, 1024)
                score = model.probability(statistics(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    return run


def quality(docs: DataFrame, model: Trees) -> DataFrame:
    """One row per document: doc_id, score."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scored(model), f"doc_id {kind}, score double")


def learned_quality(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, threshold: float = 0.3,
                    most: int = MOST_ROWS) -> DataFrame:
    """Scores of all documents by a model learned from the labels that are not held out."""
    model = learn(training_rows(docs, labels, "quality", modulus, held_out, most))
    return quality(docs, model).select(
        "doc_id", (checksum_mod("doc_id", modulus) == held_out).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
