"""Hard negatives by an STR-packed R-tree over integer vectors, one tree per shard.

Rows are dealt into shards by a hash. A shard's tree is packed by sort-tile-recursive cuts: the rows are sorted by one
coordinate and cut into slabs, each slab by the next one, and so on down to leaves of LEAF rows; FAN boxes make one of
the level above. A box has the least and the greatest value of every coordinate, which bound the inner product with an
anchor from both sides: each coordinate contributes an interval.

A search keeps the boxes in a queue, best upper bound first. A box is left out if its interval lies outside all score
windows, or if in every window its best possible score is strictly below the k-th found. The search ends when the best
box in the queue is of no use to any window. Each window is answered exactly.

Two searches run: the positives of an anchor (same label, one window without bounds), then the negatives (other labels,
one window for each distinct score of its positives). Shards hold the rows first and then stream the anchors, batch by
batch, so a task holds one shard and one batch whatever the number of anchors; nothing is copied per block of anchors.
Each shard sends at most k rows per anchor and window; the k best of all shards are taken by a limited window, of
which Spark keeps k rows before the shuffle as well. A shard has about SPAN * sqrt(rows) vectors, at most SHARD: both
the anchors' copies (one per shard) and the shards' size grow with the root of the table.

Scores are exact: products run in double while they fit in 53 bits, in 64-bit integers while they fit in those, else in
Python integers; an inner product outside 64 bits raises OverflowError, since no long can return it.

Defined results: a row with a null id, label or vector, or with a null or non-finite component takes no part; of rows
with one id the least by (label, vector) counts; vectors of another length than the most frequent (ties: longest) take
no part; an anchor without other rows of its label gives no rows, a positive without negatives in its window neither;
a negative positive score has an empty window; equal scores go by smaller id; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundlake.llm.common import split_join, stored

LEAF, FAN = 128, 16
SPAN, SHARD = 24, 1 << 18  # a shard has SPAN * sqrt(rows) vectors, SHARD at most
LEAST_SHARD = 2048
SCALE = 256
UNBOUNDED = (-math.inf, math.inf)


def integer_rows(vectors: DataFrame, changed_every: int = 7, labels: int = 10) -> DataFrame:
    """(vec_id, label, q): each component as floor(SCALE * x); where the id is divisible by `changed_every`, the label
    first becomes (label + 1) % labels (0: never)."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~bad)
    label = F.col("label")
    if changed_every:
        label = F.when(F.col("vec_id") % changed_every == 0, (label + 1) % labels).otherwise(label)
    scaled = F.transform("x", lambda v: F.when(F.abs(v * SCALE) < 2.0 ** 62, F.floor(v * SCALE)).otherwise(
        F.raise_error(F.lit("a component is too large for an inner product in 64 bits"))))
    rows = rows.select("vec_id", label.alias("label"), scaled.alias("q"))
    one = stored(rows.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.label", "r.q"))
    # the number of distinct lengths is that of models, not of rows
    length = one.groupBy(F.size("q").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return one if length is None else one.where(F.size("q") == length.d)


def _order(q: np.ndarray) -> np.ndarray:
    """Rows in packed order: sort-tile-recursive over the coordinates of the greatest spread."""
    spread = np.argsort(-q.astype(np.float64).var(0), kind="stable") if q.size else np.zeros(0, np.int64)
    out: list[np.ndarray] = []

    def tile(rows: np.ndarray, depth: int) -> None:
        leaves = math.ceil(len(rows) / LEAF)
        if leaves <= 1 or depth == len(spread):
            out.append(rows)
            return
        left = min(len(spread) - depth, max(1, math.ceil(math.log2(leaves))))
        slabs = math.ceil(leaves ** (1 / left) - 1e-9)
        size = math.ceil(leaves / slabs) * LEAF
        rows = rows[np.argsort(q[rows, spread[depth]], kind="stable")]
        for at in range(0, len(rows), size):
            tile(rows[at:at + size], depth + 1)

    tile(np.arange(len(q)), 0)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Tree:
    """The packed rows of a shard and the boxes of every level, leaves first."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray) -> None:
        # rows of one place in order of their ids, so that ties within a leaf come in the order wanted
        by_id = np.argsort(ids, kind="stable")
        order = by_id[_order(q[by_id])]
        self.ids, self.labels, self.q = ids[order], labels[order], q[order]
        self.most = int(max(abs(int(q.min())), abs(int(q.max())))) if q.size else 0
        starts = np.arange(0, len(q), LEAF)
        low, high, least = np.minimum.reduceat(self.q, starts), np.maximum.reduceat(self.q, starts), np.minimum.reduceat(self.ids, starts)
        self.levels = [(low, high, least)]
        while len(least) > 1:
            starts = np.arange(0, len(least), FAN)
            low, high, least = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.minimum.reduceat(least, starts)
            self.levels.append((low, high, least))
        self._casts: dict[object, tuple] = {}

    def _as(self, kind) -> tuple:
        """Rows and boxes as numbers of one kind."""
        if kind not in self._casts:
            self._casts = {kind: (self.q.astype(kind), [(a.astype(kind), b.astype(kind)) for a, b, _ in self.levels])}
        return self._casts[kind]

    def search(self, anchor: np.ndarray, anchor_id: int, label: int, same: bool, windows: Sequence[tuple[float, float]],
               k: int) -> list[list[tuple[int, int]]]:
        """For each window (low, high) the k best (score, id) of rows with the same label (or with another one)."""
        bound = self.q.shape[1] * self.most * max((abs(int(v)) for v in anchor), default=0)
        kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object
        rows, levels = self._as(kind)
        a = anchor.astype(kind)
        up, down = np.maximum(a, 0), np.minimum(a, 0)
        found: list[list[tuple[int, int]]] = [[] for _ in windows]  # heaps of (score, -id), the worst on top

        def useful(worst: int, best: int, least_id: int) -> bool:
            for (low, high), heap in zip(windows, found, strict=True):
                if best >= low and worst <= high and (len(heap) < k or (min(best, high), -least_id) > heap[0]):
                    return True
            return False

        top = len(self.levels) - 1
        queue: list[tuple[int, int, int, int]] = []

        def push(level: int, first: int, end: int) -> None:
            low, high = levels[level]
            most = high[first:end] @ up + low[first:end] @ down
            least = low[first:end] @ up + high[first:end] @ down
            for i in range(end - first):
                best, worst = int(most[i]), int(least[i])
                if useful(worst, best, int(self.levels[level][2][first + i])):
                    heapq.heappush(queue, (-best, level, first + i, worst))

        push(top, 0, len(self.levels[top][2]))
        while queue:
            best, level, at, worst = heapq.heappop(queue)
            if not useful(worst, -best, int(self.levels[level][2][at])):
                continue
            if level:
                push(level - 1, at * FAN, min((at + 1) * FAN, len(self.levels[level - 1][2])))
                continue
            part = slice(at * LEAF, (at + 1) * LEAF)
            scores = rows[part] @ a
            fits = (self.labels[part] == label) == same
            fits &= self.ids[part] != anchor_id
            for (low, high), heap in zip(windows, found, strict=True):
                for i in np.flatnonzero(fits & (scores >= low) & (scores <= high)):
                    item = (int(scores[i]), -int(self.ids[part][i]))
                    if len(heap) < k:
                        heapq.heappush(heap, item)
                    elif item > heap[0]:
                        heapq.heapreplace(heap, item)
        return [[(s, -i) for s, i in sorted(heap, reverse=True)] for heap in found]


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _searched(same: bool, k: int):
    """Rows of shards (kind 0), each followed by the anchors (kind 1), to the k best per anchor and window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, tree = None, [], None
        for batch in batches:
            shards, kinds = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                piece = batch.slice(a, b - a)
                if shards[a] != shard:
                    shard, parts, tree = shards[a], [], None
                if kinds[a] == 0:
                    parts.append(piece)
                    continue
                if tree is None and parts:
                    tree = Tree(*(np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("vec_id", "label")),
                                np.concatenate([_matrix(p.column("q")) for p in parts]))
                    parts = []
                if tree is None:
                    continue
                out: list[list] = [[], [], [], []]
                anchors = piece.column("vec_id").to_numpy(), piece.column("label").to_numpy(), _matrix(piece.column("q"))
                for anchor, label, q, scores in zip(*anchors, piece.column("scores").to_pylist(), strict=True):
                    # 80 * positive <= 100 * negative <= 100 * positive
                    windows = [(-(-80 * s // 100), s) for s in scores] if scores is not None else [UNBOUNDED]
                    for window, best in zip(scores if scores is not None else [None], tree.search(q, int(anchor), int(label), same, windows, k), strict=True):
                        for score, vec_id in best:
                            for column, value in zip(out, (int(anchor), window, score, vec_id), strict=True):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["anchor_id", "window", "score", "vec_id"])

    return run


def _best(rows: DataFrame, anchors: DataFrame, same: bool, k: int, shards: int) -> DataFrame:
    """(anchor_id, window, rank, score, vec_id): the k best of all shards."""
    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"),
                        "vec_id", "label", "q", F.lit(None).cast("array<long>").alias("scores"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "label", "q", "scores")
    together = dealt.unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind", "vec_id")
    found = together.mapInArrow(_searched(same, k), "anchor_id long, window long, score long, vec_id long")
    place = F.row_number().over(Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, changed_every: int = 7, labels: int = 10) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors whose id is divisible by `every`."""
    rows = stored(integer_rows(vectors, changed_every, labels))
    n = rows.count()
    shards = max(1, math.ceil(n / min(SHARD, max(LEAST_SHARD, SPAN * math.isqrt(n)))))
    anchors = rows.where(F.col("vec_id") % every == 0)
    best = _best(rows, anchors.withColumn("scores", F.lit(None).cast("array<long>")), True, positives, shards)
    chosen = stored(best.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    asked = chosen.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_set("positive_score")).alias("scores"))
    found = _best(rows, split_join(anchors, asked, "vec_id"), False, negatives, shards).select(
        F.struct("anchor_id", F.col("window").alias("score")).alias("asked"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    wanted = chosen.withColumn("asked", F.struct("anchor_id", F.col("positive_score").alias("score")))
    return split_join(wanted, found, "asked").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
