"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Rows are dealt into shards of a bounded number of vectors by a hash of the id. In each shard a graph is built: it
starts with random edges; greedy beam searches from the entry point propose neighbours for every vector, and relaxed
pruning keeps those that no kept neighbour already covers (a candidate is dropped if alpha times its distance from a
kept one is below its distance from the vector). Back edges are pruned in the same way. A query is searched in every
shard by beam search, and the shards' answers are merged to the k nearest.

A graph's nodes are the distinct vectors of its shard (in single precision), since copies of a vector would cover each
other and everything else in the pruning. A node found stands for all its rows: of rows equal in every component the
k + 1 smallest ids are compared, more cannot be among the k nearest besides the query itself.

Searches of many points run together: one step expands the best open candidate of each of them with numpy. Distances
during a search are single precision, on vectors divided by a power of two near the shard's largest component; a query
far outside the shard is drawn near along its direction for the search. The returned distances are recomputed in double
precision on the original vectors, each scaled by a power of two, so that no square leaves the range of doubles. In a
shard whose vectors differ by some 1e18 in magnitude the small ones are one node.

The shards hold all vectors, none is left out. The query set is sent to the shards in blocks of QUERY_BLOCK, so neither
a shard nor a block of queries grows with the table; the work is queries times shards, which is the stated query set
against all rows.

Defined results: null and zero vectors and those with null or non-finite components take no part, as queries neither;
rows with a null id do not either; of repeated ids the smallest vector (in array order) counts; vectors of another length than
the most frequent (ties: longest) take no part; ties of distance go to the smaller id; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundlake.llm.common import stored

SHARD = 2048  # vectors in a shard, about
QUERY_BLOCK = 2048  # queries searched together in a shard
DEGREE = 24
ALPHA = 1.2
BUILD_BEAM = 48
SEARCH_BEAM = 64
_FAR = 6  # a query beyond 2**6 times the shard's size is drawn near


def _distances(points: np.ndarray, ids: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Squared distances of targets[i] to points[ids[i, j]]."""
    difference = points[ids] - targets[:, None, :]
    return np.einsum("ijk,ijk->ij", difference, difference)


def _exact(points: np.ndarray, rows: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Distances of targets[i] to points[rows[i]]; a scale that is a power of two changes no digit of them."""
    difference = points[rows] - targets
    _, power = np.frexp(np.abs(difference).max(1, initial=0.0))
    return np.ldexp(np.sqrt((np.ldexp(difference, -power[:, None]) ** 2).sum(1)), power)


def _power(matrix: np.ndarray) -> int:
    """The power of two just above the largest component."""
    return int(np.frexp(np.abs(matrix).max(initial=0.0))[1])


def beam_search(points: np.ndarray, graph: np.ndarray, entry: int, targets: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of the `beam` best found for each target, nearest first; -1 and infinity where fewer.

    graph: rows of neighbours, padded with -1.
    """
    many = len(targets)
    ids = np.full((many, beam), -1, np.int64)
    far = np.full((many, beam), np.inf, np.float32)
    opened = np.ones((many, beam), bool)
    ids[:, 0], opened[:, 0] = entry, False
    far[:, 0] = _distances(points, ids[:, :1], targets)[:, 0]
    seen = np.zeros((many, len(points)), bool)
    seen[:, entry] = True
    active = np.arange(many)
    while len(active):
        best = np.where(opened[active], np.inf, far[active]).argmin(1)
        now = ~opened[active, best]
        active, best = active[now], best[now]
        if not len(active):
            break
        opened[active, best] = True
        near = graph[ids[active, best]]
        new = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
        rows, columns = np.nonzero(new)
        seen[active[rows], near[rows, columns]] = True
        offered = np.where(new, _distances(points, np.maximum(near, 0), targets[active]), np.inf).astype(np.float32)
        all_far = np.concatenate([far[active], offered], 1)
        all_ids = np.concatenate([ids[active], np.where(new, near, -1)], 1)
        all_opened = np.concatenate([opened[active], ~new], 1)
        keep = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
        far[active] = np.take_along_axis(all_far, keep, 1)
        ids[active] = np.take_along_axis(all_ids, keep, 1)
        opened[active] = np.take_along_axis(all_opened, keep, 1)
    order = np.lexsort((ids, far), axis=1)
    return np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)


def robust_prune(points: np.ndarray, of: np.ndarray, candidates: np.ndarray, far: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most `degree` diverse neighbours of each points[of[i]] out of its candidates (-1: none)."""
    far = np.where((candidates < 0) | (candidates == of[:, None]), np.inf, far)
    order = np.argsort(far, 1, kind="stable")
    candidates, far = np.take_along_axis(candidates, order, 1), np.take_along_axis(far, order, 1)
    # a candidate may be listed twice
    same = (candidates[:, :, None] == candidates[:, None, :]) & np.tri(candidates.shape[1], k=-1, dtype=bool)[None]
    alive = np.isfinite(far) & ~same.any(2)
    out = np.full((len(of), degree), -1, np.int64)
    rows = np.arange(len(of))
    for k in range(degree):
        pick = np.where(alive, far, np.inf).argmin(1)
        real = alive[rows, pick]
        if not real.any():
            break
        chosen = np.where(real, candidates[rows, pick], -1)
        out[:, k] = chosen
        covered = _distances(points, np.maximum(candidates, 0), points[np.maximum(chosen, 0)]) * alpha * alpha <= far
        alive &= ~(covered & real[:, None])
        alive[rows, pick] = False
    return out


def build(points: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BUILD_BEAM, seed: int = 7) -> tuple[np.ndarray, int]:
    """(graph, entry point) of the vectors of a shard, with two rounds of searches, the second with relaxed pruning."""
    n = len(points)
    rng = np.random.default_rng(seed)
    graph = np.full((n, degree), -1, np.int64)
    if n > 1:
        graph = (np.arange(n)[:, None] + 1 + rng.integers(0, n - 1, (n, degree))) % n
    entry = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    for relaxed in (1.0, alpha):
        for at in np.array_split(rng.permutation(n), max(1, n // 512)):
            found, far = beam_search(points, graph, entry, points[at], beam)
            near = graph[at]
            known = np.where(near >= 0, _distances(points, np.maximum(near, 0), points[at]), np.inf)
            graph[at] = robust_prune(points, at, np.concatenate([found, near], 1), np.concatenate([far, known], 1), degree, relaxed)
            # back edges: every kept neighbour gets the point as a candidate of its own
            source, slot = np.nonzero(graph[at] >= 0)
            target, source = graph[at][source, slot], at[source]
            order = np.argsort(target, kind="stable")
            target, source = target[order], source[order]
            heads, first, many = np.unique(target, return_index=True, return_counts=True)
            width = int(many.max()) if len(many) else 0
            offered = np.full((len(heads), width), -1, np.int64)
            offered[np.repeat(np.arange(len(heads)), many), np.arange(len(target)) - np.repeat(first, many)] = source
            for part in np.array_split(np.arange(len(heads)), max(1, len(heads) * (width + degree) ** 2 // 40_000_000)):
                both = np.concatenate([graph[heads[part]], offered[part]], 1)
                far = np.where(both >= 0, _distances(points, np.maximum(both, 0), points[heads[part]]), np.inf)
                graph[heads[part]] = robust_prune(points, heads[part], both, far, degree, relaxed)
    return graph, entry


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 1))


def _copies(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each distinct row, number of its distinct row for each row), numbered by first appearance."""
    matrix = np.ascontiguousarray(matrix + 0.0)  # no negative zeros: rows are compared by their bytes
    rows = matrix.view(np.dtype((np.void, matrix.shape[1] * matrix.itemsize))).ravel()
    _, first, number = np.unique(rows, return_index=True, return_inverse=True)
    order = np.argsort(first)
    return first[order], np.argsort(order)[number.ravel()]


def _indexed(degree: int, alpha: float, beam: int):
    """The graph of one shard, one row per vector; rows of equal vectors share a place."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", ignore_index=True)
        points = _matrix(group["vector"])
        points = np.ldexp(points, -_power(points)).astype(np.float32)
        first, place = _copies(points)
        graph, entry = build(points[first], degree, alpha, beam)
        group["place"] = place.astype(np.int32)
        group["entry"] = np.int32(entry)
        group["neighbours"] = list(graph[place].astype(np.int32))
        return group[["shard", "vec_id", "vector", "place", "entry", "neighbours"]]

    return run


def _searched(k: int, beam: int):
    """The k nearest of a shard for each query of a block."""
    def run(key: tuple, shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(shard) or not len(queries):
            return none
        shard = shard.sort_values(["place", "vec_id"], ignore_index=True)
        _, copy = _copies(_matrix(shard["vector"]))
        shard = shard[shard.groupby(copy).cumcount() <= k].reset_index(drop=True)
        exact, ids = _matrix(shard["vector"]), shard["vec_id"].to_numpy()
        _, heads, many = np.unique(shard["place"].to_numpy(), return_index=True, return_counts=True)
        power = _power(exact)
        points, graph = np.ldexp(exact[heads], -power).astype(np.float32), np.stack(shard["neighbours"].iloc[heads].to_list()).astype(np.int64)
        wanted, names = _matrix(queries["query_vector"]), queries["query_id"].to_numpy()
        out = []
        for at in range(0, len(wanted), 512):
            targets, named = wanted[at:at + 512], names[at:at + 512]
            size = np.frexp(np.abs(targets).max(1))[1]  # each target's own power of two
            near = np.ldexp(targets, -np.maximum(power, size - _FAR)[:, None]).astype(np.float32)
            found, _ = beam_search(points, graph, int(shard["entry"].iloc[0]), near, min(beam, len(points)))
            # every row of the nodes found
            asks, columns = np.nonzero(found >= 0)
            nodes = found[asks, columns]
            asks, sizes = np.repeat(asks, many[nodes]), many[nodes]
            rows = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(heads[nodes], sizes)
            other = ids[rows] != named[asks]
            asks, rows = asks[other], rows[other]
            far = np.concatenate([np.zeros(0), *(_exact(exact, rows[i:i + 32768], targets[asks[i:i + 32768]])
                                                 for i in range(0, len(rows), 32768))])
            order = np.lexsort((ids[rows], far, asks))
            asks, rows, far = asks[order], rows[order], far[order]
            top = np.arange(len(asks)) - np.searchsorted(asks, asks) < k
            out.append(pd.DataFrame({"query_id": named[asks[top]], "vec_id": ids[rows[top]], "score": far[top]}))
        return pd.concat([none, *out], ignore_index=True)

    return run


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector of doubles) of the rows that take part."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).where(sound & F.exists("vector", lambda v: v != 0))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    rows = rows.where(F.size("vector") == (lengths.n if lengths else 0))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def index(embeddings: DataFrame, shard: int = SHARD, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BUILD_BEAM) -> DataFrame:
    """The stored graphs: shard, vec_id, vector, place, entry, neighbours (places in the shard)."""
    rows = stored(usable(embeddings))
    shards = max(1, -(-rows.count() // shard))
    return stored(rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(
        _indexed(degree, alpha, beam), "shard int, vec_id long, vector array<double>, place int, entry int, neighbours array<int>"))


def _merged(found: DataFrame, by: list[str], k: int) -> DataFrame:
    return found.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("top"))


def nearest(graphs: DataFrame, queries: DataFrame, k: int = 10, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (vec_id, vector), itself left out."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    shards = (graphs.agg(F.max("shard")).first()[0] or 0) + 1
    sent = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"),
        F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector"))
    asked = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = asked.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block")).applyInPandas(
        _searched(k, beam), "query_id long, vec_id long, score double")
    # k rows per query and shard: merged in parts first, so that no task gathers a query's rows of all shards
    parts = _merged(found.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(1 + shards // 64))), ["query_id", "part"], k)
    top = _merged(parts.select("query_id", F.explode("top").alias("hit")).select("query_id", "hit.*"), ["query_id"], k)
    return top.select("query_id", F.posexplode("top").alias("place", "hit")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")


def search_embeddings(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """The k nearest rows of every row whose id is divisible by `every`."""
    graphs = index(embeddings)
    return nearest(graphs, graphs.where(F.col("vec_id") % every == 0).select("vec_id", "vector"), k)
