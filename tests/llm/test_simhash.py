"""SimHash fingerprints and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fundlake.llm import simhash

SCHEMA = "doc_id long, text string, fp long, mask string, cell string, component_id long"


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, "m", "c", 1) for r in rows], SCHEMA)


def plain_fingerprint(text, size):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0d]+", lower)
    runs = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, size):
    prints = np.array([plain_fingerprint(t, size) for _, t in rows], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    label = np.arange(len(rows))
    while True:
        lower = np.where(near, label[None, :], len(rows)).min(1)
        if (lower == label).all():
            break
        label = lower
    least = {}
    for (i, _), c in zip(rows, label, strict=True):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    return sorted(((i, f"{p:016x}", least[c], None if i is None or least[c] is None else i == least[c])
                   for (i, _), p, c in zip(rows, prints.tolist(), label, strict=True)), key=repr)


def test_components_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One"), (6, "two words"), (7, "é é é"), (8, "x " * 5000), (9, "word " * 70_000)]
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(400)]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = "new"
            rows.append((rng.randrange(20, 400), " ".join(copy)))
    rows += rows[-3:] + [(None, "only null"), (None, rows[20][1])]
    got = sorted(map(tuple, simhash.near_duplicates(table(spark, rows), 3).collect()), key=repr)
    assert got == plain_components(rows, 3)
    assert len({r[2] for r in got}) < len({r[0] for r in rows})


def test_empty_table(spark):
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_same_hash_as_spark(spark):
    text = "shared words é"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] & (2 ** 64 - 1) == xxhash.xxh64_intdigest(text.encode(), 42)


@pytest.mark.parametrize("cell", [1024, 16])
def test_crowded_cells_lose_no_link(spark, monkeypatch, cell):
    """Many different fingerprints around a few centres share their blocks; cells are cut until they are small."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(7)
    prints = set()
    for centre in [rng.getrandbits(64) for _ in range(3)]:
        for _ in range(120):
            value = centre
            for _ in range(rng.randrange(5)):
                value ^= 1 << rng.choice([0, 1, 2, 7, 30, 31, 32, 63, 50, 51])
            prints.add(value)
    values = np.array(sorted(prints), np.uint64).view(np.int64)
    links = simhash.fingerprint_links(spark.createDataFrame([(int(v),) for v in values], "fp long")).collect()
    near = np.bitwise_count(values.view(np.uint64)[:, None] ^ values.view(np.uint64)[None, :]) <= 3

    def labels(pairs):
        parent = {int(v): int(v) for v in values}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
        return [root(int(v)) for v in values]

    want = labels([(int(values[i]), int(values[j])) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)])
    assert labels([(r.a, r.b) for r in links]) == want
