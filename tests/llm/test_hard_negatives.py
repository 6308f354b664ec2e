"""Hard negatives against brute force in Python integers."""

import math

import numpy as np
import pytest

from fundlake.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, scores string, shard string"


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, "s", "t") for r in rows], SCHEMA.replace("float", kind))


def brute(rows):
    rows = [r for r in rows if None not in r and None not in r[1] and np.isfinite(r[1]).all()]
    least = {}
    for i, v, label in rows:
        label = (label + 1) % 10 if i % 7 == 0 else label
        q = [math.floor(256 * float(x)) for x in v]
        least[i] = min(least.get(i, (label, q)), (label, q))
    lengths = [len(q) for _, q in least.values()]
    length = max(set(lengths), key=lambda n: (lengths.count(n), n), default=0)
    least = {i: r for i, r in least.items() if len(r[1]) == length}
    out = set()
    for anchor in [i for i in least if i % 100 == 0]:
        label, q = least[anchor]
        scored = sorted((-sum(a * b for a, b in zip(q, other, strict=True)), i) for i, (_, other) in least.items() if i != anchor)
        for minus, positive in [s for s in scored if least[s[1]][0] == label][:5]:
            fits = [s for s in scored if least[s[1]][0] != label and 80 * -minus <= 100 * -s[0] <= 100 * -minus]
            out |= {(anchor, positive, k + 1, i, -minus, -m) for k, (m, i) in enumerate(fits[:5])}
    return out


def vectors(seed, n, d, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    rows = [(int(i), (centres[i % 6] + rng.normal(size=d) / 3).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    for i in range(copies):  # a third of the rows are one vector
        rows[3 * i] = (rows[3 * i][0], rows[0][1], rows[3 * i][2])
    return rows


@pytest.mark.parametrize("shard", [2048, 150])
def test_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(hard_negatives, "LEAST_SHARD", shard)
    monkeypatch.setattr(hard_negatives, "SPAN", 1)
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    monkeypatch.setattr(hard_negatives, "FAN", 3)
    rows = vectors(1, 600, 5, copies=200)
    got = [tuple(r) for r in hard_negatives.mine(table(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows) and got


def test_odd_rows(spark):
    rows = vectors(2, 300, 3)
    rows += [(None, [1.0, 1.0, 1.0], 1), (1000, None, 1), (1001, [1.0, None, 1.0], 2), (1002, [float("nan"), 1.0, 1.0], 2),
             (1100, [float("inf"), 1.0, 1.0], 2), (1200, [1.0, 1.0, 1.0], None), (1300, [0.0, 0.0, 0.0], 1), (1400, [1.0, 2.0], 1),
             (1500, [], 1), (1, [9.0, 9.0, 9.0], 0), (200, [0.5, 0.25, 3.0], 3), rows[7], rows[100]]
    got = {tuple(r) for r in hard_negatives.mine(table(spark, rows)).collect()}
    assert got == brute(rows) and any(r[0] == 1300 for r in got)
    assert hard_negatives.mine(table(spark, [])).count() == 0
    assert hard_negatives.mine(table(spark, [(100, [1.0], 1)])).count() == 0
    assert hard_negatives.mine(table(spark, [(100, [], 1), (101, [], 1), (102, [], 2)])).collect()[0][:4] == (100, 101, 1, 102)


@pytest.mark.parametrize("scale", [1e4, 2.0 ** 21 / 3])
def test_large_components_stay_exact(spark, scale):
    rows = [(i, [x * scale for x in v], label) for i, v, label in vectors(3, 250, 4)]
    got = {tuple(r) for r in hard_negatives.mine(table(spark, rows, "double")).collect()}
    assert got == brute(rows) and got


def test_boxes_bound_every_score():
    rng = np.random.default_rng(5)
    q = rng.integers(-300, 300, (1000, 7))
    tree = hard_negatives.Tree(np.arange(1000), np.zeros(1000, np.int64), q)
    anchor = rng.integers(-300, 300, 7)
    (low, high, least), *_ = tree.levels
    up, down = np.maximum(anchor, 0), np.minimum(anchor, 0)
    for at in range(len(least)):
        part = slice(at * hard_negatives.LEAF, (at + 1) * hard_negatives.LEAF)
        scores = tree.q[part] @ anchor
        assert low[at] @ up + high[at] @ down <= scores.min() <= scores.max() <= high[at] @ up + low[at] @ down
        assert least[at] == tree.ids[part].min()


def test_inner_products_beyond_a_long_are_an_error(spark):
    rows = [(i, [x * 1e9 for x in v], label) for i, v, label in vectors(3, 250, 4)]
    with pytest.raises(Exception, match="Overflow|too large|does not fit|bounds"):
        hard_negatives.mine(table(spark, rows, "double")).collect()
