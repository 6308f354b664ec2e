"""Near duplicates, repeated strings and decontamination against brute force."""

import collections
import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from fundlake.llm import decontaminate, minhash, suffixes
from fundlake.llm.common import slices

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hub string, bucket string, component long"


def documents(spark, texts, ids=None):
    """Documents with further columns whose names the operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", 1) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def brute_components(rows, size, percent):
    sets, parent = {i: shingles(t, size) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {(i, len(sets[i]), find(i), find(i) == i) for i in sets}


def family_texts(seed):
    """Copies of a few texts with more and more words changed, so that similarities lie on both sides of the threshold."""
    rng = random.Random(seed)
    texts = ["", "  \n", None, "One", "one", "two words", "Two  WORDS", "two words more"]
    for _ in range(3):
        base = [f"w{rng.randrange(400)}" for _ in range(60)]
        texts.append(" ".join(base))
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randrange(0, 7)):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(30)}"
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("words, percent, block", [(3, 85, 1024), (5, 80, 1024), (3, 85, 4)])
def test_components_equal_brute_force(spark, monkeypatch, words, percent, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = family_texts(3)
    got = {tuple(r) for r in minhash.near_duplicates(documents(spark, texts), words, percent).collect()}
    assert got == brute_components(list(enumerate(texts)), words, percent)
    assert len({c for _, _, c, _ in got}) < len(texts)


def test_near_duplicates_of_odd_rows(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None, "x"], [3, 3, None, 4, 5])
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 3, 85).collect())
    assert got == [(0, 4, None, None), (3, 4, 3, True), (3, 4, 3, True), (4, 0, 4, True), (5, 1, 5, True)]
    left = minhash.without_near_duplicates(docs)
    assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 3, 4, 5]
    assert minhash.near_duplicates(documents(spark, [])).count() == 0


def test_words_on_which_weak_hashes_collide_stay_apart(spark):
    texts = [thue_morse(1024, a, b) for a, b in ("ab", "ba", "cd", "dc", ")J", "J)")] + ["x" * 64, "x" * 65, "x" * 72, "x" * 65]
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(documents(spark, texts), 3, 85).collect()}
    assert got == {(i, 7 if i == 9 else i) for i in range(10)}


def test_several_texts_of_one_id_all_link(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(50)] for _ in range(2)]
    near = [" ".join([*b[:-1], "other"]) for b in base]
    rows = [(1, " ".join(base[0])), (1, " ".join(base[1])), (3, near[1]), (5, near[0]), (7, "alone"), (7, "alone"), (7, None), (None, near[0])]
    want = sorted([(1, 1), (1, 1), (3, 1), (5, 1), (7, 7), (7, 7), (7, 7), (None, None)], key=str)
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    assert sorted(((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()), key=str) == want
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    got = sorted(((r.doc_id, r.component_id) for r in minhash.near_duplicates(named).collect()), key=str)
    assert got == sorted([(i and f"d{i}", c and f"d{c}") for i, c in want], key=str)


def test_bands_rarely_miss_a_pair_at_the_threshold():
    for percent in (50, 80, 85, 95, 100):
        bands, rows = minhash.bands_for(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= minhash.MISS or rows == 1
        assert bands * rows <= minhash.MOST_COORDINATES or rows == 1


def brute_repeats(rows, window):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = collections.Counter(b[p:p + window] for _, b in texts for p in range(len(b) - window + 1))
    out = []
    for i, b in texts:
        gone = [False] * len(b)
        for p in range(len(b) - window + 1):
            if count[b[p:p + window]] > 1:
                gone[p:p + window] = [True] * window
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [50, 7])
def test_repeats_equal_brute_force(spark, window):
    rng = random.Random(5)

    def some(n):
        return "".join(rng.choice("abcd") for _ in range(n))

    shared = [some(60), some(45), some(100)]
    rows = [(i, some(rng.randrange(80)) + rng.choice(shared)[rng.randrange(20):] + some(rng.randrange(30)) + rng.choice(shared)) for i in range(60)]
    rows += [(200, "x" * 300), (201, "ab" * 100), (202, None), (203, ""), (204, shared[2] * 3), (205, shared[2]), (205, shared[2]),
             (None, some(90)), (207, "é" * 70)]
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.without_repeats(docs, window).collect()), key=repr)
    assert got == brute_repeats(rows, window)


def thue_morse(n, a, b):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


def test_strings_on_which_weak_hashes_collide_are_kept(spark):
    rng = random.Random(8)
    shared = "".join(rng.choice("abcdefg ") for _ in range(150))
    rows = [(i, shared + thue_morse(256, *pair)) for i, pair in enumerate([")J", "J)", "ab", "ba"])]
    rows += [(10, thue_morse(1024, "x", "y")), (11, thue_morse(1024, "y", "x"))]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.without_repeats(documents(
        spark, [t for _, t in rows], [i for i, _ in rows]), 400).collect()), key=repr)
    assert got == brute_repeats(rows, 400)
    assert all(r[2] == 0 for r in got if r[0] < 10)


def test_ids_that_hold_the_separator(spark):
    shared = "".join(random.Random(1).choice("abcdefgh") for _ in range(90))
    rows = [("1", "2|" + shared + "x"), ("1|2", shared + "x"), (None, "null" + shared), ("null", shared), ("1:2", "z" * 49), ("", "y" * 60)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.without_repeats(docs, 50).collect()), key=repr)
    assert got == brute_repeats(rows, 50)


def test_long_texts_in_stretches(spark, monkeypatch):
    """Anchors of a long text are sought stretch by stretch; repeats across the stretches' ends are found."""
    monkeypatch.setattr(suffixes, "STRETCH", 500)
    monkeypatch.setattr(suffixes, "slices", lambda column, size=300: slices(column, 300))
    rng = random.Random(6)
    base = "".join(rng.choice("abcd") for _ in range(4000))
    rows = [(1, base), (2, "x" + base[450:1300] + "y"), (3, base[900:1000]), (4, base[3300:] + base[:100]), (5, "é" * 700)]
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.without_repeats(docs, 50).collect()), key=repr)
    assert got == brute_repeats(rows, 50)


def test_repeats_in_an_empty_table(spark):
    assert suffixes.without_repeats(documents(spark, [])).count() == 0


def test_decontamination_equals_its_sql(spark, monkeypatch):
    rng = random.Random(9)

    def some(n):
        return " ".join(rng.choice(["the", "of", "Éa", "x1", "long", "word"]) for _ in range(n))

    items = [(0, some(30)), (1, "Short item"), (2, None), (3, "..."), (None, some(12)), (10, some(12)), (2, "b c d e f g h i j k l")]
    texts = [None, "", "...", "short, ITEM! short item", items[0][1], "x " + items[0][1][20:] + " y", "a b c d e f g h i j", "B-C d e f g h i j k",
             items[4][1] + " " + items[5][1]] + [some(40) for _ in range(20)]
    texts += texts[4:5]
    docs = documents(spark, texts, [*range(len(texts) - 2), None, 4])
    bench = spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    con.register("benchmark", bench.toPandas().astype({"item_id": "Int64"}))
    want = sorted(con.execute(decontaminate.ORACLE).fetchall(), key=repr)
    for words in (decontaminate.BLOCK_WORDS, 20):  # one block of items, and several
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", words)
        got = decontaminate.contamination(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert any(r[5] for r in want) and not all(r[5] for r in want)
    left = decontaminate.without_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == sum(not r[5] for r in want)


def test_blocks_hold_every_window_of_long_and_repeated_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 7)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 60)
    texts = [" ".join(f"W{(i * 7 + k) % 90}É" for i in range(n)) for k, n in enumerate((1, 9, 10, 11, 16, 17, 300))] + ["--", None]
    rows = [(f"i{k}", t) for k, t in enumerate(texts)] + [("i6", texts[6])] * 200
    blocks = list(decontaminate.blocks_of(spark.createDataFrame(rows, "item_id string, text string"), 10))
    got = collections.defaultdict(set)
    for block in blocks:
        assert sum(map(len, block.windows)) < 10 * 60
        for window, items in zip(block.windows, block.items, strict=True):
            got[window] |= set(items)
    want = collections.defaultdict(set)
    for item, text in rows:
        words = decontaminate.words_of(text)
        for at in range(max(1, len(words) - 9) if words else 0):
            want[tuple(words[at:at + 10])].add(item)
    assert got == want and len(blocks) > 3


def test_decontamination_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontaminate.contamination(documents(spark, ["a b"]), bench).collect()] == [False]
    assert decontaminate.contamination(documents(spark, []), bench).count() == 0
