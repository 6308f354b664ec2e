"""Toxicity by a weighted lexicon that an Aho-Corasick automaton finds in folded texts.

Folding takes a text to lower-case Latin letters and single spaces: accents and homoglyphs of other scripts become the
letters they resemble, digits and signs inside a word the letters they replace, invisible characters vanish,
everything else parts words. An entry is a whole word or the beginning of a word. Hits inside an exception phrase do
not count. A text's score is a logistic function of the weight of its hits, absolute and per word, and of the share of
its words that begin with one of the dense entries.

The lexicon starts from SEED and learns from labelled rows. Candidate entries are the words and word beginnings of
toxic texts that clean texts lack, and, as dense entries, beginnings that at least one word in a hundred of a toxic text
has while clean texts have them now and then at most. They are taken greedily by the number of toxic texts they explain,
where a text already explained counts half as much each time. So words that only some copies of a toxic text have in
common are not needed and stay out.

Defined results: null and empty texts have no hits and get the score of a text without hits; without labels of both
kinds the seed list and fixed weights are used; repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundlake.llm.labelled import MOST_ROWS, checksum_mod, training_rows

SEED = ("idiot", "moron", "imbecile", "stupid", "dumbass", "scumbag", "scum", "loser", "worthless", "pathetic", "disgusting",
        "retard", "bastard", "asshole", "bitch", "cretin", "trash", "garbage", "clown", "subhuman", "vermin")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "garbage can", "garbage truck", "garbage collection", "garbage collector",
              "clown fish", "pathetic fallacy", "idiot proof", "sore loser", "pond scum")
#: Letters of other scripts that look like Latin ones, and the signs that stand for letters.
HOMOGLYPHS = dict(zip("авсенкморѕтухіјԁԛɡαβεηικνορτυχωΑΒΕΗΙΚΜΝΟΡΤΥΧ", "abcehkmopstyxijdqgabeniknopruxwabehikmnoptyx", strict=True))
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "€": "e"}
_INNER_SIGNS = re.compile(r"(?<=[^\W_])[$!]+(?=[^\W_])")  # elsewhere they are no letters
_PREFIXES = (4, 5, 6)
_DENSE_PREFIXES = (4, 5, 6, 7, 8)
_LEAST_TEXTS = 3
_PRECISION = 0.95
_DENSE_PRECISION = 0.8  # a beginning met by chance is common in some long text
_PER_WORDS = 100  # a dense entry is held by a text with one hit or more in so many words


class _Folding(dict):
    """A translation table that works out each character once."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        if char in SIGNS or char in HOMOGLYPHS:
            out = SIGNS.get(char) or HOMOGLYPHS[char]
        elif unicodedata.category(char) in ("Cf", "Mn"):
            out = ""
        else:
            plain = "".join(HOMOGLYPHS.get(c, c) for c in unicodedata.normalize("NFKD", char) if unicodedata.category(c) != "Mn").lower()
            out = plain if plain.isalpha() else "".join(c if c.isalpha() else " " for c in plain) or " "
        self[code] = out
        return out


_FOLDING = _Folding()


def folded(text: str | None) -> str:
    """Lower-case letters and single spaces, with one space at either end."""
    text = _INNER_SIGNS.sub(lambda m: m[0].replace("$", "s").replace("!", "i"), text or "")
    return f" {' '.join(text.translate(_FOLDING).split())} "


@dataclass
class Lexicon:
    """Entries with weights (" word " or " beginning"), dense entries (" beginning") and the coefficients of the score."""

    weights: dict[str, float]
    coefficients: tuple[float, ...] = (-6.0, 4.0, 1.0, 0.5, 0.0, 0.0)
    exceptions: tuple[str, ...] = EXCEPTIONS
    dense: frozenset[str] = frozenset()
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for entry in self.weights.keys() | self.dense:
                self._automaton.add_word(entry, (entry, self.weights.get(entry, 0.0)))
            for phrase in self.exceptions:
                self._automaton.add_word(folded(phrase), (folded(phrase), None))
            self._automaton.make_automaton()
        return self._automaton

    def found(self, text: str) -> tuple[list[tuple[str, float]], int]:
        """(hits, words of the commonest dense entry) of a folded text. At most one hit for each word: its heaviest entry.
        A word that a phrase excuses does not count."""
        best: dict[int, tuple[str, float]] = {}
        dense: dict[str, list[int]] = defaultdict(list)
        excused: list[tuple[int, int]] = []
        for end, (entry, weight) in self.automaton().iter(text):
            at = end - len(entry) + 1
            if weight is None:
                excused.append((at, end))
                continue
            if entry in self.dense:
                dense[entry].append(at)
            if weight > 0 and (at not in best or best[at][1] < weight):
                best[at] = (entry, weight)
        if excused:
            covered = {p for a, b in excused for p in range(a, b)}  # phrases are short
            best = {p: e for p, e in best.items() if p not in covered}
            dense = {e: [p for p in places if p not in covered] for e, places in dense.items()}
        return [best[p] for p in sorted(best)], max(map(len, dense.values()), default=0)

    def hits(self, text: str) -> list[tuple[str, float]]:
        """The hits of a folded text."""
        return self.found(text)[0]

    def features(self, hits: list[tuple[str, float]], words: int, dense: int = 0) -> tuple[float, ...]:
        total = sum(w for _, w in hits)
        return (1.0, float(bool(hits)), float(np.log1p(total)), float(np.log1p(100 * total / (words + 10))),
                float(dense > 1 and _PER_WORDS * dense >= words), float(np.log1p(100 * dense / (words + 10))))

    def score(self, hits: list[tuple[str, float]], words: int, dense: int = 0) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.coefficients, self.features(hits, words, dense)), -30, 30))))

    def score_of(self, text: str) -> float:
        """The score of a folded text."""
        hits, dense = self.found(text)
        return self.score(hits, text.count(" ") - 1, dense)


def seed_lexicon() -> Lexicon:
    return Lexicon({f" {w}": 3.0 for w in SEED})


def _entries(text: str) -> set[str]:
    """What a folded text holds; dense entries are marked by a tilde, which no folded text has."""
    words = text.split()
    often = Counter(words)
    beginnings: Counter = Counter()
    for word, n in often.items():
        for size in _DENSE_PREFIXES:
            if len(word) >= size:
                beginnings[word[:size]] += n
    return ({f" {w} " for w in often if len(w) > 2} | {f" {w[:n]}" for w in often for n in _PREFIXES if len(w) >= n}
            | {f"~ {b}" for b, n in beginnings.items() if n > 1 and _PER_WORDS * n >= len(words)})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of toxic and clean texts by entry, summed over the partition."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            counts[y].update(_entries(folded(text)))
    names = list(counts[0].keys() | counts[1].keys())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in counts)],
                                     ["entry", "n_clean", "n_toxic"])


def _holding(entries: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sorted(entries & _entries(folded(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], ["entries"])

    return run


def _described(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                text = folded(text)
                hits, dense = lexicon.found(text)
                rows.append(list(lexicon.features(hits, text.count(" ") - 1, dense)))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("y")], ["x", "y"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, strength: float = 1e-2) -> tuple[float, ...]:
    """Coefficients by Newton's method with a small penalty."""
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (y - p) - strength * beta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(b) for b in beta)


def learn(rows: DataFrame) -> Lexicon:
    """A lexicon from (text, y). The rows are the bounded sample; so is what comes to the driver."""
    # copies of a text are one text here, or a large group of them would make all its words toxic
    rows = rows.select("text", F.col("y").cast("int").alias("y")).dropDuplicates(["text", "y"])
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    lexicon = seed_lexicon()
    if not n.get(0) or not n.get(1):
        return lexicon
    counted = (rows.mapInArrow(_counted, "entry string, n_clean long, n_toxic long")
               .groupBy("entry").agg(F.sum("n_clean").alias("n_clean"), F.sum("n_toxic").alias("n_toxic")))
    n_toxic, n_clean = n[1], n[0]
    # precision as if both kinds were equally frequent
    ratio = F.col("n_toxic") / n_toxic / (F.col("n_toxic") / n_toxic + F.col("n_clean") / n_clean)
    least = F.when(F.col("entry").startswith("~"), _DENSE_PRECISION).otherwise(_PRECISION)
    candidates = {r.entry: (r.n_toxic, r.n_clean) for r in
                  counted.where(F.col("n_toxic") >= _LEAST_TEXTS).where(ratio >= 0.95)
                  .where(F.col("n_toxic") >= least * (F.col("n_toxic") + F.col("n_clean"))).collect()}
    holding = defaultdict(list)
    for i, r in enumerate(rows.where("y = 1").mapInArrow(_holding(frozenset(candidates)), "entries array<string>").collect()):
        for entry in r.entries:
            holding[entry].append(i)
    chosen = _greedy(holding, max(_LEAST_TEXTS - 1, 0.003 * n_toxic))
    lexicon.dense = frozenset(e[1:] for e in chosen if e.startswith("~"))
    for entry in chosen:
        a, b = candidates[entry]
        if not entry.startswith("~"):
            lexicon.weights[entry] = float(np.log((a + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_clean + 1)))
    found = rows.mapInArrow(_described(lexicon), "x array<double>, y int").collect()
    lexicon.coefficients = _logistic(np.array([r.x for r in found]), np.array([r.y for r in found], float))
    return lexicon


def _greedy(holding: dict[str, list[int]], least: float) -> list[str]:
    """Entries by the toxic texts they newly explain, until none explains enough."""
    worth = defaultdict(lambda: 1.0)
    heap = [(-float(len(rows)), -len(e), e) for e, rows in holding.items()]
    heapify(heap)
    chosen = []
    while heap:
        # gains only fall, so an entry whose fresh gain is still the best is the best
        _, size, entry = heap[0]
        fresh = (-sum(worth[i] for i in holding[entry]), size, entry)
        if fresh != heap[0]:
            heapreplace(heap, fresh)
            continue
        if -fresh[0] < least:
            break
        heappop(heap)
        chosen.append(entry)
        for i in holding[entry]:
            worth[i] *= 0.5
    return chosen


def _scored(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, hits, words, terms = [], [], [], []
            for value in batch.column("text"):
                text = folded(value.as_py())
                found, dense = lexicon.found(text)
                n = text.count(" ") - 1
                scores.append(lexicon.score(found, n, dense))
                hits.append(len(found))
                words.append(max(n, 0))
                terms.append(sorted({e.strip() for e, _ in found}))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(hits, pa.int64()),
                pa.array(words, pa.int64()), pa.array(terms, pa.list_(pa.string()))],
                ["doc_id", "score", "n_hits", "n_words", "terms"])

    return run


def toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row per document: doc_id, score, n_hits, n_words, terms."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _scored(lexicon), f"doc_id {kind}, score double, n_hits long, n_words long, terms array<string>")


def learned_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, threshold: float = 0.3,
                     most: int = MOST_ROWS) -> DataFrame:
    """Scores of all documents by a lexicon learned from the labels that are not held out."""
    lexicon = learn(training_rows(docs, labels, "toxic", modulus, held_out, most))
    return toxicity(docs, lexicon).select(
        "doc_id", (checksum_mod("doc_id", modulus) == held_out).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "n_hits", "n_words", "terms")


def _clean(lexicon: Lexicon, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for value in batch.column("text"):
                keep.append(lexicon.score_of(folded(value.as_py())) < threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def without_toxic(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, threshold: float = 0.3) -> DataFrame:
    """The documents scored below the threshold, all columns as they are."""
    lexicon = learn(training_rows(docs, labels, "toxic", modulus, held_out))
    return docs.mapInArrow(_clean(lexicon, threshold), docs.schema)
