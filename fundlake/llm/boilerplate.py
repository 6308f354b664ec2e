"""Main text of web pages: flat text blocks, classified by a decision tree trained on a small labelled table.

A page is cut into blocks at its block-level tags. A block is described by its number of words, the share of them
inside links, the same of the blocks before and after it, and the kinds of containers around it. The tree is grown from
TABLE, which describes the blocks of a few typical pages, and says of each block whether it belongs to the article.

A container that is boilerplate by its class or id alone, or a form, counts as plain where it wraps the page: outside any
article, if it holds the main element, or else if it holds more than half of the words outside navigation and no article
element stands outside it (comments and related pages never wrap it in this second way).

Markup may be broken: unclosed elements end with their parents, stray end tags are ignored, an unclosed comment or
script runs to the end of the page, a "<" that starts no tag is text.

Defined results: a null or empty page gives an empty text; repeated rows get equal results; pages of any length are
read whole; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after",
            "article", "boilerplate", "form", "heading", "item")

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^\"'>])*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SILENT = frozenset("script style noscript template svg math iframe object canvas audio video head title select option optgroup datalist "
                    "button textarea noembed noframes".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small "
                    "span strike strong sub sup time tt u var wbr nobr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BOILERPLATE = frozenset("nav aside footer menu dialog".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar form toolbar".split())
_BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars menu menus nav navbar "
    "navigation breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription share sharing social related recommended recommendations widget comment comments commentlist "
    "disqus discussion respond reply replies login signup search pagination pager copyright legal disclaimer toolbar skip teaser paywall".split())
_ASIDE_NAMES = frozenset("related recommended recommendations comment comments commentlist disqus discussion respond reply replies".split())
_SOFT = ("named", "aside", "form")
_GOOD_NAMES = frozenset("article content post entry story main maintext body text".split())
_NAME = re.compile(r"[a-z]+")


def _kind(name: str, attributes: str, in_article: bool) -> str:
    """What a container is: silent, boilerplate, named or aside (boilerplate by class or id alone), form, article or plain."""
    if name in _SILENT:
        return "silent"
    if name in ("html", "body"):
        return "plain"
    role, names, hidden = "", [], False
    for key, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id"):
            for part in value.split():
                parts = _NAME.findall(re.sub(r"(?:has|with|no)[-_]\w+", "", part))
                names += parts
        elif key == "role":
            role = value
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            hidden = True
    if hidden:
        return "silent"
    if name in _BOILERPLATE or role in _ROLES or (name == "header" and not in_article):
        return "boilerplate"
    if name == "form":
        return "form"
    if name == "header" or name in _INLINE:
        return "plain"
    if any(n in _BAD_NAMES for n in names) and not (name in ("article", "main") and "header" not in names and "comment" not in names):
        return "aside" if any(n in _ASIDE_NAMES for n in names) else "named"
    if name in ("article", "main") or role in ("main", "article") or any(n in _GOOD_NAMES for n in names):
        return "article"
    return "plain"


@dataclass
class Block:
    """A run of text between block-level tags."""

    text: str
    words: int
    linked: int
    article: bool
    boilerplate: bool
    form: bool
    heading: bool
    item: bool


def _unwrap(found: list[Block], places: list[tuple[int, bool]], soft: list[list]) -> None:
    """Sets the flags of blocks inside named containers and forms, unless these wrap the page.

    places: (innermost such container or -1, inside an article element) of each block; soft: [outer container or -1, kind,
    inside an article, holds main], outer ones first.
    """
    words, marked = [0] * len(soft), [0] * len(soft)
    total = total_marked = 0
    for b, (at, element) in zip(found, places, strict=True):
        if not b.boilerplate:
            total, total_marked = total + b.words, total_marked + b.words * element
            if at >= 0:
                words[at], marked[at] = words[at] + b.words, marked[at] + b.words * element
    for i in range(len(soft) - 1, -1, -1):
        outer = soft[i][0]
        if outer >= 0:
            words[outer], marked[outer], soft[outer][3] = words[outer] + words[i], marked[outer] + marked[i], soft[outer][3] or soft[i][3]
    flags: list[tuple[bool, bool]] = []
    for (outer, kind, in_article, main), n, m in zip(soft, words, marked, strict=True):
        bad, form = flags[outer] if outer >= 0 else (False, False)
        wraps = not in_article and (main or kind != "aside" and 2 * n > total and m == total_marked)
        flags.append((bad or not wraps and kind != "form", form or not wraps and kind == "form"))
    for b, (at, _) in zip(found, places, strict=True):
        if at >= 0:
            b.boilerplate, b.form = b.boilerplate or flags[at][0], flags[at][1]


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    found: list[Block] = []
    stack: list[tuple[str, str]] = []
    places_of: dict[str, list[int]] = defaultdict(list)  # where the open elements of a name stand in the stack
    plain: list[int] = []  # where the open block elements stand
    counts = {"silent": 0, "boilerplate": 0, "form": 0, "named": 0, "aside": 0, "article": 0, "plain": 0}
    places: list[tuple[int, bool]] = []
    soft: list[list] = []
    inner, elements = [-1], 0  # the open ones of `soft`, and the number of open article elements
    links, pieces = 0, []
    opened = {"a": 0, "heading": 0, "item": 0}

    def flush() -> None:
        nonlocal links, pieces
        text = " ".join(html.unescape("".join(p for p, _ in pieces)).split())
        if text:
            linked = sum(len(p.split()) for p, in_link in pieces if in_link)
            words = len(text.split())
            found.append(Block(text, words, min(linked, words), counts["article"] > 0, counts["boilerplate"] > 0,
                               False, opened["heading"] > 0, opened["item"] > 0))
            places.append((inner[-1], elements > 0))
        pieces = []

    def group(name: str) -> str:
        return "a" if name == "a" else "heading" if re.fullmatch("h[1-6]", name) else "item" if name in ("li", "dt", "dd", "td", "th") else ""

    def close(depth: int) -> None:
        nonlocal elements
        while len(stack) > depth:
            name, kind = stack.pop()
            places_of[name].pop()
            if name not in _INLINE:
                plain.pop()
            counts[kind] -= 1
            elements -= kind == "article" and name in ("article", "main")
            if kind in _SOFT:
                inner.pop()
            if group(name):
                opened[group(name)] -= 1

    at, end = 0, len(page)
    while at < end:
        match = _TOKEN.search(page, at)
        stop = match.start() if match else end
        if stop > at and not counts["silent"]:
            pieces.append((page[at:stop], opened["a"] > 0))
        if not match:
            break
        at = match.end()
        name = (match["name"] or "").lower()
        if match["cdata"] and not counts["silent"]:
            pieces.append((html.escape(match["cdata"]), opened["a"] > 0))
        if not name:
            continue
        if name not in _INLINE:
            flush()
        if match["end"]:
            # an inline element ends only where no block has begun within it
            depth = places_of[name][-1] if places_of[name] else None
            if depth is not None and (name not in _INLINE or not plain or plain[-1] < depth):
                close(depth)
            continue
        if name in _VOID:
            continue
        if name in _RAW:  # markup inside is text, up to its own end tag
            ending = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = ending.end() if ending else end
            continue
        if match["attributes"].rstrip().endswith("/") and name in ("svg", "math"):
            continue
        if name not in _INLINE:
            # an unclosed link or bold face ends with its block; a paragraph, item or cell ends where the next begins
            while stack and stack[-1][0] in _INLINE:
                close(len(stack) - 1)
            if stack and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd") or stack and stack[-1][0] == name and name in ("li", "td", "th", "tr"):
                close(len(stack) - 1)
        kind = _kind(name, match["attributes"], counts["article"] > 0)
        if kind in _SOFT:
            soft.append([inner[-1], kind, counts["article"] > 0, False])
            inner.append(len(soft) - 1)
        elif name == "main" and kind == "article" and not counts["boilerplate"] and inner[-1] >= 0:
            soft[inner[-1]][3] = True
        places_of[name].append(len(stack))
        if name not in _INLINE:
            plain.append(len(stack))
        stack.append((name, kind))
        counts[kind] += 1
        elements += kind == "article" and name in ("article", "main")
        if group(name):
            opened[group(name)] += 1
    flush()
    _unwrap(found, places, soft)
    return found


def _described(rows: list[Block]) -> np.ndarray:
    words = np.array([0, *(min(b.words, 200) for b in rows), 0], float)
    links = np.array([0, *(b.linked / b.words for b in rows), 0], float)
    flags = np.array([[b.article, b.boilerplate, b.form, b.heading, b.item] for b in rows], float).reshape(len(rows), 5)
    return np.column_stack([words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:], flags])


def _page(*rows: tuple) -> list[tuple[Block, int]]:
    """Rows (number of blocks, words, linked words, container, element, label) of one page."""
    return [(Block("", words, linked, "article" in place, "boilerplate" in place, "form" in place, element == "heading", element == "item"), label)
            for many, words, linked, place, element, label in rows for _ in range(many)]


#: The labelled table: blocks of typical pages, by their measures.
TABLE = [
    # a marked article between menu, advert and footer
    _page((6, 1, 1, "boilerplate", "item", 0), (1, 9, 0, "boilerplate", "", 0), (1, 10, 0, "article", "heading", 1), (1, 60, 0, "article", "", 1),
          (2, 25, 0, "article", "", 1), (1, 1, 0, "article", "", 1), (1, 120, 2, "article", "", 1), (1, 14, 0, "boilerplate", "", 0)),
    _page((4, 2, 2, "boilerplate", "item", 0), (1, 5, 0, "article", "heading", 1), (3, 3, 0, "article", "item", 1), (1, 40, 1, "article", "", 1),
          (1, 2, 2, "article", "", 1), (1, 30, 0, "article boilerplate", "", 0), (2, 45, 0, "article boilerplate", "", 0), (1, 8, 3, "boilerplate", "", 0)),
    _page((1, 30, 0, "boilerplate", "", 0), (1, 90, 0, "boilerplate", "", 0), (1, 6, 0, "article", "heading", 1), (1, 15, 0, "article", "", 1),
          (1, 4, 0, "article form", "", 0), (1, 12, 0, "article form", "", 0), (1, 70, 70, "article", "", 1), (1, 35, 0, "form", "", 0)),
    _page((2, 1, 1, "", "item", 0), (1, 2, 0, "article", "heading", 1), (1, 1, 0, "article", "", 1), (1, 3, 3, "article", "item", 1),
          (1, 2, 0, "article", "item", 1), (1, 8, 8, "article", "", 1), (1, 6, 3, "article form", "", 0), (1, 30, 8, "article form", "", 0),
          (2, 5, 5, "article form", "item", 0), (1, 60, 0, "article form", "", 0), (1, 1, 0, "article", "", 1), (5, 4, 4, "article boilerplate", "item", 0)),
    _page((1, 1, 1, "boilerplate", "", 0), (1, 2, 0, "article", "heading", 1), (1, 4, 2, "article", "", 1), (1, 2, 2, "article", "item", 1),
          (1, 3, 0, "article", "", 1), (1, 12, 2, "boilerplate", "", 0), (1, 3, 0, "article", "heading", 1), (1, 5, 5, "boilerplate", "", 0)),
    # no container is marked: words and links decide
    _page((8, 1, 1, "", "item", 0), (1, 7, 0, "", "heading", 1), (3, 55, 1, "", "", 1), (1, 12, 0, "", "", 1), (1, 80, 3, "", "", 1),
          (5, 6, 6, "", "item", 0), (1, 9, 2, "", "", 0)),
    _page((3, 2, 2, "", "", 0), (1, 3, 0, "", "", 0), (1, 9, 0, "", "heading", 1), (1, 28, 0, "", "", 1), (1, 45, 0, "", "", 1), (4, 3, 3, "", "item", 0)),
    _page((1, 4, 4, "", "", 0), (1, 22, 22, "", "", 0), (2, 33, 0, "", "", 1), (2, 18, 0, "", "item", 1), (1, 26, 0, "", "", 1), (1, 20, 18, "", "", 0)),
    _page((1, 3, 3, "", "item", 0), (1, 5, 5, "", "item", 0), (1, 16, 0, "boilerplate", "", 0), (1, 150, 4, "", "", 1), (1, 65, 0, "form", "", 0)),
    _page((1, 5, 0, "", "", 1)),
    _page((1, 2, 2, "", "", 0), (1, 2, 0, "", "heading", 0), (6, 9, 8, "", "item", 0)),
]


def _marked_pages() -> Iterator[list[tuple[Block, int]]]:
    """Pages whose containers say what belongs to the article, with blocks of every length and share of links."""
    shapes = [(words, links * words // 10) for words in (1, 3, 8, 20, 60, 150) for links in (0, 1, 3, 6, 10)]
    for place in ("boilerplate", "form", "article boilerplate", "article form"):
        for element in ("", "heading", "item"):
            inner = [(1, *shape, "article", element, 1) for shape in shapes]
            outer = [(1, *shape, place, element, 0) for shape in reversed(shapes)]
            yield _page(*(row for pair in zip(inner, outer, strict=True) for row in pair))
            yield _page(*outer, *inner)


@dataclass
class Tree:
    """A binary tree in arrays; leaves have feature -1 and carry the share of article blocks."""

    feature: list[int]
    cut: list[float]
    left: list[int]
    right: list[int]
    share: list[float]

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        feature, cut, left, right = (np.array(v) for v in (self.feature, self.cut, self.left, self.right))
        while len(x) and (feature[node] >= 0).any():
            go = feature[node] >= 0
            low = x[np.arange(len(x)), np.maximum(feature[node], 0)] <= cut[node]
            node = np.where(go, np.where(low, left[node], right[node]), node)
        return np.array(self.share)[node] >= 0.5


def train(x: np.ndarray, y: np.ndarray, depth: int = 7) -> Tree:
    """Grow by the Gini index until leaves are pure; ties go to the first feature and lowest cut."""
    tree = Tree([], [], [], [], [])

    def grow(rows: np.ndarray, level: int) -> int:
        at = len(tree.feature)
        for values, value in zip((tree.feature, tree.cut, tree.left, tree.right, tree.share), (-1, 0.0, -1, -1, float(y[rows].mean())), strict=True):
            values.append(value)
        if level == depth or len(set(y[rows])) == 1:
            return at
        best = (0.0, None, None)
        for f in range(x.shape[1]):
            values = np.unique(x[rows, f])
            for cut in (values[1:] + values[:-1]) / 2:
                low = x[rows, f] <= cut
                impurity = sum(part.sum() * y[rows][part].mean() * (1 - y[rows][part].mean()) for part in (low, ~low))
                gain = len(rows) * y[rows].mean() * (1 - y[rows].mean()) - impurity
                if gain > best[0] + 1e-9:
                    best = (gain, f, cut)
        if best[1] is not None:
            tree.feature[at], tree.cut[at] = best[1], float(best[2])
            low = x[rows, best[1]] <= best[2]
            tree.left[at], tree.right[at] = grow(rows[low], level + 1), grow(rows[~low], level + 1)
        return at

    grow(np.arange(len(y)), 0)
    return tree


def trained() -> Tree:
    """The tree of TABLE and of pages with marked containers."""
    pages = [*TABLE, *_marked_pages()]
    x = np.concatenate([_described([b for b, _ in page]) for page in pages])
    return train(x, np.array([label for page in pages for _, label in page], float))


def main_text(page: str | None, tree: Tree) -> str:
    """The article's blocks joined by single spaces."""
    found = blocks(page or "")
    if not found:
        return ""
    keep = tree.predict(_described(found))
    return " ".join(b.text for b, k in zip(found, keep, strict=True) if k)


def _extracted(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(value.as_py(), tree) for value in batch.column("html")]
            yield pa.RecordBatch.from_arrays([
                batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(
        _extracted(trained()), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
