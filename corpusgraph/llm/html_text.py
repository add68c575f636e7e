"""HTML extraction: flat text blocks, classified by a decision tree over their own and their neighbours' features.

A page is cut into flat blocks at block-level tags. Each block has its number of words and its link density (share of
words in links); the tree sees these for the block and for the ones before and after it, whether it is a heading, and
what the containers around it say: whether the block lies in the page's main container (an ``article``, or else a
``main``, or else a container named as content), whether the page has one, and whether a container is marked as
something else (menus, footers, sidebars, notices, adverts, reader comments; weakly: page headers and forms). The tree
(CART, Gini) is trained on ``EXAMPLES``, a small table of labelled blocks below.

Text: character references are decoded, white space in a block becomes one space, blocks join with an empty line.

Defined results: a null, empty or text-less page gives an empty text; broken or cut markup is read as far as it goes (an
open tag ends with its page, a lone ``<`` is text); repeated pages are read each by itself; an empty table gives no
rows; other columns pass through (one named ``main_text`` gives way to the result).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusgraph.llm.words import by_document

# Tags by their role, and words in class, id and role attributes.
BLOCK_TAGS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot "
    "thead tr ul".split()
)
SPACE_TAGS = {"br", "td", "th", "wbr"}
RAW_TAGS = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "select", "button", "object", "canvas"}
CONTAINERS = set("article aside blockquote body details dialog div dl fieldset figure footer form header li main menu nav ol section table ul".split())
OTHER_TAGS = {"aside", "dialog", "footer", "menu", "nav"}
FORM_TAGS = {"fieldset", "form"}
WEAK_TAGS = FORM_TAGS | {"header"}
OTHER_WORDS = set(
    "ad ads advert advertisement alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo "
    "cookie cookies disqus footer gdpr menu modal nav navbar navigation newsletter notice pagination pager popup promo "
    "recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe tags "
    "teaser toolbar widget".split()
)
WEAK_WORDS = {"header", "masthead", "search", "topbar"}
COMMENT_WORDS = {"comment", "comments", "disqus", "replies", "respond"}
CONTENT_WORDS = {"article", "articlebody", "content", "entry", "main", "post", "story"}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S
)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_WORDS = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str = ""
    words: int = 0
    linked: int = 0
    heading: bool = False
    other: bool = False
    weak: bool = False
    inside: tuple[bool, bool, bool] = (False, False, False)


@dataclass
class _Open:
    """A container: its tag, and what it says of its content."""

    tag: str
    level: int = -1  # 0: article, 1: main, 2: named as content
    other: bool = False  # by its names; an article or main element in it overrides
    firm: bool = False  # by its tag, or reader comments
    weak: bool = False


def _container(tag: str, attributes: str) -> _Open:
    words: set[str] = set()
    for value in _NAMES.findall(attributes):
        split = re.sub(r"([a-z])([A-Z])", r"\1 \2", value)
        words.update(_WORDS.findall(split.lower()))
        words.update(_WORDS.findall(value.lower()))
    if tag in ("html", "body"):
        return _Open(tag)
    found = _Open(tag, firm=tag in OTHER_TAGS or bool(words & COMMENT_WORDS), weak=tag in WEAK_TAGS or bool(words & WEAK_WORDS))
    found.other = found.firm or bool(words & OTHER_WORDS)
    if tag == "article":
        found.level = 0
    elif tag == "main" or "main" in words and "role" in attributes.lower():
        found.level = 1
    elif words & CONTENT_WORDS and not found.other:
        found.level = 2
    return found


class _Page:
    """Blocks of a page while its tags go by."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.open: list[_Open] = []
        self.parts: list[str] = []
        self.links: list[str] = []
        self.in_link = False
        self.heading = False

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            linked = len(" ".join(self.links).split())
            block = Block(text, len(text.split()), linked, self.heading)
            self._place(block)
            self.blocks.append(block)
        self.parts, self.links = [], []

    def _place(self, block: Block) -> None:
        other = weak = False
        levels = [False] * 3
        for c in self.open:
            if c.level in (0, 1) and not c.other:
                weak = False  # a form or a marked wrapper around the article itself says nothing of it
                if not any(o.firm for o in self.open):
                    other = False
            other |= c.other
            inside = levels[0] or levels[1]
            other |= inside and c.tag in FORM_TAGS
            weak |= c.weak and not inside
            if c.level >= 0:
                levels[c.level] = True
        block.other, block.weak, block.inside = other, weak, (levels[0], levels[1], levels[2])

    def begin(self, tag: str, attributes: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
            self.heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
            if tag in CONTAINERS:
                self.open.append(_container(tag, attributes))
        elif tag in SPACE_TAGS:
            self.parts.append(" ")
        elif tag == "a":
            self.in_link = True

    def end(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
            self.heading = False
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k].tag == tag:
                    del self.open[k:]
                    break
        elif tag == "a":
            self.in_link = False

    def data(self, text: str) -> None:
        text = html.unescape(text)
        self.parts.append(text)
        if self.in_link:
            self.links.append(text)


def blocks_of(page: str) -> list[Block]:
    """Flat blocks of a page in order."""
    state, at = _Page(), 0
    while True:
        m = _TAG.search(page, at)
        if m is None:
            break
        if m.start() > at:
            state.data(page[at : m.start()])
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            if m[1]:
                state.end(tag)
            elif tag in RAW_TAGS:
                if not m[3].endswith("/"):
                    close = re.compile(f"</{tag}[^>]*>", re.I).search(page, at)
                    at = close.end() if close else len(page)
            else:
                state.begin(tag, m[3])
    rest = page[at:]
    cut = re.search(r"<[/a-zA-Z!][^>]*\Z", rest)  # a tag that the end of the page cuts
    state.data(rest[: cut.start()] if cut else rest)
    state.flush()
    return state.blocks


FEATURES = ("other", "weak", "in_main", "has_main", "heading", "words", "density", "words_before", "density_before", "words_after", "density_after")


def features(blocks: list[Block]) -> np.ndarray:
    """A row for each block. Missing neighbours have no words and are all links."""
    n = len(blocks)
    words = np.array([0, *[b.words for b in blocks], 0], float)
    density = np.array([1.0, *[b.linked / b.words for b in blocks], 1.0])
    has = [any(b.inside[k] and not b.other for b in blocks) for k in range(3)]
    level = has.index(True) if any(has) else -1
    own = np.array([
        (b.other, b.weak, level >= 0 and b.inside[level], level >= 0, b.heading) for b in blocks
    ], float).reshape(n, 5)
    return np.column_stack([own, words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:]])


# A small labelled table. Each page is a list of (label, markup): + belongs to the article, - does not, a bare tag
# opens or closes a container. A number in braces stands for so many words, {a7} for seven words in a link. Pages whose
# containers tell the article are read three times, with the numbers at SCALES: their labels hold for blocks of any length.
SCALES = (0.2, 1, 6)
EXAMPLES = (
    # The article in its own element, with short and long paragraphs, between menus, adverts and a footer.
    [("-", "<nav><ul><li>{a1}</li><li>{a2}</li></ul></nav><div class=ad>{12}</div>"), ("", "<article>"), ("+", "<h1>{8}</h1>"),
     ("+", "<p>{60}</p>"), ("+", "<p>{1}</p>"), ("+", "<p>{3}</p>"), ("-", "<aside>{40}</aside>"), ("+", "<p>{25}</p>"), ("", "</article>"),
     ("-", "<footer>{9}</footer>")],
    [("-", "<header><p>{4}</p><h1>{3}</h1></header>"), ("", "<article>"), ("+", "<header><h1>{7}</h1></header>"), ("+", "<p>{30} {a20}</p>"),
     ("+", "<p>{a6}</p>"), ("+", "<ul><li>{5}</li><li>{a3}</li></ul>"), ("-", "<div class=share>{a2} {a2}</div>"), ("", "</article>"),
     ("-", "<section id=comments><h2>{2}</h2><p>{45}</p></section>"), ("-", "<form><p>{30}</p></form>")],
    [("-", "<div class='cookie notice'>{50}</div>"), ("", "<article>"), ("+", "<p>{2}</p>"), ("-", "<form>{20}</form>"), ("+", "<p>{80}</p>"),
     ("-", "<div class=comments><p>{60}</p></div>"), ("", "</article>"), ("-", "<div>{35}</div>"), ("-", "<p>{70}</p>")],
    # A main element instead, and containers named as content.
    [("-", "<header>{20}</header><p>{6}</p>"), ("", "<main>"), ("+", "<h1>{5}</h1>"), ("+", "<p>{40}</p>"), ("+", "<p>{2}</p>"),
     ("-", "<nav>{a9}</nav>"), ("", "</main>"), ("-", "<div>{a4} {3}</div>"), ("-", "<p>{33}</p>")],
    [("-", "<div class=menu>{a5}</div>"), ("", "<div id=content>"), ("+", "<h2>{4}</h2>"), ("+", "<p>{18}</p>"), ("+", "<p>{1}</p>"),
     ("-", "<div class=sidebar>{50}</div>"), ("", "</div>"), ("-", "<div>{28}</div>"), ("-", "<p>{3}</p>")],
    # No container says anything: words and links decide, and neighbours for short blocks.
    [("-", "<p>{a3}</p>"), ("-", "<p>{a2} {a2}</p>"), ("+", "<h1>{7}</h1>"), ("+", "<p>{45}</p>"), ("+", "<p>{6}</p>"), ("+", "<p>{70} {a5}</p>"),
     ("+", "<p>{20}</p>"), ("-", "<p>{a12} {2}</p>"), ("-", "<p>{5}</p>")],
    [("-", "<p>{4}</p>"), ("-", "<p>{a6}</p>"), ("+", "<p>{38}</p>"), ("+", "<p>{9}</p>"), ("+", "<p>{26}</p>"), ("-", "<p>{a8} {a9}</p>"),
     ("-", "<p>{3}</p>"), ("-", "<p>{a25} {6}</p>")],
    [("-", "<div class=header><p>{25}</p></div>"), ("-", "<p>{a4}</p>"), ("+", "<h2>{6}</h2>"), ("+", "<p>{90}</p>"), ("+", "<p>{14}</p>"),
     ("+", "<p>{22}</p>"), ("-", "<form><p>{24}</p></form>"), ("-", "<footer><p>{30}</p></footer>"), ("-", "<div class=related><p>{a30}</p></div>")],
)


def _filled(markup: str, word: str, scale: float) -> str:
    """Markup of the table with its words written out."""

    def words(m: re.Match) -> str:
        text = " ".join([word] * max(1, round(int(m[2]) * scale)))
        return f"<a href=x>{text}</a>" if m[1] else text

    return re.sub(r"\{(a?)(\d+)\}", words, markup)


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the table's blocks."""
    rows, labels = [], []
    for page in EXAMPLES:
        for scale in SCALES if any(label == "" for label, _ in page) else (1,):
            found = blocks_of("".join(_filled(text, f"w{k}", scale) for k, (_, text) in enumerate(page)))
            rows.append(features(found))
            labels += [page[int(re.search(r"w(\d+)", b.text)[1])][0] == "+" for b in found]
    return np.concatenate(rows), np.array(labels, float)


@dataclass
class Tree:
    """A node: a share of article blocks, or a feature and the bound up to which blocks go left."""

    share: float
    feature: int = -1
    bound: float = 0.0
    below: list[Tree] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.share >= 0.5)
        left = x[:, self.feature] <= self.bound
        out = np.empty(len(x), bool)
        out[left] = self.below[0].predict(x[left])
        out[~left] = self.below[1].predict(x[~left])
        return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7) -> Tree:
    """CART: the split with the least Gini impurity, first feature and lowest bound first, until a node is pure."""
    node = Tree(float(y.mean()))
    if depth == 0 or node.share in (0.0, 1.0):
        return node
    best = node.share * (1 - node.share) * len(y) - 1e-9
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for bound in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= bound
            cost = sum(p.mean() * (1 - p.mean()) * len(p) for p in (y[left], y[~left]))
            if cost < best - 1e-9:
                best, node.feature, node.bound = cost, f, float(bound)
    if node.feature >= 0:
        left = x[:, node.feature] <= node.bound
        node.below = [grow(x[side], y[side], depth - 1) for side in (left, ~left)]
    return node


def train() -> Tree:
    return grow(*labelled_blocks())


def main_text(page: str, tree: Tree) -> str:
    found = blocks_of(page)
    if not found:
        return ""
    keep = tree.predict(features(found))
    return "\n\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """The pages with ``main_text``."""
    tree = train()
    pages = pages.drop("main_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in by_document(batches, html):
            found = [
                main_text(data[lo:hi].tobytes().decode("utf-8", "replace"), tree)
                for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)
            ]
            columns = [*rows.columns, pa.array(found, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(columns))])

    fields = [*pages.schema.fields, T.StructField("main_text", T.StringType())]
    plain = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(fields)])
    return pages.mapInArrow(run, plain).toDF(*[f.name for f in fields])
