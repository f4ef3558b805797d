"""Main text of web pages: flat text blocks, shallow features, a decision tree.

A page is read once as a flat row of text blocks: runs of text between tags that begin or end blocks.
Features of a block: its words and its link density (share of words inside links), the same of the block
before and of the block after, whether it is a heading or a list item or cell, and whether it stands in a main region (article, main and what is
named so) or in one set apart (nav, footer, aside, form and what is named so). The tree is grown (Gini impurity) on PAGES, a small
table of labelled pages, which the same reader reads. Most of them have no regions that say anything, so words and link densities of
neighbours are what the tree asks about first.

Markup, comments of the markup, scripts, styles and what else is never shown is no text. Character references are decoded
once. White space in a block becomes one space; blocks that are kept are joined in page order by two line feeds.
Null html counts as empty; a page without main text gives an empty text. Broken markup never fails: end tags may be left out, those
that close nothing say nothing, and what is left open ends with its parent or the page (a script or another element of raw text with
the page). Reading is linear in the page. Repeated rows give repeated results, an empty table an empty one.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import map_texts, table

ATTRIBUTES = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
#: Elements whose content is no markup, and never text of a page.
RAW = "script|style|title|textarea|iframe|xmp|noembed|noframes"
TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>]){ATTRIBUTES}>.*?(?:</\1(?=[\s/>])[^>]*(?:>|\Z)|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({ATTRIBUTES})>|<[/!?a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
#: Elements with markup inside that isn't shown as text.
GONE = frozenset("noscript template svg math object canvas select datalist button audio video".split())
FOREIGN = frozenset("svg math".split())
INLINE = frozenset("abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li dt dd td th option".split())
PLAIN = frozenset("p table article main blockquote".split())
#: What a start tag ends where it was left open.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "tbody": {"td", "th", "tr", "thead", "tbody"}, "tfoot": {"td", "th", "tr", "tbody"}, "option": {"option"}}
MAIN = frozenset("article main".split())
APART = frozenset("nav footer aside form menu dialog".split())
ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
#: Parts of class, id and role names of regions apart from the main text.
APART_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs footer sidebar aside widget widgets related recommended share sharing social comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription signup pagination pager contentinfo complementary toolbar".split()
)
#: Names of the top of a page, which inside the main region is the top of the article.
TOP_NAMES = frozenset("header masthead topbar".split())
#: Whole elements, which no such name sets apart; an article only if one of its names is nothing else.
WHOLE = frozenset("html body main article".split())
#: Names that begin or end so say what an element has or does, not what it is.
STATES = frozenset("has have with without no is not show hide enabled disabled open opened closed active inactive visible on off".split())
MAIN_NAMES = frozenset("article main content post story entry".split())

#: Labelled pages: a number in braces stands for so many words, what an element with the attribute keep holds is main text.
PAGES = [
    # No regions: what is linked, what is long, and what stands beside it.
    "<div><a href=x>{1}</a> | <a href=x>{2}</a> | <a href=x>{1}</a></div><div>{4}</div><h1 keep>{7}</h1><div keep>{60}</div><div keep>{3}</div><div keep>{45} <a href=x>{3}</a></div><div><a href=x>{4}</a></div><div>{5}</div>",
    "<ul><li><a href=x>{1}</a><li><a href=x>{2}</a><li><a href=x>{1}</a></ul><h2 keep>{5}</h2><p keep>{30}</p><p keep>{80} <a href=x>{2}</a></p><p keep>{12}</p><p><a href=x>{3}</a> {1}</p><ul><li><a href=x>{2}</a><li><a href=x>{3}</a></ul><p>{6} <a href=x>{2}</a></p>",
    "<table><tr><td><a href=x>{2}</a><td><a href=x>{2}</a></table><table><tr><td keep>{90}<td><a href=x>{3}</a></table><p keep>{40}</p><p keep>{9}</p><p keep>{26}</p><div><a href=x>{1}</a> <a href=x>{1}</a></div>",
    "<div><a href=x>{2}</a></div><div><a href=x>{1}</a></div><p keep>{18}</p><p keep>{50}</p><p keep><a href=x>{4}</a></p><p keep>{70}</p><p keep>{22}</p><div><a href=x>{2}</a></div><div><a href=x>{3}</a></div>",
    "<div>{2} <a href=x>{2}</a></div><div><a href=x>{3}</a></div><h1 keep>{6}</h1><p keep>{14}</p><p keep>{200} <a href=x>{12}</a></p><h3 keep>{3}</h3><p keep>{33}</p><ul keep><li>{12} <a href=x>{1}</a><li>{15}<li>{10}</ul><p keep>{48}</p><div><a href=x>{2}</a></div><div><a href=x>{2}</a></div>",
    "<p><a href=x>{1}</a></p><p>{4} <a href=x>{3}</a></p><p><a href=x>{3}</a></p><p keep>{120} <a href=x>{5}</a></p><p keep>{20}</p><p keep>{90}</p><p>{1} <a href=x>{3}</a></p><p><a href=x>{5}</a></p>",
    "<div><a href=x>{8}</a></div><div><a href=x>{9}</a></div><div><a href=x>{7}</a></div><h2 keep>{4}</h2><p keep>{35}</p><p keep>{28}</p><h4><a href=x>{6}</a></h4><p><a href=x>{11}</a></p><p><a href=x>{10}</a></p>",
    "<ul><li><a href=x>{1}</a><li><a href=x>{1}</a><li><a href=x>{1}</a><li><a href=x>{2}</a></ul><p keep>{16}</p><ul keep><li>{8}<li>{11} <a href=x>{2}</a><li>{9}</ul><p keep>{24}</p><ul><li><a href=x>{3}</a><li><a href=x>{4}</a></ul>",
    "<h1 keep>{5}</h1><p keep>{40}</p><p keep>{7}</p><p keep>{65}</p>",
    "<div><a href=x>{2}</a></div><p keep>{55}</p><p keep>{31}</p><p keep>{4}</p>",
    "<p keep>{12}</p><p keep>{3}</p><p keep>{28} <a href=x>{2}</a></p>",
    "<p keep>{150}</p><ul><li><a href=x>{1}</a><li><a href=x>{1}</a></ul>",
    "<div><a href=x>{1}</a> | <a href=x>{1}</a></div><div keep>{75} <a href=x>{9}</a></div><div keep>{20} <a href=x>{8}</a></div><div keep>{51}</div><div><a href=x>{2}</a> {1}</div>",
    "<h1 keep>{8}</h1><p keep>{6}</p>",
    "<div><a href=x>{2}</a> | <a href=x>{1}</a></div><div keep>{5} <a href=x>{2}</a></div><div keep>{30}</div><div keep>{6} <a href=x>{3}</a></div><div keep>{5} <a href=x>{2}</a></div><div keep>{60}</div>",
    "<h2 keep>{6}</h2><div keep>{14} <a href=x>{6}</a></div><div keep>{9} <a href=x>{4}</a></div><div keep>{110}</div><div keep>{5} <a href=x>{2}</a></div><div><a href=x>{3}</a> <a href=x>{2}</a></div>",
    "<p><a href=x>{2}</a></p><p>{2} <a href=x>{2}</a></p><p><a href=x>{3}</a></p><p>{1} <a href=x>{1}</a></p><p keep>{33}</p><p keep>{15}</p><p>{2} <a href=x>{2}</a></p><p><a href=x>{2}</a></p>",
    "<div><a href=x>{1}</a> <a href=x>{1}</a></div><p keep>{5}</p><p keep>{15}</p><p keep>{5}</p><p keep>{5}</p><p keep>{30}</p><div><a href=x>{2}</a></div><div><a href=x>{1}</a></div>",
    # Regions that say something: short texts of an article, long ones beside it.
    "<nav><ul><li><a href=x>{1}</a><li><a href=x>{2}</a></ul></nav><div class=ad>{9}</div><article keep><h1>{8}</h1><p>{60}<p>{3}<p>{140} <a href=x>{4}</a></article><footer>{12} <a href=x>{1}</a></footer>",
    "<nav><ul><li><a href=x>{1}</a><li><a href=x>{1}</a></ul></nav><div class=ad>{4}</div><article keep><h1>{3}</h1><p>{2}</p></article><footer>{3}</footer>",
    "<nav><a href=x>{1}</a></nav><div class=ad>{40}</div><article keep><h1>{9}</h1><p>{1}</p><p>{6}</p></article><footer>{25}</footer>",
    "<header>{5} <a href=x>{2}</a></header><main keep><p>{4}</p><p>{1}</p></main><aside><p>{55}</p><p>{18}</p></aside><footer>{2}</footer>",
    "<header><p>{7}</p><p>{40}</p></header><main><h2 keep>{4}</h2><p keep>{1}</p><p keep>{22}</p><ul keep><li>{6}<li>{9} <a href=x>{1}</a></ul><section class=comments><h3>{1}</h3><p>{55}</p><p>{18}</p></section></main>",
    "<main><p keep>{13}</p><aside><p>{25}</p><p><a href=x>{2}</a></p></aside><p keep>{5}</p><p keep>{2}</p><form>{3} <label>{2}</label></form></main><footer>{6}</footer>",
    "<article><h1 keep>{9}</h1><p keep>{11}</p><p keep><a href=x>{4}</a></p><p keep>{2} <a href=x>{2}</a></p><p keep>{70} <a href=x>{10}</a></p><p keep>{8} <a href=x>{7}</a></p></article>",
    "<article><p keep>{21}</p><p keep><a href=x>{6}</a></p><p keep>{17}</p><ul><li><a href=x>{2}</a><li><a href=x>{3}</a><li><a href=x>{2}</a></ul></article>",
    "<article keep><h1>{6}</h1><p>{1}</p><p><a href=x>{3}</a></p><p>{6}</p></article><div id=comments><p>{30}</p><p>{80} <a href=x>{3}</a></p><p>{4}</p></div>",
    "<div class=cookie-banner><p>{20}</p></div><div class=sidebar><p>{90}</p><p>{35}</p></div><div class=content keep><h1>{4}</h1><p>{100}</p><p>{5}</p></div><div class=newsletter>{14}</div>",
    "<article keep><p>{4}</p><ul><li>{1}<li>{2}</ul></article><div class=share>{2}</div>",
    "<article keep><h1>{2}</h1><p>{2}</p><p>{5}</p></article><div class=related><h3>{2}</h3><ul><li>{9} <a href=x>{3}</a><li><a href=x>{5}</a></ul></div>",
    "<article keep><h1><a href=x>{5}</a></h1><p>{16}</p><blockquote>{8} <a href=x>{3}</a></blockquote><p>{1}</p><p><a href=x>{1}</a></p></article><nav><a href=x>{2}</a> <a href=x>{1}</a></nav>",
    "<nav><ul><li><a href=x>{2}</a><li><a href=x>{1}</a></ul></nav><article keep><h1>{3}</h1><p>{1}</p><p>{2}</p></article><nav><a href=x>{2}</a></nav>",
    "<ul class=menu><li><a href=x>{1}</a><li><a href=x>{3}</a></ul><main keep><h1>{1}</h1><p>{4}</p><p>{9}</p></main><footer>{4}</footer>",
    "<nav><a href=x>{2}</a></nav><div class=content keep><h1>{5}</h1><p>{2}</p></div><div class=related><a href=x>{4}</a></div>",
    "<nav><a href=x>{1}</a></nav><article><p keep>{2}</p><nav><ul><li><a href=x>{2}</a><li><a href=x>{1}</a></ul></nav><p keep>{4}</p><p keep>{1}</p></article>",
    "<article><p keep>{4}</p><div class=share><a href=x>{1}</a> <a href=x>{1}</a></div><p keep>{1}</p><p keep>{9}</p><aside><a href=x>{3}</a></aside><p keep>{3}</p><div class=ad><a href=x>{5}</a></div></article>",
    "<main><h1 keep>{2}</h1><p keep>{20}</p><div class=widget><a href=x>{2}</a></div><p keep>{1}</p><p keep><a href=x>{2}</a></p><div class=related><h4>{2}</h4><ul><li><a href=x>{6}</a><li><a href=x>{4}</a></ul></div></main>",
    "<article keep><p>{2} <a href=x>{1}</a></p><p><a href=x>{4}</a></p><p>{30}</p><p>{1} <a href=x>{1}</a></p></article>",
    "<nav><a href=x>{3}</a></nav><article keep><p>{2} <a href=x>{1}</a></p><p>{12}</p><p>{1} <a href=x>{1}</a></p></article><div class=share><a href=x>{2}</a></div>",
    "<main><p keep>{40}</p><p keep>{1} <a href=x>{1}</a></p><aside><a href=x>{5}</a></aside><p keep>{2} <a href=x>{1}</a></p><div class=ad><a href=x>{2}</a></div></main>",
    "<article><p keep>{8}</p><p keep>{2} <a href=x>{1}</a></p><nav><a href=x>{2}</a><a href=x>{2}</a></nav><p keep>{3} <a href=x>{2}</a></p><div class=related><a href=x>{6}</a></div></article>",
    "<main keep><p><a href=x>{12}</a></p><p>{3}</p><p>{7} <a href=x>{7}</a></p><p>{2}</p></main>",
    "<article keep><h1>{4}</h1><table><tr><td>{1}<td>{2}<tr><td>{3}<td>{1} <a href=x>{1}</a></table><p>{9}</p><p><a href=x>{2}</a></p><p>{30}</p></article><div class=promo>{15}</div><div class=promo><p>{6}</p></div>",
    "<article><h2 keep>{3}</h2><p keep>{14}</p><p keep>{1}</p><ul><li><a href=x>{4}</a><li><a href=x>{1}</a><li><a href=x>{5}</a><li><a href=x>{3}</a></ul><p keep>{10}</p></article>",
]

#: A block: words, words in links, heading, item, in a main region, in one apart, labelled as main.
Block = tuple[int, int, bool, bool, bool, bool, bool]
EDGE: Block = (0, 0, False, False, False, False, False)


def named(attributes: str) -> tuple[list[str], bool, bool]:
    """The class, id and role names of an element, whether it is hidden, whether it is labelled."""
    names, hidden, labelled = [], False, False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role"):
            names += value.split()
        elif name == "keep":
            labelled = True
        hidden |= name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value) is not None)
    return names, hidden, labelled


def set_apart(tag: str, names: list[str], in_main: bool) -> bool:
    """Whether a class, id or role names a region apart from the main text."""
    for name in names:
        parts = [w for w in re.split(r"[^a-z]+", name) if w]
        if tag in WHOLE:
            if tag == "article" and name in APART_NAMES:
                return True
        elif parts and parts[0] not in STATES and parts[-1] not in STATES and not (APART_NAMES if in_main else APART_NAMES | TOP_NAMES).isdisjoint(parts):
            return True
    return False


class Reader:
    """Reads a page into blocks. State: what is inherited by the elements below the one that is open."""

    def __init__(self, page: str):
        self.texts: list[str] = []
        self.facts: list[Block] = []
        self.parts: list[str] = []
        self.linked = 0
        #: The number of open elements at the start of the open link, or none.
        self.link: int | None = None
        self.main = self.apart = self.gone = self.labelled = False
        self.kind = "p"
        self.open: list[tuple] = []
        self.count: Counter[str] = Counter()
        at = 0
        for m in TAG.finditer(page):
            self.read(page[at : m.start()])
            at = m.end()
            if m[3]:
                self.tag(m[3].lower(), bool(m[2]), m[4])
            elif m[1]:
                self.flush()
        self.read(page[at:])
        self.flush()

    def read(self, text: str) -> None:
        if text and not self.gone:
            plain = entities.unescape(text) if "&" in text else text
            self.parts.append(plain)
            if self.link is not None:
                self.linked += len(plain.split())

    def flush(self) -> None:
        if self.parts:
            words = "".join(self.parts).split()
            if words:
                self.texts.append(" ".join(words))
                self.facts.append((len(words), min(self.linked, len(words)), self.kind == "h", self.kind == "i", self.main, self.apart, self.labelled))
            self.parts.clear()
        self.linked = 0

    def tag(self, name: str, ends: bool, attributes: str) -> None:
        if name == "a":
            self.link = None if ends else len(self.open)
        elif name in INLINE or name in VOID:
            if name == "br":
                self.parts.append(" ")
            elif name not in INLINE:
                self.flush()
        elif ends:
            self.flush()
            if self.count[name]:
                while self.pop() != name:
                    pass
        else:
            self.flush()
            # A paragraph ends where any block begins; items, cells and rows where the next does.
            if self.open and self.open[-1][0] == "p":
                self.pop()
            while self.open and self.open[-1][0] in ENDS.get(name, ()):
                self.pop()
            self.push(name, attributes)

    def push(self, name: str, attributes: str) -> None:
        if name in FOREIGN and attributes.endswith("/"):
            return
        self.open.append((name, self.main, self.apart, self.gone, self.labelled, self.kind))
        self.count[name] += 1
        self.gone |= name in GONE
        self.kind = "h" if name in HEADINGS else "i" if name in ITEMS else "p" if name in PLAIN else self.kind
        names, hidden, labelled = named(attributes) if attributes else ([], False, False)
        self.gone |= hidden
        self.labelled |= labelled
        if not self.apart:
            if name in APART or (name == "header" and not self.main) or (names and set_apart(name, names, self.main)):
                self.apart = True
            elif name in MAIN or (name not in ("body", "html") and any(not MAIN_NAMES.isdisjoint(re.split(r"[^a-z]+", x)) for x in names)):
                self.main = True

    def pop(self) -> str:
        name, self.main, self.apart, self.gone, self.labelled, self.kind = self.open.pop()
        self.count[name] -= 1
        if self.link is not None and len(self.open) < self.link:
            self.link = None
        return name


def features(facts: list[Block]) -> list[tuple[float, ...]]:
    """Of each block: words and link density, of the one before, of the one after, and the rest of what is known of it."""
    padded = [EDGE, *facts, EDGE]
    shape = [(float(words), linked / max(1, words)) for words, linked, *_ in padded]
    return [(*shape[i], *shape[i - 1], *shape[i + 1], *map(float, padded[i][2:6])) for i in range(1, len(padded) - 1)]


FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after", "heading", "item", "main", "apart")


#: Blocks that a leaf of the tree holds at least.
LEAF = 5
#: Sizes in which each labelled page is shown.
VARIANTS = 10


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6) -> tuple | bool:
    """A tree by Gini impurity: (feature, threshold, tree of rows up to it, tree of the rest), or the answer. Of equal splits the first feature's counts."""
    if depth == 0 or y.all() or not y.any():
        return bool(2 * y.sum() >= len(y))
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for low, high in pairwise(values.tolist()):
            left = x[:, f] <= (low + high) / 2
            if min(left.sum(), (~left).sum()) < LEAF:
                continue
            cost = sum(s.sum() * y[s].mean() * (1 - y[s].mean()) for s in (left, ~left))
            if best is None or cost < best[0] - 1e-9:
                best = (cost, f, (low + high) / 2, left)
    if best is None:
        return bool(2 * y.sum() >= len(y))
    _, f, cut, left = best
    low, high = grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)
    # A question whose answers are the same isn't asked.
    return low if low is high else (f, cut, low, high)


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of PAGES, each page in VARIANTS with from half to twice as many words in every place, so that no threshold rests on one number."""
    dice, x, y = random.Random(9), [], []
    for page in PAGES:
        for _ in range(VARIANTS):
            facts = Reader(re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * max(1, round(int(m[1]) * 2 ** dice.uniform(-1, 1)))), page)).facts
            x += features(facts)
            y += [f[6] for f in facts]
    return np.array(x), np.array(y)


@lru_cache(maxsize=1)
def trained() -> tuple | bool:
    return grow(*labelled_blocks())


def decide(row: tuple[float, ...]) -> bool:
    tree = trained()
    while isinstance(tree, tuple):
        f, cut, low, high = tree
        tree = low if row[f] <= cut else high
    return tree


def main_text(page: str | None) -> str:
    read = Reader(page or "")
    return "\n\n".join(text for text, row in zip(read.texts, features(read.facts), strict=True) if decide(row))


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """df with text (string) and n_chars (long)."""

    def step(pages: pa.Array) -> list[pa.Array]:
        texts = [main_text(p) for p in pages.to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return map_texts(df, html, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], step)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
