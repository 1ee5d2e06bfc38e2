"""HTML extraction: flat text blocks, classified by a decision tree on the words and link density of them and their neighbours.

A page is cut into blocks of text wherever a block-level tag begins or ends. A block's features are its words and link
density, those of the blocks before and after it, what the markup around it is called (an article, the main part, something
beside it, or nothing), how many words stand together with it in such markup and how many elsewhere. So an article in markup
that is called after something else can still be told by its words. The tree is trained on LABELLED, a small table of blocks.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_rows

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)(?:((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|[^>]*+(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([A-Za-z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.S)
#: Elements whose content is no text of the page. Fixed values.
SKIPPED = frozenset("script style title noscript template iframe object svg math canvas audio video textarea select button datalist".split())
#: Of these, elements whose content is not markup.
RAW = frozenset("script style title noscript iframe textarea".split())
#: Of these, elements that hold no sections, nor blocks if they aren't closed.
FLAT = frozenset("svg math canvas select button datalist".split())
SECTIONS = frozenset("article main section nav aside header footer form body".split())
BLOCKS = frozenset("p div ul ol dl table blockquote pre h1 h2 h3 h4 h5 h6".split())
#: Elements that don't end a block. Fixed values.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and words of class, id or role that name what is beside the article. Fixed values.
BESIDE_TAGS = frozenset("nav header footer aside".split())
NAMED_TAGS = frozenset("form menu dialog".split())
BESIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright disqus footer form gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup privacy promo promoted promotion related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets discussion kommentar kommentare commentaire commentaires comentario comentarios werbung anzeige anzeigen publicite publicidad rightcol rightcolumn leftcol leftcolumn siderail".split()
)
ARTICLE_WORDS = frozenset("article articlebody entry post story".split())
MAIN_WORDS = frozenset("main maincontent".split())
#: Before a word, these say that an element has it or lacks it, not that it is it.
QUALIFIERS = frozenset("has have no not with without show hide layout page template".split())

#: Parts of a page.
_PARTS = re.compile(r"<(?:main|article|nav|header|footer|aside|h1)\b")

#: Where a block stands.
BESIDE, NAMED, NOWHERE, MAIN, ARTICLE = -1.0, -0.5, 0.0, 0.5, 1.0
_WHERE = {"t": BESIDE, "b": NAMED, "n": NOWHERE, "m": MAIN, "a": ARTICLE}
#: The labelled table: pages of blocks (where, words, of them linked, label). ``where``: a inside an article, m in the main
#: part of a page, t in an element that is beside it, b in one so called, n nowhere that has a name; label 1: main text.
LABELLED = (
    (("t", 1, 1, 0), ("t", 1, 1, 0), ("t", 2, 2, 0), ("b", 12, 0, 0), ("a", 7, 0, 1), ("a", 80, 0, 1), ("a", 2, 0, 1), ("a", 140, 3, 1), ("t", 20, 0, 0)),
    (("t", 3, 3, 0), ("a", 9, 0, 1), ("a", 45, 0, 1), ("b", 30, 2, 0), ("a", 60, 4, 1), ("b", 40, 0, 0), ("b", 55, 0, 0), ("t", 9, 1, 0)),
    (("n", 2, 2, 0), ("n", 2, 2, 0), ("n", 1, 1, 0), ("n", 8, 0, 1), ("n", 70, 2, 1), ("n", 90, 0, 1), ("n", 12, 0, 1), ("n", 65, 1, 1), ("n", 3, 3, 0), ("n", 4, 4, 0), ("n", 5, 1, 0)),
    (("n", 1, 1, 0), ("n", 3, 3, 0), ("n", 40, 0, 1), ("n", 5, 0, 1), ("n", 33, 0, 1), ("n", 10, 9, 0), ("n", 12, 11, 0), ("n", 6, 6, 0)),
    (("b", 90, 2, 0), ("b", 120, 0, 0), ("a", 3, 0, 1), ("a", 1, 0, 1), ("a", 200, 0, 1), ("a", 25, 25, 1), ("b", 60, 0, 0), ("b", 75, 5, 0)),
    (("n", 4, 0, 0), ("n", 3, 3, 0), ("n", 2, 2, 0), ("n", 3, 0, 0), ("n", 4, 4, 0), ("n", 2, 2, 0)),
    (("n", 5, 0, 1), ("n", 30, 0, 1), ("n", 2, 0, 1), ("n", 50, 0, 1), ("n", 28, 0, 1), ("b", 7, 0, 0)),
    (("a", 6, 0, 1), ("a", 20, 3, 1), ("a", 10, 1, 1), ("a", 35, 4, 1), ("a", 12, 6, 1), ("a", 12, 0, 1), ("a", 6, 6, 1), ("a", 8, 0, 1), ("a", 5, 5, 1), ("a", 16, 2, 1)),
    (("n", 9, 0, 1), ("n", 25, 3, 1), ("n", 40, 6, 1), ("n", 14, 1, 1), ("n", 30, 0, 1), ("n", 7, 7, 0), ("n", 15, 14, 0)),
    (("a", 4, 4, 1), ("a", 5, 5, 1), ("a", 6, 0, 1), ("a", 31, 1, 1), ("a", 2, 0, 1), ("a", 18, 1, 1), ("a", 1, 0, 1)),
    # the main part may hold lists of links
    (("b", 4, 4, 0), ("m", 7, 0, 1), ("m", 60, 2, 1), ("m", 3, 0, 1), ("m", 44, 0, 1), ("m", 3, 3, 0), ("m", 2, 2, 0), ("m", 4, 4, 0), ("b", 12, 2, 0)),
    (("m", 2, 2, 0), ("m", 3, 3, 0), ("m", 5, 0, 1), ("m", 38, 1, 1), ("m", 25, 9, 1), ("m", 6, 6, 0), ("m", 5, 5, 0), ("b", 30, 0, 0)),
    (("m", 4, 0, 1), ("m", 2, 0, 1), ("m", 1, 0, 1), ("m", 9, 0, 1), ("b", 200, 0, 0), ("b", 12, 0, 0)),
    # an article of a few words beside much else
    (("b", 4, 4, 0), ("b", 50, 0, 0), ("a", 1, 0, 1), ("a", 2, 0, 1), ("b", 160, 0, 0), ("b", 90, 0, 0), ("b", 40, 3, 0)),
    (("b", 9, 2, 0), ("n", 30, 0, 1), ("n", 45, 1, 1), ("n", 3, 0, 1), ("n", 22, 0, 1), ("b", 180, 0, 0), ("b", 70, 0, 0), ("b", 150, 2, 0)),
    # no article
    (("b", 1, 1, 0), ("b", 2, 2, 0), ("b", 14, 0, 0), ("b", 35, 3, 0), ("n", 3, 3, 0), ("b", 20, 0, 0)),
    (("b", 5, 5, 0), ("b", 60, 0, 0), ("b", 30, 1, 0)),
    # articles in markup named after something else
    (("n", 2, 2, 0), ("n", 3, 3, 0), ("b", 7, 0, 1), ("b", 80, 2, 1), ("b", 3, 0, 1), ("b", 120, 0, 1), ("b", 64, 1, 1), ("n", 4, 4, 0)),
    (("t", 2, 2, 0), ("b", 6, 0, 1), ("b", 62, 0, 1), ("b", 2, 0, 1), ("b", 48, 1, 1), ("t", 8, 0, 0)),
    (("t", 2, 2, 0), ("t", 30, 0, 0), ("b", 5, 0, 1), ("b", 90, 0, 1), ("b", 70, 1, 1), ("t", 8, 0, 0), ("t", 60, 3, 0)),
    # elements beside an article never hold one
    (("t", 40, 0, 0), ("t", 120, 0, 0), ("t", 90, 4, 0), ("n", 4, 4, 0)),
    (("t", 9, 0, 0), ("t", 300, 0, 0), ("t", 80, 0, 0), ("b", 20, 0, 0)),
    (("b", 2, 2, 0), ("b", 3, 3, 0), ("b", 1, 1, 0), ("b", 9, 0, 1), ("b", 150, 4, 1), ("b", 95, 0, 1), ("b", 40, 0, 1), ("n", 5, 3, 0)),
    # short pages
    (("n", 14, 0, 1),),
    (("n", 6, 0, 1),),
    (("n", 9, 0, 1), ("b", 120, 3, 0)),
    (("n", 3, 0, 1), ("n", 11, 0, 1), ("b", 90, 0, 0)),
    (("n", 2, 2, 0), ("n", 2, 2, 0), ("n", 13, 0, 1)),
    (("b", 140, 2, 0), ("n", 4, 0, 1), ("n", 10, 0, 1), ("b", 60, 1, 0)),
)


def features(blocks: Iterable[tuple[float, int, int]]) -> np.ndarray:
    """Rows of (where, unlinked words of the run of blocks in such a place, unlinked words of all
    blocks that aren't beside it, whether the page names an article or main part, words before, here, after, link density
    before, here, after) for blocks of (where, words, linked)."""
    b = np.array(list(blocks), float).reshape(-1, 3)
    beside, own = b[:, 0] < 0, b[:, 1] - b[:, 2]
    run = np.cumsum(np.r_[0, b[1:, 0] != b[:-1, 0]]) if len(b) else np.zeros(0, int)
    together = np.bincount(run, own)[run] * beside if len(b) else own
    words = np.r_[0.0, b[:, 1], 0.0]
    density = np.r_[0.0, b[:, 2] / np.maximum(b[:, 1], 1), 0.0]
    page = np.full((len(b), 2), [own[~beside].sum(), float((b[:, 0] > 0).any())])
    return np.column_stack([b[:, 0], together, page, words[:-2], words[1:-1], words[2:], density[:-2], density[1:-1], density[2:]])


class Tree:
    """A binary decision tree by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 6):
        self.axis = None
        self.label = bool(len(y) and 2 * y.sum() >= len(y))
        if depth == 0 or not len(y) or y.min() == y.max():
            return
        best = (_gini(y) * len(y) - 1e-9, None, 0.0)
        for axis in range(x.shape[1]):
            values = np.unique(x[:, axis])
            for cut in (values[1:] + values[:-1]) / 2:
                left = x[:, axis] < cut
                best = min(best, (_gini(y[left]) * left.sum() + _gini(y[~left]) * (~left).sum(), axis, cut), key=lambda c: c[0])
        _, self.axis, self.cut = best
        if self.axis is not None:
            left = x[:, self.axis] < self.cut
            self.left, self.right = Tree(x[left], y[left], depth - 1), Tree(x[~left], y[~left], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.axis is None:
            return np.full(len(x), self.label)
        out = np.empty(len(x), bool)
        left = x[:, self.axis] < self.cut
        out[left], out[~left] = self.left.predict(x[left]), self.right.predict(x[~left])
        return out


def _gini(y: np.ndarray) -> float:
    p = y.mean() if len(y) else 0.0
    return 2 * p * (1 - p)


def train(labelled=LABELLED) -> Tree:
    x = np.concatenate([features((_WHERE[w], n, linked) for w, n, linked, _ in page) for page in labelled])
    return Tree(x, np.array([label for page in labelled for *_, label in page]))


def _named(value: str) -> int:
    """What one name of a class, id or role attribute says: -1 something beside the article, 1 an article, 2 the main part,
    0 neither. Its first or last word counts, unless a word before says that the element only has or lacks it."""
    words = [w.lower() for w in re.findall("[A-Z]?[a-z]+|[A-Z]+", value)]
    if not words or QUALIFIERS & set(words[:-1]):
        return 0
    ends = {words[0], words[-1], "".join(words)}
    if ends & BESIDE_WORDS:
        return -1
    if "".join(words) in MAIN_WORDS or words[0] in MAIN_WORDS:
        return 2
    return 1 if ends & ARTICLE_WORDS or "".join(words) in ARTICLE_WORDS else 0


def _where(tag: str, attributes: str, around: float) -> float:
    """Where the content of an element stands, given where the element does. An article or main part stays one inside
    markup of another name, but not inside a menu, footer or sidebar, where all stays beside it."""
    named: set[int] = set()
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id", "role", "itemprop"):
                named |= {_named(v) for v in value.split()}
            elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I) or name == "aria-hidden" and value == "true":
                return BESIDE
    if tag in BESIDE_TAGS and not (tag == "header" and around == ARTICLE):
        return BESIDE
    if around == BESIDE:
        return BESIDE
    if tag == "article":
        return NAMED if -1 in named and 1 not in named else ARTICLE
    if tag == "main":
        return around if around == ARTICLE else MAIN
    if tag in NAMED_TAGS:
        return min(around, NAMED)
    if 1 in named:
        return around if around < 0 else ARTICLE
    if -1 in named:
        return NAMED
    return max(around, MAIN) if 2 in named and around >= 0 else around


def blocks_of(page: str | None) -> list[tuple[str, float, int, int]]:
    """(text, where, words, linked words) of every block with text, in one pass. Unclosed elements end with the element
    around them or the page; end tags without a begin are passed over."""
    page = page or ""
    out: list[tuple[str, float, int, int]] = []
    stack: list[tuple[str, float]] = []  # block-level and skipped elements that are open, and where their content is
    opened: Counter[str] = Counter()  # of them, by tag
    last: dict[str, int] = {}  # where a tag last ends
    low = page.lower() if page.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), page)
    text: list[str] = []
    linked = anchors = at = skipping = 0
    where = NOWHERE

    def close() -> None:
        nonlocal linked
        words = _html.unescape("".join(text)).split()
        if words:
            out.append((" ".join(words), where, len(words), min(linked, len(words))))
        text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not skipping:
            text.append(piece)
            if anchors:
                linked += len(_html.unescape(piece).split())

    def pop() -> str:
        nonlocal where, skipping
        tag, _ = stack.pop()
        opened[tag] -= 1
        skipping -= tag in SKIPPED
        where = stack[-1][1] if stack else NOWHERE
        return tag

    def push(tag: str, inside: float) -> None:
        nonlocal where, skipping
        stack.append((tag, inside))
        opened[tag] += 1
        skipping += tag in SKIPPED
        where = inside

    def wraps_the_page() -> bool:
        """Whether a form holds parts of a page, so that it is none of them itself."""
        return closed_later("form") and _PARTS.search(low, at, max(at, low.find("</form", at))) is not None

    def closed_later(tag: str) -> bool:
        if tag not in last:
            last[tag] = low.rfind(f"</{tag}")
        return last[tag] >= at

    end = len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = max(m.end(), m.start() + 1)
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in INLINE:
            if tag == "a":
                anchors = 0 if closing else 1
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in SKIPPED:
            while stack and stack[-1][0] in FLAT and (tag in SECTIONS or tag in BLOCKS and not closed_later(stack[-1][0])):
                pop()  # no block begins or ends inside it
            if skipping and not (closing and opened[tag]) and tag not in SECTIONS and tag not in BLOCKS:
                continue
        close()
        anchors = 0
        if closing:
            if opened[tag]:
                while pop() != tag:
                    pass
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            if closed_later(tag):
                stop = page.find(">", low.index(f"</{tag}", at))
                at = stop + 1 if stop >= 0 else end
            else:  # code runs to the page's end, other text to the next tag
                stop = -1 if tag in ("script", "style") else page.find("<", at)
                at = stop if stop >= 0 else end
            continue
        if m[0].endswith("/>"):
            continue
        if tag in SKIPPED:
            if tag in FLAT or closed_later(tag):
                push(tag, where)
            continue
        if tag == "p" and stack and stack[-1][0] == "p":
            pop()
        if tag in ("article", "main"):
            while stack and stack[-1][1] == BESIDE and not closed_later(stack[-1][0]):
                pop()  # a menu or sidebar that nothing ends does so where the main part begins
        neutral = tag in ("body", "html") or tag == "form" and wraps_the_page()
        push(tag, where if neutral else _where(tag, m[3] or "", where))
    close()
    return out


def main_text(page: str | None, tree: Tree) -> str:
    blocks = blocks_of(page)
    if not blocks:
        return ""
    keep = tree.predict(features(b[1:] for b in blocks))
    return " ".join(b[0] for b, k in zip(blocks, keep, strict=True) if k)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html).

    Whole pages are read; a null or empty page and one without main text give an empty text. Rows are independent: repeated
    rows give repeated results, null ids and urls stay null. Other columns are not read.
    """
    tree = train()

    def make():
        def one(page_id, url, page):
            text = main_text(page, tree)
            return page_id, url, text, len(text)

        return one

    return map_rows(pages.select("page_id", "url", "html"), make, "page_id long, url string, text string, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every ``pages`` row."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
