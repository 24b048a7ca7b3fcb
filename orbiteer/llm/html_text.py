"""Main text of web pages: flat blocks, classified by a decision tree on their own and their neighbours' features."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import short_batches, table, tidy
from .html_labels import PAGES, ended, made

_ATTRIBUTES = r"""(?:[^<>"']|"[^"]*"|'[^']*')*+"""
_TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})>")
#: A tag with a stray quote, and one that the end of the page cuts off.
_LOOSE, _CUT = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"), re.compile(rf"</?[a-zA-Z][^\s/>]*{_ATTRIBUTES}\Z|<[!?]")
#: Elements whose content is no text: those that run to the page's end if they aren't closed, and those that then don't count.
_RAW = frozenset("script style title textarea iframe noscript".split())
_MUTE = frozenset("select button template object svg canvas".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_CONTAINERS = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header main menu nav ol section table td th tr ul".split())
#: Elements that end an open one of these names when they begin, and those that such a one is looked for in: the end tags
#: of cells and rows may be left out.
_ENDS = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}
#: What may not be closed from inside a table that is in it.
_CELLS = frozenset("td th tr".split())
#: Who owns a page, and what may be done with it.
_LEGAL = re.compile(r"©|\(c\) *\d{4}|\bcopyright\b|\brights reserved\b", re.I)
#: Elements that say what is in them: no article text.
_APART = frozenset("nav footer aside form menu dialog".split())
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"hidden|display", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_UNSEEN = re.compile(r"(?<![\w-])(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
#: Parts of class, id and role values that hint at something beside the article; of these, those of places where others
#: speak, or other articles are named; and parts that go with a hint without making it weaker.
_HINTS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs consent cookie cookies copyright footer gdpr masthead menu modal nav navbar navigation newsletter notice notices"
    " pager pagination popup promo share sharing sidebar signup social subscribe subscription toolbar widget".split()
)
_QUOTING = frozenset("comments discussion disqus kommentare outbrain related replies respond sponsored taboola".split())
#: Parts that say so only where nothing else is said: an article may be on a "comment-policy" or for "recommended-reading".
_MAYBE = frozenset("comment kommentar recommended reply sponsor".split())
_NEUTRAL = frozenset("area bar block bottom box container inner left list main outer panel reader right section site top wrap wrapper".split())
_LAYOUT = frozenset("has no with without".split())


def hidden(attributes: str) -> bool:
    """Whether an element isn't shown: by the attribute hidden, by aria-hidden, or by its own style."""
    if not _HIDDEN.search(attributes):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).strip().lower()
        if (name == "hidden" and value != "false") or (name == "aria-hidden" and value == "true") or (name == "style" and _UNSEEN.search(value)):
            return True
    return False


class Block(NamedTuple):
    text: str
    words: int
    linked: float
    heading: bool
    #: Number of the element it is in.
    place: int


@dataclass
class Element:
    """A container, by the number of the one around it."""

    name: str
    within: int
    #: In an element of another use than the article's (or one itself), in a part whose header belongs to it, and how
    #: strong its own names hint.
    apart: bool
    article: bool
    hint: int
    words: float = 0.0


def hint(attributes: str) -> int:
    """How strong an element's names hint at something beside the article: 2 if they say nothing else, 1 or 0."""
    if "=" not in attributes:
        return 0
    names = frozenset(p.lower() for v in _NAMES.findall(attributes) for p in _PART.findall("".join(v)))
    if names & _LAYOUT or not names & (_HINTS | _QUOTING | _MAYBE):
        return 0
    return 2 if names & _QUOTING or names <= _HINTS | _MAYBE | _NEUTRAL else 1


def blocks(html: str) -> tuple[list[Block], list[Element]]:
    """The text blocks of a page in order, what stands between two block-level tags if it has a word, and its containers.
    What isn't shown is left out.  The page is read once, from left to right."""
    found: list[Block] = []
    elements = [Element("", 0, False, False, 0)]
    text: list[str] = []
    link: list[str] = []
    stack: list[tuple[str, int, bool]] = []
    opened: dict[str, list[int]] = {}  # places in the stack, by name
    place, unseen, in_link, heading = 0, False, False, False
    unclosed: set[str] = set()

    def end() -> None:
        if text:
            own = "".join(text)
            words = (unescape(own) if "&" in own else own).split()
            if words and not unseen:
                linked = min(1.0, len(unescape("".join(link)).split()) / len(words)) if link else 0.0
                found.append(Block(" ".join(words), len(words), linked, heading, place))
                elements[place].words += len(words) * (1 - linked)
            text.clear()
            link.clear()

    def shut(name: str) -> None:
        """Closes the innermost open element of a name, with all inside it."""
        nonlocal place, unseen
        k = opened[name][-1]
        _, place, unseen = stack[k]
        for inner, *_ in stack[k:]:
            opened[inner].pop()
        del stack[k:]

    def inner(name: str) -> bool:
        """Whether an element of a name is open, for cells and rows in the innermost table."""
        own = opened.get(name)
        return bool(own) and (name not in _CELLS or own[-1] > (opened.get("table") or [-1])[-1])

    def add(piece: str) -> None:
        if piece:
            text.append(piece)
            if in_link:
                link.append(piece)

    at = look = 0
    while (start := html.find("<", look)) >= 0:
        if html.startswith("<!--", start):
            add(html[at:start])
            close = html.find("-->", start + 4)
            at = look = close + 3 if close >= 0 else len(html)
            continue
        following = html[start + 1 : start + 2]
        if following not in "!?/" and not (following.isascii() and following.isalpha()) or not following:
            look = start + 1
            continue
        if html.find(">", start) < 0:
            add(html[at:start])
            at = look = len(html) if _CUT.match(html, start) else start
            break
        if following in "!?":
            add(html[at:start])
            at = look = html.find(">", start) + 1
            continue
        m = _TAG.match(html, start) or _LOOSE.match(html, start)
        if not m:
            look = start + 1
            continue
        add(html[at:start])
        at = look = m.end()
        closing, name, attributes = m[1], m[2].lower(), m[3]
        if not closing and name not in unclosed and (name in _RAW or name in _MUTE):
            close = _CLOSED[name].search(html, at)
            if close:
                at = look = close.end()
            elif name in _RAW:
                at = look = len(html)
            else:
                unclosed.add(name)
        if name in _INLINE:
            if name == "a":
                in_link = not closing
                if in_link and link:
                    link.append(" ")
            continue
        if name == "br":
            add(" ")
            continue
        if name in _RAW or name in _MUTE:
            continue
        end()
        in_link = False
        heading = not closing and len(name) == 2 and name[0] == "h" and name[1] in "123456"
        if name not in _CONTAINERS:
            continue
        if closing:
            if inner(name):
                shut(name)
        else:
            for other in _ENDS.get(name, ()):
                if inner(other) and (name == "tr" or opened[other][-1] > (opened.get("tr") or [-1])[-1]):
                    shut(other)
            opened.setdefault(name, []).append(len(stack))
            stack.append((name, place, unseen))
            around = elements[place]
            article = around.article or name in ("article", "main", "section")
            apart = around.apart or name in _APART or (name == "header" and not around.article)
            unseen = unseen or hidden(attributes)
            elements.append(Element(name, place, apart, article, 0 if name == "body" else hint(attributes)))
            place = len(elements) - 1
    add(html[at:])
    end()
    return found, elements


_CLOSED = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW | _MUTE}


def core(elements: list[Element]) -> tuple[int, bool]:
    """The number of the element that holds the article, and whether its name says so.

    That is the article element with the most unlinked words, or the main element if it has less than half of that one's.
    On a page without them, it is the innermost container with most of the words."""
    total, quoted = [0.0] * len(elements), [False] * len(elements)
    for i, e in enumerate(elements):
        quoted[i] = i > 0 and (quoted[e.within] or (e.hint == 2 and e.name not in ("article", "main")))
    for i in range(len(elements) - 1, -1, -1):
        e = elements[i]
        total[i] += 0.0 if e.apart or quoted[i] else e.words
        if i:
            total[e.within] += total[i]
    named = {"article": [], "main": []}
    for i, e in enumerate(elements):
        if e.name in named and total[i] > 0:
            named[e.name].append(i)
    article, main = (max(named[x], key=lambda i: (total[i], -i), default=None) for x in ("article", "main"))
    if main is not None and (article is None or total[article] < total[main] / 2):
        article = main
    if article is not None and 10 * total[article] >= total[0]:
        return article, True
    within: dict[int, list[int]] = {}
    for i, e in enumerate(elements[1:], 1):
        if 10 * total[i] >= 6 * total[0] > 0:
            within.setdefault(e.within, []).append(i)
    at = 0
    while at in within:
        at = within[at][0]
    return at, False


#: What a tree sees of a block.
FEATURES = ("words", "linked", "words before", "linked before", "words after", "linked after", "in the core", "apart", "hint", "heading", "legal", "blocks after")


def features(page: list[Block], elements: list[Element]) -> Iterator[tuple[float, ...]]:
    """Of each block: words and link density, those of the block before and of the one after, whether it is in the core of
    the page (2 and -2 if an element's name says what that is, else 1 and -1), in an element of another use, under names
    that hint at something else (of containers inside the core), a heading, a note of who owns the page, and how many blocks
    of the page, up to three, follow."""
    if not page:
        return
    lead, sure = core(elements)
    inside, apart, hints = [lead == 0] * len(elements), [False] * len(elements), [0] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        inside[i] = i == lead or inside[e.within]
        if i != lead:
            hints[i] = max(hints[e.within], e.hint)
            apart[i] = apart[e.within] or e.name in _APART or (e.name == "header" and not e.article)
    none = Block("", 0, 0.0, False, 0)
    for n, (before, own, after) in enumerate(zip([none, *page[:-1]], page, [*page[1:], none], strict=True), 1):
        i = own.place
        at = (1 + sure) * (1 if inside[i] else -1)
        legal = own.words <= 40 and _LEGAL.search(own.text) is not None
        yield own.words, own.linked, before.words, before.linked, after.words, after.linked, at, apart[i], hints[i], own.heading, legal, min(3, len(page) - n)


def grow(x: np.ndarray, y: np.ndarray, depth: int, least: int = 1):
    """A decision tree by Gini impurity whose leaves have ``least`` rows or more: (feature, limit, tree up to the limit,
    tree above), or the share of true labels."""
    if depth == 0 or y.min() == y.max():
        return float(y.mean())
    n, best = len(y), (len(y) * y.mean() * (1 - y.mean()) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        value, good = x[order, f], np.cumsum(y[order])
        low = np.arange(1, n)
        cut = (value[1:] > value[:-1]) & (low >= least) & (n - low >= least)
        if cut.any():
            low, a = low[cut], good[:-1][cut]
            b = good[-1] - a
            cost = a * (1 - a / low) + b * (1 - b / (n - low))
            k = int(cost.argmin())
            if cost[k] < best[0]:
                best = float(cost[k]), f, float(value[:-1][cut][k])
    _, f, limit = best
    if f < 0:
        return float(y.mean())
    low = x[:, f] <= limit
    return f, limit, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def labelled(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks of labelled pages."""
    x, y = [], []
    for page in pages:
        marked, elements = blocks(page)
        x += features([b._replace(words=len(re.sub(r"(?<!\S)[-+]", "", b.text).split())) for b in marked], elements)
        y += [b.text[0] == "+" for b in marked]
    return np.array(x, dtype=float), np.array(y, dtype=float)


@cache
def learnt(depth: int = 8):
    """The tree for the labelled pages.  Those written by hand count several times."""
    return grow(*labelled(PAGES * 4 + made() + ended()), depth, 4)


def main_text(html: str, tree) -> str:
    kept, (page, elements) = [], blocks(html)
    for block, row in zip(page, features(page, elements), strict=True):
        node = tree
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        if node >= 0.5:
            kept.append(block.text)
    return " ".join(kept)


def _extract(tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, tree) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return tidy(run)


def extract(pages: DataFrame, depth: int = 8) -> DataFrame:
    """page_id, url, text and n_chars (code points) of ``pages`` (page_id, url, html).

    A page is cut into flat blocks at block-level tags; comments, scripts, styles, form controls, what isn't shown and
    markup go.  A tree of at most ``depth`` levels, learnt from the labelled pages of ``html_labels``, keeps a block or
    not by its word count and link density, those of the blocks around it, and where it is (``features``).  Kept blocks
    are joined by a blank; inside them character references are decoded and white space is one blank.

    A null or empty html, or one without words, gives an empty text.  Each row is taken by itself, so repeated rows give
    repeated results, an empty table gives none, and nothing is cut off: a page is held whole, and read in time that
    grows with its length.  Further columns are ignored, whatever their names."""
    short_batches(pages.sparkSession)
    return pages.selectExpr("page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(
        _extract(learnt(depth)), f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
