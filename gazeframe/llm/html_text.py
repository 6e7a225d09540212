"""Main-text extraction: flat text blocks, classified by a decision tree on their own and their neighbours' features.

Method. A page is cut into flat blocks of text at block-level tags. A block's features are its number of words, its link
density, both of the blocks before and after it, and two marks of its surroundings: whether it lies in a part that is named as
something else (menu, footer, form, advert, comments ... by tag, role, class or id), and whether it lies in a part named
as the article. A decision tree, grown here on a small labelled table of blocks, keeps or drops each block.

Scale. Pages are independent: one pass, no shuffle; a page is held by itself.

Defined cases: null and empty pages give the empty text. Pages without any tag are one block. Unclosed comments, scripts, styles
(whatever a browser reads as raw text) and tags run to the end of the page and are dropped. Other elements without main text
(``button``, ``svg``, ``select``, ...) are dropped with what they hold up to their own end tag, nested ones included; one that is never closed,
or not within the block that it is in, or that closes itself, holds nothing, so that no text after it is lost. Repeated rows are treated alike. Input columns named like an output
column are replaced.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gazeframe.llm.common import map_texts

# Elements and names with a meaning here.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template textarea title head select button svg math iframe object canvas audio video datalist map noframes applet".split())
RAW = frozenset("script style textarea title noscript iframe noframes".split())
ASIDE_TAGS = frozenset("nav footer aside form menu dialog".split())
MAIN_TAGS = frozenset("article main".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar alert alertdialog dialog status".split())
MAIN_ROLES = frozenset("main article".split())
ASIDE_NAMES = frozenset(
    "ad ads adbox adslot adsense advert adverts advertise advertisement advertising banner banners sponsor sponsored sponsors promo promos promotion menu menus nav navbar navigation topbar breadcrumb breadcrumbs footer foot header masthead sidebar sidebars aside rail widget widgets cookie cookies consent gdpr notice notices notification alert disclaimer popup modal overlay newsletter subscribe subscription signup login comment comments commentlist discussion disqus respond replies reply share sharing social related recommended recommendations trending popular teaser teasers outbrain taboola pagination pager search toolbar tags legal copyright hidden".split()
)
MAIN_NAMES = frozenset("article articlebody content maincontent main post postbody entry story storybody bodytext prose".split())
CLOSES = {"p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "aside", "article")
# The labelled table; the features above, then 1 for main text.
TABLE = np.array(
    [
        # in parts named as something else: never main text
        (6, 1.0, 0, 0.0, 12, 0.0, 1, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0), (1, 1.0, 1, 1.0, 9, 0.0, 1, 0, 0), (14, 0.0, 1, 1.0, 8, 0.0, 1, 0, 0),
        (40, 0.0, 60, 0.0, 12, 0.5, 1, 0, 0), (25, 0.1, 80, 0.0, 0, 0.0, 1, 0, 0), (9, 0.0, 70, 0.0, 0, 0.0, 1, 0, 0), (30, 0.0, 45, 0.0, 38, 0.0, 1, 1, 0),
        (12, 0.0, 90, 0.0, 60, 0.0, 1, 1, 0), (3, 1.0, 40, 0.0, 3, 1.0, 1, 1, 0), (120, 0.0, 30, 0.0, 22, 0.0, 1, 0, 0), (55, 0.05, 20, 0.0, 70, 0.0, 1, 1, 0),
        (2, 0.0, 2, 0.0, 2, 0.0, 1, 0, 0), (7, 0.4, 0, 0.0, 5, 0.8, 1, 0, 0), (18, 0.0, 5, 0.0, 5, 0.0, 1, 0, 0), (200, 0.0, 150, 0.0, 0, 0.0, 1, 0, 0),
        # in the article: main text, however short
        (8, 0.0, 14, 0.0, 8, 0.0, 0, 1, 1), (1, 0.0, 60, 0.0, 42, 0.0, 0, 1, 1), (80, 0.0, 8, 0.0, 95, 0.0, 0, 1, 1), (150, 0.02, 80, 0.0, 40, 0.0, 0, 1, 1),
        (2, 0.0, 30, 0.0, 11, 0.0, 0, 1, 1), (5, 0.0, 9, 0.0, 0, 0.0, 0, 1, 1), (12, 0.3, 50, 0.0, 61, 0.0, 0, 1, 1), (4, 1.0, 33, 0.0, 48, 0.0, 0, 1, 1),
        (35, 0.1, 2, 0.0, 12, 0.0, 0, 1, 1), (3, 0.0, 3, 0.0, 3, 0.0, 0, 1, 1), (60, 0.0, 1, 1.0, 12, 0.3, 0, 1, 1), (1, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1),
        (3, 0.0, 1, 1.0, 4, 0.0, 0, 1, 1), (2, 0.0, 2, 1.0, 3, 0.0, 0, 1, 1), (6, 0.0, 12, 0.9, 5, 0.0, 0, 1, 1), (4, 0.0, 3, 0.0, 2, 1.0, 0, 1, 1),
        (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 1), (3, 1.0, 2, 0.8, 4, 0.9, 0, 1, 1), (9, 0.8, 5, 0.0, 7, 0.5, 0, 1, 1), (5, 0.6, 3, 1.0, 2, 0.0, 0, 1, 1),
        (2, 0.0, 1, 1.0, 1, 1.0, 0, 1, 1), (4, 0.0, 6, 0.5, 3, 0.6, 0, 1, 1), (7, 0.0, 2, 0.0, 6, 0.0, 0, 1, 1), (3, 0.0, 5, 0.0, 4, 0.0, 0, 1, 1),
        # in no named part: by length and links, of the block and around it
        (60, 0.0, 45, 0.0, 52, 0.0, 0, 0, 1), (35, 0.05, 70, 0.0, 20, 0.0, 0, 0, 1), (28, 0.1, 3, 0.0, 44, 0.0, 0, 0, 1), (90, 0.2, 25, 0.0, 6, 1.0, 0, 0, 1),
        (22, 0.0, 2, 1.0, 31, 0.0, 0, 0, 1), (41, 0.0, 6, 0.0, 4, 0.6, 0, 0, 1), (18, 0.0, 38, 0.0, 49, 0.0, 0, 0, 1), (130, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1),
        (7, 0.0, 50, 0.0, 64, 0.0, 0, 0, 1), (5, 0.0, 33, 0.0, 47, 0.0, 0, 0, 1), (9, 0.0, 2, 0.0, 58, 0.0, 0, 0, 1), (4, 0.0, 7, 0.0, 75, 0.0, 0, 0, 1),
        (1, 0.0, 40, 0.0, 36, 0.0, 0, 0, 1), (16, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (3, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (11, 0.0, 64, 0.0, 27, 0.0, 0, 0, 1),
        (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0), (3, 1.0, 2, 1.0, 4, 1.0, 0, 0, 0), (5, 1.0, 60, 0.0, 3, 1.0, 0, 0, 0), (12, 0.9, 3, 1.0, 5, 0.8, 0, 0, 0),
        (25, 0.7, 6, 1.0, 9, 0.5, 0, 0, 0), (40, 0.6, 8, 0.9, 30, 0.8, 0, 0, 0), (3, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0), (2, 0.0, 3, 0.9, 4, 0.0, 0, 0, 0),
        (4, 0.0, 5, 0.0, 6, 0.4, 0, 0, 0), (6, 0.5, 7, 0.0, 3, 1.0, 0, 0, 0), (5, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0), (8, 0.6, 70, 0.0, 2, 1.0, 0, 0, 0),
        (2, 1.0, 55, 0.0, 62, 0.0, 0, 0, 0), (4, 0.0, 4, 0.0, 3, 0.0, 0, 0, 0), (6, 0.0, 2, 0.0, 5, 0.0, 0, 0, 0), (7, 0.0, 4, 1.0, 6, 0.0, 0, 0, 0),
    ]
)


@dataclass
class Node:
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None
    label: int = 0


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2) -> Node:
    """A tree by Gini impurity; of equal cuts the first feature's lowest."""
    node = Node(label=int(2 * y.sum() >= len(y)))
    if depth == 0 or y.min() == y.max():
        return node
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for a, b in zip(values[:-1], values[1:], strict=True):
            cut = (a + b) / 2
            left = x[:, f] <= cut
            n = left.sum()
            if min(n, len(y) - n) < least:
                continue
            gini = sum(len(part) * 2 * part.mean() * (1 - part.mean()) for part in (y[left], y[~left]))
            if best is None or gini < best[0] - 1e-9:
                best = (gini, f, cut, left)
    if best is None:
        return node
    _, node.feature, node.cut, left = best
    node.low, node.high = grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least)
    return node


def decide(node: Node, x: tuple) -> int:
    while node.feature >= 0:
        node = node.low if x[node.feature] <= node.cut else node.high
    return node.label


TREE = grow(TABLE[:, :-1].astype(float), TABLE[:, -1].astype(int))

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
#: Every attribute in turn, so that nothing is found within another one's value.
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_MARKING = frozenset("class id role style hidden aria-hidden".split())
#: Beginnings of names that speak of what a page has or has not, not of a part.
_ABOUT = ("has-", "has_", "no-", "no_", "with-", "with_", "without-", "is-", "js-")
_NAME = re.compile(r"[a-z0-9]+")
_NONE, _ASIDE, _MAIN = 0, 1, 2


def _marks(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """(something else by tag or role, something else by a name, article) of an element."""
    hard, soft, main = tag in ASIDE_TAGS, False, tag in MAIN_TAGS
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key = m[1].lower()
            if key not in _MARKING:
                continue
            value = (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                if tag in ("html", "body"):
                    continue
                for word in value.split():
                    if word.startswith(_ABOUT):
                        continue
                    names = _NAME.findall(word)
                    own = any(n in MAIN_NAMES for n in names)
                    # An entry's or article's header is its headline.
                    soft = soft or any(n in ASIDE_NAMES and not (own and n == "header") for n in names)
                    main = main or own
            elif key == "role":
                hard, main = hard or value in ASIDE_ROLES, main or value in MAIN_ROLES
            elif key == "style":
                hard = hard or "display:none" in value.replace(" ", "")
            else:
                hard = hard or key == "hidden" or value == "true"
    return hard, soft, main and not soft


def _end_of(page: str, tag: str, at: int, block: str | None) -> int | None:
    """Where the element ends that began before ``at``: after its own end tag, before that of the block that it is in; None if
    there is none."""
    depth = 1
    names = tag if block is None else f"{tag}|{block}"
    for m in re.compile(rf"<(/?)({names})(?=[\s/>])([^>]*)>", re.I).finditer(page, at):
        if m[2].lower() != tag:
            if m[1]:
                return None
        elif m[1]:
            depth -= 1
            if not depth:
                return m.end()
        elif not m[3].endswith("/"):
            depth += 1
    return None


def blocks(page: str) -> list[tuple[str, int, int, bool, bool]]:
    """(text, words, words in links, in a part named as something else, in the article) of each block, in order."""
    out: list[tuple[str, int, int, bool, bool]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # element, and its part's marks: hard, soft, article
    parts: list[str] = []
    linked: list[str] = []
    depth = 0  # of open links

    def state() -> tuple[bool, bool, bool]:
        return stack[-1][1:] if stack else (False, False, False)

    def end_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                hard, soft, main = state()
                out.append((text, len(text.split()), len(html.unescape("".join(linked)).split()), hard or soft, main))
            parts.clear()
            linked.clear()

    def add(piece: str) -> None:
        if piece:
            parts.append(piece)
            if depth:
                linked.append(piece)

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if closing:
            if tag == "a":
                depth = max(0, depth - 1)
                linked.append(" ") if depth == 0 else None
            if tag in BLOCKS:
                end_block()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            continue
        if tag in SKIPPED:
            if tag != "head" and tag not in RAW:
                end = None if attributes.endswith("/") else _end_of(page, tag, at, stack[-1][0] if stack else None)
                if end is not None:
                    at = end
                parts.append(" ")
            else:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                if tag == "head":  # may be left unclosed: ends where the body begins
                    body = re.compile(r"<(?:body|article|main|div|p|h1|nav|header|section)(?=[\s/>])", re.I).search(page, at)
                    if body is not None and (end is None or body.start() < end.start()):
                        at = body.start()
                        continue
                at = n if end is None else end.end()
                parts.append(" ")
            continue
        if tag == "br":
            add(" ")
        elif tag == "a":
            depth += 1
        elif tag in BLOCKS:
            end_block()
            depth = 0
            if tag in CLOSES:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in CLOSES[tag]:
                        del stack[k:]
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table", "div", "article", "section", "td", "th", "li", "blockquote") and tag not in ("tr", "td", "th"):
                        break
                    if stack[k][0] == "table":
                        break
            if tag not in VOID:
                hard, soft, main = state()
                h, s, a = _marks(tag, attributes)
                if tag == "header" and not main:
                    h = True  # a header of the page, not of the article
                if tag in MAIN_TAGS and not s and not h:
                    soft = False  # a wrapper's name doesn't speak for the article in it
                stack.append((tag, hard or h, soft or s, main or a))
    end_block()
    return out


def extract(page: str | None, tree: Node = TREE) -> str:
    """The main text: kept blocks, joined by line ends."""
    found = blocks(page or "")
    links = [b[2] / b[1] for b in found]
    kept = []
    for i, b in enumerate(found):
        before = (found[i - 1][1], links[i - 1]) if i else (0, 0.0)
        after = (found[i + 1][1], links[i + 1]) if i + 1 < len(found) else (0, 0.0)
        if decide(tree, (b[1], links[i], *before, *after, int(b[3]), int(b[4]))):
            kept.append(b[0])
    return "\n".join(kept)


def extract_pages(pages: DataFrame, html_column: str = "html", out: tuple[str, str] = ("text", "n_chars")) -> DataFrame:
    """``pages`` with its columns, the main text and its number of code points."""

    def work(b: pa.RecordBatch) -> dict:
        texts = [extract(x.as_py()) for x in b.column(html_column)]
        return {out[0]: texts, out[1]: [len(t) for t in texts]}

    return map_texts(pages, [html_column], [(out[0], "string"), (out[1], "long")], work)
