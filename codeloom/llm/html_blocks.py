"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into text blocks at block-level tags. A block is described by its
words and link density and those of its neighbours, by what it is (heading, list
item) and by the landmarks it stands in: elements and class names that
announce content or page furniture. Landmarks are features among the others, none
decides on its own, and a word that is only a part of a name, as in ``has-comments``,
is another feature than the name itself. A tree grown on a small labelled table
of example pages decides which blocks are main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import without
from codeloom.llm.html_examples import example_pages

# What the names of elements, classes and roles announce.
SKIPPED = "script|style|noscript|template|iframe|object|svg|canvas|textarea|select|button|title|audio|video"
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = BLOCKS - frozenset("dd dt hr h1 h2 h3 h4 h5 h6 li optgroup option p td th tr html head body".split()) | {"span"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE_TAGS = frozenset("nav footer aside menu dialog".split())
FORM_TAGS = frozenset("form fieldset".split())
CONTENT_TAGS = frozenset("article main".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs byline captcha comment comments commentlist "
    "consent contentinfo cookie cookies copyright disclaimer disqus footer gdpr infobar legal login masthead menu menubar modal nav navbar "
    "navigation newsletter notice notification outbrain overlay pager pagination paywall popup privacy promo promoted promotion related replies reply "
    "search share sharing sidebar signup sitemap skip social sponsor sponsored subscribe tags taboola teaser toolbar topbar widget widgets".split())
CONTENT_WORDS = frozenset("article articlebody content entry maincontent post posttext story storybody main".split())
# Say nothing of their own next to one of the words above.
NEUTRAL_WORDS = frozenset(
    "area bar block body bottom box button buttons container form global group inner item left link links list middle outer page panel primary right "
    "secondary section site slot text top unit wrap wrapper".split())

_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{SKIPPED})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:/>|>.*?(?:</(?P=raw)\s*+>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>|</?[a-z][^>]*+(?:>|\Z)",
    re.S | re.I)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_PART = re.compile(r"[a-z]+")

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "heading", "item",
            "furniture", "furniture_part", "form", "content", "content_part",
            "nearest_is_furniture", "furniture_around_content", "page_header")


def _announces(name: str, rest: str) -> str:
    """What an element announces, weakest first: q and p for content and furniture as a part of a longer name, h for
    a header, m for a form, f for furniture and c for content as a name of its own or an element; '' for nothing.

    An element that names both is content, with furniture as a part.
    """
    if name in FURNITURE_TAGS or rest and _HIDDEN.search(rest):
        return "f"
    found = {"c"} if name in CONTENT_TAGS else {"h"} if name == "header" else {"m"} if name in FORM_TAGS else set()
    if rest:
        for m in _NAMES.finditer(rest):
            for one in (m[1] or m[2] or m[3] or "").lower().split():
                parts = set(_PART.findall(one))
                bad, good = parts & FURNITURE_WORDS, parts & CONTENT_WORDS
                if "header" in parts:
                    found |= {"h", "q"} if good else {"h"}
                elif bad:
                    found.add("f" if parts <= FURNITURE_WORDS | CONTENT_WORDS | NEUTRAL_WORDS else "p")
                elif good:
                    found.add("c" if parts <= CONTENT_WORDS | NEUTRAL_WORDS else "q")
    if {"c", "f"} <= found:
        found = found - {"f"} | {"p"}
    return "".join(z for z in "qphmfc" if z in found)


def blocks(page: str | None) -> list[tuple]:
    """(text, words, linked words, heading, item, open landmarks) per text block of a page, in order."""
    out: list[tuple] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, str]] = []
    in_link, tag = False, ""

    def close() -> None:
        nonlocal linked, parts
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, text.count(" ") + 1, linked, tag in HEADINGS, tag in ("li", "option", "dt", "dd"), "".join(z for _, z in stack)))
        parts, linked = [], 0

    def read(raw: str) -> None:
        nonlocal linked
        if "&" in raw:
            raw = html.unescape(raw)
        parts.append(raw)
        if in_link:
            linked += len(raw.split())

    page, at = page or "", 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            read(page[at:m.start()])
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if name == "a":
            in_link = not m["end"]
        elif name == "br":
            parts.append(" ")
        if name in BLOCKS:
            close()
            tag = "" if m["end"] else name
        if name in CONTAINERS:
            if m["end"]:
                in_link = in_link and name == "span"
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        if stack[k][1] and name == "span":
                            close()
                        del stack[k:]
                        break
            elif not m["rest"].endswith("/"):
                zone = _announces(name, m["rest"])
                if zone and name == "span":
                    close()
                stack.append((name, zone))
    if at < len(page):
        read(page[at:])
    close()
    return out


def features(found: list[tuple]) -> np.ndarray:
    """One row of ``FEATURES`` per block of a page."""
    n = len(found)
    words = np.array([b[1] for b in found], "f8")
    density = np.array([min(b[2] / b[1], 1.0) for b in found], "f8")
    ahead = lambda x: np.r_[x[1:], 0][:n]
    behind = lambda x: np.r_[0, x[:-1]][:n]
    flags = np.array([(b[3], b[4]) for b in found], "f8").reshape(n, 2)
    marks = np.array([_marks(b[5]) for b in found], "f8").reshape(n, 8)
    return np.column_stack([
        words, density, behind(words), behind(density), ahead(words), ahead(density), flags, marks])


@lru_cache(maxsize=4096)
def _marks(zones: str) -> tuple:
    """Features of the landmarks a block stands in, outermost first."""
    strong = [z for z in zones if z in "fmc"]
    return ("f" in zones, "p" in zones, "m" in zones, "c" in zones, "q" in zones, bool(strong) and strong[-1] != "c",
            "f" in zones.partition("c")[0] and "c" in zones, "h" in zones and not set("cq") & set(zones.partition("h")[0]))


# The tree


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 4) -> list[tuple]:
    """A classification tree as (feature, threshold, left, right, share) nodes; feature -1 marks a leaf."""
    nodes: list[tuple] = []

    def build(rows: np.ndarray, left: int) -> int:
        at = len(nodes)
        share = float(y[rows].mean())
        nodes.append((-1, 0.0, -1, -1, share))
        if not left or len(rows) < 2 * least or share in (0.0, 1.0):
            return at
        best = (share * (1 - share) * len(rows) - 1e-9, None, None)
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            values, hits = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(values[1:] > values[:-1]) + 1
            cut = cut[(cut >= least) & (cut <= len(order) - least)]
            if not len(cut):
                continue
            a, b = hits[cut - 1] / cut, (hits[-1] - hits[cut - 1]) / (len(order) - cut)
            cost = cut * a * (1 - a) + (len(order) - cut) * b * (1 - b)
            k = int(cost.argmin())
            if cost[k] < best[0]:
                best = (cost[k], f, (values[cut[k] - 1] + values[cut[k]]) / 2)
        if best[1] is not None:
            low = x[rows, best[1]] <= best[2]
            nodes[at] = (best[1], float(best[2]), build(rows[low], left - 1), build(rows[~low], left - 1), share)
        return at

    build(np.arange(len(y)), depth)
    return nodes


def shares(tree: list[tuple], x: np.ndarray) -> np.ndarray:
    """Share of main text in the leaf of each row."""
    feature, threshold, left, right, share = (np.array(c) for c in zip(*tree))
    at = np.zeros(len(x), int)
    while True:
        inner = np.flatnonzero(feature[at] >= 0)
        if not len(inner):
            return share[at]
        node = at[inner]
        low = x[inner, feature[node]] <= threshold[node]
        at[inner] = np.where(low, left[node], right[node])


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the example pages; main blocks carry the mark §."""
    xs, ys = [], []
    for page in example_pages():
        found = blocks(page)
        ys += [b[0].startswith("§") for b in found]
        xs.append(features([(b[0].replace("§", ""), *b[1:]) for b in found]))
    return np.concatenate(xs), np.array(ys, "f8")


@lru_cache(maxsize=1)
def default_tree() -> tuple[tuple, ...]:
    return tuple(grow(*labelled_blocks()))


def main_texts(pages: list[str | None], tree) -> list[str]:
    found = [blocks(p) for p in pages]
    rows = [features(f) for f in found if f]
    keep = shares(tree, np.concatenate(rows)) >= 0.5 if rows else np.zeros(0, bool)
    out, at = [], 0
    for f in found:
        out.append("\n".join(b[0] for b, k in zip(f, keep[at:at + len(f)]) if k))
        at += len(f)
    return out


def main_text(column, tree=None):
    """Column of main texts of a column of pages."""
    tree = tree or default_tree()

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            values, out = pages.tolist(), []
            for at in range(0, len(values), 256):
                out += main_texts(values[at:at + 256], tree)
            yield pd.Series(out, dtype=object)

    return of(column)


def extract_main_text(pages: DataFrame, html_col: str = "html", text_col: str = "text", tree=None) -> DataFrame:
    """``pages`` without the html, with the main text and its number of code points (``n_chars``).

    A null or empty page, or one without main blocks, has an empty text. Other
    columns stay, repeated rows come as often as they do, no rows give none.
    """
    kept = without(pages, [html_col, text_col, "n_chars"])
    return pages.select(*kept, main_text(F.col(html_col), tree).alias(text_col)).withColumn("n_chars", F.char_length(text_col).cast("bigint"))
