"""Main text of HTML pages by tag-path ratios.

Every text node belongs to the path of tags from the root to it. For each path
the amount of text per node and the punctuation per node are summed over
the page; both ratios are smoothed along the page, fused to one score, and the
nodes of paths whose score passes the page's threshold are content. Elements that
are never an article (menus, forms, scripts and so on) are left out before
the ratios are taken, by tag, role and class words. Of the nodes below the
threshold only headings of content and the unlinked paragraphs, lists and tables
in an element that itself holds content are added again.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelspark.llm.common import extended, named

# HTML element names by what they mean for a page (fixed values)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
NEVER = {
    "head", "script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "nav", "header",
    "footer", "aside", "form", "button", "select", "textarea", "input", "label", "fieldset", "dialog", "menu", "title",
    "noembed", "noframes", "audio", "video", "datalist",
}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr",
    "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "tr", "ul",
}
MAIN = {"article", "main"}
NEVER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
# words of class and id attributes that name page furniture
NEVER_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "respond", "disqus", "replies", "consent", "cookie", "cookies", "footer", "gdpr", "header", "masthead",
    "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay",
    "pagination", "pager", "popup", "promo", "promoted", "promotion", "related", "recommended", "share", "sharing",
    "sidebar", "skip", "social", "sponsor", "sponsored", "sponsors", "subscribe", "subscription", "toolbar", "topbar",
    "widget", "widgets", "alert", "login", "signup", "search",
}
# words that a name may add to one of these, before it (a state of the page, no furniture) or behind it
STATE_WORDS = {"with", "without", "has", "have", "no", "not", "is", "hide", "show"}
HOLDER_WORDS = {
    "area", "articles", "bar", "block", "body", "box", "btn", "button", "buttons", "column", "container", "content", "form",
    "group", "holder", "icons", "inner", "item", "items", "link", "links", "list", "outer", "panel", "posts", "row", "section",
    "slot", "stories", "text", "title", "unit", "wrap", "wrapper",
}
# block elements that are text of the element around them, not a part of the page
MARKUP = {
    "p", "pre", "blockquote", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "figure",
    "figcaption", "address",
}
LISTS = {"ul", "ol", "dl", "table"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
IN_HEAD = {"title", "meta", "link", "base", "basefont", "bgsound", "script", "style", "noscript", "template", "noframes"}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+(?=>|\Z)|[^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))|([^\s=/>\"']+)")
_WORDS = re.compile(r"[a-z]+|[0-9]+")
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[^\w\s]")
# an opening tag ends an open element of the same group (fixed by the HTML grammar)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "article", "main", "section", "div", "body", "nav", "aside"}


def _names_furniture(name: str, header_kept: bool) -> bool:
    """Whether a class or id name is one of the words, alone, as the head word or before a holder's word."""
    words = [w for w in _WORDS.findall(name) if not w.isdigit()]
    if not words or words[0] in STATE_WORDS:
        return False
    if header_kept and "header" in words:
        return False
    return words[-1] in NEVER_WORDS or words[0] in NEVER_WORDS and all(w in HOLDER_WORDS for w in words[1:])


def _furniture(tag: str, attributes: str, inside: int) -> int:
    """2 if an element is never part of an article (the header of an article is), 1 if only its names say so."""
    if tag in NEVER and not (tag == "header" and inside):
        return 2
    if tag in ("body", "html") or not attributes:
        return 0
    found = 0
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values[:3]).lower()
        if name == "hidden" or values[3].lower() == "hidden":
            return 2
        if name == "role" and value in NEVER_ROLES or name == "aria-hidden" and value == "true":
            return 2
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return 2
        if name in ("class", "id") and tag not in MAIN and not (name == "id" and tag in HEADINGS) and any(
            _names_furniture(w, bool(inside) and tag == "header") for w in value.split()
        ):
            found = 1
    return found


class _Node:
    __slots__ = ("tag", "path", "never", "main", "named", "block", "part", "unit", "linked")

    def __init__(self, tag: str, path: str, never: bool, main: int, named: tuple[int, ...], above: _Node | None, number: int):
        self.tag, self.path, self.never, self.main, self.named = tag, path, never, main, named
        self.block, self.part, self.unit, self.linked = tag, number, number, tag == "a"
        if above is not None:
            self.linked = self.linked or above.linked
            if tag not in BLOCKS:
                self.block, self.part, self.unit = above.block, above.part, above.unit
            elif tag in MARKUP or tag in HEADINGS:
                self.part = above.part
                if above.unit != above.part and above.block in LISTS | MARKUP:
                    self.unit = above.unit


class Block(NamedTuple):
    path: str
    text: str
    main: int  # number of the outermost article or main element around it, 0 for none
    named: tuple[int, ...]  # numbers of the elements around it whose names are those of furniture
    block: str  # tag of the block element it stands in
    part: int  # number of the part of the page around it: its nearest block element that is no text markup
    unit: int  # number of the outermost list, table, quote or paragraph around it in that part
    linked: int  # characters of it inside links


def _kept(found: list[Block]) -> list[Block]:
    """The blocks outside elements with names of furniture, but for those that hold the article.

    Such an element stays if it holds the page's only article or main elements, or
    most of its text, measured without what other such elements inside it hold.
    """
    if not any(b.named for b in found):
        return found
    only = not any(b.main and not b.named for b in found)
    total, own, mains = sum(len(b.text) for b in found), {}, set()
    for b in found:
        if b.named:
            own[b.named] = own.get(b.named, 0) + len(b.text)
            if b.main:
                mains.add(b.named)
    stays: set[int] = set()
    if only and mains:
        stays.update(max(mains, key=lambda n: own[n]))
    elif only:
        stays.update(k for n, size in own.items() if 2 * size > total for k in n)
    return [b for b in found if stays.issuperset(b.named)]


def blocks(page: str) -> list[Block]:
    """The blocks outside page furniture, in order."""
    return _kept(list(_all_blocks(page)))


def _all_blocks(page: str) -> Iterator[Block]:
    """All blocks but those in elements that are never part of an article."""
    stack = [_Node("", "", False, 0, (), None, 0)]
    opened = linked = 0
    words: list[str] = []
    where, mains, names, place, blank = stack[0], 0, 0, 0, True

    def ended():
        nonlocal blank, linked
        blank, linked = True, 0
        text = _SPACE.sub(" ", html.unescape("".join(words)).replace("\x00", "")).strip()
        words.clear()
        return text

    while place < len(page):
        match = _TOKEN.match(page, place)
        place = match.end()
        if match["text"] is not None:
            if stack[-1].tag == "head" and not match["text"].isspace():
                stack.pop()
            if not stack[-1].never:
                if blank and not match["text"].isspace():
                    where, blank = stack[-1], False
                words.append(match["text"])
                if stack[-1].linked:
                    linked += len(match["text"].strip())
            continue
        if match["tag"] is None:
            continue
        tag, attributes = match["tag"].lower(), match["attributes"]
        block = tag in BLOCKS
        if match["close"]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if block or depth and any(n.tag in BLOCKS for n in stack[depth:]):
                links = linked
                if text := ended():
                    yield Block(where.path, text, where.main, where.named, where.block, where.part, where.unit, links)
            if depth:
                del stack[depth:]
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:  # its end tag may be omitted
            stack.pop()
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, place)
            place = found.end() if found else len(page)
            if tag not in NEVER:
                words.append(" ")
            continue
        if block or tag in NEVER:
            links = linked
            if text := ended():
                yield Block(where.path, text, where.main, where.named, where.block, where.part, where.unit, links)
            if block:  # a paragraph ends where a block begins, and takes its inline tags along
                open_p = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == "p" or stack[k].tag in _SCOPE), 0)
                if open_p and stack[open_p].tag == "p":
                    del stack[open_p:]
        if tag in _CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _CLOSES[tag]:
                    del stack[k:]
                    break
                if stack[k].tag in _SCOPE:
                    break
        if tag == "br":
            words.append(" ")
            continue
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCKS:
            continue
        above = stack[-1]
        main = above.main
        if tag in MAIN and not main and not above.never:
            mains += 1
            main = mains
        opened += 1
        kind, named = _furniture(tag, attributes, above.main), above.named
        if kind == 1:
            names += 1
            named = (*named, names)
        stack.append(_Node(tag, f"{above.path}/{tag}", above.never or kind == 2, main, named, above, opened))
    links = linked
    if text := ended():
        yield Block(where.path, text, where.main, where.named, where.block, where.part, where.unit, links)


def _smoothed(values: np.ndarray) -> np.ndarray:
    """Gaussian smoothing along the page, the standard deviation one block, edges mirrored."""
    if len(values) < 3:
        return values
    weights = np.exp(-0.5 * np.arange(-2, 3) ** 2.0)
    return np.convolve(np.pad(values, 2, mode="edge"), weights / weights.sum(), "valid")


def content_paths(found: list[Block]) -> set[str]:
    """Paths whose fused, smoothed ratios reach the threshold of the page.

    Per path: characters of text per node, and punctuation marks per node. Both
    are smoothed over the nodes in order and multiplied; a path's score is the
    mean over its nodes, the threshold the smaller of mean and half the maximum.
    """
    totals: dict[str, list[float]] = {}
    for path, text, *_ in found:
        row = totals.setdefault(path, [0.0, 0.0, 0.0])
        row[0] += len(text)
        row[1] += len(_PUNCTUATION.findall(text))
        row[2] += 1
    text_ratio = _smoothed(np.array([totals[p][0] / totals[p][2] for p, *_ in found]))
    mark_ratio = _smoothed(np.array([totals[p][1] / totals[p][2] for p, *_ in found]))
    fused = np.sqrt(text_ratio * (1.0 + mark_ratio))
    scores: dict[str, list[float]] = {}
    for (path, *_), value in zip(found, fused):
        scores.setdefault(path, []).append(value)
    means = {p: sum(v) / len(v) for p, v in scores.items()}
    limit = min(float(fused.mean()), max(means.values()) / 2)
    return {p for p, v in means.items() if v >= limit}


def _selected(found: list[Block], paths: set[str]) -> list[Block]:
    """The blocks of content paths, and what belongs to them: unlinked markup in the
    same part of the page, and headings with such blocks below them."""
    keep = [b.path in paths and b.block not in HEADINGS for b in found]
    if not any(keep):
        keep = [b.path in paths for b in found]
    parts = {b.part for b, k in zip(found, keep) if k}
    units: dict[int, list[int]] = {}
    for b in found:
        row = units.setdefault(b.unit, [0, 0])
        row[0] += len(b.text)
        row[1] += b.linked
    for k, b in enumerate(found):
        if b.block in MARKUP and b.part in parts and 2 * units[b.unit][1] < units[b.unit][0]:
            keep[k] = True
    wanted = [False] * 7  # whether content follows before the next heading of at most each level
    for k in range(len(found) - 1, -1, -1):
        if found[k].block in HEADINGS:
            level = int(found[k].block[1])
            keep[k] = keep[k] or wanted[level]
            wanted[level:] = [False] * (7 - level)
        elif keep[k]:
            wanted = [True] * 7
    return [b for b, k in zip(found, keep) if k]


def main_text(page: str) -> str:
    """The article's text, one block per line.

    If content paths lie in an article or main element, nodes are selected in the
    outermost such elements that hold one (in all of them if none does), else in
    the whole page.
    """
    found = blocks(page)
    if not found:
        return ""
    paths = content_paths(found)
    mains = {b.main for b in found if b.main and b.path in paths}
    if not mains and (inside := [b for b in found if b.main]):
        mains, paths = {b.main for b in inside}, content_paths(inside)
    return "\n".join(b.text for b in _selected([b for b in found if not mains or b.main in mains], paths))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part = batch.slice(begin, 256)
            texts = [main_text(p or "") for p in part.column("html").to_pylist()]
            rest = [n for n in part.schema.names if n != "html"]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(n) for n in rest], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*rest, "text", "n_chars"],
            )


def extract(df: DataFrame, html_column: str = "html", id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    A null or empty page, or one without an article, gives an empty text. White
    space inside a block is one space, blocks are joined by one newline, nothing
    else is dropped or cut. Repeated rows give repeated results; an empty table an
    empty one; other columns are not read.
    """
    picked = df.select(
        named(df, id_column).alias("page_id"), named(df, url_column).alias("url"), named(df, html_column).alias("html")
    )
    return picked.mapInArrow(_extracted, extended(picked, "html", "text string, n_chars long"))
