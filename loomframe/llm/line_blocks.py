"""Main text of HTML pages by the distribution of text over lines.

Markup is stripped to lines: each block element (and ``<br>``) is one line. Page furniture (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) is emptied but keeps its place.
What an element is decides first, class and id names only after: inside a named article (``<article>``,
``<main>``) only names that always mark furniture count.

A line's weight is its text length without links, if it is prose: it stands in a paragraph, ends a sentence or
is long, and is neither a row of menu entries nor a copyright line. A paragraph element weighs DENSE at least. Weights are summed over sliding windows
of WINDOW filled lines. Text surges at the first weighted line of the first window that holds DENSE
characters and dives behind the last weighted line of the last one; headings right before the surge and fewer than WINDOW
link lines right behind the dive belong to it. All lines between are kept, whether prose, short lines or
links. Without such a window the weighted lines are the bounds; without any, lines that are no
links, menu rows or copyright lines are the text. Long runs of links before or after all prose are menus:
a page of nothing but links outside an article gives an empty text. In a named article every line has its whole length as
weight, save list items that are only links, and any length is dense; WINDOW such items or more before the surge are a
menu, fewer belong to the article. It has no dive: all lines behind the surge are kept, since lists of links often
close an article, and an article of such items only is kept whole.

Missing and empty pages give an empty text. Markup is scanned once from left to right, in time linear in the page,
also where tags, quotes or comments never end; a tag that never ends takes the rest of the page with it. Rows are
independent: repeated rows and ties need no rule. Added columns replace input columns of the same name; an
empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 3  # filled lines in a window
DENSE = 40  # characters of prose in a dense window
LONG = 80  # characters from which a line is prose without ending a sentence

# Elements of HTML by their role.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "title", "xmp", "noembed", "noframes")
FURNITURE = frozenset((
    "nav", "header", "footer", "aside", "form", "menu", "dialog", "head", "button", "select", "fieldset", "object", "canvas",
    "audio", "video", "datalist", "map",
))
VOID = frozenset((
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
))
BLOCKS = frozenset((
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup",
    "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
))
#: An open element on the left ends when one of the right begins.
CLOSES = {
    "p": BLOCKS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"},
}
ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "form"))
#: Words of class and id names that mark furniture.
NAMES = frozenset("""
ad ads adv advert adverts advertisement advertisements advertising adbox adsense sponsor sponsored sponsors promo promos promotion
promoted banner nav navbar navigation navi menu menus breadcrumb breadcrumbs crumbs sidebar sidebars sidenav aside widget widgets
footer foot masthead topbar toolbar pagehead cookie cookies consent gdpr notice notices notification notifications alert
popup modal overlay newsletter subscribe subscription signup login signin comment comments commentlist replies reply
respond disqus discussion feedback reviews share sharing shares social socials related recommended recommendations recirc trending
outbrain taboola copyright legal disclaimer tags tagcloud pagination pager skip skiplink hidden
""".split())

#: Whole class and id names that mark the head of a site; an article's own head is text.
SITE_HEADS = frozenset(("header", "site-header", "page-header", "global-header", "main-header", "siteheader", "pageheader"))

#: Words that mark furniture inside a named article too; the others may name what the article is about.
ALWAYS = frozenset("""
ad ads adv advert adverts advertisement advertisements advertising adbox adsense sponsor sponsored sponsors promo promos banner nav
navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars sidenav cookie cookies consent gdpr notice notices notification
notifications popup modal newsletter subscribe subscription signup login signin comment comments commentlist disqus share sharing
shares social outbrain taboola pagination pager skiplink
""".split())
#: Kind of the lines of an element: paragraphs, headings and list items; other blocks have none, inline elements that of what holds them.
KINDS = {"li": "l", "p": "p", "blockquote": "p", "pre": "p", "dd": "p", "figcaption": "p", **{f"h{n}": "h" for n in range(1, 7)}}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_TAG_END = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_SENTENCE_END = re.compile(r"[.!?\u2026\u3002][\"'\u201d\u2019\u00bb)\]]*$")
_COPYRIGHT = re.compile(r"\s*(?:\u00a9|\(c\)|copyright\b|all rights reserved)", re.I)
_MENU_ROW = re.compile(r"[^|\u00b7\u2022\u00bb\u203a]{0,30}(?:\s[|\u00b7\u2022\u00bb\u203a]\s[^|\u00b7\u2022\u00bb\u203a]{0,30}){2,}$")
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


def _furniture(tag: str, more: str, inside: bool) -> bool:
    if tag in FURNITURE and not (inside and tag == "header"):
        return True
    if not more.strip() or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in _ATTRIBUTE.findall(more):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value.strip() in ROLES:
            return True
        if name in ("class", "id"):
            for x in value.split():
                if not (ALWAYS if inside else NAMES).isdisjoint(_WORDS.findall(x)) or not inside and x in SITE_HEADS:
                    return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


class Line:
    """One line of a page: its text, how much of it is not link text, its kind, and whether it is in the named article."""

    __slots__ = ("inside", "kind", "links", "pieces")

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.links, self.inside, self.kind = 0, False, ""

    def text(self) -> str:
        return _SPACE.sub(" ", "".join(self.pieces)).strip()


def scan(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): ``text``, ``open`` with the attributes, ``shut``; comments and raw elements are left out.

    Every step goes on behind what it looked at. Once a quote proves to have no end, tags end at the next ">".
    """
    at, quoted = 0, True
    while True:
        start = page.find("<", at)
        if start < 0:
            start = len(page)
        if start > at:
            yield "text", "", page[at:start]
        if start == len(page):
            return
        for mark, end, skip in (("<!--", "-->", 4), ("<![CDATA[", "]]>", 9), ("<!", ">", 2), ("<?", ">", 2)):
            if page.startswith(mark, start):
                stop = page.find(end, start + skip)
                at = len(page) if stop < 0 else stop + len(end)
                break
        else:
            shut = page.startswith("</", start)
            name = _NAME.match(page, start + 1 + shut)
            if not name:
                yield "text", "", "<"
                at = start + 1
                continue
            stop, found = -1, None
            if not shut and quoted:
                found = _TAG_END.match(page, name.end())
                quoted = found is not None
            stop = found.end() - 1 if found else page.find(">", name.end())
            if stop < 0:
                return
            at, own = stop + 1, name[0].lower()
            if shut:
                yield "shut", own, ""
            elif own in _RAW_ENDS:
                closed = _RAW_ENDS[own].search(page, at)
                stop = page.find(">", closed.end()) if closed else -1
                at = len(page) if stop < 0 else stop + 1
            else:
                yield "open", own, page[name.end() : stop]


def lines_of(page: str) -> tuple[list[Line], bool]:
    """Lines of a page in order, and whether it names its article."""
    lines, line, named = [], Line(), False
    stack: list[tuple[str, bool, bool, str]] = []  # open elements: name, in furniture, in the article, kind of line
    links = 0
    for what, name, rest in scan(page):
        off, inside, kind = stack[-1][1:] if stack else (False, False, "")
        if what == "text":
            if not off:
                text = html.unescape(rest)
                line.pieces.append(text)
                if text.strip():
                    line.inside |= inside
                    line.kind = line.kind or kind
                if links:
                    line.links += len(text)
            continue
        if name in BLOCKS:
            lines.append(line)
            line = Line()
        if what == "open":
            while stack and name in CLOSES.get(stack[-1][0], ()):
                links -= stack.pop()[0] == "a"
            if name in VOID or rest.endswith("/") and name not in BLOCKS:
                continue
            off, inside, kind = stack[-1][1:] if stack else (False, False, "")
            article = name in ("article", "main")
            # A header or form inside the article's furniture stays furniture; nothing inside it is text.
            here = off or _furniture(name, rest, inside)
            if article and not here:
                named, inside = True, True
            stack.append((name, here, inside, KINDS.get(name, "" if name in BLOCKS else kind)))
            links += name == "a"
        else:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    for closed in stack[depth:]:
                        links -= closed[0] == "a"
                    del stack[depth:]
                    break
                if stack[depth][0] in ("article", "main", "body") and name not in ("article", "main", "body", "html"):
                    break
    lines.append(line)
    return lines, named


def _plain(text: str, links: int) -> bool:
    """Text that is neither only links nor a row of menu entries nor a copyright line."""
    return len(text) > links and not _COPYRIGHT.match(text) and not _MENU_ROW.match(text)


def weights(lines: list[tuple[str, int, str]]) -> list[int]:
    """Weight of each filled line (text, length of link text, kind); a paragraph is dense by itself, however short."""
    prose = [_plain(t, links) and kind != "h" and (kind == "p" or len(t) >= LONG or bool(_SENTENCE_END.search(t))) for t, links, kind in lines]
    return [max(len(t) - links, DENSE if kind == "p" else 0) if p else 0 for (t, links, kind), p in zip(lines, prose, strict=True)]


def bounds(weight: list[int], window: int, dense: int) -> tuple[int, int] | None:
    """First and last line of the text: surge and dive over sums of ``window`` weights. None if nothing has weight."""
    filled = [i for i, w in enumerate(weight) if w]
    if not filled:
        return None
    total, surge, dive = 0, None, None
    for end, w in enumerate(weight):  # windows reach over the first and last line
        total += w - (weight[end - window] if end >= window else 0)
        if total >= dense:
            surge = max(0, end - window + 1) if surge is None else surge
            dive = end
    if surge is None:
        return filled[0], filled[-1]
    return next(i for i in filled if i >= surge), next(i for i in reversed(filled) if i <= dive)


def main_text(page: str | None, window: int = WINDOW, dense: int = DENSE) -> str:
    """The text between surge and dive points, one line per block."""
    lines, named = lines_of(page or "")
    filled = [(text, x) for x in lines if (text := x.text())]
    if named:
        article = [(t, x) for t, x in filled if x.inside]
        found = bounds([0 if x.kind == "l" and x.links >= len(t) else len(t) for t, x in article], window, 1)
        surge = found[0] if found and found[0] >= window else 0
        return "\n".join(t for t, _ in article[surge:])
    rows = [(t, x.links, x.kind) for t, x in filled]
    found = bounds(weights(rows), window, dense)
    if found is None:
        return "\n".join(t for t, links, _ in rows if _plain(t, links))
    surge, dive = found
    while surge and rows[surge - 1][2] == "h":
        surge -= 1
    behind = dive + 1
    while behind < len(rows) and rows[behind][1] >= len(rows[behind][0]):
        behind += 1
    if behind - dive - 1 < window:
        dive = behind - 1
    return "\n".join(t for t, _, _ in rows[surge : dive + 1])


def extract(pages: DataFrame, markup: str = "html") -> DataFrame:
    """The input without its markup, with ``text`` and ``n_chars``."""
    added = {"text": T.StringType(), "n_chars": T.LongType()}
    kept = [c for c in pages.columns if c != markup and c not in added]
    schema = T.StructType([pages.schema[c] for c in kept] + [T.StructField(k, v) for k, v in added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            made = [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*kept, *added])

    return pages.select(*[pages[c] for c in kept], F.col(markup).alias("_markup")).mapInArrow(run, schema)
