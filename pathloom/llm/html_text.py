"""Main text of web pages from a stream of parser events.

The standard library's HTMLParser yields events; they are folded into lines (one for
each block of text) that carry their characters, the tags seen since the line before,
the characters inside links, the element and the landmark (article, main) they stand
in, and whether a structural sign (menu, header, footer, sidebar, form, notice, advert,
comment) marks them. Scripts, styles and the like make no lines.

The text-to-tag ratios of all lines, weighed by structure (a landmark raises them, a mark
lowers them), are smoothed by a Gaussian. Lines above a threshold (a share of the
standard deviation) are content; runs of them are clusters. The clusters of the greatest
weighed mass (of equal ones all) say where the content is: the region is the outermost
landmark around a cluster, or else the element that holds all clusters without one, or, if
that is the whole page, what runs from the first of their lines to the last. Of a region
all unmarked lines are returned, short ones too.

Null or empty html, and pages without text, give an empty text; pages of any length are
read whole. Every input row gives one row; repeated rows and null ids pass through; other
columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices

#: Standard deviation, in lines, and reach of the Gaussian; cores lie above this share of the ratios' deviation.
SIGMA, REACH, SHARE = 1.0, 2, 0.5
#: Weights of lines in a landmark and of marked lines; a cluster counts with this share of the greatest mass.
LANDMARK, MARKED, PART = 8.0, 0.1, 0.25

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start and end part text into blocks.
BLOCKS = frozenset(
    """address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
    h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol option p pre section select summary table tbody td
    textarea tfoot th thead title tr ul""".split()
)
#: Elements whose text isn't shown as text, and elements that are marked by their name; a form marks unless all else is marked.
UNSEEN = frozenset("head script style noscript template svg math canvas iframe object embed applet audio video select option datalist textarea button".split())
ASIDE = frozenset("fieldset nav aside footer menu dialog".split())
#: How a line is marked.
OPEN, IN_FORM, OUT, GONE = range(4)
#: An open p ends where one of these starts.
ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: What an element of the same kind ends, and what holds it.
SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
#: Words of class and id attributes that mark what is not content.
MARKS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adsbygoogle adslot adbox adunit banner sponsor sponsored promo promotion promoted
    nav navbar navigation menu submenu breadcrumb breadcrumbs toc pager pagination sidebar side sidenav rail masthead topbar toolbar
    footer foot copyright colophon legal cookie cookies consent gdpr notice notices alert popup modal overlay lightbox
    newsletter subscribe subscription signup signin login register paywall share sharing social follow related recommended
    recommendations trending popular comment comments commentlist respond reply replies disqus discussion responses
    form search searchbox widget widgets skip skiplink hidden""".split()
)
#: Words of names that only say what a layout has, as in "with-sidebar".
PHRASES = frozenset("has with no without".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
LANDMARKS = frozenset(("article", "main"))
_words = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+").findall
_none_shown = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden").search


class Line:
    __slots__ = ("text", "tags", "linked", "landmark", "node", "mark")

    def __init__(self, text: str, tags: int, linked: int, landmark: int, node: int, mark: int):
        self.text, self.tags, self.linked, self.landmark, self.node, self.mark = text, tags, linked, landmark, node, mark


class Reader(HTMLParser):
    """Folds events into lines. Unclosed and stray tags are tolerated: an end tag closes up to the last open element of its name, if there is one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, int, int]] = []  # tag, mark, landmark, node
        self.lines: list[Line] = []
        self.pieces: list[tuple[int, str, bool]] = []  # since the last flush: mark, text, whether it is linked
        self.tags = self.links = 0
        self.landmarks: list[tuple[str, int]] = [("", -1)]  # tag and enclosing landmark; 0 is the page
        self.nodes: list[int] = [-1]  # parents of block elements; 0 is the page

    def here(self) -> tuple[int, int, int]:
        return self.open[-1][1:] if self.open else (OPEN, 0, 0)

    def flush(self) -> None:
        """The pieces of each mark make a line: marked words within a block are neither content nor a part of the words around them."""
        mark, landmark, node = self.here()
        made = False
        for own in sorted({m for m, *_ in self.pieces}):
            text = " ".join("".join(t for m, t, _ in self.pieces if m == own).split())
            if text:
                self.lines.append(Line(text, self.tags, sum(len(t) for m, t, linked in self.pieces if m == own and linked), landmark, node, own))
                made = True
        if made or mark:
            self.tags = 0
        self.pieces.clear()

    def mark(self, tag: str, attrs: dict[str, str | None], landmark: int) -> int:
        if tag in UNSEEN:
            return GONE
        if tag in ASIDE or tag == "header" and not landmark:
            return OUT
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role") in ROLES or _none_shown(attrs.get("style") or ""):
            return OUT
        if tag in ("html", "body", "main"):
            return OPEN
        for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
            found = {w.lower() for w in _words(name)}
            if PHRASES.isdisjoint(found) and (not MARKS.isdisjoint(found) or "header" in found and not landmark and tag in ("div", "section")):
                return OUT
        return IN_FORM if tag == "form" else OPEN

    def close_to(self, i: int) -> None:
        self.flush()
        for tag, *_ in self.open[i:]:
            self.links -= tag == "a"
        del self.open[i:]

    def last(self, names: tuple[str, ...] | list[str], until: tuple[str, ...] = ()) -> int:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in names:
                return i
            if self.open[i][0] in until:
                break
        return -1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if tag in VOID:
            return
        if tag in ENDS_P and (i := self.last(("p",), ("button", "table", "td"))) >= 0:
            self.close_to(i)
        if tag in SIBLINGS and (i := self.last(SIBLINGS[tag][0].split(), SIBLINGS[tag][1])) >= 0:
            self.close_to(i)
        if tag == "body" and (i := self.last(("head",))) >= 0:
            self.close_to(i)
        if tag in LANDMARKS and (i := self.last(("nav", "head"))) >= 0:  # a menu that was never closed
            self.close_to(i)
        mark, landmark, node = self.here()
        if tag in LANDMARKS and mark == IN_FORM:  # a form around the article marks nothing in it
            mark = OPEN
        mark = max(mark, self.mark(tag, dict(attrs), landmark))
        if tag in LANDMARKS and mark == OPEN:
            self.landmarks.append((tag, landmark))
            landmark = len(self.landmarks) - 1
        if tag in BLOCKS and tag not in ("html", "body"):
            self.nodes.append(node)
            node = len(self.nodes) - 1
        self.links += tag == "a"
        self.open.append((tag, mark, landmark, node))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # as browsers do, the slash means nothing

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if (i := self.last((tag,))) >= 0:
            if tag in BLOCKS or any(t in BLOCKS for t, *_ in self.open[i:]):
                self.close_to(i)
            else:
                for t, *_ in self.open[i:]:
                    self.links -= t == "a"
                del self.open[i:]

    def handle_data(self, data: str) -> None:
        mark = self.here()[0]
        if mark == GONE:
            return
        self.pieces.append((mark, data, self.links > 0))


def lines_of(html: str) -> tuple[list[Line], list[tuple[str, int]], list[int]]:
    """Lines, landmarks and the parents of block elements."""
    reader = Reader()
    reader.feed(html)
    reader.close()
    reader.flush()
    lines = reader.lines
    forms = any(x.mark == OPEN for x in lines)
    for x in lines:
        if x.mark == IN_FORM:
            x.mark = OUT if forms else OPEN
    return lines, reader.landmarks, reader.nodes


def smoothed(values: list[float], sigma: float = SIGMA, reach: int = REACH) -> list[float]:
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for k, w in enumerate(kernel, -reach):
            if 0 <= i + k < len(values):
                total += w * values[i + k]
                weight += w
        out.append(total / weight)
    return out


def weighed(line: Line) -> float:
    """Characters outside links, weighed by structure."""
    return max(0, len(line.text) - line.linked) * (MARKED if line.mark else LANDMARK if line.landmark else 1.0)


def clusters(lines: list[Line], outermost: list[int]) -> list[list[int]]:
    """Runs of lines of one outermost landmark (0: none) whose smoothed ratio of weighed text to tags is over the threshold."""
    ratios = smoothed([weighed(x) / max(1, x.tags) for x in lines])
    mean = sum(ratios) / len(ratios)
    least = min(SHARE * math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios)), max(ratios))
    out: list[list[int]] = []
    for i, r in enumerate(ratios):
        if r >= least and 2 * lines[i].linked <= len(lines[i].text):
            if out and out[-1][-1] == i - 1 and outermost[i] == outermost[i - 1]:
                out[-1].append(i)
            else:
                out.append([i])
    return out


def around(nodes: list[int], a: int, b: int) -> int:
    """The innermost block element that holds both; parents have smaller numbers."""
    while a != b:
        a, b = (nodes[a], b) if a > b else (a, nodes[b])
    return a


def main_text(html: str | None) -> str:
    if not html:
        return ""
    lines, landmarks, nodes = lines_of(html)
    if not lines:
        return ""
    held = []  # of each line, the landmarks around it, the innermost first
    for x in lines:
        at, own = x.landmark, []
        while at > 0:
            own.append(at)
            at = landmarks[at][1]
        held.append(own)
    outermost = [own[-1] if own else 0 for own in held]
    found = clusters(lines, outermost)
    masses = [sum(weighed(lines[i]) for i in c if not lines[i].mark) for c in found]
    most = max(masses, default=0.0)
    if not most:  # nothing but links and marked text: what landmarks hold
        return " ".join(x.text for x in lines if x.landmark and not x.mark)
    content = [c for c, m in zip(found, masses, strict=True) if m >= PART * most]
    inside = {outermost[c[0]] for c in content} - {0}
    # articles inside a main part are its content; the text around them is not
    articles = {own[-1] for own in held if any(landmarks[a][0] == "article" for a in own)}
    chosen = [bool(own) and own[-1] in inside and (own[-1] not in articles or any(landmarks[a][0] == "article" for a in own)) for own in held]
    free = [i for c in content if not outermost[c[0]] for i in c if not lines[i].mark]
    if free:
        region = lines[free[0]].node
        for i in free[1:]:
            region = around(nodes, region, lines[i].node)
        whole_page = not region or all(around(nodes, region, x.node) == region for x in lines)
        for i, x in enumerate(lines):
            if not outermost[i]:
                chosen[i] = free[0] <= i <= free[-1] and 2 * x.linked <= len(x.text) if whole_page else around(nodes, region, x.node) == region
    return " ".join(x.text for x, ok in zip(lines, chosen, strict=True) if ok and not x.mark)


def extract(df: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """keys, text string (the main text) and n_chars long (its code points) of every row."""
    bounded_batches(df)
    inner = [f"k{i}" for i in range(len(keys))]
    source = df.select(*[F.col(k).alias(i) for k, i in zip(keys, inner, strict=True)], F.coalesce(F.col(html), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            texts = [main_text(x) for x in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in inner], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*inner, "text", "n_chars"])

    types = dict(source.dtypes)
    out = source.mapInArrow(run, ", ".join([*[f"{i} {types[i]}" for i in inner], "text string", "n_chars long"]))
    return out.withColumnsRenamed(dict(zip(inner, keys, strict=True)))
