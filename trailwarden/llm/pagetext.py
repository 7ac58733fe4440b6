"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's parser streams a page; block elements end a line. Each
line has the ratio of its text to the tags inside it. The ratios are smoothed
with a Gaussian, and the lines above a threshold form clusters. The cluster
with the most text shows which element holds the content: the article or main
element around it, with every article beside it that has a cluster, or else the smallest one that can hold blocks, has nearly
all of the cluster and leaves no running text, title or other cluster outside.
From that element every line is taken, however short, that does not stand in a
menu, header, footer, sidebar, notice, advert, form or comment. Paragraphs and
sections that are named like these by their subject stay if they hold running
text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailwarden.llm.common import table

SIGMA = 1.0
#: Share of the largest smoothed ratio's root mean square that a line of content reaches.
THRESHOLD = 0.5
#: Share of a cluster's text that the element chosen for it must hold.
HELD = 0.9

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split())
HIDDEN = frozenset("applet button canvas head iframe math noscript object script select style svg template textarea title".split())
ASIDE = frozenset("aside dialog footer form header menu nav".split())
CONTENT = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Classes and ids that mark, as a whole, what is not content.
MARKS = frozenset(
    "ad ads adbox adsense advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices "
    "popup promo promotion recommended related share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
#: Compounds that do so, too: each word of the first list with each of the second, however they are joined.
COMPOUNDS = frozenset(
    a + b for first, second in (
        ("ad ads advert advertisement adsense google googlead sponsored", "ad ads area banner box container label placeholder slot space unit wrap wrapper"),
        ("blog bottom footer global header left main mobile page primary right secondary side site top", "breadcrumb breadcrumbs footer menu nav navbar navigation sidebar toolbar"),
        ("page site top", "banner header masthead"), ("article blog entry page post user", "comment comments footer share sharing"),
        ("breadcrumb breadcrumbs menu nav navbar navigation sidebar", "bar container inner links list menu nav wrap wrapper"),
        ("comment comments", "area author body container content form list meta reply respond section text thread wrap wrapper"),
        ("consent cookie cookies gdpr privacy", "alert banner bar box consent message modal notice overlay popup"),
        ("paywall", "banner box message modal notice overlay popup prompt"),
        ("newsletter promo promotion signup subscribe subscription", "banner block box container form modal popup promo signup teaser widget"),
        ("share sharing social", "bar box button buttons icons links list media menu share sharing tools widget"),
        ("recommended related", "article articles box content links list news post posts reading stories widget"),
        ("alert popup site", "banner modal notice overlay"), ("footer sidebar", "area column content widget widgets"),
    ) for a in first.split() for b in second.split())
#: Ids that mark a section even if it holds running text; others are as often made from its heading.
SECTION_MARKS = frozenset("ad ads adbox adsense advert advertisement adverts breadcrumb breadcrumbs comment comments disqus nav navbar sidebar".split())
#: Marks that are as often the subject of a paragraph or section: these are content if they hold running text.
SUBJECTS = frozenset("alert related recommended share sharing social".split())
PARAGRAPHS = frozenset("blockquote p pre".split())
#: Classes of a section that say what it is for, not what it is about.
LISTINGS = frozenset("related recommended".split())
#: What an article or main element is called that is not the page's content.
CONTENT_MARKS = frozenset("comment comments related teaser".split())
#: Characters outside of links in a line of running text.
RUNNING = 40
#: The same for a line that ends as a sentence does.
SENTENCE = 15
SENTENCE_END = re.compile(r"[.!?\u2026\u3002\uff01\uff1f][\"'\u00bb\u201c\u201d\u2019)\]]*$")
#: Elements whose end is implied when one of the same kind begins beside them.
IMPLIED = {
    "p": frozenset("p"), "li": frozenset(("li", "p")), "dt": frozenset(("dt", "dd", "p")), "dd": frozenset(("dt", "dd", "p")),
    "tr": frozenset(("tr", "td", "th", "p")), "td": frozenset(("td", "th", "p")), "th": frozenset(("td", "th", "p")),
    "option": frozenset(("option",)),
}
SCOPES = frozenset("article aside body div dl footer form header main nav ol section table ul".split())


@dataclass
class Element:
    number: int
    tag: str
    skipped: bool
    linked: bool  # a link, or within one
    doubtful: tuple[int, ...]  # numbers of the sections around it that are content if they hold running text


@dataclass
class Line:
    text: str
    tags: int
    path: tuple[int, ...]  # numbers of the elements around it that can hold several blocks, outermost first
    inside: int  # number of the innermost article or main element, or -1
    unlinked: int  # characters outside of links
    doubtful: tuple[int, ...]
    title: bool  # within a heading of the first level
    article: int = -1  # number of the outermost article around it, or -1 if there is none or it lies in a main element or an aside


@lru_cache(4096)
def _name(value: str) -> tuple[str, bool]:
    """A class or id without a number at its end, and whether it is a known compound."""
    name = re.sub(r"[^a-z]*[0-9]+$", "", value)
    return name, re.sub(r"[-_:]+", "", name) in COMPOUNDS


def _named(tag: str, attr: str, value: str) -> bool:
    """A whole class or id says that the element is not content."""
    if attr == "id" and (tag in HEADINGS or tag == "dt"):
        return False  # made from the heading's words
    names = map(_name, value.split())
    if tag in CONTENT:
        return any(name in CONTENT_MARKS or known and name.startswith(("comment", "related")) for name, known in names)
    return any(known or name in MARKS and not (tag in HEADINGS and name == "header") for name, known in names)


def _subject(tag: str, attr: str, value: str, section: bool) -> bool:
    """A mark that may as well say what the element is about."""
    if attr == "id" and section:
        return _name(value.strip())[0] not in SECTION_MARKS
    marks = {name for name, known in map(_name, value.split()) if known or name in MARKS}
    return (tag in PARAGRAPHS and marks <= SUBJECTS) or (section and marks <= SUBJECTS - LISTINGS)


def _marked(tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, bool]:
    """Whether an element is not content, and whether it is not unless it holds running text."""
    section = tag == "section" or (tag == "div" and any(n == "class" and "section" in (v or "").lower().split() for n, v in attrs))
    doubtful = False
    for name, value in attrs:
        value = (value or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True, False
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, False
        if name == "role" and value in ROLES:
            return True, False
        if name in ("class", "id") and tag not in ("html", "body") and _named(tag, name, value):
            if not _subject(tag, name, value, section):
                return True, False
            doubtful = True
    return False, doubtful


class LineParser(HTMLParser):
    """Lines of a page outside of what is never content."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[Element] = []
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = 0
        self.linked = 0
        self.number = 0
        self.beside: set[int] = set()  # articles that begin in a menu, sidebar or the like

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            path = tuple(e.number for e in self.open if e.tag in SCOPES)
            inside = next((e.number for e in reversed(self.open) if e.tag in CONTENT), -1)
            doubtful = self.open[-1].doubtful if self.open else ()
            title = any(e.tag == "h1" for e in self.open)
            outer = [e for e in self.open if e.tag in CONTENT]
            article = -1 if not outer or self.beside.intersection(e.number for e in outer) or any(e.tag == "main" for e in outer) else outer[0].number
            self.lines.append(Line(text, self.tags, path, inside, max(0, len(text) - self.linked), doubtful, title, article))
        self.parts, self.tags, self.linked = [], 0, 0

    @property
    def skipping(self) -> bool:
        return bool(self.open) and self.open[-1].skipped

    def _close(self, tags: frozenset[str], scopes: frozenset[str]) -> None:
        """End the innermost of these elements, unless a scope lies between."""
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at].tag in tags:
                del self.open[at:]
                return
            if self.open[at].tag in scopes:
                return

    def handle_starttag(self, tag, attrs):
        if tag == "body":
            self._close(frozenset(("head",)), frozenset())
        if tag in BLOCK:
            self._flush()
            if tag in IMPLIED:
                self._close(IMPLIED[tag], SCOPES)
            elif tag in SCOPES or tag in HEADINGS:
                self._close(frozenset("p"), SCOPES)
        else:
            self.tags += 1
        if tag == "br":
            self.parts.append("\n")
        if tag in VOID:
            return
        marked, doubtful = _marked(tag, attrs)
        skipped = tag in HIDDEN or tag in ASIDE or marked
        if tag in CONTENT and not skipped:
            # content does not begin inside what was left open
            if self.skipping:
                self.beside.add(self.number + 1)
            while self.skipping and self.open[-1].tag not in HIDDEN and not any(e.tag in CONTENT for e in self.open):
                self.open.pop()
        if tag in HEADINGS and self._article_header():
            skipped = False
        else:
            skipped = skipped or self.skipping
        self.number += 1
        around = self.open[-1] if self.open else None
        linked = tag == "a" or (around is not None and around.linked)
        unsure = around.doubtful if around else ()
        self.open.append(Element(self.number, tag, skipped, linked, (*unsure, self.number) if doubtful else unsure))

    def _article_header(self) -> bool:
        """The innermost skipped element is an article's own header."""
        first = next((i for i, e in enumerate(self.open) if e.skipped), None)
        return first is not None and self.open[first].tag == "header" and any(e.tag in CONTENT for e in self.open[:first])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "span"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self._flush()
        else:
            self.tags += 1
        if tag in SCOPES or tag in HIDDEN or tag in ("head", "html"):
            self._close(frozenset((tag,)), frozenset())
        else:
            self._close(frozenset((tag,)), SCOPES)

    def handle_data(self, data):
        if not self.skipping:
            self.parts.append(data)
            if self.open and self.open[-1].linked:
                self.linked += len(data)

    def finish(self) -> list[Line]:
        self.close()
        self._flush()
        running = {n for x in self.lines if x.unlinked >= RUNNING for n in x.doubtful}
        return [x for x in self.lines if running.issuperset(x.doubtful)]


def smoothed(ratios: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing; weights beyond an edge are left out."""
    reach = math.ceil(2 * sigma)
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(ratios)):
        low, high = max(0, i - reach), min(len(ratios), i + reach + 1)
        weights = kernel[low - i + reach : high - i + reach]
        out.append(sum(w * r for w, r in zip(weights, ratios[low:high])) / sum(weights))
    return out


def clusters(values: list[float], threshold: float) -> list[range]:
    """Runs of neighbouring lines at or above the threshold."""
    out, start = [], None
    for i, v in enumerate([*values, -1.0]):
        if v >= threshold and start is None:
            start = i
        elif v < threshold and start is not None:
            out.append(range(start, i))
            start = None
    return out


def _running(line: Line) -> bool:
    """A line of running text or a title, mostly outside of links."""
    if 2 * line.unlinked <= len(line.text):
        return False
    return line.title or line.unlinked >= RUNNING or (line.unlinked >= SENTENCE and SENTENCE_END.search(line.text) is not None)


def _innermost(lines: list[Line], numbers: set[int]) -> int:
    """The innermost element around all of these lines, or 0 for the page."""
    return max(numbers.intersection(*(x.path for x in lines)), default=0)  # elements are numbered outside in


def main_lines(lines: list[Line]) -> list[str]:
    if not lines:
        return []
    own = [len(x.text) / max(1, x.tags) for x in lines]
    ratios = smoothed(own)
    limit = THRESHOLD * math.sqrt(sum(r * r for r in ratios) / len(ratios))
    weight = lambda run: sum(len(lines[i].text) for i in run)
    runs = clusters(ratios, limit)
    best = max(runs, key=weight)
    held: dict[int, int] = {}
    for i in best:
        for number in set(lines[i].path):
            held[number] = held.get(number, 0) + len(lines[i].text)
    marked = {x.inside for x in lines if x.inside >= 0}
    inside = [n for n in held if n in marked]
    if inside:
        # the outermost article or main element that the content lies in, and the articles beside it with a cluster of their own
        chosen = max(inside, key=lambda n: (held[n], -n))
        articles = {lines[i].article for run in runs for i in run if own[i] >= limit and _running(lines[i])}
        taken = articles - {-1} | {chosen} if any(x.article == chosen for x in lines) else {chosen}
        return [x.text for x in lines if not taken.isdisjoint(x.path)]
    if marked:
        sizes = {n: sum(len(x.text) for x in lines if n in x.path) for n in marked}
        chosen = max(sizes, key=lambda n: (sizes[n], -n))
        return [x.text for x in lines if chosen in x.path]
    enough = {n for n, size in held.items() if size >= HELD * weight(best)}
    core = max(enough, default=0)
    # lines that only a neighbour lifts above the threshold do not count
    dense = {i for run in runs for i in run if own[i] >= limit and 2 * lines[i].unlinked > len(lines[i].text)}
    whole = [x for i, x in enumerate(lines) if i in dense or _running(x)]
    chosen = _innermost(whole, enough) if core else 0
    taken = [x for x in lines if chosen in x.path or not chosen]
    if chosen == core:
        return [x.text for x in taken]
    # beside the core, a block of nothing but links is a menu
    block = lambda x: next((n for n in x.path if n > chosen), 0)
    filled = {block(x) for x in taken if core in x.path or 2 * x.unlinked > len(x.text)}
    return [x.text for x in taken if block(x) in filled or not block(x)]


def main_text(html: str | None) -> str:
    """The content's blocks, one a line."""
    if not html:
        return ""
    last = html.rfind("<")
    if last > html.rfind(">") and re.match(r"</?[a-zA-Z]|<!", html[last : last + 3]):
        html = html[:last]  # a page cut off within a tag
    parser = LineParser()
    parser.feed(html)
    return "\n".join(main_lines(parser.finish()))


def extract(pages: DataFrame) -> DataFrame:
    """The columns of ``pages`` with ``text`` in place of ``html``.

    A null or empty html, or a page without content, has an empty text. Other
    columns, null ids included, stay; repeated pages are extracted each; an
    empty table gives an empty table.
    """

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in series:
            yield pages.map(main_text, na_action=None).astype(str)

    keep = [c for c in pages.columns if c not in ("html", "text")]
    return pages.select(*keep, F.pandas_udf(run, "string")(F.coalesce(pages["html"], F.lit(""))).alias("text"))


def op7_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return text.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
