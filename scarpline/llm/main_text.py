"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each under a path of tags from the root. Per path:

* text ratio: characters of its blocks by their number; punctuation ratio likewise,
* both are smoothed along the page, so that a short line between long ones stays,
* fused into one score, and blocks above a threshold, by the scores' own spread, are content.

The content node is the deepest element that holds most of the fused score, or the article
around it; all its blocks are the text, so headings and short lines are not lost. Paths that
are never content (menus, headers of the page, footers, sidebars, notices, adverts, forms,
scripts, styles, comments), told by tag or by the name of a class or id, take no part. A form
that holds most of the page's score is no form to fill in but a wrapper round the page, as is
one round an article; it takes part.

Defined results: a null or empty page, or one without text, gives an empty text. Character
references are decoded, white space in a block becomes one space, blocks are joined by one
line end. Unclosed and misnested tags are closed where the next block needs it. Long pages are
read whole; repeated rows and other columns pass through; a column named like the output is
replaced.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without content, of raw text, and that break a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object select noembed noframes xmp".split())
BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr caption ul".split()
)
#: What a start tag closes, up to the element that bounds it.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
#: Elements that are no content, and names of classes and ids that say so.
APART = frozenset("head nav footer aside form button menu dialog search".split())
NAMED = re.compile(
    r"(?:^|(?<!with)(?<!has)(?<!no)[-_])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w+|"
    r"sidebar|widgets?|related|recommend\w*|menu|nav|navbar|navigation|breadcrumbs?|masthead|header|footer|comments?|replies|respond|disqus|"
    r"share|sharing|social|login|signup|search|pagination|pager)(?:$|[-_]?(?:box|bar|list|area|section|wrap|wrapper|container|block|unit|item|form|slot|links?|\d+)$)",
    re.I,
)
CONTENT = frozenset("article main".split())
HOLDERS = frozenset("article main section div td body html".split())
TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=\s|/|$)""", re.I)
MARKS = re.compile(r"[.,;:!?…¿¡。，、！？；：]")


class Page:
    """Elements as parallel lists, and blocks as lists of (element, text)."""

    def __init__(self, html: str):
        self.tag, self.parent, self.path, self.apart, self.named, self.form = ["#"], [-1], [0], [False], [False], [False]
        self.paths = {(-1, "#"): 0}
        self.blocks: list[list[tuple[int, str]]] = []
        self.open = [0]
        self.parts: list[tuple[int, str]] = []
        self.parse(html)

    def push(self, tag: str, attributes: str) -> None:
        parent, apart, named, label = self.open[-1], False, False, tag
        if attributes:
            for name, *values in NAMES.findall(attributes):
                value = next(filter(None, values), "")
                if name.lower() == "hidden":
                    apart = True
                elif name.lower() == "role":
                    apart |= value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert")
                else:
                    label += "." + value.lower()
                    named |= any(NAMED.search(v) for v in value.split())
        named &= tag not in HOLDERS - {"section", "div", "td"} and not re.fullmatch("h[1-6]", tag)
        self.form.append(tag == "form" and not apart)  # apart for being a form alone
        apart |= tag in APART or tag == "header" and not any(self.tag[e] in CONTENT for e in self.open)
        self.open.append(len(self.tag))
        self.tag.append(tag)
        self.parent.append(parent)
        self.path.append(self.paths.setdefault((self.path[parent], label), len(self.paths)))
        self.apart.append(apart)
        self.named.append(named)

    def flush(self) -> None:
        if self.parts:
            self.blocks.append(self.parts)
            self.parts = []

    def close(self, tags: frozenset, bound: frozenset) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[i]]
            if tag in tags:
                del self.open[i:]
                return
            if tag in bound:
                return

    def text(self, raw: str) -> None:
        if raw:
            self.parts.append((self.open[-1], unescape(raw) if "&" in raw else raw))

    def parse(self, html: str) -> None:
        at, n, scan = 0, len(html), TOKEN.search
        ends = frozenset(("table", "td", "th", "button", "body"))
        while at < n:
            found = scan(html, at)
            if not found:
                self.text(html[at:])
                break
            self.text(html[at : found.start()])
            at = found.end()
            closing, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
            if not tag:
                continue
            tag = tag.lower()
            if tag == "br":
                self.text(" ")
                continue
            if tag in BLOCK:
                self.flush()
            if closing:
                self.close(frozenset((tag,)), frozenset() if tag in BLOCK else BLOCK)
                continue
            if tag in RAW:
                if not attributes.endswith("/") or tag not in ("svg", "math"):
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                    at = end.end() if end else n
                continue
            if tag in VOID:
                continue
            if tag in BLOCK:
                self.close(frozenset(("p",)), ends)
            if tag in CLOSES:
                self.close(*CLOSES[tag])
            self.push(tag, attributes)
        self.flush()

    def lines(self, by_name: bool, forms: bool = False) -> list[tuple[int, str]]:
        """Blocks (element, text) outside of what is no content; names count only if asked, and not
        on an element around an article. `forms` lets the text of forms in."""
        around = [False] * len(self.tag)
        for e, tag in enumerate(self.tag):
            if tag in CONTENT:
                while e >= 0 and not around[e]:
                    around[e] = True
                    e = self.parent[e]
        out = [False] * len(self.tag)
        for e in range(1, len(self.tag)):
            apart = self.apart[e] and not (self.form[e] and (forms or around[e]))
            out[e] = out[self.parent[e]] or apart or by_name and self.named[e] and not around[e]
        found = []
        for parts in self.blocks:
            kept = [(e, t) for e, t in parts if not out[e]]
            line = " ".join("".join(t for _, t in kept).split())
            if line:
                holder = next(e for e, t in kept if t.strip())
                while self.tag[holder] not in BLOCK and holder > 0:
                    holder = self.parent[holder]
                found.append((holder, line))
        return found


def fused(page: Page, lines: list[tuple[int, str]]) -> np.ndarray:
    """The score of each line: its path's text and punctuation ratios, smoothed and fused."""
    path = np.unique([page.path[e] for e, _ in lines], return_inverse=True)[1]
    size = np.array([len(t) for _, t in lines], float)
    marks = np.array([len(MARKS.findall(t)) for _, t in lines], float)
    n = np.bincount(path)
    ratios = []
    for values in (size, marks):
        along = np.pad((np.bincount(path, values) / n)[path], 1, mode="edge")
        ratios.append(0.25 * along[:-2] + 0.5 * along[1:-1] + 0.25 * along[2:])
    return np.sqrt(ratios[0] * (1 + ratios[1]))


def score_held(page: Page, lines: list[tuple[int, str]], spread: float) -> np.ndarray:
    """The score of the lines above the threshold, for each element those of all it holds."""
    score = fused(page, lines)
    score = np.where(score >= min(spread * score.std(), score.max()), score, 0)
    held = np.zeros(len(page.tag))
    for (e, _), s in zip(lines, score, strict=True):
        held[e] += s
    for e in range(len(page.tag) - 1, 0, -1):  # children come after their parents
        held[page.parent[e]] += held[e]
    return held


def main_text(html: str | None, spread: float = 1.0, most: float = 0.8) -> str:
    if not html:
        return ""
    page = Page(html)
    if any(page.form) and (lines := page.lines(True, True) or page.lines(False, True)):
        held = score_held(page, lines, spread)
        for e in np.flatnonzero(page.form):
            if held[e] > held[0] / 2:
                page.apart[e] = False
    lines = page.lines(True) or page.lines(False)
    if not lines:
        return ""
    held = score_held(page, lines, spread)
    node = max(e for e in range(len(held)) if held[e] >= most * held[0])
    node = around = node if page.tag[node] in HOLDERS else next((e for e in _up(page, node) if page.tag[e] in HOLDERS), 0)
    node = next((e for e in [around, *_up(page, around)] if page.tag[e] in CONTENT), around)
    inside = [False] * len(page.tag)
    for e in range(len(page.tag)):
        inside[e] = e == node or e > 0 and inside[page.parent[e]]
    return "\n".join(t for e, t in lines if inside[e])


def _up(page: Page, e: int):
    while e > 0:
        e = page.parent[e]
        yield e


def with_main_text(df: DataFrame, html: str = "html", out: str = "text", spread: float = 1.0, most: float = 0.8) -> DataFrame:
    """Add the main text of each page. `spread` is the threshold in standard deviations of the page's
    scores, `most` the share of the score that the content node holds at least."""

    @F.arrow_udf("string")
    def texts(pages: pa.Array) -> pa.Array:
        return pa.array((main_text(x.as_py(), spread, most) for x in pages), pa.string())

    return df.withColumn(out, texts(F.col(html)))
