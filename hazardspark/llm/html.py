"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of the page. A line weighs its characters, and their sums over a sliding window of lines show where text is
dense: a stretch of lines between two dives, where the sum is low, is text if the sum surges above a threshold in it, and its lines are kept in page order.
Characters in links weigh nothing, so lists of links make dives. What markup says is a factor of the weights: lines of menus, footers, adverts, comments and such containers weigh
a fiftieth, and their sums are taken apart from the others'; where articles hold much of a page's characters, lines outside them weigh less in proportion, and lines in
them more. So a long text is found wherever it stands, and an article of links is none.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardspark.llm.common import map_texts, packed, text_bytes, unpacked

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|title|select|button)\b[^>]*+(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attr>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[a-zA-Z/!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)

#: Elements that begin and end lines.
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Blocks that may lie open without an end tag, and so hold no others.
_LOOSE = frozenset("p li dt dd tr td th tbody thead tfoot option hr body html".split())
#: Elements, and words of class, id or role, of what is no part of an article.
_ASIDE = frozenset("nav footer aside form menu dialog head".split())
_ASIDE_WORDS = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies contentinfo disclaimer footer masthead menu menubar nav navbar navigation newsletter notice notices notification pagination popup promo promoted related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: Of these only outside articles.
_TOP_WORDS = frozenset("header banner".split())
#: Of these on an article element itself: a teaser, an advert or a reader's comment.
_NOT_ARTICLE = frozenset("ad ads advert advertisement comment comments promo promoted related sponsored teaser".split())
#: Words that make a class say what a container holds or lacks, not what it is.
_HOLDS = frozenset("has with without no hide".split())


def _names(attributes: str) -> set[str]:
    """Words of class, id and role."""
    out = set()
    for m in _CLASS.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").lower().split():
            words = re.split(r"[^a-z0-9]+", token)
            if words[0] not in _HOLDS:
                out.update(words)
    return out


class _Page:
    def __init__(self) -> None:
        self.lines: list[tuple[str, int, bool, bool]] = []  # text, characters outside links, in an article, aside
        self.parts: list[str] = []
        self.plain = 0
        self.stack: list[tuple[str, bool, bool]] = []
        self.open: Counter = Counter()  # names on the stack
        self.articles = self.asides = self.links = 0

    def text(self, raw: str) -> None:
        if "&" in raw:
            raw = unescape(raw)
        self.parts.append(raw)
        if not self.links:
            self.plain += len(raw) - raw.count(" ")

    def line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, self.plain, self.articles > 0, self.asides > 0))
            self.parts, self.plain = [], 0
        self.links = 0

    def begin(self, name: str, attributes: str) -> None:
        article = name in ("article", "main")
        aside = name in _ASIDE or (name == "header" and not self.articles)
        if attributes and name not in ("body", "html"):
            words = _names(attributes)
            if article:
                aside = name == "article" and not words.isdisjoint(_NOT_ARTICLE)
            else:
                aside = aside or not words.isdisjoint(_ASIDE_WORDS) or (not self.articles and not words.isdisjoint(_TOP_WORDS))
            aside = aside or bool(_HIDDEN.search(attributes))
        if self.stack and self.stack[-1][0] in _LOOSE and name in _LOOSE:
            self._pop()  # a new loose block ends the last
        if name not in _LOOSE or aside:
            self.stack.append((name, article, aside))
            self.open[name] += 1
            self.articles += article
            self.asides += aside

    def _pop(self) -> str:
        name, article, aside = self.stack.pop()
        self.open[name] -= 1
        self.articles -= article
        self.asides -= aside
        return name

    def finish(self, name: str) -> None:
        if name in _LOOSE and not (self.stack and self.stack[-1][0] == name):
            return
        if self.open[name]:
            while self._pop() != name:
                pass


def page_lines(html: str) -> list[tuple[str, int, bool, bool]]:
    page, at = _Page(), 0
    for m in _MARKUP.finditer(html):
        if m.start() > at:
            page.text(html[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if name in _BLOCKS:
            page.line()
            page.finish(name) if m["end"] else page.begin(name, m["attr"])
        elif name == "br":
            page.parts.append("\n")
        elif name == "a":
            page.links = max(0, page.links - 1) if m["end"] else 1
    page.text(html[at:])
    page.line()
    return page.lines


#: Weight of a character in containers that are no part of an article, and least weight of one outside the articles.
FAINT = 0.02
#: How much more a character weighs in the articles of a page that hold at least half of its characters.
DENSE = 0.5


def line_weights(lines: list[tuple[str, int, bool, bool]]) -> list[float]:
    """What each line adds to the sums of its windows.

    With share the part of the characters outside links that are in articles, pull is twice that, one at most. A line in an article weighs its characters outside links, and its others in
    proportion to pull, each 1 + DENSE * pull; a line outside the articles 1 - pull (FAINT at least) a character outside links; an aside line FAINT a character.
    """
    inside = sum(plain for _, plain, article, aside in lines if article and not aside)
    total = sum(plain for _, plain, _, aside in lines if not aside)
    pull = min(1.0, 2 * inside / total) if total else 0.0
    out = []
    for text, plain, article, aside in lines:
        if aside:
            out.append(FAINT * plain)
        elif article:
            out.append((plain + pull * (len(text) - plain)) * (1 + DENSE * pull))
        else:
            out.append(plain * max(FAINT, 1 - pull))
    return out


def dense_lines(weights: list[float], window: int, surge: float, dive: float) -> list[int]:
    """Numbers of the lines with weight in the stretches whose sums are all above dive and somewhere above surge.

    A sum is of the window's lines around a line.
    """
    before = window // 2
    ends = [0.0, *accumulate(weights)]
    n = len(weights)
    sums = [ends[min(n, i - before + window)] - ends[max(0, i - before)] for i in range(n)]
    out, i = [], 0
    while i < n:
        first = i
        while i < n and sums[i] > dive:
            i += 1
        if i > first and max(sums[first:i]) > surge:
            out += [k for k in range(first, i) if weights[k] > 0]
        i += 1
    return out


def main_text(html: str, window: int = 3, surge: float = 86, dive: float = 2, short: float = 172) -> str:
    """Kept lines of the page joined by a line feed; empty if there are none.

    Sums run over the lines in articles, the lines outside and the aside lines each by themselves, so that an advert in an article neither parts it nor is carried by it. On a page whose
    lines weigh no more than short together, nothing surges, and its heaviest kind of lines is text whole.
    """
    lines = page_lines(html)
    weights = line_weights(lines)
    kinds = [[i for i, (_, _, article, aside) in enumerate(lines) if (2 if aside else int(article)) == kind] for kind in range(3)]
    if sum(weights) <= short:
        heaviest = max(kinds[:2], key=lambda of: sum(weights[i] for i in of))
        kept = [i for i in heaviest if weights[i] > 0 and surge < short]
    else:
        kept = sorted(of[k] for of in kinds for k in dense_lines([weights[i] for i in of], window, surge, dive))
    return "\n".join(lines[i][0] for i in kept)


def extract(pages: DataFrame, html: str = "html", window: int = 3, surge: float = 86, dive: float = 2, short: float = 172) -> DataFrame:
    """pages without html, with text and n_chars (code points).

    Null or empty html, and pages without text, give an empty text; every row gives one row, repeated rows alike; pages are read whole,
    however long or deep, in time that grows with their length; an empty table gives an empty table; other columns stay, but for ones named text or n_chars, which are replaced.
    """

    def make():
        return lambda raw: (main_text(raw.decode("utf-8", "replace"), window, surge, dive, short),)

    own = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    rows = map_texts(pages.select(packed(own).alias("own"), text_bytes(f"`{html}`").alias("__text")), T.StructType([T.StructField("text", T.StringType())]), make)
    return rows.select(*unpacked(own), "text", F.length("text").cast("long").alias("n_chars"))
