"""Main text of HTML pages by smoothed text-to-tag ratios (operator 1).

The standard library's streaming parser turns a page into lines: the runs of
text between block-level tags, each with the number of tags seen since the
line before.  Lines inside elements that never hold the article (navigation,
headers and footers of the page, sidebars, forms, scripts, notices, adverts,
reader comments) have no weight.  Each other line gets its text-to-tag ratio;
the ratios are smoothed with a Gaussian and lines above a threshold between
the two clusters of the smoothed ratios (two-means on one dimension) form the
content regions.  The regions choose the element that holds the article (by the
text they put into it), and all weighted lines of that element are the main
text, short paragraphs between long ones included.

Defined results: null, empty and text-free pages give an empty text; repeated
rows one row each; an empty table an empty result; extra columns are ignored.
Unclosed and truncated markup is read as far as it goes, a marked section with an
unknown keyword is a comment; time grows with the length of a page however deep
it is.  Of equal holders the deepest counts, then the one with more region text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame

from vigil.llm.common import map_texts

SIGMA = 1.5           # lines: width of the Gaussian

# Element names by their role in a page.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "caption", "dd", "details", "dialog", "div", "dl",
         "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
         "header", "hr", "html", "li", "main", "nav", "ol", "option", "p", "pre", "section", "summary", "table",
         "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"}
NEVER = {"head", "title", "script", "style", "noscript", "template", "nav", "footer", "aside", "form", "iframe",
         "button", "select", "textarea", "object", "svg", "canvas", "dialog", "menu", "label", "input", "video", "audio"}
HOLDERS = {"article", "main", "section", "div", "body", "td"}
# Elements whose start closes an open one of the same kind inside the same parent.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Words of a class, id or role that mark parts beside the article.
NOISE = re.compile(
    r"(?:^|[^a-z])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo(?:tion)?|banner|nav(?:bar|igation)?|menu|"
    r"breadcrumbs?|side-?bar|footer|masthead|site-?header|page-?header|cookies?|consent|notice|alert|popup|modal|"
    r"newsletter|subscribe|signup|login|share|sharing|social|related|recommended|comments?|replies|disqus|toolbar|"
    r"widget|pagination|pager|skip-?link|copyright|legal|contentinfo|complementary|search|teaser)(?:$|[^a-z])")


class Lines(HTMLParser):
    """Collects lines: (text, tags, weighted, innermost open holder).  Holders are
    (name, place of the holder around it, or -1) in the order they open, so a line costs no more on a deep page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool, int]] = []
        self.holders: list[tuple[str, int]] = []
        self.open: list[tuple[str, bool, int]] = []     # name, noise, innermost holder outside it
        self.count: Counter = Counter()                 # open elements by name
        self.holder = -1
        self.text: list[str] = []
        self.beside = False                             # the line has text outside the article
        self.tags = 0
        self.noise = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text or self.beside:
            self.lines.append((text, self.tags, bool(text), self.holder))
            self.tags = 0
        self.text, self.beside = [], False

    def parse_marked_section(self, i, report=1):
        """``<![`` with an unknown keyword is a comment, as browsers read it."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK or tag in NEVER:
            self.end_line()
        self.tags += 1
        if tag in VOID:
            return
        if tag in CLOSES:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] in CLOSES[tag]:
                    self.close(i)
                    break
                if self.open[i][0] in HOLDERS or self.open[i][0] in ("ul", "ol", "dl", "table"):
                    break
        self.open.append((tag, self.is_noise(tag, attrs), self.holder))
        self.count[tag] += 1
        self.noise += self.open[-1][1]
        if tag in HOLDERS:
            self.holders.append((tag, self.holder))
            self.holder = len(self.holders) - 1

    def is_noise(self, tag, attrs) -> bool:
        if tag in NEVER:
            return True
        if tag == "header":
            return not self.count["article"] and not self.count["main"]
        if not attrs or tag in ("html", "body", "article", "main") or tag in ("h1", "h2", "h3"):
            return False
        for key, value in attrs:
            if key in ("hidden",) or key == "aria-hidden" and value == "true":
                return True
            if key == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
            if key in ("class", "id", "role") and value and NOISE.search(
                    re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().replace("_", "-")):
                return True
        return False

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)       # HTML knows no self-closing elements but the void ones

    def close(self, i: int) -> None:
        """Close the open elements from number ``i`` up."""
        for name, noise, _ in self.open[i:]:
            self.noise -= noise
            self.count[name] -= 1
        self.holder = self.open[i][2]
        del self.open[i:]

    def handle_endtag(self, tag):
        if tag in BLOCK or tag in NEVER:
            self.end_line()
        self.tags += 1
        if self.count[tag]:
            i = len(self.open) - 1
            while self.open[i][0] != tag:
                i -= 1
            self.close(i)

    def handle_data(self, data):
        if not self.noise:
            self.text.append(data)
        elif not self.beside and not data.isspace():
            self.beside = True


def _smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    r = max(1, math.ceil(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    num = np.convolve(x, k, "full")[r:r + len(x)]
    den = np.convolve(np.ones(len(x)), k, "full")[r:r + len(x)]
    return num / den


def _threshold(x: np.ndarray) -> float:
    """The border of two clusters of ``x`` (two-means from its extremes)."""
    low, high = float(x.min()), float(x.max())
    for _ in range(50):
        cut = (low + high) / 2
        a, b = x[x <= cut], x[x > cut]
        if not len(a) or not len(b):
            break
        new = float(a.mean()), float(b.mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def content_lines(lines: list, holders: list, sigma: float = SIGMA) -> list[int]:
    """Indices of the lines of the main text."""
    weighted = [i for i, x in enumerate(lines) if x[2]]
    if not weighted:
        return []
    ratio = np.array([len(x[0]) / max(1, x[1]) if x[2] else 0.0 for x in lines])
    smooth = _smooth(ratio, sigma)
    cut = _threshold(smooth)
    region = [i for i in weighted if smooth[i] > cut or smooth[i] == smooth.max()] or weighted
    # the element of the article: an article or main holding most region text,
    # else the deepest holder that has most of it
    total = sum(len(lines[i][0]) for i in region)
    votes, depth = [0] * len(holders), [0] * len(holders)
    for i in region:
        if lines[i][3] >= 0:
            votes[lines[i][3]] += len(lines[i][0])
    for k in range(len(holders) - 1, -1, -1):              # a holder opens after the one around it
        if holders[k][1] >= 0:
            votes[holders[k][1]] += votes[k]
    for k, (_, outer) in enumerate(holders):
        depth[k] = depth[outer] + 1 if outer >= 0 else 0
    named = [k for k, (name, _) in enumerate(holders) if name in ("article", "main") and votes[k] and votes[k] >= total / 2]
    deep = [k for k in range(len(holders)) if votes[k] and votes[k] >= 0.6 * total]
    if named:
        chosen = max(named, key=lambda k: (holders[k][0] == "article", depth[k], -k))
    elif deep:
        chosen = max(deep, key=lambda k: (depth[k], votes[k], holders[k][0], k))
    else:
        return region
    inside = [False] * len(holders)
    for k in range(chosen, len(holders)):
        inside[k] = k == chosen or holders[k][1] >= 0 and inside[holders[k][1]]
    return [i for i in weighted if lines[i][3] >= 0 and inside[lines[i][3]]]


def main_text(html: str | None) -> tuple[str, int, int]:
    """(main text, its lines, all lines) of one page."""
    if not html:
        return "", 0, 0
    parser = Lines()
    parser.feed(html)
    HTMLParser.close(parser)
    parser.end_line()
    keep = content_lines(parser.lines, parser.holders)
    return " ".join(parser.lines[i][0] for i in keep), len(keep), len(parser.lines)


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, text, n_chars, n_lines, n_all_lines) for every page."""
    def run(texts):
        found = [main_text(h) for h in texts]
        return [[x[0] for x in found], [len(x[0]) for x in found], [x[1] for x in found], [x[2] for x in found]]

    return map_texts(pages, [id_col, url], html, run,
                     {"text": "string", "n_chars": "long", "n_lines": "long", "n_all_lines": "long"})
