"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass classifies every block by link density, length and
stop-word density: blocks full of links are not text, long enough blocks with the density of function words that prose
has are, and the rest stays open, above all short blocks. A block's region is one more input: what lies in menus, headers,
footers, sidebars, notices, adverts, forms or comments, or outside the page's article, is never text; inside an article
links alone do not decide (a paragraph may be one link). In the second pass an open block takes the label of its nearest
decided neighbour; between two unlike neighbours the nearer one counts, and at equal distance the good one. Kept blocks
are joined by line ends in page order.

Inside a block, white space becomes one space; one ``<br>`` counts as white space and two or more part blocks. Tags are
read as browsers do where it matters here: a ``<p>`` ends at the next block, raw text ends at its own end tag only, a
tag that the page's end cuts off is dropped.

Defined cases: a null or empty page has an empty text; a page without blocks too; repeated rows stay; other columns are
ignored; texts of any length are read whole, in time linear in their length.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textstats import STOP_WORDS

TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*"[^"]*+(?:"|\Z)|=\s*'[^']*+(?:'|\Z)|["'=])*+)(?:>|\Z)""", re.S
)
NAMED = re.compile(r"""(?<![\w-])(class|id|role|aria-label|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe textarea title template select option svg object canvas noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption head".split()
)
REGION = frozenset("nav footer aside form header dialog menu button label fieldset head".split())
MAIN = frozenset(("article", "main"))
#: Words of class and id names, roles included, that name what is not the article.
WORDS = re.compile(
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banners?|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscri\w+|signup|login|sidebar|side|aside|widgets?|menus?|nav\w*|breadcrumbs?|foot|footer|header|masthead|topbar|toolbar|comments?|commentlist|disqus|respond|repl(?:y|ies)|reactions?|shar(?:e|ing)|social|follow|related|recommend\w*|pagination|pager|search\w*|skip|contentinfo|complementary|navigation|dialog|copyright|legal|disclaimer|form|tags?|toc", re.I
)
#: Words with which a name only tells what else a frame holds (has-sidebar), and last words that name the frame itself
#: (sidebar-page). An article's own header holds its title.
FRAME, FRAMES, TITLES = frozenset("has no with without is single".split()), frozenset("page layout site template".split()), frozenset(("header", "masthead"))
MAIN_NAMES = re.compile(r"(?<![\w])(?:article|article-?body|post-?body|post-?content|entry-?content|entry|main-?content|story|story-?body)(?![\w])", re.I)

#: Characters below which a block is short; links from this share of its letters on; function words from this share of its words on.
SHORT, LINKS, STOPS = 70, 0.4, 0.2


def names_region(attributes: str) -> tuple[set[str], bool]:
    """(words that name something that is not the article, the attributes name the article)."""
    if not attributes.strip():
        return set(), False
    bad, main = set(), False
    for key, a, b, c in NAMED.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            bad.add("hidden")
        elif key in ("class", "id", "role"):
            for name in value.split():
                words = re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", name).replace("_", "-").lower().split("-")
                if words[-1] not in FRAMES and not FRAME.intersection(words):
                    bad.update(w for w in words if WORDS.fullmatch(w))
            main = main or bool(MAIN_NAMES.search(value)) or value.lower() == "main"
    return bad, main and not bad


class Page:
    """The blocks of a page: [text parts, characters in links, out of the article, in the article, heading]."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, float, bool, bool, bool]] = []
        self.stack: list[tuple[str, bool, bool]] = []  # tag, out, main
        self.parts: list[str] = []
        self.linked = self.links = self.breaks = 0
        self.heading = False
        at, n, end = 0, len(html), len(html)
        while at < n:
            m = TOKEN.search(html, at)
            if m is None:
                self.text(html[at:])
                break
            if m.start() > at:
                self.text(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            cut_off = at == end and html[-1] != ">"
            if cut_off:
                break
            if m[1]:
                self.close(tag)
            elif tag in RAW and not m[3].rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                at = (html.find(">", stop.start()) + 1 or n) if stop else n
                if tag in ("iframe", "object", "svg", "canvas"):
                    self.text(" ")
            else:
                self.open(tag, m[3])
        self.flush()

    def text(self, raw: str) -> None:
        if raw:
            if self.breaks and not raw.isspace():
                if self.breaks > 1:
                    self.flush()
                self.breaks = 0
            raw = unescape(raw) if "&" in raw else raw
            self.parts.append(raw)
            if self.links:
                self.linked += len("".join(raw.split()))

    def flush(self) -> None:
        words = "".join(self.parts).split()
        if words:
            _, out, main = self.stack[-1] if self.stack else ("", False, False)
            text = " ".join(words)
            self.blocks.append((text, self.linked / max(1, sum(map(len, words))), out, main, self.heading))
        self.parts, self.linked, self.breaks = [], 0, 0

    def open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            self.breaks += 1
            return
        if tag in BLOCK:
            self.flush()
            while self.stack and (self.stack[-1][0] == "p" or (tag in ("li", "dt", "dd", "td", "th", "tr", "option") and self.stack[-1][0] == tag) or (self.stack[-1][0] not in BLOCK and self.has("p"))):
                self.pop()
        if tag in VOID:
            return
        _, out, main = self.stack[-1] if self.stack else ("", False, False)
        words, named = names_region(attributes) if tag not in ("html", "body", "a") else (set(), False)
        bad = bool(words - TITLES if main else words)
        if tag in MAIN or (named and tag in ("div", "section", "td")):
            inside = main and tag == "article"
            out, main = (bad or (out and inside)), not bad
        elif bad or (tag in REGION and not (tag == "header" and main)):
            out = True
        self.stack.append((tag, out, main))
        if tag == "a":
            self.links += 1
        if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self.heading = True

    def has(self, tag: str) -> bool:
        """A ``tag`` is open within the nearest container."""
        for t, _, _ in reversed(self.stack):
            if t == tag:
                return True
            if t in BLOCK:
                return False
        return False

    def pop(self) -> None:
        tag = self.stack.pop()[0]
        if tag == "a":
            self.links = max(0, self.links - 1)
        if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self.heading = False

    def close(self, tag: str) -> None:
        if tag == "br":
            return self.open("br", "")
        if tag in BLOCK:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            t = self.stack[i][0]
            if t == tag:
                while len(self.stack) > i:
                    self.pop()
                return None
            if tag not in BLOCK and t in BLOCK:
                break  # an inline end tag closes nothing beyond its block
            if tag == "p" and t in BLOCK:
                break
        return None


def stop_density(text: str) -> float:
    words = text.lower().encode().split()
    return sum(w.strip(b".,;:!?") in STOP_WORDS for w in words) / max(1, len(words))


def first_pass(blocks: list) -> list[bool | None]:
    """True: text; False: not text; None: open."""
    article = any(main and not out for _, _, out, main, _ in blocks)
    labels: list[bool | None] = []
    for text, links, out, main, _ in blocks:
        if out or (article and not main):
            labels.append(False)
        elif links > LINKS:
            labels.append(None if article else False)
        elif text.startswith(("©", "(c)", "Copyright")) and not article:
            labels.append(False)
        elif len(text) >= SHORT and stop_density(text) >= STOPS:
            labels.append(True)
        else:
            labels.append(None)
    return labels


def second_pass(labels: list[bool | None], blocks: list) -> list[bool]:
    """Open blocks take their nearest decided neighbour's label. What a region has decided says nothing of its neighbours;
    without any decided neighbour an open block is text."""
    article = any(main and not out for _, _, out, main, _ in blocks)
    votes = [x is not None and not out and (main or not article) for x, (_, _, out, main, _) in zip(labels, blocks)]
    before, marks = None, []
    for i, vote in enumerate(votes):
        before = i if vote else before
        marks.append(before)
    after, final = None, list(labels)
    for i in range(len(labels) - 1, -1, -1):
        after = i if votes[i] else after
        if labels[i] is None:
            near = [(abs(i - j), not labels[j]) for j in (marks[i], after) if j is not None]
            final[i] = not min(near)[1] if near else True
    return final


def classify(blocks: list) -> list[bool]:
    """True for each block of the main text."""
    final = second_pass(first_pass(blocks), blocks)
    if any(final):
        return final
    return [not out and links <= LINKS for _, links, out, _, _ in blocks]  # a page without prose: what is no link and in no region


def main_text(html: str | None) -> str:
    blocks = Page(html or "").blocks
    return "\n".join(b[0] for b, keep in zip(blocks, classify(blocks)) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``pages``, without a shuffle."""

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
