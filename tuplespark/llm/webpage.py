"""HTML extraction (operator 10): tag-path ratios.

A page is parsed into text blocks, each with the path of block-level tags (and
classes) from the root. Per path the operator aggregates the number of blocks,
text length, punctuation and linked characters; a block's path score fuses
text per block with punctuation per block and is damped by the linked share.
Scores are smoothed over the blocks in page order and paths whose smoothed
mean reaches the page's threshold are high. The threshold is a share of the
length-weighted mean, so it follows the page. The content root is the common
ancestor of the blocks on high paths, raised to the outermost ``article`` or
``main`` around it. Everything in the root is kept, short blocks and
headings too, and so are the page's last h1 before the root and what stands
between the two; only paths that are nothing but links go (link lists).

Menus, headers and footers of the page, sidebars, notices, adverts, forms,
scripts, styles and reader comments are cut by tag or role, and containers by
a whole class name or id.
White space inside a block becomes one space, blocks are trimmed and joined by
one newline; character references are decoded.

Null or empty html: empty text. Broken markup (unclosed or misnested tags,
pages that end early) is read like a browser would: an open element ends with
its parent. Rows are judged one by one, so repeated rows and null ids stay;
extra columns are dropped. The whole page is read and nothing is capped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuplespark.llm.common import ship_package

# Tag classes of HTML and the wording of page furniture.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
             "strong sub sup time tt u var br wbr img".split())
SKIP = set("script style noscript template head title nav footer aside form button select option textarea iframe object "
           "svg canvas menu dialog audio video input".split())
SKIP_ROLE = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
FURNITURE = re.compile(
    r"^(ad|ads|adv|advert\w*|adbox|adsense|banner|cookie\w*|consent|gdpr|notice|notices|popup|modal|overlay|promo\w*|sponsor\w*|"
    r"sidebar|side|menu|menus|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|comments?|commentlist|disqus|reply|"
    r"replies|respond|share|sharing|social|related|recommended|widget|newsletter|subscribe|subscription|login|signup|search|"
    r"toolbar|pagination|pager|hidden|(site|page|main|top|bottom|left|right|global|primary|secondary)[-_]?(nav|navbar|navigation|"
    r"menu|header|footer|sidebar|banner)|(cookie|consent|gdpr|newsletter|social|share|sharing|related|ad|comments?)[-_]"
    r"(banner|bar|box|notice|popup|modal|form|links?|buttons?|posts?|list|section|area|container|slot|wrapper|unit))$")
CONTAINERS = set("div section ul ol dl table tr td th header footer nav aside figure details fieldset center".split())
CLOSES_P = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p "
               "pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}}
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")


class _Blocks(HTMLParser):
    """Collects ``[path, text parts, linked characters, elements, tag]`` per
    block; elements are the ids of the open ones and whether each is marked as
    main content, from the root down."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str, bool]] = []  # tag, step of the path, furniture
        self.blocks: list[list] = []
        self.open: list | None = None
        self.serial = 0
        self.roots: list[tuple[int, bool]] = []

    def _end(self):
        self.open = None

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close({"p"}, CLOSES_P - {"p"} | {"button", "td", "th", "li"})
        if tag in SIBLINGS:
            self._close(SIBLINGS[tag], {"ul", "ol", "dl", "table", "select"})
        if tag == "br" or tag in VOID and tag not in INLINE:
            if tag == "br" and self.open is not None:
                self.open[1].append(" ")
            elif tag == "hr":
                self._end()
            return
        if tag in VOID:
            return
        at = dict(attrs)
        names = f"{at.get('class') or ''} {at.get('id') or ''}".lower().split()
        inner = any(t in ("article", "main") for t, _, _ in self.stack)
        cut = (tag in SKIP or tag == "header" and not inner or (at.get("role") or "").lower() in SKIP_ROLE
               or "hidden" in at or tag in CONTAINERS and any(map(FURNITURE.match, names)))
        if tag not in INLINE:
            self._end()
        self.serial += 1
        step = tag if not at.get("class") else tag + "." + ".".join(sorted((at["class"] or "").split()))
        main = tag in ("article", "main") or (at.get("role") or "").lower() in ("main", "article")
        self.stack.append((tag, step, cut))
        self.roots.append((self.serial, main))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _pop(self, k: int):
        if any(t not in INLINE for t, _, _ in self.stack[k:]):
            self._end()
        del self.stack[k:], self.roots[k:]

    def _close(self, tags: set[str], until: set[str]):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in tags:
                return self._pop(k)
            if self.stack[k][0] in until:
                return

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                return self._pop(k)
            if tag in INLINE and self.stack[k][0] not in INLINE:
                return

    def handle_data(self, data):
        if any(cut for _, _, cut in self.stack):
            return
        if self.open is None:
            if not data.strip():
                return
            path = tuple(step for t, step, _ in self.stack if t not in INLINE)
            tag = next((t for t, _, _ in reversed(self.stack) if t not in INLINE), "")
            self.open = [path, [], 0, tuple(r for r, (t, _, _) in zip(self.roots, self.stack) if t not in INLINE), tag]
            self.blocks.append(self.open)
        self.open[1].append(data)
        if any(t == "a" for t, _, _ in self.stack):
            self.open[2] += len(data.strip())


def _smooth(x: list[float]) -> list[float]:
    """Weighted mean with both neighbours (1, 2, 1)."""
    n = len(x)
    return [(x[max(i - 1, 0)] + 2 * x[i] + x[min(i + 1, n - 1)]) / 4 for i in range(n)]


def tag_path_content(blocks: list[tuple], share: float = 0.1) -> list[bool]:
    """Which blocks are content. ``blocks``: (path, text, linked chars, elements, tag)."""
    if not blocks:
        return []
    stat: dict[tuple, list[float]] = {}
    for path, text, linked, _, _ in blocks:
        s = stat.setdefault(path, [0, 0, 0, 0])
        s[0] += 1
        s[1] += len(text)
        s[2] += len(PUNCTUATION.findall(text))
        s[3] += linked
    score = {p: (c / n) * (1 + m / n) ** 0.5 * max(0.0, 1 - a / max(c, 1)) for p, (n, c, m, a) in stat.items()}
    flat = _smooth([score[b[0]] for b in blocks])
    mean: dict[tuple, list[float]] = {}
    for b, s in zip(blocks, flat):
        m = mean.setdefault(b[0], [0.0, 0])
        m[0] += s
        m[1] += 1
    fused = {p: (m[0] / m[1] * score[p]) ** 0.5 for p, m in mean.items()}
    total = sum(len(b[1]) for b in blocks)
    threshold = share * sum(fused[b[0]] * len(b[1]) for b in blocks) / max(total, 1)
    # A paragraph or the like is no root itself.
    high = [b[3] if b[4] in CONTAINERS or b[3] and b[3][-1][1] else b[3][:-1]
            for b in blocks if fused[b[0]] >= threshold and fused[b[0]] > 0]
    if not high:
        return [False] * len(blocks)
    depth = next((k for k, level in enumerate(zip(*high)) if len(set(level)) > 1), min(map(len, high)))
    root = high[0][:depth]
    outer = next((k + 1 for k, (_, main) in enumerate(root) if main), depth)
    root = root[:outer]
    content = [b[3][:len(root)] == root for b in blocks]
    start = content.index(True)
    if not any(b[4] == "h1" for b, c in zip(blocks, content) if c):
        title = max((i for i in range(start) if blocks[i][4] == "h1"), default=start)
        content[title:start] = [True] * (start - title)
    return [c and score[b[0]] > 0 for b, c in zip(blocks, content)]


def main_text(html: str | None) -> str:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    blocks = [(p, t, a, r, tag) for p, t, a, r, tag in ((p, " ".join("".join(x).split()), a, r, tag) for p, x, a, r, tag in parser.blocks) if t]
    return "\n".join(b[1] for b, keep in zip(blocks, tag_path_content(blocks)) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """The id, the columns of ``keep``, ``text`` and ``n_chars`` for every row."""
    ship_package(pages.sparkSession)
    cols = [id_col, *keep]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part[["page"]].assign(text=[main_text(h) for h in part["html"]])

    # The columns travel in a struct: pandas would turn ids with nulls into floats.
    src = pages.select(F.struct(*cols).alias("page"), F.col(html_col).alias("html"))
    out = src.mapInPandas(run, T.StructType([src.schema["page"], T.StructField("text", T.StringType())]))
    return out.select("page.*", "text", F.length("text").cast("long").alias("n_chars"))
