"""Main text of web pages by tag-path ratios.

A page becomes a list of text runs. Each run's root-to-leaf tag path (inline tags count as part of the block they are
in) gets the length and the punctuation of its text outside links. Both ratios (per block of the path) are smoothed
over neighbouring paths in page order by a Gaussian, fused by multiplication with a weight of the path's place, and
thresholded by their standard deviation: the paths that pass are content. The content node is the smallest box that
has most of the content paths' text, widened until it has all text of the paths found in it, headings that pass, and
text that lies directly in the box around it; a list, table, section or paragraph alone is never one. Where most of
the text that passes is in article or main elements, those that have some of it are the content nodes. All blocks
inside are text, whatever their own ratio.

What the page says about an element only weighs its path: inside article or main a path counts four times; in an
element whose class or id consists of words for adverts, notices, sidebars, menus, headers, footers, forms or reader
comments it counts a fiftieth, and such an element inside the content node stays only if its path passes all the same
on a page without article or main. Elements that are such a part by their tag or role, or are hidden, have no path.

Rows: null or empty html gives the empty text; broken markup is read as a browser does as far as tags can be told;
unclosed elements end with their parent; null ids, null urls and repeated rows stay as they are, columns of other
names are not looked at. Nesting and length have no bound; time and memory grow in proportion to the html.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe import texts_of

_VALUE = r"""(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s"'>][^\s>]*)"""
_ATTRIBUTE = re.compile(rf"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+({_VALUE})?)?")
_MARKUP = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE}?)?)*+)(?:>|\Z)""",
    re.S,
)
_PUNCTUATION = re.compile(r"[.,;:!?¡¿…。，、！？]")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea title svg object canvas audio video select noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3".split())
ARTICLES = frozenset(("article", "main"))
#: Boxes of a page's layout, which can be the content node: no lists, tables, sections or parts of a text.
BOXES = frozenset("article body center div html main td".split())
LAYOUT = ("article", "body", "center", "div", "html", "main")
#: Parts that the result leaves out, by tag and by role.
PARTS = frozenset("nav header footer aside form menu dialog button head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words for these parts, and words that say nothing beside them. Only a class or id of such words alone is one.
PART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion adbox adsense"
    " menu topmenu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer sidebar aside"
    " comment comments commentlist reply replies respond discussion disqus cookie cookies consent gdpr notice notices notification alert"
    " popup modal overlay newsletter subscribe subscription signup login register search form share sharing social related recommended toolbar pagination pager".split()
)
PLAIN_WORDS = frozenset("a area bar block box button buttons col column container content group inner item items left link links list main outer page panel post posts right section site slot the top bottom unit widget wrap wrapper".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
IN_ARTICLE, IN_PART, MOST = 4.0, 0.02, 0.75
_LIKE = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "thead": ("tbody", "tfoot"), "tbody": ("thead", "tfoot"), "tfoot": ("thead", "tbody"),
}
_SCOPE = {
    "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "thead", "tbody", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"),
    "thead": ("table",), "tbody": ("table",), "tfoot": ("table",),
}


def part_word(value: str) -> bool:
    """Is one of a class's or id's names made of words for parts that are left out?"""
    for name in value.split():
        words = [w.lower() for w in _WORDS.findall(name) if not w.isdigit()]
        if words and any(w in PART_WORDS for w in words) and all(w in PART_WORDS or w in PLAIN_WORDS for w in words):
            return True
    return False


class Node:
    """An element; `last` is the number of the last element inside it, `path` the number of its block's tag path."""

    __slots__ = ("article", "box", "last", "link", "number", "out", "parent", "part", "path", "tag", "top_article")

    def __init__(self, tag: str, parent: Node | None, number: int):
        self.tag, self.parent, self.number, self.last = tag, parent, number, number
        self.out = self.link = False
        self.part = self.box = self.article = self.top_article = None  # the nearest elements around it, itself included
        self.path = 0


class Page:
    """The text runs (text, element, block) of a page in order, its elements and its tag paths."""

    def __init__(self, page: str):
        self.root = Node("", None, 0)
        self.nodes, self.runs, self.paths, self.has_article = [self.root], [], {}, False
        self._read(page)
        for node in reversed(self.nodes[1:]):
            node.parent.last = max(node.parent.last, node.last)

    def _opened(self, tag: str, attributes: str, parent: Node) -> Node:
        node = Node(tag, parent, len(self.nodes))
        self.nodes.append(node)
        named = False
        node.link = parent.link or tag == "a"
        inside = parent.article is not None and parent.article.tag == "article"
        # an article's own header is its title; noscript elsewhere asks for scripts
        node.out = parent.out or tag in PARTS and not (tag == "header" and inside) or tag == "noscript" and parent.article is None
        if attributes and not node.out:
            for name, value in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'")
                if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                    node.out = True
                elif name == "role" and value.lower() in ROLES:
                    node.out = True
                elif name in ("class", "id") and tag not in ("html", "body", "main") and part_word(value):
                    named = True
        node.part = node if named else parent.part
        node.article = node if tag in ARTICLES and not named else parent.article
        node.top_article = parent.top_article or node.article
        node.box = node if tag in BOXES else parent.box
        self.has_article |= node.article is node
        step = (parent.path, tag, named)
        node.path = self.paths.setdefault(step, len(self.paths) + 1) if tag in BLOCK or named else parent.path
        return node

    def _read(self, page: str) -> None:
        runs, stack, opened = self.runs, [self.root], Counter()  # the open elements, and how many there are of each tag
        block, pos, size = 0, 0, len(page)

        def close(to: int) -> None:
            while len(stack) > to:
                opened[stack.pop().tag] -= 1

        def nearest(tags: tuple[str, ...], within) -> int:
            """The place of the innermost open element with one of the tags, none of `within` inside it; 0 if there is none."""
            if not any(opened[t] for t in tags):
                return 0
            at = len(stack) - 1
            while at and stack[at].tag not in tags and stack[at].tag not in within:
                at -= 1
            return at if stack[at].tag in tags else 0

        while pos < size:
            m = _MARKUP.search(page, pos)
            text = page[pos : m.start() if m else size]
            if text and not stack[-1].out:
                runs.append((entities.unescape(text), stack[-1], block))
            if not m:
                break
            pos = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                if m[0].startswith("<![CDATA[") and not stack[-1].out:
                    runs.append((m[0][9:-3], stack[-1], block))
                continue
            block += tag in BLOCK
            if m[1]:
                if at := nearest((tag,), ()):
                    close(at)
            elif tag in RAW:
                if not m[0].endswith("/>") or tag in ("script", "style", "textarea", "title"):
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, pos)
                    pos = end.end() if end else size
            elif tag in VOID:
                if tag == "br" and not stack[-1].out:
                    runs.append(("\n", stack[-1], block))
            else:
                if tag in BLOCK and tag not in ("html", "body") and (at := nearest(("p",), BLOCK)):  # a block ends an open paragraph
                    close(at)
                if tag in _LIKE:  # as an item ends the item before, within its list or table
                    while at := nearest(_LIKE[tag], (*_SCOPE.get(tag, ()), *LAYOUT)):
                        close(at)
                node = self._opened(tag, m[3], stack[-1])
                stack.append(node)
                opened[tag] += 1


def content_paths(page: Page) -> dict[int, float]:
    """The tag paths that pass, with the weight of their place."""
    rows: dict[int, list] = {}
    for text, node, block in page.runs:
        n = len(text.strip())
        if n:
            row = rows.get(node.path)
            if row is None:
                row = rows[node.path] = [0, 0, 0, -1, (IN_PART if node.part else 1.0) * (IN_ARTICLE if node.article else 1.0)]
            if not node.link:
                row[0] += n
                row[1] += len(_PUNCTUATION.findall(text))
            if row[3] != block:
                row[2], row[3] = row[2] + 1, block
    if not rows:
        return {}
    length, marks, blocks, _, weight = np.array(list(rows.values()), float).T
    kernel = np.exp(-0.5 * np.arange(-1, 2) ** 2)
    smooth = lambda x: np.convolve(np.pad(x, 1, mode="edge"), kernel / kernel.sum(), "valid")
    fused = smooth(length / blocks) * smooth((1 + marks) / blocks) * weight
    passing = fused >= min(fused.std(), fused.max())
    return {p: float(w) for p, w, x in zip(rows, weight, passing, strict=True) if x}


def content_nodes(page: Page) -> tuple[list[Node], dict[int, float]]:
    """The elements that hold the main text, and the paths that pass."""
    paths = content_paths(page)
    picked = [(node, n * paths[node.path]) for text, node, _ in page.runs if node.path in paths and not node.link and (n := len(text.strip()))]
    total = sum(w for _, w in picked)
    if not total:
        return [], paths
    if 2 * sum(w for node, w in picked if node.article) > total:
        tops = {node.top_article.number: node.top_article for node, _ in picked if node.article}
        return [tops[k] for k in sorted(tops)], paths
    # the smallest element that has most of the weight is around the run in whose middle it lies
    picked.sort(key=lambda x: x[0].number)
    numbers, sums = [node.number for node, _ in picked], np.append(0, np.cumsum([w for _, w in picked]))
    best = picked[min(int(np.searchsorted(sums, total / 2, "right")) - 1, len(picked) - 1)][0]
    while best.parent is not None and sums[bisect_left(numbers, best.last + 1)] - sums[bisect_left(numbers, best.number)] < MOST * total:
        best = best.parent
    best = best.box or page.root
    # all text of the paths found in it, and headings that pass, belong to it
    mine = {node.path for node, _ in picked if best.number <= node.number <= best.last}
    asked = [node.number for node, _ in picked if node.path in mine or page_heading(node)]
    while best.parent is not None and not (best.number <= min(asked) and max(asked) <= best.last):
        best = best.parent
    best = best.box or page.root
    # so does text that lies directly in the box around it, and in boxes further out if its path passes
    direct: dict[int, bool] = {}
    for text, node, _ in page.runs:
        if node.box is not None and not node.link and not node.part and text.strip():
            direct[node.box.number] = direct.get(node.box.number, False) or node.path in paths
    around, first = best.parent and best.parent.box, True
    while around is not None:
        if direct.get(around.number) or first and around.tag == "div" and around.number in direct:
            best = around
        around, first = around.parent and around.parent.box, False
    return [best], paths


def page_heading(node: Node) -> bool:
    while node.parent is not None and node.tag not in BLOCK:
        node = node.parent
    return node.tag in HEADINGS


def main_text(html: str | None) -> str:
    """The blocks of the main text in page order, joined by two line breaks."""
    page = Page(html or "")
    tops, paths = content_nodes(page)
    firsts, lasts = [x.number for x in tops], [x.last for x in tops]  # in page order, none inside another
    blocks: dict[int, list[str]] = {}
    for text, node, block in page.runs:
        at = bisect_right(firsts, node.number) - 1
        if at < 0 or node.number > lasts[at]:
            continue
        if node.part and (page.has_article or node.path not in paths):
            continue
        blocks.setdefault(block, []).append(text)
    joined = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(x for x in joined if x)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every page."""
    common.share_code(pages.sparkSession)

    def work(batches):
        for batch in common.slices(batches, 2):
            texts = [main_text(x) for x in texts_of(batch, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string())], names=["id", "url", "text"])

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(work, "id long, url string, text string")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extracted(common.table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))
