"""Main text of web pages by tag-path ratios.

A page becomes a run of text nodes, each with its path of open tags. By path, text letters, punctuation and nodes are
summed; their ratios (letters and punctuation per node) are smoothed over the run, multiplied, and thresholded at a share
of their spread. Nodes above the threshold are content, inside of article and main and outside of them.

The result is the blocks with content, and the paragraphs, headings and other named parts of running text between them or
in the same division, article or main.
Smoothing also lifts what borders on content; such a block stays only if it is such a part, or if the ratios of its own
path pass. Outside of an article or main with content, they must pass in any case. Lists, tables and divisions
that are mostly links are no content, nor is the heading above them.

Scripts, styles and what is hidden do not take part. Navigation, footers, asides, forms, page headers, and elements whose
class, id or role says menu, advert, notice, sidebar, comment and the like are doubted: they stay out unless they wrap
the article. A form, or an element named only in a compound like ``has-sidebar``, is not doubted where it holds an
article or main, or most of the page's text; any other one where every article or main of the page is as
doubted, or, named in full, where it holds most of the text of a page without article or main.

A block is what lies between tags other than inline ones. Character references are decoded, white space inside a block
becomes one space, blocks are joined by an empty line.

Defined results: null or empty html has the empty text; plain text without tags is its own article; a page whose text is all
in left-out elements has the empty text; rows are extracted one by one; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import string
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Share of the standard deviation of fused ratios that a content node exceeds; width of the smoothing window.
THRESHOLD, WINDOW = 0.5, 3

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
_DROPPED = frozenset(
    "button canvas dialog head iframe input noscript object script select style svg template textarea title video audio".split()
)
_DOUBTED = frozenset("aside footer menu nav".split())
_FORMS = frozenset("fieldset form".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: An opening tag of the key closes an open element of the value, up to the nearest element that bounds it.
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "optgroup": {"option", "optgroup"}, "body": {"head"},
}
_BOUNDS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
_BOUNDS_P = frozenset("td th caption button object table html body article section main div li blockquote aside".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose own text runs with the article's, and those that can be lists of links.
_RUNNING = _HEADINGS | frozenset(
    "address article blockquote body caption dd dt figcaption html li main p pre summary td th".split()
)
_CONTAINERS = frozenset("div dl ol section table ul".split())
_BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar aside footer foot masthead topbar cookie cookies consent gdpr notice "
    "notices alert popup modal newsletter subscribe subscription signup login search share sharing social related "
    "recommended recommendations comment comments discussion disqus replies reply respond pagination pager toolbar widget "
    "complementary contentinfo".split()
)
_SIMPLE = r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
_OTHER = r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
_TAG = re.compile(rf"""{_OTHER}|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|{_SIMPLE}""", re.S)
_PLAIN_TAG = re.compile(rf"{_OTHER}|()()()(?!)|{_SIMPLE}", re.S)
#: Tags whose quotes do not close up to the end of the page; after so many, quotes are no longer looked at.
_OPEN_QUOTES = 8
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_PUNCTUATION = frozenset(string.punctuation + "…“”„‘’«»¿¡、。，；：？！")
_SPACES = re.compile(r"\s+")


@dataclass
class _Page:
    """A page as a tree: elements and paths by number, each with its parent; text nodes by their element.

    Element 0 and path 0 are the page itself. A doubt is an element that may not belong to the article; ``around`` names the
    innermost doubt that an element or node is in, ``doubt_parent`` the one around a doubt.
    """

    parent: list[int]
    tag: list[str]
    path_of: list[int]
    #: Innermost article, main and division of every element, itself included.
    homes: list[tuple[int, int, int]]
    path_parent: list[int]
    path_tag: list[str]
    element: list[int]
    block: list[int]
    text: list[str]
    around: list[int]
    why: dict[int, str]
    doubt_parent: dict[int, int]
    articles: list[int]

    @staticmethod
    def empty() -> _Page:
        return _Page([0], [""], [0], [(0, 0, 0)], [0], [""], [], [], [], [], {}, {}, [])

    def inherited(self, own: list[bool]) -> list[bool]:
        """Whether an element or one around it has the property; parents come before children."""
        out = list(own)
        for e in range(1, len(out)):
            out[e] = out[e] or out[self.parent[e]]
        return out


def _left_out(tag: str, attributes: str) -> bool:
    if tag in _DROPPED:
        return True
    if tag in ("html", "body", "article", "main") or not attributes:
        return False
    return bool(_HIDDEN.search(attributes))


def _doubt(tag: str, attributes: str, sectioned: bool) -> str:
    """Why an element may not belong to the article: its tag, its name, a part of its name; empty if nothing says so."""
    if tag in _DOUBTED or (tag == "header" and not sectioned):
        return "tag"
    if tag in ("html", "body", "article", "main"):
        return ""
    why = "part" if tag in _FORMS else ""
    for found in _NAMES.finditer(attributes):
        for name in (found[1] or found[2] or found[3] or "").lower().split():
            if name in _BAD_NAMES:
                return "name"
            if not _BAD_NAMES.isdisjoint(re.split(r"[_\-:]+", name)):
                why = "part"
    return why


def _doubted(page: _Page) -> set[int]:
    """The doubts that still stand, or lie in one that does, once those that wrap the article are cleared."""
    letters, total = dict.fromkeys(page.why, 0), 0
    for text, around in zip(page.text, page.around):
        size = len(text.strip())
        total += size
        if around:
            letters[around] += size
    order = sorted(page.why)
    depth = {0: 0}
    for x in order:
        depth[x] = depth[page.doubt_parent[x]] + 1
    for x in reversed(order):
        if page.doubt_parent[x]:
            letters[page.doubt_parent[x]] += letters[x]
    fewest = min((depth[x] for x in page.articles), default=0)
    clear: set[int] = set()
    # Chains meet, so each doubt is walked over once for either reason.
    for reason in ("part", "fewest"):
        seen: set[int] = set()
        for x in page.articles:
            if reason == "part" or depth[x] == fewest:
                while x and x not in seen:
                    seen.add(x)
                    if reason == "fewest" or page.why[x] == "part":
                        clear.add(x)
                    x = page.doubt_parent[x]
    clear |= {
        x
        for x, reason in page.why.items()
        if 2 * letters[x] > total and (reason == "part" or (reason == "name" and not page.articles))
    }
    stand: set[int] = set()
    for x in order:
        if x not in clear or page.doubt_parent[x] in stand:
            stand.add(x)
    return stand


def parsed(html: str) -> _Page:
    """The page without left-out elements."""
    page, size = _Page.empty(), len(html)
    open_: list[tuple[str, int, bool, int]] = [("", 0, False, 0)]  # tag, element, left out, innermost doubt
    places: dict[str, list[int]] = defaultdict(list)  # where elements of a tag are open
    paths: dict[tuple[int, str], int] = {}
    block, at, last, odd = 0, 0, html.rfind(">"), 0

    def text(content: str) -> None:
        _, element, out, around = open_[-1]
        if content and not out:
            page.element.append(element)
            page.block.append(block)
            page.text.append(content)
            page.around.append(around)

    def close(k: int) -> None:
        while len(open_) > k:
            places[open_.pop()[0]].pop()

    def nearest(tags) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=0)

    while at < size:
        found = (_TAG if odd < _OPEN_QUOTES else _PLAIN_TAG).search(html, at) if at <= last else None
        if found is None:
            # An unclosed comment has no end to be found by.
            rest = html[at:]
            text(rest[: rest.find("<!--")] if "<!--" in rest else rest)
            break
        text(html[at : found.start()])
        at = found.end()
        odd += found[5] is not None
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        if tag not in _INLINE:
            block += 1
        if tag == "br":
            text(" ")
            continue
        if found[1] or found[4]:
            if places[tag]:
                close(places[tag][-1])
            continue
        attributes = found[3] or found[6] or ""
        closes, bounds = _CLOSES.get(tag, ()), _BOUNDS.get(tag, ())
        if tag in _ENDS_P:
            closes, bounds = ("p",), _BOUNDS_P
        if closes and (above := nearest(closes)):
            bound = nearest(bounds)
            if above > bound:
                close(min(places[t][bisect_right(places[t], bound)] for t in closes if places[t] and places[t][-1] > bound))
        if tag in _VOID:
            continue
        _, outer, out, around = open_[-1]
        element = len(page.parent)
        out = out or _left_out(tag, attributes)
        sectioned = any(places[t] for t in ("article", "main", "section"))
        if not out and (reason := _doubt(tag, attributes, sectioned)):
            page.why[element], page.doubt_parent[element] = reason, around
            around = element
        if not out and tag in ("article", "main"):
            page.articles.append(around)
        if tag in _RAW and (tag != "xmp" or out):
            end = _raw_end(tag).search(html, at)
            at = end.end() if end else size
            # The element still has its number.
            page.parent.append(outer)
            page.tag.append(tag)
            page.path_of.append(page.path_of[outer])
            page.homes.append(page.homes[outer])
            continue
        key = (page.path_of[outer], tag)
        if key not in paths:
            paths[key] = len(page.path_parent)
            page.path_parent.append(key[0])
            page.path_tag.append(tag)
        article, main, inner = page.homes[outer]
        page.parent.append(outer)
        page.tag.append(tag)
        page.path_of.append(paths[key])
        page.homes.append(
            (
                element if tag == "article" else article,
                element if tag == "main" else main,
                element if tag in ("article", "body", "div", "html", "main", "section") else inner,
            )
        )
        places[tag].append(len(open_))
        open_.append((tag, element, out, around))
    return page


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


def _fused(texts: list[str], paths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Ratios of letters and of punctuation by path, for every node."""
    sums: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    for text, path in zip(texts, paths):
        size, total = len(text.strip()), sums[path]
        total[0] += size
        total[1] += sum(map(_PUNCTUATION.__contains__, text))
        total[2] += size > 0
    ratio = {path: (a / max(1, n), b / max(1, n)) for path, (a, b, n) in sums.items()}
    return np.array([ratio[p][0] for p in paths]), np.array([ratio[p][1] for p in paths])


def content_nodes(texts: list[str], paths: list[int], outer: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Which nodes the fused, smoothed ratios of their paths pass, and which ones the ratios of their block's own path.

    ``outer`` has every node's path without the inline elements at its end.
    """
    text_ratio, mark_ratio = _fused(texts, paths)
    window = np.ones(min(WINDOW, len(texts))) / min(WINDOW, len(texts))
    fused = np.convolve(text_ratio, window, "same") * (1 + np.convolve(mark_ratio, window, "same"))
    real = np.array([bool(t.strip()) for t in texts])
    least = THRESHOLD * fused[real].std()
    own_text, own_mark = _fused(texts, outer)
    return real & (fused >= least), real & (own_text * (1 + own_mark) >= least)


def _linked(page: _Page, nodes: list[int], in_link: list[bool]) -> list[bool]:
    """Whether an element is a list, table or division whose text is mostly links."""
    more = [0] * len(page.parent)
    for n in nodes:
        size, e = len(page.text[n].strip()), page.element[n]
        more[e] += size if in_link[e] else -size
    for e in range(len(more) - 1, 0, -1):
        more[page.parent[e]] += more[e]
    return [tag in _CONTAINERS and m > 0 for tag, m in zip(page.tag, more)]


def main_text(html: str | None) -> str:
    """The article's blocks, joined by empty lines."""
    page = parsed(html or "")
    stand = _doubted(page) if page.why else set()
    nodes = [n for n in range(len(page.text)) if page.around[n] not in stand]
    texts = [page.text[n] for n in nodes]
    if not any(t.strip() for t in texts):
        return ""
    # Of every path: the path without inline elements at its end.
    outer = [0] * len(page.path_parent)
    for p in range(1, len(outer)):
        outer[p] = outer[page.path_parent[p]] if page.path_tag[p] in _INLINE else p
    paths = [page.path_of[page.element[n]] for n in nodes]
    content, own = content_nodes(texts, paths, [outer[p] for p in paths])
    in_link = page.inherited([t == "a" for t in page.tag])
    in_list = page.inherited(_linked(page, nodes, in_link))
    in_article = page.inherited([t in ("article", "main") for t in page.tag])
    blocks: dict[int, list[int]] = {}
    for k, n in enumerate(nodes):
        blocks.setdefault(page.block[n], []).append(k)
    rows = [at for at in blocks.values() if any(texts[k].strip() for k in at)]
    heads = [page.element[nodes[at[0]]] for at in rows]
    last_tag = [page.path_tag[outer[page.path_of[e]]] for e in heads]
    marked = [in_article[e] for e in heads]
    passed = [any(content[k] for k in at) for at in rows]
    alone = [any(own[k] for k in at) for at in rows]
    linked = [any(in_list[page.element[nodes[k]]] for k in at) for at in rows]
    edge = any(m and p for m, p in zip(marked, passed))
    sure = [p and not x and (a or (t in _RUNNING and (m or not edge))) for p, x, a, t, m in zip(passed, linked, alone, last_tag, marked)]
    if not any(sure):
        # No block stands out: what is not links, or else all, is the text.
        sure = [not x for x in linked] if not all(linked) else [True] * len(rows)

    def homes(e: int) -> set[int]:
        """The elements whose running text a block of content vouches for: the innermost division, article and main."""
        article, main, inner = page.homes[e]
        return {x for x in (article, main) if x} | {inner}

    vouched = {x for e, is_sure in zip(heads, sure) if is_sure for x in homes(e)}
    near = [not vouched.isdisjoint(homes(e)) for e in heads]
    first, last = sure.index(True), len(sure) - 1 - sure[::-1].index(True)
    kept, below = [False] * len(rows), False
    for k in range(len(rows) - 1, -1, -1):
        between = first <= k <= last and (marked[k] or not edge)
        kept[k] = sure[k] or (not linked[k] and last_tag[k] in _RUNNING and (near[k] or between))
        if last_tag[k] in _HEADINGS and k + 1 < len(rows) and linked[k + 1] and not below:
            kept[k] = False
        below = kept[k]
    joined = ("".join(texts[i] for i in at) for k, at in enumerate(rows) if kept[k])
    return "\n\n".join(t for t in (_SPACES.sub(" ", entities.unescape(x)).strip() for x in joined) if t)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
