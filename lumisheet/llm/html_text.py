"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each a leaf of a tree of structural elements. The tags from the root to
a block are its path. Per path, text outside links and punctuation are summed and divided by the number of
blocks; both ratios are smoothed over the blocks in page order, neighbours weighing less the farther they
stand in the tree, and fused with what tags and class names say: being inside an article or main doubles
a score, a form or an element whose class, id or role names a menu, advert, comments and the like
divides it by ten. Paths that reach ``strength`` standard deviations of all path scores select the content
nodes, which weigh their score times their text.

The content root is the lowest element that holds ``share`` of this weight. It moves up from parts of a
text (a paragraph, a list, a table) to the element that holds them, over headings that stand alone, and to the
outermost article or main round it. All blocks under the root make the text, save those in marked elements
or navigation, footers, asides, headers and the like below the root; what is marked above it (a wrapper named
``widget``) does no harm. Outside articles and mains a branch of the root in which all text is links is a menu.

Pages are independent: one pass, no shuffle, memory by page, time in proportion to a page however deep it is
nested. Defined results: a null or empty page, or one without content, has empty text; a truncated page is
read as far as it goes; very long pages are read whole; repeated rows are judged alike; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)(>|$)|</?[a-zA-Z][^>]*>?", re.DOTALL)
_NAMED = re.compile(r"(?i)(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_WORD = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")

_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose whole content is no text of the page.
_RAW = frozenset("script style title textarea noscript template svg iframe math object video audio canvas xmp noembed noframes".split())
_DROP = frozenset("nav footer aside head menu dialog".split())
#: Controls of forms; what stands up to their own end tag is no text of the page.
_CONTROLS = frozenset("button datalist label meter output progress select".split())
#: Elements that count as marked.
_DOUBT = frozenset(("form", "fieldset"))
#: Start tags that end an open element of these names, up to the nearest of the limits.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}
#: Words of class, id or role that mark what is no article.
_AWAY = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer discussion disqus feedback footer form login masthead menu modal nav navbar navigation newsletter notice notices outbrain overlay pagination paywall popup promo promoted promotion recommended related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar widget widgets".split()
)
#: Words that may stand beside those in a name without changing what it names.
_PLAIN = frozenset("area bar block bottom box button buttons container group holder inner item items left link links list main module outer page panel post right row section site slot top wrap wrapper".split())
#: Those of them that name no wrapper of an article: such an element is no content wherever anything else is.
_NEVER = frozenset("breadcrumb breadcrumbs cookie cookies consent copyright disqus footer login masthead nav navbar navigation signup sidebar".split())
_HEADS = frozenset(("header", "hgroup"))
_ROOTS = frozenset(("article", "main"))
#: Elements that are part of a text; the root is what holds them.
_PARTS = frozenset("p li h1 h2 h3 h4 h5 h6 dt dd ul ol dl blockquote pre caption figcaption figure hgroup tr tbody thead tfoot table".split())


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Factors of a path score: for each marked element on the path, and for an article or main.
MARKED, ROOTED = 0.1, 2.0
#: Characters beside its headings (those in links count five times) up to which an element with an h1 is a headline as a whole.
TITLE_CHARS = 200
_KERNEL = (4.0, 2.0, 1.0)  # weight by distance in page order
_NEAR = 8  # steps up the tree after which two blocks are strangers


class Element(NamedTuple):
    parent: int  # -1: the page itself
    tag: str
    path: int
    away: bool  # inside navigation, footers and the like
    marked: bool
    rooted: bool  # an article or main, or inside one


class Block(NamedTuple):
    element: int
    text: str
    links: int  # characters inside links


class Page(NamedTuple):
    elements: list[Element]
    blocks: list[Block]
    priors: list[float]  # by path


def read(page: str, hard: bool = True) -> Page:
    """Elements and blocks of text of the page in order, white space folded, character references decoded.

    ``hard``: whether names of footers, sidebars and the like count as such elements do.
    """
    out: list[Block] = []
    elements: list[Element] = [Element(-1, "", 0, False, False, False)]  # the page itself
    paths: dict[tuple[int, str, bool, bool], int] = {}
    priors = [1.0]
    stack = [0]
    open_: dict[str, list[int]] = {}  # depths at which elements of a tag are open
    unended: set[str] = set()  # tags of controls without an end tag further on
    parts: list[str] = []
    links = anchors = 0

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(stack[-1], text, min(links, len(text))))
        parts.clear()
        links = 0

    def close(depth: int) -> None:
        for e in stack[depth:]:
            open_[elements[e].tag].pop()
        del stack[depth:]

    def deepest(tags: set[str]) -> int:
        return max((open_[t][-1] for t in tags if open_.get(t)), default=0)

    def push(tag: str, marked: bool, never: bool) -> None:
        above = elements[stack[-1]]
        rooted = above.rooted or tag in _ROOTS
        away = above.away or tag in _DROP or never or (tag in _HEADS and not rooted)
        key = (above.path, tag, marked, away)
        if key not in paths:
            paths[key] = len(priors)
            priors.append(priors[above.path] * (MARKED if marked else 1.0) * (ROOTED if rooted and not above.rooted else 1.0))
        elements.append(Element(stack[-1], tag, paths[key], away, marked, rooted))
        open_.setdefault(tag, []).append(len(stack))
        stack.append(len(elements) - 1)

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        raw = page[at : m.start() if m else len(page)]
        if raw:
            text = html.unescape(raw)
            parts.append(text)
            links += len(text) if anchors else 0
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if not m[1]:
            if not m[4]:  # cut off inside a tag
                break
            if tag in _RAW and not m[3].endswith("/"):
                end = re.compile(rf"(?i)</{tag}[^>]*>?").search(page, at)
                at = end.end() if end else len(page)
                parts.append(" ")
            elif tag in _CONTROLS:
                end = None if tag in unended else re.compile(rf"(?i)</{tag}[^>]*>?").search(page, at)
                if end:
                    at = end.end()
                else:
                    unended.add(tag)
                parts.append(" ")
            elif tag == "br" or tag in _VOID and tag != "hr":
                parts.append(" ")
            elif tag in _BLOCK:
                flush()
                if tag in _CLOSES:
                    own, limits = _CLOSES[tag]
                    if (depth := deepest(own)) > deepest(limits):
                        close(depth)
                if elements[stack[-1]].tag == "p":
                    close(len(stack) - 1)
                if tag != "hr":
                    names = () if tag in ("html", "body") else _marks(m[3])
                    push(tag, tag in _DOUBT or bool(names), hard and any(w in _NEVER for w in names))
            elif tag == "a":
                anchors = 1
        elif tag == "a":
            anchors = 0
        elif tag in _BLOCK:
            flush()
            if open_.get(tag):
                close(open_[tag][-1])
    flush()
    return Page(elements, out, priors)


def _marks(attributes: str) -> list[str]:
    """The words of class, id or role by which a whole name says that this is no article."""
    out: list[str] = []
    for m in _NAMED.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = [w for w in _WORD.findall(name) if len(w) > 1]
            if any(w in _AWAY for w in words) and all(w in _AWAY or w in _PLAIN for w in words):
                out += words
    return out


def _steps(elements: list[Element], a: int, b: int) -> int:
    """Steps in the tree between two elements; ``_NEAR`` or more count as that."""
    up = {}
    for k in range(_NEAR):
        up[a] = k
        if a == 0:
            break
        a = elements[a].parent
    for k in range(_NEAR):
        if b in up:
            return min(_NEAR, up[b] + k)
        if b == 0:
            break
        b = elements[b].parent
    return _NEAR


def path_scores(page: Page) -> dict[int, float]:
    """Fused score of each path: smoothed text per block times smoothed punctuation per block, times the factors of its tags and names."""
    elements, found = page.elements, page.blocks
    sums: dict[int, list[float]] = {}
    of = [elements[b.element].path for b in found]
    for b, path in zip(found, of, strict=True):
        own = sums.setdefault(path, [0.0, 0.0, 0.0])
        if not elements[b.element].away:
            own[0] += len(b.text) - b.links
            own[1] += len(_PUNCTUATION.findall(b.text))
        own[2] += 1
    text = [sums[path][0] / sums[path][2] for path in of]
    marks = [sums[path][1] / sums[path][2] for path in of]
    # sums over the kernel, a pair of neighbours at a time
    weight = [_KERNEL[0]] * len(found)
    t, p = [_KERNEL[0] * x for x in text], [_KERNEL[0] * x for x in marks]
    for gap in range(1, len(_KERNEL)):
        for i in range(len(found) - gap):
            j = i + gap
            w = _KERNEL[gap] * 0.5 ** (_steps(elements, found[i].element, found[j].element) / 2)
            for x, y in ((i, j), (j, i)):
                weight[x] += w
                t[x] += w * text[y]
                p[x] += w * marks[y]
    fused: dict[int, list[float]] = {}
    for i, path in enumerate(of):
        own = fused.setdefault(path, [0.0, 0.0])
        own[0] += t[i] / weight[i] * (1 + p[i] / weight[i])
        own[1] += 1
    return {path: 0.0 if elements[b.element].away else fused[path][0] / fused[path][1] * page.priors[path] for path, b in zip(of, found, strict=True)}


def main_text(source: str | None, strength: float = 0.5, share: float = 0.75) -> str:
    """The article of a page: its blocks, joined by an empty line."""
    page = read(source or "")
    kept = [b for b in page.blocks if not page.elements[b.element].away]
    if not kept and page.blocks:  # all of it lies in something named like a footer
        page = read(source or "", False)
        kept = [b for b in page.blocks if not page.elements[b.element].away]
    elements = page.elements
    if not kept:
        return ""
    scores = path_scores(page)
    threshold = strength * float(np.std(list(scores.values())))
    score = lambda b: scores[elements[b.element].path]
    content = {id(b) for b in kept if score(b) >= threshold and len(b.text) > b.links}
    content = content or {id(b) for b in kept}
    mass = [0.0] * len(elements)
    for b in kept:
        if id(b) in content:
            mass[b.element] += score(b) * (len(b.text) - b.links)
    direct = list(mass)
    for e in range(len(elements) - 1, 0, -1):
        mass[elements[e].parent] += mass[e]
    root = _root(page, kept, mass, direct, share)
    # what lies under the root and in no marked element below it
    under = [False] * len(elements)
    under[root] = True
    opened = set(_above(elements, _lowest(elements, mass, share)))
    branch = [0] * len(elements)  # the child of the root that holds an element
    for e in range(root + 1, len(elements)):
        up = elements[e].parent
        under[e] = under[up] and (not elements[e].marked or e in opened)
        branch[e] = e if up == root else branch[up]
    own = [b for b in kept if under[b.element]]
    if not elements[root].rooted:
        # a list or box of links is a menu; a paragraph or a heading that is one is part of the text
        prose = {branch[b.element] for b in own if len(b.text) > b.links or id(b) in content or elements[b.element].tag == "p" or elements[b.element].tag in _HEADINGS}
        own = [b for b in own if branch[b.element] in prose]
    return "\n\n".join(b.text for b in own)


def _above(elements: list[Element], e: int) -> list[int]:
    """An element and all that hold it."""
    out = [e]
    while out[-1]:
        out.append(elements[out[-1]].parent)
    return out


def _lowest(elements: list[Element], mass: list[float], share: float) -> int:
    """The lowest element with this share of the weight: elements are in page order, so the last one (parts of over half hold each other)."""
    return max(e for e in range(len(elements)) if mass[e] >= share * mass[0])


def _root(page: Page, kept: list[Block], mass: list[float], direct: list[float], share: float) -> int:
    """The element whose blocks are the text."""
    elements = page.elements
    root = _lowest(elements, mass, share) if mass[0] else 0
    while root and (elements[root].tag in _PARTS or elements[root].tag in ("td", "th") and direct[root]):
        root = elements[root].parent
    if elements[root].rooted:
        return [e for e in _above(elements, root) if elements[e].rooted][-1]
    # blocks below each element that no marked one below it holds, and those of them that belong to headings
    count, headings, first = [0] * len(elements), [0] * len(elements), [len(kept)] * len(elements)
    chars, title = [0] * len(elements), [False] * len(elements)
    for i, b in enumerate(kept):
        e = b.element
        count[e] += 1
        headings[e] += elements[e].tag in _HEADINGS
        title[e] |= elements[e].tag == "h1"
        chars[e] += 0 if elements[e].tag in _HEADINGS else len(b.text) + 4 * b.links
        first[e] = min(first[e], i)
    titled = [False] * len(elements)
    for e in range(len(elements) - 1, 0, -1):
        up = elements[e].parent
        first[up] = min(first[up], first[e])
        if elements[e].marked:
            continue
        if title[e] and chars[e] <= TITLE_CHARS:  # a headline with its byline: all of it counts as a heading
            titled[e], headings[e] = True, count[e]
        count[up] += count[e]
        headings[up] += headings[e]
        chars[up] += 0 if titled[e] else chars[e]
        title[up] |= title[e]
    e = root
    while e:
        up, own = elements[e].parent, not elements[e].marked
        more, heads = count[up] - own * count[e], headings[up] - own * headings[e]
        if more != heads:
            break
        e, root = up, up if heads else root
    return root


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the main text instead of the html."""
    rest = [f for f in pages.schema.fields if f.name not in (html_col, out_col, "n_chars")]
    schema = T.StructType([*rest, T.StructField(out_col, T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=schema.fieldNames())

    return pages.select(*[f.name for f in rest], html_col).mapInArrow(run, schema)


def digest(pages: DataFrame) -> DataFrame:
    """The report of the query: one row per page."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
