"""Main text of web pages by a maximum-scoring subsequence of words and tags.

A page is a sequence of tags and blocks of words. Words score by what stands around them, tags cost; both weights come from
labelled pages. One linear scan finds the contiguous stretch of the page with the largest sum, without any bound on what a
block or a tag may add or take away. Whether a block is a menu or a footer that nothing marks is learned from the share of
links in it and in the list or container around it, from runs of short blocks and from lines about rights.

Two things are named steps of their own, before the scan. *Asides* are the elements that are no part of an article by their
tag, or by a class, id or role that names one: menus, headers, footers, sidebars, notices, adverts, forms, comments. And the
*marked* part of a page is what it calls its article or main content, if it does. Adverts, notices and forms, and any
asides within the marked part, are cut out: they neither score nor come into the text. All others score as their words do.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, html_labelled

#: Fixed values of HTML: elements without an end tag, elements that begin and end a line (all others stand within one),
#: elements whose content is no text, and those of them in which nothing is markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav "
    "ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
HIDDEN = frozenset("script style template noscript svg canvas iframe object select textarea head title audio video annotation annotation-xml datalist".split())
RAW = frozenset("script style textarea title".split())
#: Elements that stand beside an article whatever their class, those that may be asides by their class, and those whose end tag may be left out.
SIDE_TAGS = frozenset("nav footer aside menu dialog".split())
CUT_TAGS = frozenset("form fieldset".split())
CONTAINERS = frozenset("div section article aside nav header footer ul ol dl table tbody tr td form fieldset figure details center".split())
PROSE_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dd td".split())
OPTIONAL_END = frozenset("p li dt dd tr td th option".split())
STOPS = frozenset("ul ol table div section dl".split())
#: Words that name what stands beside an article, what is said about it, what interrupts it, and the article.
SIDE_WORDS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs pagination pager header masthead topbar footer colophon copyright sidebar rail complementary contentinfo search searchbox".split())
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond discussion disqus".split())
CUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal dialog overlay share sharing social "
    "related recommended recommendations trending popular newsletter subscribe subscription signup login form skip".split()
)
MAIN_WORDS = frozenset("article articlebody post postbody story storybody entry content contents maincontent prose body text main".split())
#: Those words that name an advert, and how a line about rights begins.
ADVERT_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion".split())
RIGHTS = re.compile(r"(?:©|\(c\) *\d{4}|copyright\b)|.*\ball rights reserved\b", re.I)
#: Words that say nothing of the kind of an element, and words before a name that make it a state of the page.
NEUTRAL = frozenset("box area left right inner outer wrapper wrap container list block section bar group item top bottom content contents body text main title link links s id js".split())
STATES = frozenset("has have with no without is hide show not".split())
FEATURES = ("side_tag", "side_word", "main_tag", "main_word", "beyond", "prose", "link", "long", "links_around", "short_run", "rights", "constant")
#: A block of so many words is long; of at most so many it is short; so many short ones in a row are a list of names.
LONG, SHORT, RUN = 12, 5, 3
#: An article with a link that has less than this share of the words of the page's longest is a teaser.
TEASER = 0.25
NO, SIDE, COMMENT, CUT, MAIN, ADVERT = range(6)

_NAME = re.compile(r"/?([A-Za-z][A-Za-z0-9:-]*)")
_ATTRIBUTES = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?)*+>""")
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|(role))\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@lru_cache(maxsize=20_000)
def token_kind(token: str) -> int:
    """What a class, an id or a role says, by the last of its words that says anything: site-footer, comments-area,
    sidebarRight, entry-content. has-sidebar, social-science and tag-news say nothing."""
    words = [w.lower() for w in _PIECES.findall(token)]
    if not words or words[0] in STATES:
        return NO
    told = [w for w in words if w not in NEUTRAL]
    last = told[-1] if told else words[-1]
    for kind, known in ((COMMENT, COMMENT_WORDS), (CUT, CUT_WORDS), (SIDE, SIDE_WORDS)):
        if last in known:
            return kind
    if last in MAIN_WORDS or any(w in MAIN_WORDS for w in words[-1:]):
        return CUT if words[0] in CUT_WORDS else NO if any(w in SIDE_WORDS or w in COMMENT_WORDS for w in words) else MAIN
    return NO


@lru_cache(maxsize=20_000)
def element_kind(tag: str, attributes: str) -> int:
    """NO, SIDE, COMMENT, CUT or MAIN from an element's tag, classes, id and role. A token that names the article
    outweighs others; only containers can be asides by a token, and paragraphs by one of an advert (ADVERT) or a notice."""
    named = {token_kind(t) for m in _NAMES.finditer(attributes) for t in (m[2] or m[3] or m[4] or "").split()} if "=" in attributes else set()
    if tag in ("html", "body", "main"):
        return MAIN if tag == "main" else NO
    if tag == "article":
        return COMMENT if COMMENT in named and MAIN not in named else MAIN
    if tag in SIDE_TAGS or tag in CUT_TAGS:
        return SIDE if tag in SIDE_TAGS else CUT
    if tag not in CONTAINERS:
        advert = any(w.lower() in ADVERT_WORDS for m in _NAMES.finditer(attributes) for w in _PIECES.findall(m[2] or m[3] or m[4] or "")) if named == {CUT} else False
        return ADVERT if advert else CUT if named == {CUT} else NO
    if MAIN in named:
        return MAIN
    if tag == "header":
        return SIDE
    return next((kind for kind in (COMMENT, CUT, SIDE) if kind in named), NO)


@dataclass
class Block:
    """A run of text between block-level tags, the element it stands in, and the tags since the last one."""

    text: str
    words: int
    element: int
    linked: bool
    link_chars: int
    block_tags: int
    inline_tags: int
    features: tuple[float, ...] = ()
    cut: bool = False


@dataclass
class Page:
    """The blocks of a page in order, and its block-level elements: tag, parent, kind. The first stands for the page."""

    blocks: list[Block] = field(default_factory=list)
    tags: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [0])
    kinds: list[int] = field(default_factory=lambda: [NO])


def parse(page: str) -> Page:
    """One pass over the page. White space in a block is one space, character references are decoded."""
    out = Page()
    stack, depths, text = [0], [0], []
    opened: dict[str, int] = {}
    block_tags = inline_tags = linked = links = 0
    skip, nested, muted, at, size = "", 0, False, 0, len(page)
    last_end: dict[str, int] = {}

    def ends_later(name: str) -> bool:
        """Whether an end tag of the name is still to come; without one an element hides nothing."""
        if name not in last_end:
            last_end[name] = max((m.start() for m in re.finditer(rf"</{re.escape(name)}(?![a-z0-9-])", page, re.I)), default=-1)
        return last_end[name] >= at

    def close() -> None:
        nonlocal block_tags, inline_tags, linked
        if text:
            words = "".join(text).split()
            text.clear()
            if words:
                joined = " ".join(words)
                out.blocks.append(Block(joined, len(words), stack[-1], 2 * linked > len(joined), linked, block_tags, inline_tags))
                block_tags = inline_tags = 0
        linked = 0

    def heard(raw: str) -> None:
        nonlocal linked
        if muted:
            return
        decoded = entities.unescape(raw) if "&" in raw else raw
        text.append(decoded)
        if links:
            linked += len(decoded.strip())

    def leave(name: str, stops: frozenset) -> None:
        """Close the innermost open element of a name and all in it, unless one that it cannot end stands before."""
        nonlocal links
        for i in range(len(stack) - 1, 0, -1):
            tag = out.tags[stack[i]]
            if tag == name:
                for e in stack[i:]:
                    opened[out.tags[e]] -= 1
                links = depths[i]
                del stack[i:], depths[i:]
                return
            if tag in stops:
                return

    while at < size:
        lt = page.find("<", at)
        if not skip and (lt < 0 or lt > at):
            heard(page[at : lt if lt >= 0 else size])
        if lt < 0:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else size
            continue
        if page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt)
            at = end + 3 if end >= 0 else size
            continue
        named = _NAME.match(page, lt + 1)
        if not named and page[lt + 1 : lt + 2] not in ("!", "?", "/"):
            if not skip:
                text.append("<")
            at = lt + 1
            continue
        near = page.find(">", lt)
        if near < 0:  # no tag ends here or later
            if not skip:
                heard(page[lt:])
            break
        if not named:
            at = near + 1
            continue
        name = named[1].lower()
        if "=" in page[named.end() : near] and (whole := _ATTRIBUTES.match(page, named.end())):
            near = whole.end() - 1
        attributes, at, ending = page[named.end() : near], near + 1, page[lt + 1] == "/"
        if skip:
            if name == skip and not (attributes.endswith("/") and not ending):
                nested += -1 if ending else 1
                skip = skip if nested else ""
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in HIDDEN and not ending:
            if name in BLOCK_TAGS:
                close()
                block_tags += 1
            if name in RAW:  # nothing in them is markup
                end = re.compile(rf"</{name}\s*+>", re.I).search(page, at)
                at = end.end() if end else size if name != "textarea" else at
            elif not attributes.endswith("/") and ends_later(name):
                skip, nested = name, 1
            continue
        if name not in BLOCK_TAGS:
            inline_tags += 1
            if name == "a":
                links = max(depths[-1], links - 1) if ending else links + 1
            elif name == "button":  # what is on it is part of a form
                muted = not ending
            continue
        close()
        muted = False
        block_tags += 1
        if ending:
            if opened.get(name):
                leave(name, frozenset())
        elif name not in VOID and not attributes.endswith("/"):
            if name in OPTIONAL_END and opened.get(name):
                leave(name, STOPS)
            opened[name] = opened.get(name, 0) + 1
            out.tags.append(name)
            out.parents.append(stack[-1])
            out.kinds.append(element_kind(name, attributes))
            stack.append(len(out.tags) - 1)
            depths.append(links)
    close()
    _judge(out)
    return out


def _judge(page: Page) -> None:
    """Gives each block its features, and whether it is cut out.

    An aside by class, a form or a page header that holds the article or main element is a wrapper and no aside. So is one
    with most of the page's words (a form: with over half) if nothing outside of it is marked as the article. Comments are
    never wrappers.
    """
    n = len(page.tags)
    kinds, parents = page.kinds, page.parents
    words, holds = [0] * n, [False] * n
    chars, linked = [0] * n, [0] * n
    for b in page.blocks:
        words[b.element] += b.words
        chars[b.element] += len(b.text)
        linked[b.element] += b.link_chars
    for e in range(n - 1, 0, -1):
        words[parents[e]] += words[e]
        chars[parents[e]] += chars[e]
        linked[parents[e]] += linked[e]
        holds[parents[e]] |= holds[e] or (kinds[e] == MAIN and page.tags[e] in ("article", "main"))
    marks = [0] * n  # elements marked as the article in and below an element
    for e in range(n - 1, 0, -1):
        marks[e] += kinds[e] == MAIN
        marks[parents[e]] += marks[e]
    longest = max((words[e] for e in range(n) if page.tags[e] == "article"), default=0)
    teaser = [page.tags[e] == "article" and linked[e] > 0 and words[e] < TEASER * longest for e in range(n)]
    around = [0] * n  # the nearest list, table or container of an element
    level, tag_marked, word_marked, prose = [NO] * n, [False] * n, [False] * n, [False] * n
    tagged, worded = holds[0], False
    for e in range(1, n):
        up, kind, tag = parents[e], kinds[e], page.tags[e]
        large = words[e] > words[0] * (0.5 if tag == "form" else 0.9) and marks[0] == marks[e]
        wrapper = kind in (SIDE, CUT) and tag not in SIDE_TAGS and (holds[e] or large)
        own = NO if wrapper or kind == MAIN else CUT if kind == ADVERT else kind
        # Within the article a paragraph is cut by its class only if that names an advert.
        if kind == CUT and tag not in CONTAINERS and tag not in CUT_TAGS and (tag_marked[up] or word_marked[up]):
            own = NO
        # The header of an article is part of it.
        if tag == "header" and own == SIDE and (tag_marked[up] or word_marked[up]):
            own = NO
        around[e] = e if tag in CONTAINERS or tag in SIDE_TAGS else around[up]
        prose[e] = tag in PROSE_TAGS or (tag not in CONTAINERS and prose[up])
        level[e] = level[up] or own
        tag_marked[e] = not teaser[e] and (tag_marked[up] or (kind == MAIN and tag in ("article", "main") and not level[e]))
        word_marked[e] = word_marked[up] or (kind == MAIN and not level[e])
        worded = worded or word_marked[e]
    inner = any(tag_marked[e] and page.tags[e] == "article" for e in range(n))
    if inner:  # of main and article the article is meant
        tag_marked = [False] * n
        for e in range(1, n):
            tag_marked[e] = not teaser[e] and (tag_marked[parents[e]] or (kinds[e] == MAIN and page.tags[e] == "article" and not level[e]))
    tagged = tagged and any(tag_marked)
    run = _short_runs([b.words for b in page.blocks])
    for b, short in zip(page.blocks, run, strict=True):
        e = b.element
        inside = tag_marked[e] if tagged else word_marked[e]
        b.cut = level[e] == CUT or (inside and level[e] != NO)
        box = around[e]
        b.features = tuple(map(float, (
            level[e] == SIDE or level[e] == CUT, level[e] == COMMENT, inside and tagged, inside and not tagged, (tagged or worded) and not inside,
            prose[e], b.linked, b.words >= LONG, not inside and 2 * linked[box] > chars[box], not inside and short, not inside and b.words <= 3 * LONG and RIGHTS.match(b.text) is not None, 1,
        )))


def _short_runs(words: list[int]) -> list[bool]:
    """Whether each block is one of at least RUN short ones in a row."""
    out, begin = [False] * len(words), 0
    for i in range(len(words) + 1):
        if i == len(words) or words[i] > SHORT:
            if i - begin >= RUN:
                out[begin:i] = [True] * (i - begin)
            begin = i + 1
    return out


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, with their features."""
    return parse(page).blocks


@dataclass
class Weights:
    """What a word of each feature, a block-level tag and an inline tag add to the sum."""

    word: tuple[float, ...]
    block_tag: float
    inline_tag: float


def learn(pages=None, *, ridge: float = 0.5, rounds: int = 50) -> Weights:
    """Weights from labelled pages, each a list of (is it content, html). Words by logistic regression on their features,
    tags by the log odds of a tag against a word in content and elsewhere, below zero always."""
    x, y, n, tokens = [], [], [], np.ones((2, 3))
    for page in html_labelled.pages() if pages is None else pages:
        wanted = {b.text for kept, part in page if kept for b in blocks(part)}
        for b in blocks("".join(part for _, part in page)):
            if b.cut:
                continue
            kept = b.text in wanted
            x.append(b.features)
            y.append(float(kept))
            n.append(b.words)
            tokens[int(kept)] += (b.block_tags, b.inline_tags, b.words)
    x, y, n = np.array(x), np.array(y), np.sqrt(np.array(n, float))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (n * p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (y - p)) - ridge * w)
    shares = tokens / tokens.sum(axis=1, keepdims=True)
    odds = np.log(shares[1] / shares[0])
    return Weights(tuple(float(v) for v in w), float(min(odds[0], -0.25)), float(min(odds[1], -0.05)))


def scores(found: list[Block], weights: Weights) -> np.ndarray:
    """What the tags before each block and its words add: tags and words by turns. What is cut out adds nothing, nor do the
    tags before a block of the marked part."""
    if not found:
        return np.zeros(0)
    words = np.array([b.features for b in found]) @ np.array(weights.word) * [b.words for b in found]
    tags = np.array([(b.block_tags, b.inline_tags) for b in found]) @ np.array([weights.block_tag, weights.inline_tag])
    # Tags are no sign against a part that the page itself calls its article.
    tags = tags * np.array([not (b.features[FEATURES.index("main_tag")] or b.features[FEATURES.index("main_word")]) for b in found])
    return (np.stack([tags, words], axis=1) * np.array([[not b.cut] for b in found])).ravel()


def best_stretch(values) -> tuple[int, int]:
    """The contiguous stretch of the largest sum above zero, as (begin, end), in one scan: of equal ones that which ends
    first. (0, 0) where no sum is above zero."""
    best = total = 0.0
    begin, stretch = 0, (0, 0)
    for i, v in enumerate(values):
        if total <= 0:
            begin, total = i, 0.0
        total += v
        if total > best:
            best, stretch = total, (begin, i + 1)
    return stretch


def main_text(page: str, weights: Weights) -> str:
    """The blocks of the best stretch that are not cut out, joined by an empty line."""
    found = blocks(page)
    begin, end = best_stretch(scores(found, weights).tolist())
    return "\n\n".join(b.text for b in found[begin // 2 : (end + 1) // 2] if not b.cut)


def _extracted(weights: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py(), weights) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each page; the text is empty where nothing scores above zero.

    * a null html counts as empty; null ids and urls are kept; repeated rows stay repeated;
    * broken markup: end tags without a start are ignored, open elements end with the page, unknown tags stand within a line;
    * elements within a line (maths, ruby, pictures too) belong to their block; scripts, drawings, frames and what is on a
      button are left out without ending it;
    * pages of any length take time in proportion to it; of stretches of equal sum the first counts;
    * an empty table gives an empty result; further columns are ignored.
    """
    common.ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), common.string_or_empty("html").alias("html"))
    found = rows.mapInArrow(_extracted(weights or learn()), "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
