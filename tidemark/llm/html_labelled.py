"""Labelled pages, made by rule for this library: each is a list of (is it content, html).

Every page is put together from the parts of a layout: how the article is marked (or not at all), what stands before and
after it, and what interrupts it. Words are invented from syllables, so that only the layout tells content from the rest.
"""

from __future__ import annotations

import random
import re

_SYLLABLES = ("ba", "ri", "to", "len", "mu", "sa", "ke", "vor", "ni", "pal", "dro", "shi", "em", "ulo", "cha", "wi")
#: How an article may be marked: before it, after it. The last ones are not marked at all.
_FRAMES = (
    ("<article>", "</article>"), ('<article class="post tag-river tags">', "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"), ('<div role="main">', "</div>"),
    ('<div class="content">', "</div>"), ('<div id="main"><div class="entry-content">', "</div></div>"), ('<div class="post-tags entry">', "</div>"), ('<form id="pageForm"><div><article>', "</article></div></form>"),
    ("<div><div>", "</div></div>"), ("<div>", "</div>"), ("<section>", "</section>"), ("<table><tr><td>", "</td></tr></table>"), ("", ""),
)
#: So many of them are marked.
_MARKED = 9


def _words(rng: random.Random, least: int, most: int) -> str:
    out = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(least, most))]
    out[0] = out[0].capitalize()
    return " ".join(out)


def _prose(rng: random.Random, plain: bool) -> str:
    """A paragraph of an article, a heading, a quotation or a list; without paragraphs of its own if ``plain``."""
    text = _words(rng, 12, 60) + "."
    if rng.random() < 0.4:
        at = text.index(" ")
        text = text[:at] + rng.choice((" <b>{}</b>", " <a href='/x'>{}</a>", " <em>{}</em>,<br>")).format(_words(rng, 1, 2)) + text[at:]
    if plain:
        return f"<div>{text}</div>"
    kind = rng.random()
    if kind < 0.1:
        return f"<h2>{_words(rng, 2, 6)}</h2>"
    if kind < 0.2:
        return "<ul>" + "".join(f"<li>{_words(rng, 3, 12)}</li>" for _ in range(rng.randint(2, 4))) + "</ul>"
    if kind < 0.25:
        return f"<blockquote>{text}</blockquote>"
    return f"<p>{_words(rng, 1, 4)}.</p>" if kind < 0.35 else f"<p>{text}</p>"


def _aside(rng: random.Random, kind: str) -> str:
    """What does not belong to an article."""
    links = "".join(f'<li><a href="/{i}">{_words(rng, 1, 5)}</a></li>' for i in range(rng.randint(2, 6)))
    said, much = f"<p>{_words(rng, 4, 25)}.</p>", "".join(f"<p>{_words(rng, 8, 40)}.</p>" for _ in range(rng.randint(1, 4)))
    return {
        "menu": rng.choice((f"<nav><ul>{links}</ul></nav>", f'<div class="menu"><ul>{links}</ul></div>', f'<div role="navigation"><ul>{links}</ul></div>')),
        "header": rng.choice((f"<header><div>{_words(rng, 1, 3)}</div>{said}</header>", f'<div id="header"><h1>{_words(rng, 1, 3)}</h1>{said}</div>')),
        "footer": rng.choice((f"<footer>{_words(rng, 4, 20)}</footer>", f'<div class="site-footer"><p>{_words(rng, 4, 20)}</p></div>')),
        "sidebar": rng.choice((f"<aside><h3>{_words(rng, 1, 3)}</h3>{much}</aside>", f'<div class="sidebar">{much}<ul>{links}</ul></div>', f'<div class="related"><ul>{links}</ul></div>')),
        "notice": rng.choice((f'<div class="cookie-notice">{said}<button>OK</button></div>', f'<div role="alert">{said}</div>')),
        "advert": rng.choice((f'<div class="ad">{_words(rng, 4, 25)}</div>', f'<div class="advert-box">{said}</div>', f'<div class="sponsored">{much}</div>')),
        "form": f'<form action="/join"><label>{_words(rng, 1, 3)}</label><input name="e">{said}<button>{_words(rng, 1, 1)}</button></form>',
        "unmarked": rng.choice((much, f"<div>{much}</div>", f"<div>{_words(rng, 2, 12)}</div>")),
        "bare_menu": rng.choice((f"<ul>{links}</ul>", f"<div>{' '.join(re.findall('<a.*?</a>', links))}</div>", f"<table><tr>{links.replace('li>', 'td>')}</tr></table>", f"<div><p>{_words(rng, 1, 3)}</p><ul>{links}</ul></div>")),
        "bare_footer": rng.choice((f"<p>© 2024 {_words(rng, 2, 10)}.</p>", f"<div>Copyright {_words(rng, 2, 8)}. All rights reserved.</div>", f"<div><ul>{links}</ul><p>© {_words(rng, 1, 5)}</p></div>", f"<p>{_words(rng, 1, 3)}. All rights reserved.</p>")),
        "comments": rng.choice((f'<section id="comments"><h3>{_words(rng, 1, 2)}</h3><div class="comment">{much}</div></section>', f'<div class="comments-area"><article class="comment-body">{much}</article></div>')),
    }[kind]


def _page(rng: random.Random, frame: int) -> list[tuple[bool, str]]:
    opening, closing = _FRAMES[frame]
    body = rng.choice(("<body>", '<body class="has-sidebar">', '<body class="page social-science">'))
    before = "".join(_aside(rng, k) for k in ("notice", "header", "menu", "sidebar", "advert") if rng.random() < 0.5)
    after = "".join(_aside(rng, k) for k in ("comments", "sidebar", "form", "footer") if rng.random() < 0.6)
    if frame < _MARKED and rng.random() < 0.5:
        before, after = rng.choice(((_aside(rng, "unmarked") + before, after), (before, _aside(rng, "unmarked") + after), (before, after + _aside(rng, "unmarked"))))
    parts = [(False, f"<!DOCTYPE html><html><head><title>{_words(rng, 1, 4)}</title><style>p{{}}</style></head>{body}{before}{opening}")]
    if rng.random() < 0.5:
        before += _aside(rng, "bare_menu")
    if rng.random() < 0.5:
        after += rng.choice(("", _aside(rng, "bare_menu"))) + _aside(rng, "bare_footer")
    plain = frame >= _MARKED and rng.random() < 0.5
    if not plain and rng.random() < 0.8:
        parts.append((True, f"<h1>{_words(rng, 1, 8)}</h1>"))
    for _ in range(rng.randint(1, 8)):
        parts.append((True, _prose(rng, plain)))
        if rng.random() < 0.12:
            parts.append((False, _aside(rng, rng.choice(("advert", "form", "advert")))))
    return [*parts, (False, closing + after + "</body></html>")]


def pages(seed: int = 17, per_frame: int = 8) -> list[list[tuple[bool, str]]]:
    """``per_frame`` pages of each way to mark an article, the same for every seed."""
    rng = random.Random(seed)
    return [_page(rng, frame) for frame in range(len(_FRAMES)) for _ in range(per_frame)]
