"""Main text: ordinary markup, the scan against brute force, layouts not learned from, time in proportion to the page."""

import random
import re
import time

import duckdb
import numpy as np
import pytest

from tidemark.llm import html, html_labelled

P = "<p>The committee met on Tuesday to discuss the plans for the bridge, which had been delayed twice before.</p>"
T = P[3:-4]
WEIGHTS = html.learn()
PAGES = {
    f'<body class="has-sidebar"><article>{P}</article></body>': [T],
    f'<body class="page social-science"><main>{P}</main></body>': [T],
    f'<article class="post tag-news tags">{P}</article>': [T],
    f'<div class="post-tags entry">{P}</div>': [T],
    f'<form id="aspnetForm"><article>{P}</article></form>': [T],
    f'<body><form id="aspnetForm"><div>{P}</div></form></body>': [T],
    "<div>text</div>": ["text"],
    "<div>text of a plain page</div><div>more text in it</div>": ["text of a plain page", "more text in it"],
    f'<article>{P}<p class="legal">This is legal.</p>{P}</article>': [T, "This is legal.", T],
    # A long sidebar, and a comment that nothing marks.
    f'<article><p>Short.</p></article><div class="sidebar">{P * 20}</div><p>Some comment that nobody asked for, in plain words.</p>': ["Short."],
    f'<div>{P}</div><div class="ad">{P * 5}</div><div><p>The end of it.</p></div>': [T, "The end of it."],
    f'<article>{P}</article><div class="comments-area"><article class="comment-body">{P * 5}</article></div>': [T],
    f'<div class="site"><header class="site-header"><h1>Site</h1></header><div class="elementor-widget-container">{P}</div><footer>foot</footer></div>': [T],
    f'<main><nav><a href="/">menu</a></nav><h1>Title</h1>{P}<aside>beside the point</aside><p>last</p></main>': ["Title", T, "last"],
    "<p>it's <a title=don't>x</a> and it's fine</p>": ["it's x and it's fine"],
    f'<div class="related-story">{P}</div><div class="story">{P}<p>Only this.</p></div>': [T, "Only this."],
    f'<article><header><h1>Own header</h1></header>{P}</article>': ["Own header", T],
    f'<article>{"".join(f"<p>{w}</p>" for w in "one two three".split())}<div><div><div><p>four</p></div></div></div></article>': ["one", "two", "three", "four"],
    "<nav><p>only a menu with words in it</p></nav>": [],
}


@pytest.mark.parametrize("page", PAGES)
def test_ordinary_markup(page):
    assert html.main_text(page, WEIGHTS) == "\n\n".join(PAGES[page])


def test_the_scan_is_the_best_of_all_stretches():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 40):
        for _ in range(60):
            values = rng.normal(-0.2, 1, n).round(1).tolist() if rng.random() < 0.8 else rng.integers(-2, 3, n).tolist()
            begin, end = html.best_stretch(values)
            sums = [sum(values[a:b]) for a in range(n) for b in range(a + 1, n + 1)]
            assert sum(values[begin:end]) == pytest.approx(max([0, *sums]))
            assert (begin, end) == (0, 0) or sum(values[begin:end]) > 0


def test_no_score_is_clipped():
    found = html.blocks(f"<div><nav>{'word ' * 5000}</nav>{'<div>' * 30}{P}</div>")
    got = html.scores(found, WEIGHTS)
    assert got[1] == pytest.approx(5000 * np.dot(WEIGHTS.word, found[0].features)) and got[1] < -10_000
    assert got[2] == pytest.approx(WEIGHTS.block_tag * found[1].block_tags) and found[1].block_tags > 30


def test_layouts_of_other_seeds():
    right = total = 0
    for page in html_labelled.pages(seed=99, per_frame=12):
        wanted = [b.text for kept, part in page if kept for b in html.blocks(part)]
        right, total = right + (html.main_text("".join(part for _, part in page), WEIGHTS).split("\n\n") == wanted), total + 1
    assert right / total > 0.95


def test_pages_of_the_tables_are_their_article():
    for (page,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        article = re.search(r"<article>.*</article>", page, re.S)
        assert html.main_text(page, WEIGHTS) == "\n\n".join(b.text for b in html.blocks(article[0]) if not b.cut)


@pytest.mark.parametrize("page", ["<a " * 200_000, '<a "' * 200_000, "<a x='" * 100_000 + ">", "<" * 200_000, "<div>" * 100_000, "<p>x" * 50_000, "<table><tr><td>" * 20_000 + "</p>" * 20_000, "<b>" * 100_000 + "x", "<x-y>" * 30_000 + "<p>x" * 30_000])
def test_time_is_in_proportion(page):
    began = time.perf_counter()
    html.main_text(page, WEIGHTS)
    assert time.perf_counter() - began < 10


def test_words_of_the_result_are_words_of_the_page():
    rng = random.Random(4)
    tags = ["<div>", "</div>", "<p>", "</p>", "<nav>", "</nav>", "<article>", "</article>", "<b>", "<!-- x -->", "<form>", "</form>", "&amp;", "<", ">", '<div class="ad">', "<li>", "<td>", "<script>", "</script>"]
    for _ in range(300):
        parts = [rng.choice(tags) if rng.random() < 0.5 else f"w{i} " for i in range(60)]
        text = html.main_text("".join(parts), WEIGHTS)
        assert [w for w in re.findall(r"w\d+", text)] == sorted(set(re.findall(r"w\d+", text)), key=lambda w: int(w[1:]))
