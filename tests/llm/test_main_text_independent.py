"""Main text against texts that do not come from the parser under test: written by hand, or by the standard library's parser
from the article elements of the tables."""

import html as entities
import re
from html.parser import HTMLParser

import pandas as pd
import pytest

from tidemark.llm import html, queries

WEIGHTS = html.learn()
T = "The committee met on Tuesday to discuss the plans for the bridge, which had been delayed twice before."
P = f"<p>{T}</p>"
TEASER = "<article><h2><a href=/n>Next story</a></h2><p>A short teaser of it.</p></article>"
PAGES = {
    "<p>Hello <svg/> world of many words that go on and on here.</p>": ["Hello world of many words that go on and on here."],
    "<p>Before <script>var x='<p>';</script>after <button>Click</button>the <ruby>漢<rt>kan</rt></ruby> and <picture><source><img></picture>end of it.</p>": ["Before after the 漢kan and end of it."],
    "<article><p>The area is <math><mi>a</mi><mo>=</mo><mn>2</mn><annotation>a=2</annotation></math> metres.</p></article>": ["The area is a=2 metres."],
    "<article><p>a <svg><g><svg><text>no</text></svg></g><text>no</text></svg>b <canvas>no</canvas>c</p></article>": ["a b c"],
    "<article><p>Text <svg>never closed and the text goes on.</p><p>More <object>of it.</p></article>": ["Text never closed and the text goes on.", "More of it."],
    "<article><p>one <x-term>custom</x-term> word, <label>two</label></p><p><b><i><u><em>x</em></u></i></b></p></article>": ["one custom word, two", "x"],
    f'<article>{P}<p class="alert">The dam broke at nine and the water came.</p><p class="ad">Buy it now.</p>{P}</article>': [T, "The dam broke at nine and the water came.", T],
    f"<ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li><li><a href=/c>Contact</a></li></ul><div><h1>A title</h1>{P * 3}</div><p>© 2024 Example Company</p>": ["A title", T, T, T],
    f"<div><a href=/>Home</a> <a href=/a>About</a></div><div>{P * 3}</div><p>Copyright 2024 by us. All rights reserved.</p>": [T, T, T],
    f"<table><tr><td><a href=/>Home</a><td><a href=/a>News</a><td><a href=/b>Help</a></table>{P * 2}<ul><li><a href=/>Terms</a><li><a href=/p>Privacy</a></ul>": [T, T],
    f"<article>{P * 4}</article>{TEASER}{TEASER}": [T] * 4,
    f"<article>{P}<ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li><li><a href=/3>Three</a></li></ul>{P}</article>": [T, "One", "Two", "Three", T],
    f"<article>{P}<p>© is a sign that the law does not ask for any more.</p></article>": [T, "© is a sign that the law does not ask for any more."],
    "<article>one<hr>two<br>three<img>four &amp;&#x41;&nbsp;five<!-- no --></article>": ["one", "two threefour &A five"],
}


@pytest.mark.parametrize("page", PAGES)
def test_by_hand(page):
    assert html.main_text(page, WEIGHTS) == "\n\n".join(PAGES[page])


class Article(HTMLParser):
    """The blocks of a page's first article element but for adverts and notices in it."""

    BREAKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "table", "tr", "td", "th", "blockquote", "section", "article", "figure", "figcaption", "pre", "aside", "form", "hr", "dl", "dt", "dd", "header", "footer", "nav"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.out, self.now, self.cut = 0, [], [], []

    def end(self):
        said = " ".join("".join(self.now).split())
        self.now = []
        if said:
            self.out.append(said)

    def handle_starttag(self, tag, attrs):
        if tag in self.BREAKS:
            self.end()
        if tag == "article":
            self.inside += 1
        elif self.cut:
            self.cut += [tag] * (tag == self.cut[0])
        elif tag in ("script", "style", "form", "aside", "nav", "button") or re.search(r"\b(ad|cookie|share|newsletter|related|promo)\b", dict(attrs).get("class") or ""):
            self.cut = [tag]
        elif tag == "br":
            self.now.append(" ")

    def handle_endtag(self, tag):
        if tag in self.BREAKS:
            self.end()
        if self.cut and tag == self.cut[0]:
            self.cut.pop()
        elif tag == "article":
            self.inside -= 1

    def handle_data(self, data):
        if self.inside and not self.cut:
            self.now.append(data)


def test_pages_of_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    wanted = {}
    for page in pd.read_parquet(f"{folder}/pages.parquet").itertuples():
        parser = Article()
        parser.feed(page.html)
        parser.end()
        wanted[page.page_id] = "\n\n".join(parser.out)
    got = queries.QUERIES["op6_main_text"](spark, folder).collect()
    assert {r.page_id: r.text for r in got} == wanted and all(r.n_chars == len(r.text) for r in got)
    assert all(entities.unescape(t) == t or "&" in t for t in wanted.values()) and min(map(len, wanted.values())) > 0
