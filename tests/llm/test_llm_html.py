"""Extraction of main text: parser, field and query."""

import itertools
import re
import time
from html import unescape

import numpy as np
import pytest

from corpusgauge.llm import html_extract
from corpusgauge.llm.dom_blocks import blocks
from corpusgauge.llm.page_layouts import draw_page
from corpusgauge.llm.queries import QUERIES


@pytest.fixture(scope="module")
def field(spark):
    return html_extract.fit(html_extract.labelled_pages(spark))


def texts(html):
    return [b.text for b in blocks(html)]


def test_blocks_of_careless_markup():
    assert texts("") == [] and texts("just text &amp; more") == ["just text & more"]
    assert texts("<p>one<p>two<br>three</p> four") == ["one", "two three", "four"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert [b.path for b in blocks("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>")][2:] == [">ul>li>ul>li", ">ul>li"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>d") == ["a", "b", "c", "d"]
    assert texts('x<script>var t="</p><p>y";</script><style>p{}</style><!-- <p>z</p> -->w') == ["xw"]
    assert texts("<title>t</title><textarea>u</textarea><noscript><p>v</p></noscript><p>w") == ["w"]
    assert texts("<p>a &lt;b&gt; &#233; &eacute; &amp &am &nbsp;c") == ["a <b> é é & &am c"]
    # references do not reach across tags
    assert texts("<p>&am<b>p;</b>") == ["&amp;"]
    # tags cut off by the end of the page, comments and scripts that never end
    assert texts("<p>a</p>b <div class='x") == ["a", "b"]
    assert texts("<p>a<!-- b <p>c") == ["a"] and texts("<p>a<script>b <p>c") == ["a"]
    assert texts("<p title='>'>a</p><p title=\"it's\">b</p><p title='open>c") == ["a", "b", "c"]
    assert texts("<DIV CLASS=ad>a</DIV>") == ["a"] and blocks("<DIV CLASS=ad>a</DIV>")[0].path == ">div.ad"
    assert texts("a < b and c > d") == ["a < b and c > d"]
    b = blocks('<li><a href="/x">four</a> more</li>')[0]
    assert (b.linked, b.links) == (4, 1)


def test_parsing_takes_linear_time():
    for piece in ("<p>word ", "<a \"", "<div class='", "<!-- ", "a<b ", "</p>", "<ul><li>x"):
        begin = time.time()
        blocks(piece * 40_000)
        assert time.time() - begin < 10, piece


def brute_likelihood(w, page):
    """Log-likelihood by enumerating all labellings."""
    features, sizes, y = page
    at = np.concatenate([[0], np.cumsum(sizes)])
    score = [sum(w[f] for f in features[a:b]) for a, b in zip(at[:-1], at[1:])]
    step = w[html_extract.SIZE :].reshape(2, 2)

    def total(labels):
        return sum(s for s, v in zip(score, labels) if v) + sum(step[a, b] for a, b in zip(labels, labels[1:]))

    every = [total(v) for v in itertools.product((0, 1), repeat=len(y))]
    return total(y.tolist()) - np.logaddexp.reduce(every), every


def test_likelihood_gradient_and_viterbi_equal_enumeration():
    rng = np.random.default_rng(4)
    w = rng.normal(0, 1, html_extract.SIZE + 4)
    pages = []
    for n in (1, 2, 5, 7):
        sizes = rng.integers(1, 5, n)
        pages.append((rng.integers(0, 50, sizes.sum()), sizes, rng.integers(0, 2, n)))
    value, grad = html_extract.likelihood(w, pages)
    assert abs(value - sum(brute_likelihood(w, p)[0] for p in pages)) < 1e-8
    for i in [*range(0, 50, 7), *range(html_extract.SIZE, html_extract.SIZE + 4)]:
        up, down = w.copy(), w.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        slope = (html_extract.likelihood(up, pages)[0] - html_extract.likelihood(down, pages)[0]) / 2e-5
        assert abs(slope - grad[i]) < 1e-5
    field = html_extract.Field(w)
    for p in pages:
        at = np.concatenate([[0], np.cumsum(p[1])])
        score = [float(sum(w[f] for f in p[0][a:b])) for a, b in zip(at[:-1], at[1:])]
        best = np.argmax(brute_likelihood(w, p)[1])
        want = list(itertools.product((False, True), repeat=len(score)))[best]
        assert tuple(field.decode(score)) == want
    assert field.decode([]) == []


def test_held_out_pages(field):
    extract, same, right, total = html_extract.main_text(field), 0, 0, 0
    for i in range(900_000, 900_300):
        html, want = draw_page(i)
        page = blocks(html)
        label = html_extract.align(page, want)
        assert sum(label) == len(want.split("\n")) if want else not sum(label)
        same += extract(html) == want
        got = html_extract.align(page, extract(html))
        right += sum(a == b for a, b in zip(label, got))
        total += len(label)
    assert right / total > 0.99
    assert same > 285


PAGES = {
    "semantic": (
        """<html><head><title>A</title></head><body><header><h1>The Daily</h1><p>News of the day, every day.</p></header>
        <nav><a href=/>Home</a> <a href=/a>World</a></nav><div class="cookie-notice"><p>We use cookies, as others do, to improve your visit.</p></div>
        <main><article><h1>Rain in spring</h1><p>It rained for a week, and the river rose.</p>
        <aside><h3>Related</h3><ul><li><a href=/b>Snow in winter, a long report</a></li></ul></aside>
        <p>Then it stopped.</p><ul><li>Monday: wet</li><li>Tuesday: wet</li></ul></article>
        <section class="comments" id="comments"><h2>Comments</h2><div class="comment"><p>I was there, and it was wet indeed.</p></div></section></main>
        <form action=/s><label>Search</label><input><button>Go</button></form><footer><p>&copy; 2020 The Daily. All rights reserved.</p></footer></body></html>""",
        "Rain in spring\nIt rained for a week, and the river rose.\nThen it stopped.\nMonday: wet\nTuesday: wet",
    ),
    "divisions": (
        """<body><div id="header"><div class="logo">Garden</div></div><ul class="menu"><li><a href=/>Home</a><li><a href=/x>Plants</a></ul>
        <div class="sidebar"><h3>Popular</h3><p>Ten roses that grow anywhere, even in shade.</p></div>
        <div class="post-content"><h2>Pruning &amp; care</h2><p>Cut old wood in March. Keep the young shoots.<p>Water well.
        <div class="ad">Buy tools today, at half the price.</div><p>Wait.</div>
        <div id="comments"><h3>Leave a reply</h3><p>Thank you, this helped me a lot with my garden.</p></div>
        <div class="footer">Copyright Garden</div></body>""",
        "Pruning & care\nCut old wood in March. Keep the young shoots.\nWater well.\nWait.",
    ),
    "menus only": ("<body><nav><ul><li><a href=/>Home</a></li></ul></nav><footer>&copy; x</footer></body>", ""),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_pages_of_other_make(field, name):
    html, want = PAGES[name]
    assert html_extract.main_text(field)(html) == want


def article_of(html):
    """The article element of a given page, by plain replacement."""
    m = re.search(r"<article>(.*)</article>", html or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", m.group(1)) if m else []
    lines = [" ".join(unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts]
    return "\n".join(x for x in lines if x)


def test_query_equals_the_articles_of_the_given_pages(spark):
    sf_dir = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = QUERIES["op13_html_extraction"](spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        want = article_of(pages[r["page_id"]]["html"])
        assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], want, len(want))


def test_odd_pages(spark, field):
    long = "<article>" + "<p>word word, word.</p>" * 20_000 + "</article>"
    rows = [(1, None, "u"), (2, "", None), (None, "<p>", "w"), (4, long, "x"), (4, long, "x"), (5, " \n", "y"), (6, "<article><p>a.</p>", "z")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = html_extract.extract_text(df, field, to="main")
    assert got.columns == ["page_id", "text", "main"]
    out = sorted(((r["page_id"] or 0, len(r["main"])) for r in got.collect()))
    size = len("word word, word.") * 20_000 + 19_999
    assert out == [(0, 0), (1, 0), (2, 0), (4, size), (4, size), (5, 0), (6, 2)]
    # the result may take the place of a column
    assert html_extract.extract_text(df, field).columns == ["page_id", "text"]
    none = spark.createDataFrame([], "page_id long, html string, text string")
    assert html_extract.extract_text(none, field).collect() == []
    # a table without labelled pages trains a field that keeps nothing
    empty = html_extract.fit(spark.createDataFrame([(None, None), ("", "x")], "html string, main_text string"))
    assert html_extract.main_text(empty)("<p>a</p>") == ""
