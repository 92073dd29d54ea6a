import html
import math
import re
from collections import Counter, defaultdict

import pytest

from seriesloom.llm import htmlextract
from seriesloom.llm.htmlextract import Page, extract, host_of, importance, style_nodes


@pytest.mark.parametrize(
    "source,want",
    [
        (None, ""),
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<article>a <b>b</b>c<br>d<p>e\n f</p></article><footer>x</footer>", "a bc d e f"),
        ('<nav>n</nav><div class="ad">x</div><article>t&nbsp;u</article>', "t u"),
        ('<body><div class="sidebar-left">s</div><p>one</p><p>two</p><form>f<input></form></body>', "one two"),
        ('<main><p>m</p><section id="comments"><article class="comment">c</article></section></main>', "m"),
        ('<article><header><h1>T</h1></header><p>x</p><aside>no</aside><script>var a="</p>";</script></article>', "T x"),
        ("<article><p>a<!-- <p>hid</p> -->b</p>", "ab"),
        ("<article>cut &am", "cut &am"),
        ("<article>2 < 3 <p>ok</p", "2 < 3 ok"),
        ('<article>x<p class="cookie-notice">no<p>yes</article>', "x yes"),
        ('<article>x<p title="a>b">y</p></article>', "x y"),
        ('<div class="header">h</div><div class="content">c</div>tail', "c tail"),
        ('<article><div class="article-header"><h1>T</h1></div><p>x</p></article>', "T x"),
        ('<article><p>a</p><section class="discussion"><p>b</p></section><div id="register-map">c</div></article>', "a b c"),
        ('<body><p>lead</p><div class="post">story</div></body>', "lead story"),
        ('<body><div class="site-header">h</div><div class="post"><div class="post-header">H</div>t<div class="comment-list">c</div></div><div id="page-footer">f</div></body>', "H t"),
        ('<div class="ad">x<p>y</div><p class="promo">z<div>kept</div>', "kept"),
        ("<ARTICLE>U<STYLE>p{}</STYLE>V</ARTICLE>", "UV"),
        ('<p title="never closed>a<p>b', "a b"),
    ],
)
def test_cases(source, want):
    assert Page(source).text() == want


def test_deep_and_long_pages_stay_small():
    assert Page("<div>" * 30000 + "x").text() == "x"
    assert len(Page("<article>" + "<p>word</p>" * 100000).text()) == 5 * 100000 - 1
    assert Page("<" * 50000).text() == "<" * 50000


def test_hosts():
    assert [host_of(u) for u in (None, "x", "http://A.b:80/c", "http://[bad")] == ["", "", "a.b", ""]


def site(n, host="h.example"):
    return [(i, f"http://{host}/{i}", f'<body><div class="xa"><p>Same line for all.</p></div><div class="xb"><p>Own words {i} and {i * 7}.</p></div></body>') for i in range(n)]


def plain_importance(pages):
    """(host, key) -> (pages, importance), page by page and node by node."""
    seen = defaultdict(set)
    for _, url, source in pages:
        page = Page(source)
        for key, look, content in page.facts():
            seen[host_of(url), key].add((tuple(t for _, t in page.blocks), look, content))
    out = {}
    for node, rows in seen.items():
        m = len(rows)

        def entropy(i, rows=rows, m=m):
            return -sum(c / m * math.log(c / m, m) for c in Counter(r[i] for r in rows).values()) if m > 1 else 1.0

        w = 0.9 ** len({r[1] for r in rows})
        out[node] = (m, (m * ((1 - w) * entropy(1) + w * entropy(2)) + 2) / (m + 2))
    return out


def varied(n, host):
    """Pages without an article element: a line of every page, a menu of three, a
    box that is on half of them, and words of their own."""
    for i in range(n):
        box = "<section><h4>Box</h4></section>" if i % 2 else ""
        yield i, f"http://{host}/{i}", f'<body><div class="xa"><p>Same line.</p></div><ul class="m{i % 3}"><li>one<li>two</ul>{box}<div class="xb"><h1>T {i}</h1><p>Own {i}.<p>More {i * i}.</div></body>'


def test_style_tree_against_a_plain_computation(spark):
    rows = [*varied(30, "a.example"), *site(20), *site(3, "few.example"), *varied(1, "one.example")]
    df = spark.createDataFrame(rows + rows[:4], "page_id long, url string, html string")
    found = {(r.host, r.path): (r.pages, r.importance) for r in importance(style_nodes(df)).collect()}
    want = plain_importance(rows)
    assert found.keys() == want.keys()
    assert all(found[k][0] == want[k][0] and found[k][1] == pytest.approx(want[k][1]) for k in want)
    for r in extract(df).collect():
        worth = {k: v for (host, k), (_, v) in want.items() if host == host_of(r.url)}
        assert r.text == Page(dict((row[1], row[2]) for row in rows)[r.url]).text(worth) and r.n_chars == len(r.text)


def test_importance_decides_without_articles(spark):
    df = spark.createDataFrame([*varied(30, "a.example"), *site(20), *site(3, "few.example")], "page_id long, url string, html string")
    for r in extract(df).collect():
        if "a.example" in r.url:
            assert r.text == f"T {r.page_id} Own {r.page_id}. More {r.page_id**2}."
        else:
            same = "" if "h.example" in r.url else "Same line for all. "
            assert r.text == f"{same}Own words {r.page_id} and {r.page_id * 7}."


def test_an_article_that_is_the_same_everywhere_is_no_article(spark):
    rows = [(i, f"http://h/{i}", f"<body><article>Please enable scripts.</article><div><p>Page {i}</p></div></body>") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert all(r.text == f"Page {r.page_id}" for r in extract(df).collect())


def test_joined_tables_say_what_broadcast_ones_say(spark, monkeypatch):
    df = spark.createDataFrame([*varied(30, "a.example"), *site(20)], "page_id long, url string, html string")
    want = sorted(map(tuple, extract(df).collect()))
    monkeypatch.setattr(htmlextract, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, extract(df).collect())) == want


def test_odd_rows(spark):
    rows = [(1, None, None, 5), (1, None, None, 5), (2, "::", "<article>a</article>", 5), (None, "http://x/", "<p>b", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    assert sorted(((r.page_id, r.text, r.n_chars) for r in extract(df).collect()), key=str) == sorted([(1, "", 0), (1, "", 0), (2, "a", 1), (None, "b", 1)], key=str)
    assert extract(df.limit(0)).count() == 0


def test_article_of_every_page(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extract(df).collect()}
    for r in df.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        plain = re.sub(r"<[^>]*(?:>|$)", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inner)
        assert got[r.page_id] == " ".join(html.unescape(plain).split())
