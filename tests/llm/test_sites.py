"""Main text of pages: whole given tables, sites without named articles, and hostile markup."""

from __future__ import annotations

import html
import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from maskframe.llm import sites
from maskframe.llm.queries import op12_main_text

SCHEMA = "page_id long, url string, html string"


def article_text(source):
    """The given pages are flat: an article of headings and paragraphs."""
    found = re.search(r"<article>(.*?)</article>", source or "", re.S)
    blocks = re.split(r"</?(?:p|h1)>", found[1]) if found else []
    said = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks)
    return "\n\n".join(b for b in said if b)


def alone(source):
    """The text of a page of which no other page of its site is known."""
    _, nodes, blocks = sites.site_tree(sites.Page(source), "h")
    return sites.main_text([[up, node, weight, kind] for up, node, _, weight, kind in nodes], blocks, {})


def texts(df):
    return {r.page_id: r.text for r in df.collect()}


def test_query_against_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r for r in op12_main_text(spark, sf).collect()}
    assert len(got) == len(pages)
    for p in pages:
        assert got[p.page_id].text == article_text(p.html) and got[p.page_id].url == p.url
        assert got[p.page_id].n_chars == len(article_text(p.html))


def soup(i, rnd, said):
    """A page of a site that names nothing: the same frame around other paragraphs."""
    body = "".join(f'<div class="t"><p>{s}</p></div>' for s in said)
    links = "".join(f"<li><a href='/{k}'>Part {k}</a></li>" for k in range(5))
    return f"""<html><body><div class="x1"><ul>{links}</ul></div><div class="x2"><div>Welcome to our site! {i} visitors today.</div></div>
    <div class="x3">{body}</div><div class="x4"><p>We use what you tell us.</p><p>All rights reserved, {2000 + i % 20}</p></div></body></html>"""


def test_a_site_without_named_parts(spark):
    rnd = random.Random(1)
    vocabulary = [f"wort{i}" for i in range(500)]
    rows, want = [], {}
    for i in range(40):
        said = [" ".join(rnd.choices(vocabulary, k=12)) for _ in range(3)]
        rows.append((i, f"https://soup.example.com/{i}", soup(i, rnd, said)))
        want[i] = "\n\n".join(said)
    # one page of another host looks the same, but nothing is known of its site
    rows.append((100, "https://other.example.com/1", soup(1, rnd, ["one two three"])))
    # thousands of copies of one page count as one
    rows += [(200 + i, "https://copies.example.com/", soup(7, rnd, ["copied text"])) for i in range(30)]
    got = texts(sites.extract(spark.createDataFrame(rows, SCHEMA)))
    assert {i: got[i] for i in want} == want
    assert "one two three" in got[100] and "Welcome to our site! 1 visitors today." in got[100]
    assert all("copied text" in got[200 + i] for i in range(30))


def test_a_site_with_several_named_articles(spark):
    """Of the articles that a page names those go that its site's pages have in common; copies of a whole page keep all."""
    rnd = random.Random(4)
    vocabulary = [f"wort{i}" for i in range(500)]

    def cards(i, said, card):
        return f"<body><nav>{i} online</nav><div class='w'><article><h1>{said[0]}</h1><p>{said[1]}</p></article><article><p>{card}</p><ul><li>{i} of us</li></ul></article></div></body>"

    rows, want = [], {}
    for i in range(40):
        said = [" ".join(rnd.choices(vocabulary, k=9)) for _ in range(2)]
        rows.append((i, f"https://cards.example.com/{i}", cards(i, said, "Join our readers today.")))
        want[i] = "\n\n".join(said)
    # pages that differ in a number alone, a page alone, and second articles that differ
    rows += [(100 + i, "https://copies.example.com/", cards(i, ["one", "two"], "three")) for i in range(30)]
    rows.append((200, "https://alone.example.com/", cards(1, ["one", "two"], "three")))
    rows += [(300 + i, "https://both.example.com/", cards(i, [f"a{chr(97 + i)}", "b"], f"c{chr(97 + i)}")) for i in range(20)]
    got = texts(sites.extract(spark.createDataFrame(rows, SCHEMA)))
    assert {i: got[i] for i in want} == want
    assert all(got[100 + i] == f"one\n\ntwo\n\nthree\n\n{i} of us" for i in range(30))
    assert got[200] == "one\n\ntwo\n\nthree\n\n1 of us"
    assert all(got[300 + i] == f"a{chr(97 + i)}\n\nb\n\nc{chr(97 + i)}\n\n{i} of us" for i in range(20))


def test_importance_against_entropy(spark):
    """The table of importances against the definition, over the trees of all pages."""
    rnd = random.Random(2)
    rows = [(i, f"http://h{i % 3}.example.com/", soup(i, rnd, [rnd.choice("abc") * 3] * rnd.randint(1, 2))) for i in range(60)]
    seen, styles = {}, {}
    for _, url, source in rows:
        layout, nodes, _ = sites.site_tree(sites.Page(source), url.split("/")[2])
        for _, node, style, _, _ in nodes:
            seen.setdefault((layout, node), {}).setdefault(style, set()).add(source)
    for key, by in seen.items():
        sizes = [len(pages) for pages in by.values()]
        m = sum(sizes)
        if m >= sites.MIN_PAGES:
            styles[key] = (sum(-n / m * math.log(n / m, m) for n in sizes), len(sizes))
    got = {(r.layout, n.node): (n.importance, n.styles) for r in sites.site_importance(spark.createDataFrame(rows, SCHEMA)).collect() for n in r.nodes}
    assert got.keys() == styles.keys() and len(got) > 20
    assert all(got[k][1] == styles[k][1] and abs(got[k][0] - styles[k][0]) < 1e-9 for k in got)
    assert Counter(round(v[0], 2) == 0 for v in got.values())[True] > 10


def test_hot_layouts_are_spread(spark, monkeypatch):
    """Every page meets its layout's importances, whatever part it is dealt to."""
    rnd = random.Random(3)
    rows = [(i, f"https://h{min(i % 7, 2)}.example.com/{i}", soup(i, rnd, [f"{rnd.choice('abcdefgh')}{chr(97 + i % 26)}{chr(97 + i // 26)} is said here"])) for i in range(200)]
    rows += [(200 + i, "https://copies.example.com/same", soup(1, rnd, ["one"])) for i in range(100)]
    frame = spark.createDataFrame(rows, SCHEMA)
    one = texts(sites.extract(frame))
    monkeypatch.setattr(sites, "HOT_SHARE", 10)
    assert texts(sites.extract(frame)) == one and len(one) == 300
    assert all("is said here" in one[i] and "Welcome" not in one[i] for i in range(200))


@pytest.mark.parametrize(
    "source,text",
    [
        ("", ""),
        ("plain & simple", "plain & simple"),
        ("<p>a<p>b</p>c", "a\n\nb\n\nc"),
        ("<p><b>one<br>two<p>three</b> four", "one two\n\nthree four"),
        ("<div>a<div>b</div>c</div>", "a\n\nb\n\nc"),
        ("<article>in</article>out", "in"),
        ("<main>near<article>in</article></main>out", "in"),
        ("<main>near</main>out<footer>f</footer>", "near"),
        ("<header>h</header><p>x</p><nav>n</nav><aside>s</aside><form>f<input value=1></form><footer>f</footer>", "x"),
        ("<article><header><h1>T</h1></header><p>x</p><footer>by me</footer><aside>s</aside></article>", "T\n\nx"),
        ('<article><p>x <span class="ad">buy</span> y</p><div id="comments"><article class="comment"><p>nice</p></article></div></article>', "x y"),
        ('<div class="cookie-notice">ok?</div><div class="postSidebar2">s</div><p class="adventure">x</p>', "x"),
        ('<div class="page with-sidebar"><article>x</article></div>', "x"),
        ('<div hidden>h</div><div style="display: none">i</div><div aria-hidden="true">j</div><div role=navigation>k</div><p>x', "x"),
        ("<script>if (a<b) document.write('<p>no</p>')</script><style>p{}</style><p>x</p><!-- <p>no</p> --><noscript>n</noscript>", "x"),
        ("<p title='a>b' data-x=\"<p>\">x</p><p class=>y", "x\n\ny"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\n\nb\n\nc\n\nd"),
        ("<table><tr><td>a<td>b<tr><th>c</table>d", "a\n\nb\n\nc\n\nd"),
        ("1 < 2 &lt; 3 <3 &eacute;&#233;&#x1F642;&nbsp;&amp;amp; &unknown; &copy", "1 < 2 < 3 <3 éé🙂 &amp; &unknown; ©"),
        ("<p>cut off <a href='x", "cut off"),
        ("<p>x</p><!-- never ends <p>y", "x"),
        ("<script>never ends <p>y", ""),
        ("<article></article><p>x</p>", "x"),
        ("</p></div></b>x<//>y<?php no ?>z<!DOCTYPE q>", "xyz"),
    ],
)
def test_markup(source, text):
    assert alone(source) == text


def test_hostile_nesting_takes_seconds():
    deep = 20_000
    for source in ("<div>" * deep + "</section>" * deep + "x", "<div>" * deep + "<li>a" * 50, "<div><span>" * deep + "</p></b>" * deep + "x", "<p>x</b>" * deep, "<b><p>" * deep + "x"):
        began = time.process_time()
        assert alone(source).replace("\n\n", "")
        assert time.process_time() - began < 20


def test_odd_rows(spark):
    long = "<article>" + "<p>word &amp; word" * 50_000 + "</article>"
    deep = "<div>" * 3_000 + "deep" + "</div>" * 3_000
    rows = [(1, None, "<p>x"), (2, "http://a.example.com/", None), (2, "http://a.example.com/", ""), (None, "no url", "<p>y"), (3, "http://a.example.com", long), (4, "http://a.example.com", deep), (4, "http://a.example.com", deep), (5, "x", "<" * 20_000), (6, "x", "<a " * 20_000), (7, "x", "<a b='" * 5_000), (8, "x", "<!--" * 20_000)]
    clash = spark.createDataFrame(rows, SCHEMA).withColumn("layout", F.lit(1)).withColumn("text", F.lit("t")).withColumn("nodes", F.lit(2))
    got = sites.extract(clash)
    assert got.columns == ["page_id", "url", "text"]
    found = got.collect()
    by = texts(got)
    assert len(found) == len(rows) and by[1] == "x" and by[2] == "" and by[None] == "y" and by[4] == "deep"
    assert by[3] == "\n\n".join(["word & word"] * 50_000)
    assert sites.extract(spark.createDataFrame([], SCHEMA)).count() == 0
