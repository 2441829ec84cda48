"""Chosen pages, templates of a host, broken and deep markup, edge cases, the test table against plain patterns."""

import html
import re

import pytest
from pyspark.sql import functions as F

from keyloom.llm import html_text as ht


@pytest.mark.parametrize(
    "source,text",
    [
        ("<p>a <b>b</b>c<p>d&amp;e &lt;f", "a bc d&e <f"),
        ("<body><nav>x</nav><article><h1>T</h1><p>a<br>b</p><div class='ad-box'>y</div><aside>z</aside></article><footer>f</footer>", "T a b"),
        ("<header>h</header><main><p>a</main><div id=sidebar>s</div>", "a"),
        ("<div>one</div><script>var a='</p>';</script><style>p{}</style><!-- <p>no</p> --><div>two &nbsp; 2</div>", "one two 2"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a b c d"),
        ("<article>a</article><article class=comment>b</article><div class='comments'><article>c</article></div>", "a"),
        ("<article>long story here</article><article>x</article>", "long story here x"),
        ("<main>a<main>b</main></main><div role=main>c</div>", "a b c"),
        ('<div class="content has-sidebar"><p>whole story</p></div><div class=sidebar>s</div>', "whole story"),
        ('<article class="post comments-open"><p>a</p><div class="post-comments">c</div><div class="comment-list">d</div></article>', "a"),
        ('<article id="promotion-of-science">a</article>', "a"),
        ('<div class="ad-content widget-2"><h1>T</h1><p>the whole article is in here, with all of its words</p></div><p>x</p>', "T the whole article is in here, with all of its words x"),
        ('<div class="widget"><article>all</article></div>', "all"),
        ('<div class="comments"><p>comments of readers that are far longer than the page</p></div><p>x</p>', "x"),
        ("<article></article><div class=ad>buy this</div>", ""),
        ('<div class="cookie-notice">we use</div><div class="site_footer">f</div><div id="top-nav">n</div><p>text of the page itself</p>', "text of the page itself"),
        ("<p title='a>b'>q</p><p class=\"unclosed>r", "q r"),
        ("a < b <3 c", "a < b <3 c"),
        ("<form>f<input></form><p hidden>h</p><p style='display: none'>n</p>t", "t"),
        ("x<div role=navigation>y</div>z", "x z"),
        ("", ""),
        (None, ""),
        ("<html><head><title>t</title></head><body class='has-sidebar'>b", "b"),
    ],
)
def test_pages(source, text):
    assert ht.text_of(source) == text


def test_long_and_deep_pages_take_linear_time():
    assert ht.text_of("<div>" * 100_000 + "x") == "x"
    for bad in ("<" * 300_000, "<!--" * 100_000, "<p " * 100_000, "<a href=\"" * 50_000, "</b>" * 100_000, "&amp" * 100_000, "<p><b>" * 20_000):
        ht.text_of(bad)


def site(n, body):
    return [(i, f"https://www.site.example/{i}", body(i)) for i in range(n)]


def test_templates_are_deleted_and_prose_is_kept(spark):
    box = "<div class=x7>Read our <b>other</b> stories</div>"
    plain = site(20, lambda i: f"<div><span>Site name</span></div><div>story {i} of its own</div>{box}<p>last line")
    marked = [(100 + i, f"http://b.example:80/{i}", f"<article><p>Same words on each page</p>{box}<p>own {i}</p></article>") for i in range(20)]
    few = [(200 + i, f"http://c.example/{i}", f"<div>{box}</div>") for i in range(3)]
    odd = [(300, None, box), (301, "no host", box), (302, "http://b.example/", None), (302, "http://b.example/", ""), (None, "http://u@B.example/q", "<p>q</p>")]
    pages = spark.createDataFrame([(*r, "t") for r in plain + marked + few + odd], "page_id long, url string, html string, hash string")
    got = {r.page_id: r for r in ht.extract(pages).collect()}
    assert all(got[i].text == f"story {i} of its own" for i in range(20))
    assert all(got[100 + i].text == f"Same words on each page own {i}" for i in range(20))
    assert all(got[i].text == "Read our other stories" for i in (200, 201, 202, 300, 301))
    assert got[302].text == "" and got[302].n_chars == 0 and got[None].text == "q" and got[0].hash == "t"
    assert ht.extract(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ht.extract(pages.withColumn("text", F.lit("")))


def test_copies_of_a_page_are_no_templates(spark):
    box = "<div class=x7>Read our <b>other</b> stories</div>"
    copied = "<article><h1>T</h1><div><section>body of <i>it</i></section><ul><li>x</ul></div></article>"
    article = [(i, f"http://a.example/{i}", (copied if i < 6 else f"<article><p>own {i}</p></article>") + box) for i in range(16)]
    body = [(100 + i, f"http://b.example/{i}", f"<div><div>whole body</div></div>{box}" if i < 6 else f"<div>own {i}</div>{box}") for i in range(16)]
    inside = [(200 + i, f"http://c.example/{i}", f"<article><div>story {i // 2}</div>{box}</article>") for i in range(12)]
    all_same = [(300, "http://d.example/", copied)] * 20
    pages = spark.createDataFrame(article + body + inside + all_same, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in ht.extract(pages).collect()}
    assert all(got[i] == ("T body of it x" if i < 6 else f"own {i}") for i in range(16))
    assert all(got[100 + i] == ("whole body" if i < 6 else f"own {i}") for i in range(16))
    assert all(got[200 + i] == f"story {i // 2}" for i in range(12)) and got[300] == "T body of it x"


def test_many_templates_join_by_host(spark, monkeypatch):
    box = "<div class=x7>Read our <b>other</b> stories</div>"
    rows = [(i, f"http://a.example/{i}", f"<div>story {i}</div>{box}") for i in range(40)] + [(100 + i, f"http://b{i}.example/", f"<p>own {i}</p>{box}") for i in range(5)] + [(200, None, box), (201, "http://a.example/x", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    small = sorted(map(tuple, ht.extract(pages).select("page_id", "text", "n_chars").collect()))
    monkeypatch.setattr(ht, "BROADCAST", -1)
    assert sorted(map(tuple, ht.extract(pages).select("page_id", "text", "n_chars").collect())) == small
    assert dict((a, b) for a, b, _ in small)[3] == "story 3"


def test_the_test_table(spark):
    got = ht.op8_html_text(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), ["page_id", "url"]).collect()
    assert len(got) == 250
    for r in got:
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))).split())
        assert r.text == want and r.n_chars == len(want)
