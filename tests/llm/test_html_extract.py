import html
import re
import time

import pytest

from conftest import SF001
from omics_spark.llm import html_extract as H
from omics_spark.llm.common import table

TREE, SCAN = H.train(), H.scanner()


def main_text(page):
    blocks = SCAN(page)
    return " ".join(b.text for b, row in zip(blocks, H.features(blocks)) if H.classify(TREE, row))


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<html><body></body></html>", ""), ("<p", ""), ("<script>var a = '<p>no</p>';", ""),
    ("<article><p>One  two\n\tthree</p><p>four</p></article>", "One two three four"),
    ("<article><p>a &amp; b &lt;i&gt; &#233; &eacute; &nbsp;x &amp;amp; &copy</p></article>", "a & b <i> é é x &amp; ©"),
    ("<article><p><b>Bo<i>ld</b>er</i> word.<br>next<p>open</article>tail", "Bolder word. next open"),
    ("<nav><a href=/>Home</a></nav><article><h1>T</h1><p>Text here.</p><aside>Other</aside><div class='ad'>Buy</div><p>More.</p><form><label>Mail</label><input></form></article><footer>Foot</footer>", "T Text here. More."),
    ("<header><h1>Site name</h1></header><article><header><h1>Title</h1></header><p>Body.</p><footer>Share it</footer></article>", "Title Body."),
    ("<main><p>Only this.</p></main><section id=comments><article><p>A long reader comment that has very many words in it, and still is none of the article.</p></article></section>", "Only this."),
    ("<div class='post-content'><p>Short.</p></div><div id='cookie-notice'><p>We use cookies and so on and on and on in many words.</p></div>", "Short."),
    ("<article><p>a<!-- hidden <p>x</p> -->b</p><style>p{}</style><script>if (a<b) t='</p>'</script><p>c</p></article>", "ab c"),
    ("<ARTICLE CLASS=story><P>Upper case</P></ARTICLE>", "Upper case"),
    ("<article><p title='a > b'>quoted</p><p data-x=\"</p>\">more</p></article>", "quoted more"),
    ("<article><table><tr><td>cell one</td><td>cell two</td></tr></table><pre>x\n  y</pre></article>", "cell one cell two x y"),
    ("<article><p>5 < 6 and 7 <8</p></article>", "5 < 6 and 7 <8"),
])
def test_small_pages(page, text):
    assert main_text(page) == text


def test_pages_without_marked_containers():
    long, more = "word " * 60, "other " * 45
    page = f"<body><div><a href=1>Home</a> <a href=2>About</a></div><p>{long}</p><p>{more}</p><ul><li><a href=3>x y</a></li></ul><p class='copyright'>Rights</p></body>"
    assert main_text(page) == f"{long}{more}".strip()


def test_link_density_decides_without_marks():
    text = "plain words " * 20
    assert main_text(f"<p>{text}</p>") == text.strip() and main_text(f"<p><a href=1>{text}</a></p>") == ""


def test_whole_table(spark):
    pages = table(spark, SF001, "pages")
    rows = H.extract(pages).collect()
    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        want[r["page_id"]] = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
    assert {r["page_id"]: r["text"] for r in rows} == want and len(rows) == pages.count()
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_awkward_rows(spark):
    long = "<article>" + "<p>some words</p>" * 30_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article>é🙂</article>"), (3, "u", long), (3, "u", long)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = H.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted(((r["page_id"] or 0, r["url"], r["n_chars"]) for r in got.collect()), key=str)
    assert found == sorted([(0, "u", 2), (1, "u", 0), (2, None, 0), (3, "u", 30_000 * 11 - 1), (3, "u", 30_000 * 11 - 1)], key=str)
    assert H.extract(pages.limit(0)).count() == 0


def test_tree_fits_its_table():
    for blocks, marks in H.LABELLED:
        rows = H.features([H.Block(words=w, linked=n, heading=bool(h), bad=bool(b), good=bool(g)) for w, n, h, b, g in blocks])
        assert [H.classify(TREE, r) for r in rows] == marks


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x", "<div>" * 50_000 + "</nav>" * 50_000, '<a "' * 50_000, "<a x=\"" * 50_001, "<a x='" * 30_001 + "<b>", "<" * 200_000,
                                  "<article>" * 30_000 + "<header>" * 30_000, "<!--" * 50_000, "<script" * 50_000 + ">", "<a <b" * 50_000 + ">"])
def test_malformed_pages_take_time_in_proportion(page):
    began = time.time()
    H.scanner()(page)
    assert time.time() - began < 3


def test_quotes_hide_ends_of_tags_only_as_values():
    scan = H.scanner()
    assert [b.text for b in scan('<p title="a>b">one</p><p "x>two</p><p title=\'>\'>three</p><p x="open>four</p> <q> five')] == ["one", "two", "three", "four", "five"]
    assert scan("<!-- a > b") == scan("<script>x > y") == scan("<p <!-- ") == []
    assert [b.text for b in scan("<![CDATA[1 > 0")] == ["1 > 0"] and [b.text for b in scan("<script>a</script> b")] == ["b"]
