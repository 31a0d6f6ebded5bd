"""Main text by host consensus, against pages whose text is known and an independent parser."""

from html.parser import HTMLParser

import duckdb
import pytest

from rosterloom.llm import html_extract, queries
from rosterloom.llm.html_extract import Page

FRAME = """<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style><script>var x="<p>no</p>"</script></head><body class="with-sidebar">
<header class="site-header"><a href="/">no</a><h1>no site</h1></header><nav><ul><li><a href="/a">no</a></li></ul></nav>
<div class="cookie-notice">no cookies</div><div id="page-{n}"><div class="post p{n}"><h2>Title {n}</h2><p>{body}</p>
<div class="ad-slot">no ad</div><form action="/s"><label>no</label><input name=q></form><ul><li>one &amp; two<li>three</ul>
<blockquote>said<br>so</blockquote></div><aside>no aside</aside><section id="comments"><article class="comment"><p>no, a long comment {long}</p></article></section></div>
<footer>&copy; no</footer></body></html>"""


def page(n, body="A sentence  that\n is &lt;main&gt; text."):
    return FRAME.format(n=n, body=body, long="word " * 40)


def text(n, body="A sentence that is <main> text."):
    return f"Title {n}\n{body}\none & two\nthree\nsaid so"


def test_what_is_left_out():
    read = Page(page(7))
    assert read.text() == text(7)
    assert read.path(read.best()[0]) == "html/body.with-sidebar/div/div.p0.post"


@pytest.mark.parametrize("html, want", [
    ("", ""), ("only text", "only text"), ("<p>a<p>b", "a\nb"), ("<article><header><h1>T</h1><p>by no one</p></header><p>x</p></article>", "T\nx"),
    ("<main><h1>T</h1><p>a b<div>c</div></main><div>" + "<a href=x>link</a> " * 50 + "</div>", "T\na b\nc"),
    ("<div role=navigation>no</div><td>cell<p>x", "cell\nx"), ("<div><p>real</p><p hidden>no</p><div style='display: none'>no</div></div>", "real"),
    ("<table><tr><td>menu<td><p>" + "long " * 20 + "</table>", "long " * 19 + "long"), ("<b>a<p>b</b> c</p>", "a\nb c"),
    ("<article><p>one</p></div></article><p>stray</p>", "one"), ("<p>x &nbsp;&#160; y z</p>", "x y z"), ("<script>no</script>", ""),
])
def test_small_pages(html, want):
    assert Page(html).text() == want


def test_deep_and_long_pages():
    assert Page("<div>" * 50_000 + "x" + "</div>" * 50_000).text() == "x"
    assert len(Page("<article>" + "<p>word word</p>" * 50_000).text()) == 10 * 50_000 - 1


def test_hosts_agree(spark):
    """A short text beside a long box of links' neighbour goes by the path of the host's other pages."""
    boxed = "<body><div class='post'><p>short</p></div><div class='more'><p>" + "other things " * 40 + "</p></div></body>"
    usual = "<body><div class='post'><p>" + "real text " * 60 + "</p></div><div class='more'><p>x</p></div></body>"
    rows = [(i, "http://H.example.com:80/x", usual) for i in range(5)] + [(9, "https://u@h.example.com/y", boxed), (10, "nowhere", boxed), (11, None, boxed), (12, "https://other.example.com", boxed), (13, "https://h.example.com", None), (14, "https://h.example.com", "<section>no path here</section>"), (None, "https://h.example.com/q", boxed), (9, "https://u@h.example.com/y", boxed)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_extract.extract(df).collect()}
    assert html_extract.extract(df).count() == len(rows)
    other = ("other things " * 40).strip()
    assert got[9, "https://u@h.example.com/y"] == got[None, "https://h.example.com/q"] == ("short", 5)
    assert got[10, "nowhere"][0] == got[11, None][0] == got[12, "https://other.example.com"][0] == other
    assert got[13, "https://h.example.com"] == ("", 0) and got[14, "https://h.example.com"][0] == "no path here"
    assert html_extract.BROADCAST_BYTES > 0


def test_shuffled_winners_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", 0)
    rows = [(i, f"http://h{i % 3}.example.com/{i}", page(i), "a", "b", "c", "d") for i in range(9)]
    df = spark.createDataFrame(rows, "id long, url string, html string, host string, path string, row string, text string")
    out = html_extract.extract(df)
    assert set(out.columns) == {"id", "url", "html", "host", "path", "row", "text", "n_chars"}
    assert {(r.id, r.text, r.host, r.path, r.row) for r in out.collect()} == {(i, text(i), "a", "b", "c") for i in range(9)}


def test_empty_table(spark):
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


class Article(HTMLParser):
    """The blocks of the article of a given page, another way."""

    def __init__(self):
        super().__init__()
        self.blocks, self.inside = [], False

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if self.inside and tag in ("p", "h1"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_query_on_all_pages(spark):
    at = "/root/testdata/sf0.01"
    got = {r.page_id: tuple(r) for r in queries.op11_html_extract(spark, at).collect()}
    rows = duckdb.connect().execute(f"select page_id, url, html from '{at}/pages.parquet'").fetchall()
    assert len(got) == len(rows)
    for key, url, html in rows:
        parser = Article()
        parser.feed(html)
        parser.close()
        want = "\n".join(b for b in (" ".join(x.split()) for x in parser.blocks) if b)
        assert got[key] == (key, url, want, len(want))
