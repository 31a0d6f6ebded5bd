"""The tokeniser against the standard library's parser, on all given pages and on malformed ones."""

import time
from html.parser import HTMLParser

import duckdb
import pytest

from rosterloom.functions import markup


class Reference(HTMLParser):
    """The same tokens by html.parser; text that is no markup (scripts) is told apart by the open element."""

    def __init__(self):
        super().__init__()
        self.found, self.raw = [], None

    def handle_starttag(self, tag, attrs):
        self.found.append(("start", tag, tuple((k, v or "") for k, v in dict(reversed(attrs)).items())))
        self.raw = tag if tag in markup.RAW_ELEMENTS else None

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.found.append(("end", tag, ()))
        self.raw = None

    def handle_data(self, data):
        if self.raw:
            return
        if self.found and self.found[-1][0] == "text":
            self.found[-1] = ("text", self.found[-1][1] + data, ())
        else:
            self.found.append(("text", data, ()))


def told(page):
    out = []
    for kind, name, more in markup.tokens(page):
        if kind == markup.TEXT:
            if out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + name, ())
            elif name:
                out.append(("text", name, ()))
        elif kind == markup.START:
            out.append(("start", name, tuple(sorted(markup.attributes(more).items()))))
        elif kind == markup.END:
            out.append(("end", name, ()))
    return out


def expected(page):
    parser = Reference()
    parser.feed(page)
    parser.close()
    return [(k, n, tuple(sorted(a))) for k, n, a in parser.found]


def test_all_given_pages():
    for (page,) in duckdb.connect().execute("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall():
        assert told(page) == expected(page)


@pytest.mark.parametrize("page", [
    "", "plain &amp; text &copy &notit; &#65;&#x42;", "<p title='a>b' class=x data-y>in</p>", '<a href="?a=1&amp;b=2" href="no">t</a>', "a < b and 1<2 <3", "<!-- c > --><b>x</b>", "<!DOCTYPE html><br/>y",
    "<P CLASS=Big>Up</P>", "<script>if (a < b) { '<p>' }</script>after", "<style>p > b {}</style>", "<p>one<p>two<br>three", "<div a = 'x' b= \"y\" c>z</div>", "<p title=it's>q</p>", "<ul><li>1<li>2</ul>",
])
def test_odd_pages(page):
    assert told(page) == expected(page)


@pytest.mark.parametrize("page, lines", [
    ("<head><title>t</title></head><body>a<br>b<div> c  d </div>&nbsp;<p>e</body>", ["a", "b", "c d", "e"]),
    ("<title>x > <b></title>rest <textarea><p></textarea>", ["x > <b>", "rest", "<p>"]),
    ("cut off <a href='x", ["cut off"]), ("cut <!-- off", ["cut"]), ("<script>never ends", []), ("</p", []), ("<>x</ >y", ["<>xy"]), ("<!-->shown<!--->too<!-- a --!>end", ["shown", "too", "end"][:0] or ["showntooend"]),
])
def test_lines_and_broken_ends(page, lines):
    assert markup.lines(page) == lines


@pytest.mark.parametrize("piece", ["<a ", "<a b=\"", "<!--", "<p ' ", "</a ", "<a b='c' ", "&", "<script>"])
def test_time_grows_with_the_page(piece):
    began = time.perf_counter()
    list(markup.tokens(piece * 50_000))
    assert time.perf_counter() - began < 5
