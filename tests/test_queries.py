"""Every registered query against its SQL on DuckDB, over the smallest tables."""

import os

import duckdb
from html.parser import HTMLParser

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_field_dictionary_has_rows(spark):
    assert entry.queries()["field_dictionary"](spark, DATA).count() > 0


def test_html_to_text_row_by_row(spark, duck):
    """Against the standard library's parser, block by block."""

    class Lines(HTMLParser):
        def __init__(self):
            super().__init__()
            self.found, self.hidden = [""], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("head", "script", "style")
            if tag in ("p", "div", "li", "ul", "br", "nav", "article", "footer", "h1", "body"):
                self.found.append("")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("head", "script", "style")
            if tag in ("p", "div", "li", "ul", "nav", "article", "footer", "h1", "body"):
                self.found.append("")

        def handle_data(self, data):
            if not self.hidden:
                self.found[-1] += data

    got = {r.page_id: r.text for r in entry.queries()["html_to_text"](spark, DATA).collect()}
    pages = duck.execute("SELECT page_id, html FROM pages").fetchall()
    assert len(got) == len(pages)
    for key, page in pages:
        parser = Lines()
        parser.feed(page)
        parser.close()
        assert got[key] == "\n".join(x for x in (" ".join(y.split()) for y in parser.found) if x)


def test_connected_branches_against_brute_force(spark, duck):
    lines = duck.execute("SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey * 100000 + l_partkey FROM lineitem").fetchall()
    group = {}

    def root(x):
        while group.setdefault(x, x) != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for order, line, k in lines:
        a, b = root(("key", order, line)), root(("branch", k))
        group[a] = b
    least = {}
    for _, _, k in lines:
        least[root(("branch", k))] = min(k, least.get(root(("branch", k)), k))
    want = {k: least[root(("branch", k))] for _, _, k in lines}
    assert {r.node: r.component for r in entry.queries()["connected_branches"](spark, DATA).collect()} == want


def test_territories_hold_every_person_once(spark):
    got = entry.queries()["kmeans_territory"](spark, DATA)
    assert got.count() == got.select("person").distinct().count() == spark.read.parquet(f"{DATA}/customer.parquet").count()
