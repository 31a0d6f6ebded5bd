"""Pages, ragged lists, rankings, verdicts, shards and checks on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from rosterloom.operators import audit, rosters
from rosterloom.sources import files, html

OWNERS = """<table><tr><th>Full Legal Name</th><th>DE/FE/I</th><th>CRD No.</th><th>Ownership Code</th></tr>
<tr><td> Oak &amp; Elm <b>LLC</b></td><td>DE</td><td>7</td><td>E</td></tr><tr><td>short row</td></tr><tr><td></td><td>I</td><td>8</td><td>A</td></tr></table>
<table><tr><td>x</td></tr></table><table><tr><td>CRD No.</td><td>FULL LEGAL NAME</td></tr><tr><td>9</td><td>Ann Ash</td></tr></table>"""


def test_tables_go_by_their_header(spark):
    df = spark.createDataFrame([(1, OWNERS), (2, None), (3, "<p>no table</p>")], "page int, html string")
    rows = html.table_rows(df, "page", "html").orderBy("place").collect()
    assert [(r.page, r.owner_name, r.owner_type, r.owner_crd, r.ownership_code) for r in rows] == [(1, "Oak & Elm LLC", "DE", "7", "E"), (1, "Ann Ash", None, "9", None)]


def masked(address, key=0x2A):
    return f"{key:02x}" + "".join(f"{ord(c) ^ key:02x}" for c in address)


def test_contacts_of_a_page(spark):
    page = f"""<title> Oak
      Advisers </title><a href="mailto:Ann@oak.com?x=1">a</a><a href="/cdn-cgi/l/email-protection#{masked('bob@oak.com')}">b</a><a href="/cdn-cgi/l/email-protection#zz">c</a>
      write to carl@oak.com or eve@elsewhere.org, logo@2x.png <a href="tel:+1 (212) 555-0100">t</a> call 415.555.0199 or 115 555 0100 <a href="/team#x">x</a><a href="/team">y</a>"""
    got = html.harvest(spark.createDataFrame([("https://www.oak.com/x", page), ("https://z.com", None)], "url string, html string"), "url", "html").orderBy("url").collect()
    r = got[0]
    assert r.emails == ["ann@oak.com", "bob@oak.com", "carl@oak.com"] and r.phones == ["212.555.0100", "415.555.0199"] and r.title == "Oak Advisers" and "/team" in r.links
    assert got[1].emails is None and got[1].title is None
    df = spark.createDataFrame([("info@x.com",), ("ann@x.com",)], "a string")
    assert [x.g for x in df.select(html.is_generic(F.col("a")).alias("g")).collect()] == [True, False]


def test_sites_and_their_teams(spark):
    rows = [
        (1, "Marcos Oak !The Elm Group", "/the-elm-group"), (2, "Ash Team!Fir Team", "/ash!/fir"), (3, "Wrong!Right Name!Other", "/fir!/hkls"), (4, "Yew!Yew", "/yewteam"), (5, None, None), (6, "Klinger Group !Jeff Klinger", "/klingergroup"),
    ]
    got = {r.url: r.name for r in rosters.team_sites(spark.createDataFrame(rows, "at int, names string, urls string"), "at", "names", "urls").collect()}
    assert got == {"/the-elm-group": "The Elm Group", "/ash": "Ash Team", "/fir": "Fir Team", "/hkls": "Other", "/yewteam": "Yew", "/klingergroup": "Klinger Group"}


def test_rows_of_one_identity_are_merged(spark):
    rows = [(1, "7", None, "A", ""), (2, "7", "x@y", "", "t1"), (3, None, "X@Y ", "B", None), (4, None, "x@y", "C", "t2"), (5, None, None, "D", None)]
    df = spark.createDataFrame(rows, "pos int, crd string, mail string, name string, tel string")
    got = {r.identity: (r.rows, r.name, r.tel) for r in rosters.merged(df, "pos", [F.col("crd"), F.col("mail")], ["name", "tel"]).collect()}
    assert got == {"0:7": (2, "A", "t1"), "1:x@y": (2, "B", "t2")}


def test_rankings_with_details(spark, tmp_path):
    rows = [
        {"ranking": "top1500", "year": 2024, "state": "GA", "rank": 3, "advisor": "Ann", "crd": " 7 ", "detail": {"Team Assets ($bil)": "$1.2", "Typical Account Size ($mil)": "1,250", "Client Types": " rich ", "2023 Rank": "9"}},
        {"ranking": "top100", "year": 2024, "state": "", "rank": 1, "advisor": "Bob", "detail": None},
    ]
    (tmp_path / "r.json").write_text(json.dumps(rows))
    a, b = files.rankings(spark, f"{tmp_path}/r.json").orderBy("rank", ascending=False).collect()
    assert (a.rank_scope, a.advisor_crd, a.team_assets_bil, a.team_assets_usd, a.typical_account_usd, a.client_types, a.prior_rank) == ("state", "7", 1.2, 1.2e9, 1.25e9, "rich", 9.0)
    assert (b.rank_scope, b.rank_state, b.team_assets_bil, b.client_types) == ("national", None, None, None)


def test_verdicts_on_places(spark):
    good = dict(status="OK", types=["street_address"], number="12", state="GA", country="US", city="ATLANTA", postal="30301", lat=33.1234567, lon=-84.0, location_type="ROOFTOP")
    filed = dict(number="12", state="GA", city="Atlanta", postal="30301")
    cases = [
        ({}, {}, ("rooftop", "", None)), ({"status": "ZERO"}, {}, (None, "REJECTED", "no answer")), ({"types": ["locality", "political"]}, {}, (None, "REJECTED", "centroid")),
        ({"state": "TX"}, {}, (None, "REJECTED", "state mismatch")), ({"state": "San Juan", "country": "PR"}, {"state": "PR"}, ("rooftop", "", None)),
        ({"postal": "30999", "city": None}, {}, (None, "REJECTED", "zip and city mismatch")), ({"postal": "30999"}, {}, ("rooftop", "", None)), ({"lat": None}, {}, (None, "REJECTED", "no geometry")),
        ({"number": None}, {}, ("approximate", "STREET LEVEL", None)), ({"number": "13"}, {}, ("approximate", "HOUSE NUMBER MISMATCH", None)), ({"number": "10-12"}, {}, ("rooftop", "", None)),
        ({"types": ["establishment"]}, {"number": ""}, ("approximate", "POI MATCH", None)), ({"types": ["establishment"]}, {}, ("rooftop", "", None)), ({"location_type": "APPROXIMATE"}, {}, ("approximate", "", None)),
    ]
    rows = [(k, {**good, **a}, {**filed, **f}) for k, (a, f, _) in enumerate(cases)]
    schema = "k int, a struct<status:string,types:array<string>,number:string,state:string,country:string,city:string,postal:string,lat:double,lon:double,location_type:string>, f struct<number:string,state:string,city:string,postal:string>"
    df = spark.createDataFrame(rows, schema)
    got = df.select("k", *[c.alias(n) for n, c in rosters.place_verdict(F.col("a"), F.col("f")).items()]).orderBy("k").collect()
    assert [(r.precision, r.check, r.note) for r in got] == [want for _, _, want in cases] and got[0].lat == 33.123457


def test_sized_shards_and_team_shards(spark, tmp_path):
    df = spark.range(1000).withColumn("text", F.lit("x" * 50))
    names = files.write_sized(df, "id", f"{tmp_path}/s", target_bytes=20_000)
    assert len(names) == 4 and spark.read.json(f"{tmp_path}/s/manifest").count() == 4 and spark.read.json(f"{tmp_path}/s/shards").count() == 1000
    assert len(files.write_sized(df.filter("false"), "id", f"{tmp_path}/e")) <= 1
    teams, members = spark.createDataFrame([(1, "A"), (2, "B")], "team int, name string"), spark.createDataFrame([(1, "GA"), (1, "TX"), (1, "TX"), (2, "GA"), (2, None)], "team int, st string")
    files.write_team_shards(teams, members, "team", "st", f"{tmp_path}/t")
    assert sorted((r.shard, r.name) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [("GA", "A"), ("GA", "B"), ("TX", "A")]


def test_checks(spark):
    rows = spark.createDataFrame([("a", 1, "high", 0.9), ("a", 2, "high", 0.5), ("", None, "none", 0.0), ("c", None, "review", 0.4), ("d", 4, "none", 0.0)], "k string, id int, tier string, score double")
    assert audit.sound_crosswalk("x", rows, "k", "id", 0.72).first().failures == 5
    one = lambda v: spark.createDataFrame([(v,)], "total double")
    assert [audit.shared_book("b", one(p), one(u), one(s)).first().failures for p, u, s in ((200.0, 100.0, 100.0), (104.0, 100.0, 100.0), (200.0, 102.0, 100.0))] == [0, 1, 1]
    results, bad = audit.run_checks([audit.Check("fine", lambda: audit.shared_book("b", one(2.0), one(1.0), one(1.0))), audit.Check("gone", lambda: None), audit.Check("broken", lambda: spark.table("no_such"))])
    assert [r[1] for r in results] == ["ok", "skipped", "error"] and bad == 1


@pytest.mark.parametrize("most", [1, 5])
def test_nearest_of_a_list(spark, most):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 60.0, 10.0)], "k int, lat double, lon double")
    b = spark.createDataFrame([("far", 50.0, 50.0), ("b", 1.0, 0.0), ("a", -1.0, 0.0), ("up", 60.0, 13.0)][:most] if most > 1 else [("only", 9.0, 9.0)], "base string, b_lat double, b_lon double")
    assert {r.k: r.base for r in rosters.nearest_of(p, b, "k", "lat", "lon").collect()} == ({1: "a", 2: "up"} if most > 1 else {1: "only", 2: "only"})
