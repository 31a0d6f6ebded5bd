"""Review sheets, published names, bases, searches and shown values on literal rows."""

from datetime import date, datetime
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterloom.functions import geo, review, text
from rosterloom.operators import activity, bases, relational, rosters, search
from rosterloom.operators import review as sheets


def told(spark, f, rows, names):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} string" for n in names))
    return [r.x for r in df.select("i", f(*[F.col(n) for n in names]).alias("x")).orderBy("i").collect()]


def test_first_names_of_a_review_sheet(spark):
    rows = [
        ("Ronald Grove", "RONALD Grove JR", "RONALD GROVE"), ("Casey Compston", "MARK COMPSTON", "MARK COMPSTON"), ("Bob Smith", "ROBERT SMITH", None),
        ("Henry Millian", "PATRICK H MILLIAN", "PATRICK HENRY MILLIAN"), ("R Smith", "ROBERT SMITH", None), ("Robert Smith", "R. SMITH", ""), ("", "X Y", "X Y"), ("Ann", None, ""),
    ]
    assert told(spark, review.first_names_agree, rows, ["a", "b", "c"]) == ["yes", "no", "yes", "no", "initial", "initial", "unknown", "unknown"]


def test_firms_postals_and_cities_of_a_review_sheet(spark):
    firms = [("Acme Wealth Management LLC", "ACME"), ("Acme North", "Acme South"), ("The 680 Group", "Independent Advisor Alliance"), ("Capital Group", "Acme"), (None, "Acme")]
    assert told(spark, review.firms_agree, firms, ["a", "b"]) == ["yes", "partial", "no", "unknown", "unknown"]
    assert told(spark, review.postals_agree, [("30301-1234", "30301"), ("30301", "30302"), ("303", "30301"), (None, None)], ["a", "b"]) == ["yes", "no", "unknown", "unknown"]
    assert told(spark, review.cities_agree, [("St. Paul", "ST PAUL"), ("New York", "New York City"), ("Sheman", "Sherman"), ("", "X")], ["a", "b"]) == ["yes", "yes", "no", "unknown"]
    said = [("no", "no", "yes", "no"), ("yes", "no", "no", "yes"), ("no", "initial", "no", "yes"), ("no", "yes", "no", "no"), ("yes", "unknown", "yes", "yes")]
    assert told(spark, review.suggestion, said, ["f", "n", "p", "c"]) == ["CHECK", "REJECT", "ACCEPT", "CHECK", "CHECK"]


def test_the_branch_that_fits_and_the_order_of_work(spark):
    rows = spark.createDataFrame([(1, 7, "55402", "Minneapolis", "head", "New York", "NY", "10036"), (2, 7, None, "Boston", "head", "New York", "NY", "10036"), (3, 9, "1", None, "head", "X", "NY", "10036")], "row int, person int, our_postal string, our_city string, street string, city string, state string, postal string")
    branches = spark.createDataFrame([(7, 1, "1 Bryant", "New York", "NY", "10036"), (7, 2, "Minnehaha", "Minneapolis", "MN", "55111"), (7, 3, "80 S 8th", "Minneapolis", "MN", "55402-1")], "person int, ord int, street string, city string, state string, postal string")
    got = {r.row: (r.street, r.branch_count) for r in sheets.best_branch(rows, branches, "row", "person", "ord").collect()}
    assert got == {1: ("80 S 8th", 3), 2: ("head", 3), 3: ("head", 0)}
    work = spark.createDataFrame([(1, "none", "CHECK", 9.0, 1, 0.1), (2, "high", "REJECT", None, 1, 0.1), (3, "high", "REJECT", 5.0, 1, 0.1), (4, "high", "ACCEPT", None, 2, 0.1), (5, "high", "ACCEPT", None, 2, 0.3)], "i int, tier string, suggestion string, assets double, namesakes int, gap double")
    assert [r.i for r in work.orderBy(*sheets.work_order(F.col("assets"))).collect()] == [5, 4, 3, 2, 1]


def test_published_names(spark):
    people = spark.createDataFrame([(1, "Bo", "", "O'Neil", "Bogan"), (2, "Josesph", "", "Ray", "Josesph"), (3, "A", "Raj", "Sharma", "Adhiraj"), (4, "T", None, "Lee", "Timonthy"), (5, "T", None, "Lee", "Timonthy"), (6, "W", None, "Kaiser", "William")], "id int, first string, middle string, last string, used string")
    held = spark.createDataFrame([(1, "high", "Bo O'Neil", "bo@x.com", None), (2, "high", "Joe Ray", "joe@x.com", "/joe"), (3, "high", "Raj Sharma", "raj@x.com", ""), (4, "confirmed", "Tim Lee", "tim.lee@x.com", "/tim-lee"), (5, "high", "Tim Lee", "tim@x.com", "/t"), (6, "high", "Bill Kaiser", "bill@x.com", "/bill")], "id int, tier string, name string, email string, url string")
    got = {r.id: (r.reason, r.preferred, r.replaced) for r in sheets.published_names(people, held, "id").collect()}
    assert got == {
        1: ("shown", "Bo O'Neil", "Bogan O'Neil"), 3: ("shown", "A Sharma", "Adhiraj Sharma"), 4: ("shown", "Tim Lee", "Timonthy Lee"),
        5: ("no_corroboration", None, None), 6: ("not_in_filing", None, None),
    }
    with pytest.raises(ValueError):
        sheets.published_names(people, held, "id", most=2)


def parts_by_search(group, borders):
    left, parts = set(group), []
    while left:
        part = {left.pop()}
        while True:
            more = {b for b in left if any((a, b) in borders or (b, a) in borders for a in part)}
            if not more:
                break
            part |= more
            left -= more
        parts.append(len(part))
    return parts


def direct_cost(weights, distance, borders, bases_, owner):
    k, efforts, travel, broken, detached = len(bases_), [], 0.0, 0, 0
    for c in range(k):
        own = [i for i, o in enumerate(owner) if o == c]
        if not own:
            return float("inf")
        t = sum(weights[i] * distance[i][bases_[c]] for i in own)
        w = sum(weights[i] for i in own)
        travel += t
        efforts.append(w * (1 + t / w / 300))
        parts = parts_by_search(own, borders)
        detached += len(parts) == 2 and min(parts) == 1
        broken += 0 if len(parts) == 2 and min(parts) == 1 else len(parts) - 1
    return travel / sum(weights) + 1e6 * (broken + max(0, detached - 3)) + 600 * max(0, max(efforts) / min(efforts) - 1.35)


def test_bases_against_every_assignment(spark):
    rng = np.random.default_rng(3)
    for _ in range(4):
        n, borders = 7, {(i, i + 1) for i in range(6)} | {(0, 4)}
        weights, distance = rng.integers(5, 20, n).astype(float), rng.integers(10, 900, (n, 4)).astype(float)
        bits = [sum(1 << j for j in range(n) if (i, j) in borders or (j, i) in borders) for i in range(n)]
        design = bases.Design(weights, distance, bits)
        every = [(direct_cost(weights, distance, borders, [a, b], owner), a, b) for a in range(4) for b in range(a) for owner in product(range(2), repeat=n)]
        found = min((design.search(2, seed) for seed in range(4)), key=lambda x: x[0])
        assert found[0] == pytest.approx(direct_cost(weights, distance, borders, found[1], found[2]))
        assert found[0] == pytest.approx(min(every)[0])


def test_choosing_bases_over_tables(spark):
    states = spark.createDataFrame([("A", 40.0, -100.0, 5.0), ("B", 40.0, -99.0, 5.0), ("C", 30.0, -80.0, 5.0), ("D", 30.0, -81.0, 5.0)], "state string, lat double, lon double, weight double")
    cities = spark.createDataFrame([("west", 40.0, -99.5), ("east", 30.0, -80.5), ("far", 10.0, -10.0)], "city string, lat double, lon double")
    borders = spark.createDataFrame([("A", "B"), ("C", "D")], "a string, b string")
    got = bases.choose(states, cities, borders, k=2, starts=2).collect()
    assert {r.state: r.base for r in got} == {"A": "west", "B": "west", "C": "east", "D": "east"}
    assert bases.choose(states.limit(0), cities, borders).count() == 0
    owner, places = bases.recentred(states, {1: (41.0, -95.0), 2: (35.0, -85.0)}, "state", "lat", "lon", "weight")
    assert owner == {"A": 1, "B": 1, "C": 2, "D": 2} and places[2] == pytest.approx((30.0, -80.5))
    heavy = spark.createDataFrame([("A", 40.0, -100.0, 5.0), ("B", 40.0, -99.9, 5.0)], "state string, lat double, lon double, weight double")
    assert len(set(bases.recentred(heavy, {1: (40.0, -100.0), 2: (0.0, 0.0)}, "state", "lat", "lon", "weight")[0].values())) == 2


def test_people_by_words_and_alternates(spark):
    index = spark.createDataFrame([(1, "William Kaiser", ["bill"]), (2, "Bill Kane", None), (3, "Ann Abill", [])], "id int, name string, alternates array<string>")
    near = spark.createDataFrame([(2, "Bill Kane UBS Seal Beach CA"), (9, "Zoe Q UBS Atlanta GA")], "id int, text string")
    terms = spark.createDataFrame([(1, "Bill ka"), (2, "ubs seal beach"), (3, "b"), (4, None), (5, "ubs ga")], "q int, term string")
    got = {(r.q, r.id, r.source) for r in search.field(terms, index, near).collect()}
    assert got == {(1, 1, "index"), (1, 2, "near"), (2, 2, "near"), (5, 9, "near")}
    assert search.field(terms, index.limit(0)).count() == 0


def test_shown_values_and_state_codes(spark):
    amounts = [("1250000000000", "$1.3T"), ("12400000000000", "$12T"), ("2000000000", "$2.0B"), ("15600000000", "$16B"), ("345500000", "$346M"), ("345917", "$346K"), ("950.4", "$950"), (None, None)]
    assert told(spark, lambda c: text.short_money(c.cast("decimal(30,6)")), [(a,) for a, _ in amounts], ["d"]) == [b for _, b in amounts]
    df = spark.createDataFrame([(date(2024, 1, 1), 0), (date(2023, 12, 1), 1), (date(2023, 1, 1), 2), (date(2020, 11, 1), 3), (date(2025, 1, 1), 4)], "d date, i int")
    assert [r.x for r in df.orderBy("i").select(text.tenure(F.col("d"), F.lit(date(2024, 1, 1))).alias("x")).collect()] == ["0 months", "1 month", "1 year", "3 yr 2 mo", "0 months"]
    assert told(spark, geo.state_code, [("new  york",), (" ga ",), ("West Virginia",), ("Ontario",), (None,)], ["s"]) == ["NY", "GA", "WV", None, None]


def test_capped_lists_pages_and_label_columns(spark):
    rows, counts = relational.capped(spark.range(7), 5, F.desc("id"))
    assert [r.id for r in rows.collect()] == [6, 5, 4, 3, 2] and tuple(counts.collect()[0]) == (5, 7, 2)
    mail = spark.createDataFrame([("a", i, datetime(2024, 1, 1 + i)) for i in range(6)] + [("b", 9, datetime(2024, 1, 9)), (None, 10, datetime(2024, 1, 9))], "box string, id int, at timestamp")
    got = activity.oldest_pages(mail, "box", "at", "id", F.lit(datetime(2024, 1, 2)), size=2, pages=2).collect()
    assert {(r.box, r.id, r.page, r.truncated) for r in got} == {("a", 1, 1, True), ("a", 2, 1, True), ("a", 3, 2, True), ("a", 4, 2, True), ("b", 9, 1, False), (None, 10, 1, False)}
    teams = [("city", f"Town {i}", f"TOWN-{i}", i) for i in range(60)] + [("depts", f"Dept {i % 3}", "X", 100 + i) for i in range(60)] + [("teams", f"The {i} Group", "X", 200 + i) for i in range(60)] + [("few", "Dept", "X", 300)]
    df = spark.createDataFrame(teams, "roster string, team string, city string, id int")
    left = rosters.drop_label_columns(df, "roster", "team", "city").filter("team <> ''").groupBy("roster").count().collect()
    assert {r.roster: r["count"] for r in left} == {"teams": 60, "few": 1}
