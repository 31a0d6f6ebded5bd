"""Matching of contacts and names against plain loops over small tables."""


import pytest
from pyspark.sql import functions as F

from rosterloom.functions import names
from rosterloom.operators import matching
from rosterloom.plans import match_queries

DATA = "/root/testdata/sf0.001"


def near(a, b):
    """Whether one edit or none leads from a to b."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def agreement(given, forms):
    best = 0.0
    for x in given:
        for y in forms:
            best = max(best, 1.0 if x == y else 0.8 if min(len(x), len(y)) > 1 and near(x, y) else 0.45 if min(len(x), len(y)) == 1 and x[0] == y[0] else 0.0)
    return best


def plain_match(rec, index, config):
    """One contact after the other, as a person would write it down."""
    known = {r["id"] for r in index}
    if rec["given_id"] in known:
        return rec["given_id"], "confirmed", 1.0
    said = rec["name"].split(",")
    skip = {"jr", "sr", "ii", "iii", "iv", "v", "md", "cfp", "cfa", "cpa", "phd"}
    surnames = {r["last_key"] for r in index}

    def parse(parts):
        kept = [parts[0], *[p for p in parts[1:] if p.strip().lower() not in ("cfp", "")]]
        words = [w.lower() for p in kept for w in p.replace(".", " ").split() if w.strip(".").lower() not in skip]
        return words[:-1], (words[-1] if words else "")

    given, last = parse(said)
    if last not in surnames:
        for cut in (1, 2):
            if len(said) > cut and (trial := parse(said[:-cut]))[1] in surnames:
                given, last = trial
                break
    tail = rec["name"].replace(",", " ").replace(".", " ").split()[-1].lower()
    scored = []
    for r in index:
        if r["last_key"] != last:
            continue
        n = agreement(given, r["forms"])
        if n <= 0 and rec["email"] and rec["firm"] in r["firms"] and rec["email"].split("@")[0].split(".")[-1] == last:
            n = 0.60
        if n <= 0:
            continue
        f, c, s = rec["firm"] in r["firms"], rec["city"] in r["cities"], rec["state"] in r["states"]
        rest = config.name * n + config.city * c + config.state * s
        total = rest + config.firm * f if rec["firm"] else rest / (config.name + config.city + config.state)
        suffix = tail if tail in ("jr", "sr") else None
        total += 0 if not suffix or not r["suffix"] else config.generation * (1 if suffix == r["suffix"] else -1)
        scored.append((-total, r["id"], n))
    if not scored:
        return None, "none", 0.0
    scored.sort()
    best, gap = -scored[0][0], -scored[0][0] + (scored[1][0] if len(scored) > 1 else 0)
    namesakes = sum(n >= 0.8 for _, _, n in scored)
    high = best >= config.accept and gap >= config.margin and namesakes <= config.namesakes
    return scored[0][1], "high" if high else "review", best


def test_contacts_against_a_plain_loop(spark):
    people, index = match_queries._people(spark, DATA)
    small = index.withColumn("last_key", F.expr("substring(last_key, 1, length(last_key) - 2)"))  # several candidates a surname
    near_ = people.withColumn("name", F.regexp_replace("name", "[a-j]{2}(,.*| Jr.)?$", "$1")).withColumn("email", F.regexp_replace("email", "[a-j]{2}@", "@"))
    met = set()
    for p, i in ((people, index), (near_, small)):
        rows = [r.asDict() for r in i.collect()]
        want = {r["contact"]: plain_match(r, rows, matching.CONTACT) for r in (x.asDict() for x in p.collect())}
        got = {r.contact: (r.id, r.tier, r.score) for r in matching.match_contacts(p, i).collect()}
        assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
        assert all(abs(got[k][2] - want[k][2]) < 1e-3 for k in want)
        met |= {v[1] for v in got.values()}
    assert met == {"confirmed", "high", "review", "none"}


def test_safe_lookup_drops_twins_and_strangers(spark):
    decided = spark.createDataFrame([
        (1, 10, "high", 0.2, "Bill Oak", None), (2, 20, "high", 0.9, "Ann Elm", None), (3, 20, "high", 0.9, "Ann Elm", None), (4, 30, "high", 0.15, "Dave Ash", None),
        (5, 40, "high", 0.8, "Chip Fir", None), (6, 50, "high", 0.8, "Art Yew", "art.yew@x.com"), (7, 60, "review", 0.9, "Jo Bay", None), (8, 70, "high", 0.1, "No File", None),
    ], "contact int, id int, tier string, gap double, name string, email string")
    filed = spark.createDataFrame([(10, "William Oak", None), (20, "Ann Elm", None), (30, "Shanicia Ash", None), (40, "Edward Fir", None), (50, "Lorin Yew", "lorin.yew@x.com"), (60, "Jo Bay", None)], "id int, filed_name string, filed_email string")
    assert {(r.id, r.contact) for r in matching.safe_lookup(decided, filed, "contact", "id").collect()} == {(10, 1), (40, 5), (70, 8)}


def test_confirmed_ids_keep_what_was_inferred(spark):
    decided = spark.createDataFrame([("a", 1, 0.5, "review"), ("b", 2, 0.9, "high")], "k string, id int, score double, tier string")
    got = {r.k: r for r in matching.confirm(decided, spark.createDataFrame([("a", 9)], "k string, id int"), "k", "id").collect()}
    assert (got["a"].id, got["a"].tier, got["a"].score, got["a"].inferred, got["a"].inferred_score) == (9, "confirmed", 1.0, 1, 0.5)
    assert (got["b"].id, got["b"].tier, got["b"].inferred) == (2, "high", 2)


def test_no_candidates_left_is_none_and_any_best_is_for_review(spark):
    df = spark.createDataFrame([("a", 1, 0.3, 0.45), ("a", 2, 0.9, 0.0), ("b", 3, 0.9, 0.0)], "k string, id int, score double, name_score double")
    got = {r.k: (r.id, r.tier, r.score) for r in matching.decide(df, "k", "id").collect()}
    assert got == {"a": (1, "review", 0.3), "b": (None, "none", 0.0)}


@pytest.mark.parametrize("said,given,last", [("Ann Oak, Unheard", ["ann"], "oak"), ("Ann Oak, X, Y", ["ann"], "oak"), ("Ann Nobody, Z", ["ann", "nobody"], "z"), ("Oak", [], "oak")])
def test_surnames_from_the_index(spark, said, given, last):
    index = spark.createDataFrame([("oak",)], "last_key string")
    r = matching.resolved_names(spark.createDataFrame([(1, said)], "c int, name string"), index, "c").first()
    assert (r.given, r.last_key) == (given, last) and names.NICKNAMES


def test_a_surname_of_many_people_makes_no_pairs(spark, monkeypatch):
    """Ten times the people of one surname: ten times the lookups, equal boxes, and what every pair would give."""
    sizes, plain = [], matching.two_best

    def seen(rows, held, total):
        sizes.append((rows.count(), held.count()))
        return plain(rows, held, total)

    monkeypatch.setattr(matching, "two_best", seen)
    schema = "contact long, name string, email string, firm string, city string, state string, given_id long"
    for n in (60, 600):
        index = [{"id": i, "last_key": "shaw", "forms": [["lynn"], ["lyn", "l"], ["bob"]][i % 3], "firms": [f"f{i % 4}"], "cities": ["x" if i % 5 else "y"], "states": ["s"], "suffix": "jr" if i % 7 == 0 else None} for i in range(n)]
        people = [(i, ["Lynn Shaw", "Zed Shaw", "L Shaw Jr."][i % 3], "z.shaw@x.com" if i % 2 else None, f"f{i % 4}" if i % 9 else None, "x", "s" if i % 4 else None, None) for i in range(n)]
        rows, known = spark.createDataFrame(people, schema), spark.createDataFrame(index, "id long, last_key string, forms array<string>, firms array<string>, cities array<string>, states array<string>, suffix string")
        got = {r.contact: (r.id, r.tier, round(r.score, 3)) for r in matching.match_contacts(rows, known).collect()}
        if n == 60:
            want = {r.contact: plain_match(r.asDict(), index, matching.CONTACT) for r in rows.collect()}
            assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    assert sizes[1][0] <= 11 * sizes[0][0] and sizes[1][1] == sizes[0][1]
