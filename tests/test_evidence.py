"""The evidence matcher against every pair of people, one by one."""

import random

from pyspark.sql import functions as F

from rosterloom.functions import names
from rosterloom.operators import evidence, matching

PUBLISHED = "pub long, last_key string, said array<string>, firm string, city string, state string, suffix string"
INDEX = "id long, last_key string, forms array<string>, firms array<string>, cities array<string>, states array<string>, suffix string"
NOISE = set(names.FIRM_NOISE)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def agreement(a, b):
    if a == b:
        return 1.0
    if len(a) > 1 and len(b) > 1:
        return 0.8 if edits(a, b) <= 1 else 0.0
    return 0.45 if a[:1] == b[:1] else 0.0


def words(name):
    return {w for w in "".join(c if c.isalpha() else " " for c in name.lower()).split() if len(w) > 1 and w not in NOISE}


def firm(published, known):
    parts = [w for w in map(words, (published or "").split("|")) if w]
    if not parts:
        return None
    sets = [w for w in map(words, known or []) if w]
    return max(len(p & k) / min(len(p), len(k)) for p in parts for k in sets) if sets else 0.3


def one_by_one(published, index, config=matching.MatchConfig()):
    out = {}
    for pub, last, said, firm_name, city, state, suffix in published:
        rated, namesakes = [], 0
        for key, l, forms, firms, cities, states, ending in index:
            n = max((agreement(a, b) for a in said or [] for b in forms), default=0)
            if l != last or n <= 0:
                continue
            f, c, s = firm(firm_name, firms), float(city is not None and city in (cities or [])), float(state is not None and state in (states or []))
            rest = n * config.name + c * config.city + s * config.state
            total = rest / (config.name + config.city + config.state) if f is None else rest + f * config.firm
            total += config.generation * (0 if not suffix or not ending else 1 if suffix == ending else -1)
            namesakes += n >= 0.8
            rated.append((-round(total, 4), key))
        rated.sort()
        score = -rated[0][0] if rated else 0.0
        gap = round(score + (rated[1][0] if len(rated) > 1 else 0.0), 4)
        tier = "none" if not rated else "high" if score >= 0.72 and gap >= 0.12 and namesakes <= 3 else "review"
        out[pub] = (rated[0][1] if rated else None, score, gap if rated else 0.0, namesakes, tier)
    return out


def check(spark, published, index):
    got = evidence.match_published(spark.createDataFrame(published, PUBLISHED), spark.createDataFrame(index, INDEX), "pub").collect()
    assert len(got) == len(published)
    want = one_by_one(published, index)
    assert {r.pub: (r.id, round(r.score, 4), round(r.gap, 4), r.namesakes, r.tier) for r in got} == {k: (v[0], round(v[1], 4), *v[2:]) for k, v in want.items()}
    return want


def test_random_people(spark):
    rng = random.Random(3)
    given = ["john", "jon", "jonn", "jo", "j", "ann", "anne", "a", "nan", "mary", "marie", "m", "bob"]
    firms = ["Oak Hill Advisors LLC", "Oak Wealth", "Hill River Group", "River Capital | Oak Partners", "The Company", "", None]
    pick = lambda xs, n: rng.sample(xs, rng.randint(0, n))
    index = [(i, rng.choice(["shaw", "lee"]), sorted(set(rng.choices(given, k=rng.randint(1, 3)))), rng.choice([None, pick([f for f in firms if f], 2), pick([f for f in firms if f], 2)]), pick(["x", "y", "z"], 2), pick(["s", "t"], 2), rng.choice([None, None, "jr", "sr", "iii"])) for i in range(120)]
    published = [(i, rng.choice(["shaw", "lee", "nobody", None]), rng.choice([None, [], rng.choices(given, k=2), [rng.choice(given)], [rng.choice(given)]]), rng.choice(firms), rng.choice(["x", "y", None, "q"]), rng.choice(["s", "t", None]), rng.choice([None, None, "jr", "iii"])) for i in range(150)]
    index += [(500 + i, f"rare{i}", ["john"], ["Oak Wealth"], ["x"], ["s"], None) for i in range(4)]
    published += [(500 + i, f"rare{i}", ["jon"], "Oak Hill", "x", "s", None) for i in range(4)]
    tiers = {v[-1] for v in check(spark, published, index).values()}
    assert tiers == {"none", "review", "high"}


def test_twins_and_repeats(spark):
    """Two people alike in all are a gap of nothing; repeated published rows get the same answer."""
    index = [(2, "shaw", ["lynn"], ["Oak"], ["x"], ["s"], None), (1, "shaw", ["lynn"], ["Oak"], ["x"], ["s"], None), (3, "shaw", ["lynn"], None, [], [], "jr")]
    rows = [(1, "shaw", ["lynn"], "Oak", "x", "s", None), (2, "shaw", ["lynn"], "Oak", "x", "s", None), (3, "shaw", ["lynn"], None, None, None, "jr")]
    found = check(spark, rows, index)
    assert found[1] == (1, 1.0, 0.0, 3, "review") and found[3][0] == 3


def test_empty_sides(spark):
    rows = [(1, "shaw", ["lynn"], "Oak", "x", "s", None)]
    index = [(1, "shaw", ["lynn"], ["Oak"], ["x"], ["s"], None)]
    check(spark, rows, [])
    check(spark, [], index)


def test_spellings_that_meet_nearly_all_agree(spark):
    """One hot surname with every spelling of two words: few pairs meet that do not agree, and all that do."""
    rng = random.Random(7)
    forms = {"".join(rng.choices("abcde", k=rng.randint(2, 7))) for _ in range(400)} | set("abcde")
    known = spark.createDataFrame([("shaw", [w]) for w in sorted(forms)], "last_key string, forms array<string>")
    met = evidence.name_pairs(known.withColumnRenamed("forms", "said"), known)
    rows = [(r.said[0], r.forms[0]) for r in met.collect()]
    kept = {(a, b) for a in forms for b in forms if agreement(a, b) > 0}
    assert kept <= set(rows) and len(rows) == len(set(rows)) <= 3 * len(kept)


def test_work_follows_the_people(spark):
    """Ten times the people of one name make ten times the cells that are looked up, not a hundred times."""
    def looked(n):
        index = spark.range(n).select(F.col("id"), F.lit("shaw").alias("last_key"), F.array(F.lit("lynn")).alias("forms"), F.array(F.concat(F.lit("firm"), F.chr(97 + F.col("id") % 20))).alias("firms"), F.array((F.col("id") % 7).cast("string")).alias("cities"), F.array((F.col("id") % 3).cast("string")).alias("states"), F.lit(None).cast("string").alias("suffix"))
        return evidence.cells(index.withColumns({"firm_key": F.lit("=x"), "forms_id": F.lit(1)})).count()

    assert looked(3000) <= 10 * looked(300)


def test_a_house_of_many_teams_is_looked_up_once(spark, monkeypatch):
    """People of one name and house in teams of their own: a row looks up its house, not every known firm that agrees."""
    sizes, plain = [], evidence.two_best

    def seen(rows, held, total):
        sizes.append((rows.select(F.explode("parts")).count(), held.count()))
        return plain(rows, held, total)

    monkeypatch.setattr(evidence, "two_best", seen)
    letters = lambda i: "".join(chr(97 + int(d)) for d in f"{i:03d}")
    rows = [(1, "shaw", ["lynn"], "Zeta | Oak Hill", "x", "s", None), (2, "shaw", ["lynn"], "Oak Hill", "q", "s", "jr")]
    for n in (20, 200):
        index = [(i, "shaw", ["lynn"], ["Oak Hill LLC", f"team{letters(i)} zeta"], ["x"], ["s"], "jr" if i == 7 else None) for i in range(n)]
        check(spark, rows, index)
    assert sizes[0] == sizes[1]
