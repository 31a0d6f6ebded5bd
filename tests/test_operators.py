"""Operators on literal rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rosterloom.operators import activity, allocation, audit, graph, matching, relational


def test_allocation_sums_back(spark):
    rows = spark.createDataFrame([("f", "a", 1), ("f", "a", 2), ("f", "b", 1), ("g", "c", 1)], "firm string, person string, office int")
    totals = spark.createDataFrame([("f", 100.0), ("g", 10.0), ("h", 7.0)], "firm string, assets double")
    got = allocation.allocate(rows, totals, "firm", "person", "assets")
    assert sorted(r.allocated for r in got.collect()) == [10.0, 25.0, 25.0, 50.0]
    assert allocation.reconcile(got, totals, "firm", "assets").first() == (117.0, 110.0, 110.0)


def test_latest_book_reports_conflicts(spark):
    df = spark.createDataFrame([("x", 5.0, 1), ("x", 7.0, 2), ("y", 1.0, 1), ("y", 1.001, 1)], "acct string, v double, stamp int")
    got = {r.acct: (r.v, r.holders, r.conflict) for r in allocation.latest_book(df, "acct", "v", F.col("stamp")).collect()}
    assert got == {"x": (7.0, 2, True), "y": (1.001, 2, False)}


def test_chain_stops_at_a_cycle_and_after_the_hops(spark):
    edges = spark.createDataFrame([(1, 2, 5), (1, 9, 4), (2, 3, 1), (3, 1, 1), *[(k, k + 1, 1) for k in range(10, 40)]], "child int, parent int, weight int")
    starts = spark.createDataFrame([(1,), (10,), (77,)], "node int")
    got = {r.node: r.chain for r in graph.chains(edges, starts).collect()}
    assert got == {1: [1, 2, 3], 10: list(range(10, 23)), 77: [77]}


def test_components(spark):
    edges = spark.createDataFrame([*[(k, k + 1) for k in range(1, 60)], (100, 101), (101, 100), (None, 5)], "a int, b int")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert set(got[k] for k in range(1, 61)) == {1} and got[101] == 100 and len(got) == 62


def test_components_of_shuffled_paths_and_a_hub(spark):
    import random

    names = list(range(900))
    random.Random(3).shuffle(names)
    path, hub = names[:500], names[500:800]
    edges = spark.createDataFrame([*zip(path, path[1:]), *[(hub[0], x) for x in hub[1:]], (names[800], names[801])], "a int, b int")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    want = {x: min(group) for group in (path, hub, names[800:802]) for x in group}
    assert got == want


def test_numbered_is_the_position_in_the_order(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("g")).repartition(7)
    got = relational.numbered(df, "pos", F.desc("g"), F.asc("id")).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(1, 501))
    assert [r.id for r in got] == sorted(range(500), key=lambda i: (-(i % 3), i))


def test_bridge_needs_both_directions(spark):
    left = spark.createDataFrame([(1, "k"), (2, "m"), (3, "m"), (4, "n")], "l int, k string")
    right = spark.createDataFrame([(10, "k"), (20, "m"), (30, "n"), (31, "n")], "r int, k string")
    assert [tuple(r) for r in relational.bridge(left, right, ["k"], "l", "r").collect()] == [(1, 10)]


def test_routes_upsert_interleave(spark):
    df = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "id int, ref int")
    a, b = spark.createDataFrame([(1, "x")], "id int, who string"), spark.createDataFrame([(5, "z"), (6, "y")], "ref int, who string")
    got = relational.first_route(df, ("direct", a, ["id"]), ("ref", b, ["ref"]), value="who").orderBy("id").collect()
    assert [(r.who, r.route) for r in got] == [("x", "direct"), ("y", "ref"), (None, "none")]
    old, new = spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string"), spark.createDataFrame([(2, "new"), (3, "new")], "k int, v string")
    assert {r.k: r.v for r in relational.upsert(old, new, ["k"]).collect()} == {1: "old", 2: "new", 3: "new"}
    assert {r.k: r.v for r in relational.upsert(old, new, ["k"], replace=False).collect()} == {1: "old", 2: "old", 3: "new"}
    mail = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a")], "id int, domain string")
    assert [r.id for r in relational.interleave(mail, "domain", "id").orderBy("position").collect()] == [1, 3, 2, 4]


def test_within_miles_equals_all_pairs(spark):
    from rosterloom.functions import geo

    points = spark.range(300).select("id", (F.col("id") * 37 % 170 - 85.0).alias("lat"), (F.col("id") * 91 % 360 - 180.0).alias("lon"))
    others = points.filter("id % 3 = 0").select(F.col("id").alias("o_id"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"))
    near = {(r.id, r.o_id) for r in relational.within_miles(points.filter("abs(lon) < 170"), others.filter("abs(o_lon) < 170"), 400.0, size=5.0).collect()}
    every = points.filter("abs(lon) < 170").crossJoin(others.filter("abs(o_lon) < 170")).filter(geo.miles(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon")) <= 400)
    assert near == {(r.id, r.o_id) for r in every.collect()} and near


def test_best_record_and_donation(spark):
    df = spark.createDataFrame([("p", 0.9, "", "m1"), ("p", 0.88, "555", ""), ("p", 0.5, "777", "m3")], "id string, s double, phone string, mail string")
    best = matching.best_record(df, "id", "s", 0.05, F.desc(F.col("phone") != ""), F.desc("s")).first()
    assert best["phone"] == "555"
    filled = matching.donate(df, "id", ["phone", "mail"], F.desc("s")).orderBy(F.desc("s")).first()
    assert (filled["phone"], filled["mail"]) == ("555", "m1")


def test_tiers(spark):
    df = spark.createDataFrame([("a", 1, 0.9, 1.0), ("a", 2, 0.5, 0.0), ("b", 1, 0.8, 1.0), ("b", 2, 0.75, 1.0), ("c", 1, 0.2, 0.0)], "k string, id int, score double, name_score double")
    assert {r.k: r.tier for r in matching.decide(df, "k", "id").collect()} == {"a": "high", "b": "review", "c": "none"}


def test_sticky_codes_and_bounces(spark):
    df = spark.createDataFrame([("x", "U"), ("x", "1"), ("y", "2"), ("y", "N")], "a string, code string")
    assert {r.a: r.code for r in activity.strongest_code(df, "a", "code").collect()} == {"x": "U", "y": "N"}
    said = ["Status: 5.1.1", "Status: 5.7.1", "Status: 4.2.2", "all is well", "Status: 5.1.8", "status: 5.2.2", "550 5.1.1 no such user", "smtp; 550", "Status: 2.0.0", "we block spam", "Status: 5.01.010", None]
    kinds = spark.createDataFrame([(k, t) for k, t in enumerate(said)], "k int, t string").select("k", activity.bounce(F.col("t")).alias("b")).orderBy("k").collect()
    assert [r.b.kind for r in kinds] == ["hard", "policy", "soft", None, "hard", "policy", "hard", "hard", None, None, "hard", None]
    assert [r.b.code for r in kinds if r.b.kind] == ["5.1.1", "5.7.1", "4.2.2", "5.1.8", "5.2.2", "550", "550", "5.1.10"]
    mail = spark.createDataFrame([("MAILER-DAEMON@x", "hi", None, None), ("a@x", "Undeliverable: hi", None, None), ("a@x", "hi", "multipart/report; report-type=delivery-status", ""), ("a@x", "hi", "", "true"), ("a@x", "Re: Undeliverable", None, None)], "s string, j string, c string, f string")
    assert [r.r for r in mail.select(activity.is_report(F.col("s"), F.col("j"), F.col("c"), F.col("f")).alias("r")).collect()] == [True] * 4 + [False]


def test_limits(spark):
    at = lambda h: datetime(2024, 1, 1 + h // 24, h % 24)
    df = spark.createDataFrame([("u", 1, at(0), 6), ("u", 2, at(10), 5), ("u", 3, at(24), 1)], "user string, id int, ts timestamp, n int")
    used = df.select("id", relational.rolling_sum(df, "user", "ts", "n", 86400).alias("used")).orderBy("id").collect()
    assert [r.used for r in used] == [6, 11, 12]  # a row exactly a day old still counts
    free = activity.capacity_returns(df.filter("id < 3"), "user", "ts", "id", "n", 4, 12).first()
    assert free["free_at"] == at(24)


@pytest.mark.parametrize("most,ok", [(0, False), (1, True)])
def test_drift(spark, most, ok):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    assert audit.drift_within(a, b, "k", "v", most) is ok


STATE = "k int, direction string, classification string, occurred_at timestamp"


def test_replies_acts_and_snoozes(spark):
    day = lambda d: datetime(2024, 3, d)
    log = spark.createDataFrame([
        (1, "inbound", "reply", day(5)), (2, "inbound", "reply", day(5)), (3, "inbound", "reply", day(5)), (4, "inbound", "bounce", day(6)), (5, "inbound", "bounce", day(6)),
        (6, "inbound", "reply", datetime(2024, 1, 2)), (7, "outbound", "sent", datetime(2024, 1, 2)), (8, "inbound", "reply", day(5)), (9, "inbound", "auto_reply", day(5)), (10, "outbound", "reply", day(5)),
    ], STATE)
    acts = spark.createDataFrame([
        (2, None, day(6), None, None, None), (3, "follow_up", day(6), None, None, None), (4, None, None, day(1), None, True), (5, None, None, None, day(20), None),
        (6, "done", day(1), None, None, None), (8, "done", day(4), None, None, None),
    ], "k int, reply_state string, acted_at timestamp, next_action_at timestamp, snoozed_until timestamp, bounce_dismissed boolean")
    as_of = F.lit("2024-03-10").cast("timestamp")
    made = activity.fold(log, ["k"], as_of, decisions=acts)
    assert {r.k: r.reply_state for r in made.collect()} == {1: "new", 2: "reviewed", 3: "follow_up", 4: "none", 5: "none", 6: "done", 7: "none", 8: "new", 9: "none", 10: "none"}
    assert {r.k for r in made.filter("ever_replied").collect()} == {1, 2, 3, 6, 8}
    queue = activity.attention(made, as_of)
    assert [(r.k, r.reason) for r in queue.orderBy("urgency", "last_activity", "k").collect()] == [(1, "reply_new"), (8, "reply_new"), (3, "reply_followup"), (4, "due"), (6, "quiet_warm")]
    seeded = activity.fold(log, ["k"], as_of, historic=F.col("k") != 1)
    assert {r.k: r.reply_state for r in seeded.filter("k in (1, 2)").collect()} == {1: "new", 2: "reviewed"}
    assert activity.drift(made, made, ["k"], ["last_in", "has_bounce"]).collect() == []


def test_levels_need_a_sample_and_include_their_bounds(spark):
    sends = spark.createDataFrame([(1, "a")] * 100 + [(2, None)] * 29, "rep int, domain string")
    events = spark.createDataFrame([(1, "a", "hard")] * 2 + [(1, "a", "policy")] * 3 + [(1, "a", "soft")] * 9 + [(2, None, "hard")] * 9 + [(3, "b", "odd")], "rep int, domain string, kind string")
    outs = spark.createDataFrame([(1, "a")], "rep int, domain string")
    got = {(r.rep, r.domain): r for r in activity.health(sends, events, outs, "rep", "domain").collect()}
    r = got[1, None]
    assert (r.sent, r.hard_level, r.policy_level, r.soft_level, r.unsubscribed_level) == (100, "warn", "bad", "ok", "warn")
    assert got[2, "(unknown)"].hard_level == "unknown" and got[2, None].hard == 9


def test_turned_away_events_do_not_count(spark):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    df = spark.createDataFrame([("u", 1, at(0)), ("u", 2, at(6)), ("u", 3, at(10)), ("u", 4, at(19)), ("u", 5, at(20)), ("v", 6, at(6))], "k string, id int, ts timestamp")
    assert {r.id: r.admitted for r in activity.admitted(df, "k", "ts", "id", 10).collect()} == {1: True, 2: False, 3: True, 4: False, 5: True, 6: True}
    mutual = spark.createDataFrame([(1, 1, "a", "a@x", ["b@x"]), (1, 2, "b", "b@x", ["a@x"]), (1, 3, "c", None, None), (2, 1, "b", "b@x", [])], "batch int, pos int, who string, mail string, cc array<string>")
    assert {(r.batch, r.who): r.kept for r in activity.without_copied(mutual, "batch", "pos", "who", "mail", "cc").collect()} == {(1, "a"): True, (1, "b"): False, (1, "c"): True, (2, "b"): True}


def test_history_flags_and_settings(spark):
    calls = spark.createDataFrame([(1, "h1", datetime(2024, 1, 2)), (2, None, datetime(2024, 1, 1))], "id int, written string, occurred_at timestamp")
    crm = spark.createDataFrame([("h1", datetime(2024, 1, 2)), ("h2", datetime(2024, 1, 3))], "crm string, occurred_at timestamp")
    assert activity.call_history(calls, crm, "written", "crm").count() == 3
    assert activity.call_history(calls, crm, "written", "crm", F.lit("2024-01-02").cast("timestamp")).count() == 2
    flags = spark.createDataFrame([("a", True, False), ("b", True, True)], "k string, p boolean, q boolean")
    moves = spark.createDataFrame([("a", False, None), ("b", None, False), ("c", None, True), ("d", None, None)], "k string, p boolean, q boolean")
    assert {tuple(r) for r in activity.set_flags(flags, moves, "k", ["p", "q"]).collect()} == {("b", True, False), ("c", False, True)}
    old = spark.createDataFrame([("u", {"tz": "UTC", "sign": "me"})], "k string, s map<string,string>")
    sent = spark.createDataFrame([("u", {"tz": "Europe/Berlin", "evil": "x"}), ("w", {"sign": "long text"})], "k string, s map<string,string>")
    got = {r.k: r.s for r in activity.merge_settings(old, sent, "k", "s", {"tz": 6, "sign": 4}).collect()}
    assert got == {"u": {"tz": "Europe", "sign": "me"}, "w": {"sign": "long"}}


def test_book_with_ties_and_distinct_holders(spark):
    df = spark.createDataFrame([("x", 1.0, 1, "h"), ("x", 2.0, 2, "h"), ("y", 1.0, 1, "h"), ("y", 3.0, 1, "i"), ("z", 5.0, 1, "h"), ("z", 5.0, 1, "h")], "acct string, v double, stamp int, who string")
    got = {r.acct: (r.v, r.holders, r.conflict, r.unresolved) for r in allocation.latest_book(df, "acct", "v", F.col("stamp"), holder=F.col("who")).collect()}
    assert got == {"x": (2.0, 1, True, False), "y": (3.0, 2, True, True), "z": (5.0, 1, False, False)}


def test_percent_ranks_over_tasks_equal_the_window(spark):
    from rosterloom.functions import numeric

    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 9.0), ("b", 5.0), (None, 1.0), (None, 1.0)], "g string, v double").repartition(3)
    got = sorted((r.g or "", r.v, r.p) for r in relational.percent_ranks(df, "g", "v", "p").collect())
    assert got == sorted((r.g or "", r.v, r.p) for r in df.select("g", "v", numeric.percent_rank_average(F.col("v"), "g").alias("p")).collect())


def test_values_at_places_equal_the_lists(spark):
    df = spark.createDataFrame([("a", v) for v in (5, 1, 3, 3)] + [("b", 7), ("c", None)], "k string, v int")
    got = {r.k: (r.n, r.top, r.low) for r in relational.at_places(df, ["k"], "v", {"top": F.floor(F.col("n") / 2), "low": F.floor((F.col("n") - 1) * F.lit(0.12))}).collect()}
    assert got == {"a": (4, 3, 1), "b": (1, 7, 7)}
