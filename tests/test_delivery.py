"""Delivery reports, checks of messages and branches on literal rows."""

from datetime import datetime

from pyspark.sql import functions as F

from rosterloom.catalog import QUERIES
from rosterloom.operators import delivery, graph

NOW = datetime(2024, 5, 10)
REPORT = "rep int, mailbox string, item int, received timestamp, sender string, subject string, content_type string, flagged string, body string, refs array<string>"


def test_what_a_report_may_do(spark):
    def report(item, body, refs=("<A@x>",), sender="postmaster@x.com", day=9):
        return (1, "Me@us.com", item, datetime(2024, 5, day), sender, "Undeliverable: hi", None, "", body, list(refs))

    rows = [
        report(1, "Final-Recipient: rfc822; Ann@a.com\nStatus: 5.1.1"), report(2, "Final-Recipient: rfc822;eve@b.com\nStatus: 5.1.1"), report(3, "Status: 4.2.2"), report(4, "Status: 5.1.1", ["<old@x>"]),
        report(5, "Status: 5.1.1", sender="me@US.com"), report(6, "Status: 5.1.1", day=7), report(7, "Status: 5.1.1"), report(8, "nothing"), report(9, "Status: 5.1.1", ["<none@x>", "<B@x>", "<A@x>"]),
        report(10, "Status: 5.1.1", []),
    ]
    sent = spark.createDataFrame([(1, "<a@X>", "m1", "ann@a.com", datetime(2024, 5, 1)), (1, "<b@x>", "m2", "Bob@b.com", datetime(2024, 5, 1)), (1, "<old@x>", "m3", "c@c.com", datetime(2024, 3, 1)), (2, "<none@x>", "m4", "d@d.com", datetime(2024, 5, 1))], "rep int, internet_id string, message string, recipient string, at timestamp")
    seen = spark.createDataFrame([(1, 7)], "rep int, item int")
    got = {r.item: (r.outcome, r.address, r.act) for r in delivery.sweep(spark.createDataFrame(rows, REPORT), sent, seen, F.lit(NOW)).collect()}
    assert got == {
        1: ("hard", "ann@a.com", True), 2: ("recipient-mismatch", None, False), 3: ("soft", "ann@a.com", False), 4: ("unmatched", None, False),
        8: ("not-a-bounce", None, False), 9: ("hard", "bob@b.com", True), 10: ("unmatched", None, False),
    }


def test_what_stops_a_message(spark):
    kind = "batch int, message int, recipient string, subject string, body string, html string, signature string, images array<string>, base_revision int, common_revision int, attachments array<struct<id:int,version:int,sha256:string,size:long,approved:boolean>>"
    file = (1, 2, "s", 300, True)
    rows = [
        (1, 1, "a@a.com", "Hi", "Dear Ann", "é", None, ["One"], 0, 3, [file]), (1, 2, "b@a.com", " ", "{{x}} {{image: one }}", "", "", ["One"], 3, 3, []), (1, 3, "b@a.com", "{{ image:two}}", "", "", "", ["One"], 1, 0, None),
        (2, 4, "b@a.com", "Hi {{image:two}}", "t", "", "", None, None, None, [(1, 1, "s", 900, True), file]), (2, 5, None, None, None, None, None, None, None, None, [(9, 1, "s", 3, True)]), (3, 6, "gone@a.com", "s", "t" * 11, "", "", [], 0, 0, [(1, 2, "s", 1000, True)] * 10),
    ]
    got = delivery.check(spark.createDataFrame(rows, kind), spark.createDataFrame([("gone@a.com",)], "recipient string"), spark.createDataFrame([(1, 2, "s")], "id int, version int, sha256 string"), 9000, 500, 10)
    got = {r.message: (r.errors, r.behind, r.estimated_bytes) for r in got.collect()}
    assert got == {
        1: ([], True, 2 + 2 + 400 + 4096), 2: (["duplicate_recipient", "missing_subject", "unresolved_merge_fields", "body_too_large"], False, 1 + 4096), 3: (["duplicate_recipient", "missing_body", "unknown_image"], False, 14 + 4096),
        4: (["attachment_unavailable", "attachment_too_large"], False, 16 + 1600 + 4096), 5: (["invalid_recipient", "missing_subject", "missing_body", "attachment_unavailable"], False, 4 + 4096),
        6: (["permanent_bounce_suppression", "attachment_too_large", "message_too_large", "body_too_large"], False, 1 + 13334 + 4096),
    }


def test_branches_by_mail_and_street(spark):
    kind = "id int, emails array<string>, address string, zip string, city string, state string"
    rows = [(1, ["A@x.com", None], None, None, "Rome", "GA"), (2, ["a@x.com", "b@x.com"], "1 Oak St., Suite 2", "30301-1", "Rome", "GA"), (3, None, "1 OAK ST SUITE 2", "30301", "Rome", "GA"), (4, [], "1 Oak St., Suite 2", "99999", "Rome", "NY"), (5, None, None, None, None, None), (6, ["c@x.com"], "", "", "Troy", "NY"), (7, ["C@x.com"], None, None, "Troy", "NY")]
    got = {r.id: (r.branch_id, r.branch_name, r.branch_size) for r in graph.branches(spark.createDataFrame(rows, kind), "id", "id").collect()}
    assert got[1] == got[2] == got[3] and got[1][1:] == ("Rome, GA (1 Oak St.)", 3)
    assert got[4] == got[5] == (None, None, 1)
    assert got[6] == got[7] and got[6][1:] == ("Troy, NY", 2) and got[6][0] != got[1][0]


def test_branch_groups_hold_every_firm_once(spark):
    data = "/root/testdata/sf0.001"
    got = QUERIES["branch_groups"](spark, data).collect()
    assert len(got) == len({r.s_suppkey for r in got}) == spark.read.parquet(f"{data}/supplier.parquet").count()
    for r in got:
        assert (r.branch_id is None) == (r.branch_size == 1)
        assert r.branch_id is None or sum(x.branch_id == r.branch_id for x in got) == r.branch_size
