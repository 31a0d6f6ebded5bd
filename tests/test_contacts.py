"""Literal rows for names, addresses, contacts and quotes: what each rule must give."""

import pytest
from pyspark.sql import functions as F

from rosterloom.functions import contacts, display, names, text


def L(x):
    return F.lit(x).cast("string") if x is None else F.lit(x)


def A(*x):
    return F.array(*[F.lit(i) for i in x]) if x else F.array().cast("array<string>")


def H(**k):
    return F.create_map(*[F.lit(v) for kv in k.items() for v in (kv[0].replace("_", "-"), kv[1])]) if k else F.create_map().cast("map<string,string>")


def cs(line):
    found = contacts.city_state(line)
    return F.concat_ws(", ", found["city"], found["state"])


def cases():
    return [
        (cs(L('880 S PRESTON RD STE 10 PROSPER, TX 75078')),'Prosper, TX'),
        (cs(L("12 Oak Rd, Suite A O'FALLON, MO 63366-1234")),"O'Fallon, MO"),
        (cs(L("WARNER TOWERS; TOWER ONE")),''),
        (cs(L("99 Elm; New Haven CT 06511")),'New Haven, CT'),
        (cs(L(None)),''),
        (contacts.without_credentials(L('Adam Example, FPQP')),'Adam Example'),
        (contacts.without_credentials(L('Lynn Example, AWMATM, Jr')),'Lynn Example, Jr'),
        (contacts.without_credentials(L('Smith, John')),'Smith, John'),
        (contacts.without_credentials(L('Cheryl Example, JD, LL.M.')),'Cheryl Example'),
        (text.firm_key(L('SMITH-JONES LLC')),'SMITH JONES'),(text.firm_key(L('ACME L L C')),'ACME'),(text.firm_key(L('Acme Trust Group, N.A.')),'ACME'),
        (F.array_join(text.aliases(L('Acme LLC'),A('ACME, Inc.','Oak Co','none','OAK','Elm & Ash','xy')),'|'),'Oak Co|Elm & Ash'),
        (text.street(L('PHIPPS TOWER-3438 Peachtree Road')),'3438 PEACHTREE RD'),(text.street(L('3280 Peachtree Road North East')),'3280 PEACHTREE RD NE'),
        (text.street(L('3280 PEACHTREE ROAD NORTHEAST, SUITE 2000')),'3280 PEACHTREE RD NE'),(text.street(L('3438 PEACHTREE RD. NE.')),'3438 PEACHTREE RD NE'),
        (text.street(L('PO BOX 1234')),None),(text.street(L('7 Long Trail, rear gate')),'7 LONG TRL'),(text.street(L('5 Main St Bldg 4')),'5 MAIN ST'),(text.street(L('5 Main St')),'5 MAIN ST'),
        (text.street_of(L('Enterprise Mill'),L('1450 Greene Street, Suite 501')),'1450 GREENE ST'),
        (text.money(L('over $5.7B')),5.7e9),(text.money(L('$966M')),966e6),(text.money(L('1,250')),1250.0),(text.money(L('none')),None),
        (names.generation(L('Jr Smith')),None),(names.generation(L('Lynn Shaw II')),'ii'),(names.generation(L('A Example, VI.')),'vi'),
        (names.surname(L('P. Schuyler Example-Quack, Jr.')),'examplequack'),
        (F.array_join(names.given(L('P. Schuyler Example, Jr.')),'|'),'p|schuyler'),
        (F.array_join(F.array_sort(names.given_forms(L('JAMES'),L(None),L('(JAY)'),L('Westmore (Rod)'))),'|'),'jamie|james|jay|jim|jimmy|rod|roderick|rodney'.replace('jamie|james','james|jamie')),
        (names.firm_agreement(L('Oak Team | Merrill Private Wealth Management'),A('MERRILL LYNCH','Acme')),1.0),
        (names.firm_agreement(L('Capital Investment Advisors'),A('Acme')),None),(names.firm_agreement(L('Merrill'),A()),0.30),(names.firm_agreement(L('Merrill'),A('Acme Sons')),0.0),
        (F.array_join(contacts.email_list(L('["a@x.com", "b@y.com"]')),'|'),'a@x.com|b@y.com'),(F.array_join(contacts.email_list(L('a@x.com; b@y.com c')),'|'),'a@x.com|b@y.com'),
        (contacts.own_email(L('Tom Example, CFP'),A('sloane.example@x.com','thomas.example@x.com')),'thomas.example@x.com'),
        (contacts.own_email(L('James Mitch'),A('b.mitch@x.com','j.mitch@x.com')),'j.mitch@x.com'),
        (contacts.own_email(L('Ann Mitch'),A('b.mitch@x.com','c.other@x.com')),'b.mitch@x.com'),
        (contacts.own_email(L('Ann Mitch'),A('b.mitch@x.com','c.mitch@x.com')),None),
        (contacts.own_email(L('Ann Mitch'),A('front@x.com')),'front@x.com'),
        (contacts.given_names_disagree(L('April Bruns'),L('ashley_bruns@m.com'),L('april_bruns@m.com')),True),
        (contacts.given_names_disagree(L('April Bruns'),L('a.bruns@m.com'),L('april_bruns@m.com')),False),
        (contacts.e164(L('1-404-842-2322')),'+14048422322'),(contacts.e164(L('104-842-2322')),None),
        (contacts.first_number(L('(469) 296-0055; Local Phone:(469) 296-0056; Toll-Free Phone:(866) 281-7436')),'(469) 296-0056'),
        (contacts.first_number(L('(866) 281-7436; +14048422322')),'+14048422322'),(contacts.first_number(L('+18004001177')),'+18004001177'),(contacts.first_number(L('nan')),None),
        (contacts.team_name(L('[]')),None),(contacts.team_name(L('[{"team_name": "Oak"}]')),'Oak'),(contacts.team_name(L('{"name":"Elm"}')),'Elm'),(contacts.team_name(L('Ash')),'Ash'),
        (contacts.reply_kind(H(x_auto_response_suppress='All'),L('hi')),'auto_reply'),(contacts.reply_kind(H(auto_submitted='no'),L('hi')),'reply'),(contacts.reply_kind(H(),L(' Out of Office: x')),'auto_reply'),(contacts.reply_kind(H(precedence='Bulk '),L(None)),'auto_reply'),
        (text.quote_present(L('We ofﬁce “here”'),L('office "here"')),True),(text.quote_present(L('abc'),L('')),False),(text.quote_present(L('alpha beta gamma delta then more words here'),L('alpha beta gamma ... more words here')),True),(text.quote_present(L('abc'),L('a ... b')),False),
        (text.quote_status(F.lit(True),L('yes'),L('abc'),L('xabcx')),'verified'),(text.quote_status(F.lit(False),L('yes'),L('abc'),L('x')),'missing_field'),(text.quote_status(F.lit(True),L('No'),L(None),L('x')),'negative_finding'),(text.quote_status(F.lit(True),L('yes'),L(None),L('x')),'VALUE_WITHOUT_QUOTE'),(text.quote_status(F.lit(True),L(None),L(None),L('x')),'not_stated'),(text.quote_status(F.lit(True),L('y'),L('q'),L('x')),'QUOTE_NOT_IN_SOURCE'),
    ]


@pytest.mark.parametrize("part", range(8))
def test_literal_rows(spark, part):
    every = [(k, *case) for k, case in enumerate(cases())][part::8]
    row = spark.range(1).select(*[c.alias(f"c{k}") for k, c, _ in every]).first()
    assert [(k, got, want) for (k, _, want), got in zip(every, row) if got != want] == []


def test_shown_names(spark):
    people = [("BRUNO", "GIOFFRE", "B", "Bruno Gioffre"), ("JAMES", "O'BRIEN JR", "(JAY)", "James O'Brien Jr."), ("anne", "mcdonald", "annie", "Annie McDonald"), ("Mary Ann", "de Groot, CFP", None, "Mary Ann de Groot"), (None, None, "Jr", None)]
    df = spark.createDataFrame(people, "a string, b string, c string, want string")
    assert [r.got for r in df.select(display.display_name(F.col("a"), F.col("b"), F.col("c")).alias("got")).collect()] == [p[3] for p in people]
    firms = [("UBS FINANCIAL SERVICES INC.", "UBS Financial Services Inc."), ("OAK HILL OF THE 10TH MILL, LLC", "Oak Hill of the 10th Mill, LLC"), ("S&P WEALTH &PARTNERS II", "S&P Wealth &Partners II"), ("McKay & Co", "McKay & Co"), ("ACME LP (GA, CRD 123)", "Acme LP (GA, CRD 123)"), (None, "Unknown firm")]
    df = spark.createDataFrame(firms, "a string, want string")
    assert [r.got for r in df.select(display.display_firm(F.col("a")).alias("got")).collect()] == [f[1] for f in firms]


def test_who_can_be_one_person(spark):
    pairs = [
        ("Bill Example", "William Example", True, True), ("Mr. J Example", "James Example", True, True), ("JUAN (JOHN) OECH", "John Oech", True, True), ("Gengshend Liu", "Gengsheng Liu", True, True),
        ("Terri Example", "Darren Example", False, False), ("STEVEN ARTHUR SHER", "Arthur Sher", False, True), ("R.Kenneth Irr", "Ken Irr", False, True), ("", "Ann Example", True, True), ("Chris Example", "Christopher Example", True, True),
    ]
    df = spark.createDataFrame(pairs, "a string, b string, first boolean, anyone boolean")
    got = df.select(display.same_person(F.col("a"), F.col("b")).alias("x"), display.any_name_agrees(F.col("a"), F.col("b")).alias("y")).collect()
    assert [(r.x, r.y) for r in got] == [(p[2], p[3]) for p in pairs]
