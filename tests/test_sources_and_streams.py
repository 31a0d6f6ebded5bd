"""Files read and written, and streams that must equal their batch."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rosterloom.operators import activity
from rosterloom.sources import files
from rosterloom.streaming import activity as stream

PERSON = """<IAPDIndividualReport GenOn="2026-01-01"><Indvls>
<Indvl><Info indvlPK="0012" firstNm="Ann" lastNm="Example"/><OthrNms><OthrNm firstNm="Annie" lastNm="Example"/></OthrNms>
<CrntEmps><CrntEmp orgPK="77" orgNm="Oak" city="Troy" state="NY"><CrntRgstns><CrntRgstn regAuth="NY" regCat="RA" st="APPROVED" stDt="2011-02-03"/><CrntRgstn regAuth="CT" regCat="RA" st="APPROVED" stDt="2010-01-01"/></CrntRgstns>
<BrnchOfLocs><BrnchOfLoc str1="1 Oak St" city="Troy" state="NY" postlCd="01234"/><BrnchOfLoc str1="1 Oak St" city="Troy" state="NY" postlCd="01234"/><BrnchOfLoc str1="x" city="Nowhere"/></BrnchOfLocs></CrntEmp></CrntEmps>
<Exms><Exm exmCd="S65" exmNm="Series 65" exmDt="2010-01-01"/></Exms><EmpHss><EmpHs orgNm="Elm" fromDt="01/2001" toDt="02/2009"/></EmpHss></Indvl>
<Indvl><Info indvlPK="13" firstNm="Bo" lastNm="Sample"/></Indvl></Indvls></IAPDIndividualReport>"""


def test_newest():
    assert files.newest(["roster_01_02_2026.csv", "roster_12_31_2025.csv", "x.txt"], "roster") == "roster_01_02_2026.csv"
    assert files.newest(["roster.csv"], "roster") == "roster.csv"
    for names in ([], ["roster_a.csv", "roster_b.csv"]):
        with pytest.raises(FileNotFoundError):
            files.newest(names, "roster")


def test_individual_feed(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(PERSON)
    t = {k: v.collect() for k, v in files.individual_tables(files.individuals(spark, str(tmp_path / "feed.xml"))).items()}
    assert {r.advisor_crd: (r.used_first_name, r.n_exams) for r in t["advisors"]} == {"0012": ("Annie", 1), "13": (None, 0)}
    assert [(r.firm_crd, r.reg_states, r.reg_earliest_date) for r in t["employments"]] == [("77", "CT|NY", "2010-01-01")]
    assert [(r.branch_street1, r.branch_postal) for r in t["branches"]] == [("1 Oak St", "01234")]
    assert t["history"][0].to_date == "02/2009" and t["exams"][0].exam_code == "S65"


def test_firm_feed_and_primary_site(spark, tmp_path):
    (tmp_path / "f.xml").write_text('<Firms><Firm><Info FirmCrdNb="7" BusNm="Oak"/><StateRgstn><Rgltrs><Rgltr Cd="NY" St="ACTIVE" Dt="2001"/></Rgltrs></StateRgstn><WebAddrs><WebAddr>https://facebook.com/oak</WebAddr><WebAddr>https://oak.example.com</WebAddr></WebAddrs></Firm></Firms>')
    t = files.firm_tables(spark, str(tmp_path / "f.xml"))
    assert t["state_registrations"].first()["regulator"] == "NY"
    assert tuple(files.primary_website(t["websites"]).first()) == ("7", "https://oak.example.com", 2, 1)


def test_csv_headers_json_and_slots(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Full Name,E-Mail,Phone #\n Ann , nan ,1\n,,\n")
    df = files.by_header(files.wide_csv(spark, str(tmp_path / "r.csv")), {"name": ["fullname"], "email": ["Email", "phone"], "team": ["Team"]})
    assert [tuple(r) for r in df.collect()] == [("Ann", "1", None), (None, None, None)]
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "f": {"b1": "c", "v1": "", "b2": " "}}]))
    rows = files.slots(files.json_array(spark, str(tmp_path / "a.json"), "id int, f map<string,string>"), "id", "f", [["b1", "v1"], ["b2", "v2"]])
    assert [tuple(r) for r in rows.collect()] == [(1, 1, "c", None)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("105", "=x"), ("205", "y"), ("7", "z")], "id string, note string")
    files.write_shards(df, "id", f"{tmp_path}/s")
    back = spark.read.option("basePath", f"{tmp_path}/s").parquet(f"{tmp_path}/s")
    assert {(r.id, str(r.shard).zfill(2)) for r in back.collect()} == {("105", "05"), ("205", "05"), ("7", "07")}
    files.write_export(df, f"{tmp_path}/e", "made for a test")
    assert {r.note for r in spark.read.csv(f"{tmp_path}/e", header=True).collect()} == {"'=x", "y", "z"}
    files.write_tables({"t": df}, f"{tmp_path}/o", partition={"t": "note"})
    assert spark.read.parquet(f"{tmp_path}/o/t").count() == 3


def events(n):
    kinds = [("outbound", "sent"), ("inbound", "reply"), ("inbound", "bounce"), ("inbound", "auto_reply")]
    return [(k, k % 2, k % 5, *kinds[k * 7 % 4], datetime(2024, 1, 1) + timedelta(minutes=3 * k, microseconds=7 * k)) for k in range(n)]


def test_stream_folds_like_the_batch(spark, tmp_path):
    rows = events(60)
    for a in range(0, 60, 20):  # each file repeats the last rows of the one before
        spark.createDataFrame(rows[max(0, a - 3) : a + 20], stream.LOG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = stream.fold(stream.once(stream.read_log(spark, f"{tmp_path}/in")))
    q = out.writeStream.outputMode("update").foreachBatch(stream.upsert_into(f"{tmp_path}/t", ["rep", "advisor"], "events")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    assert len(stream.versions(spark, f"{tmp_path}/t")) == 2  # older ones are gone
    got = {(r.rep, r.advisor): (r.last_out, r.last_in, r.last_reply, r.last_bounce, r.events) for r in stream.current(spark, f"{tmp_path}/t").collect()}
    with pytest.raises(ValueError, match="comes after"):
        stream.upsert_into(f"{tmp_path}/t", ["rep", "advisor"], "events")(spark.range(1), 0)
    log = spark.createDataFrame(rows, stream.LOG_SCHEMA)
    want = activity.fold(log, ["rep", "advisor"], F.lit("2024-02-01").cast("timestamp")).join(log.groupBy("rep", "advisor").agg(F.count("*").alias("events")), ["rep", "advisor"])
    assert got == {(r.rep, r.advisor): (r.last_out, r.last_in, r.last_reply, r.last_bounce, r.events) for r in want.collect()}


def test_sessions(spark):
    df = spark.createDataFrame(events(20), stream.LOG_SCHEMA)
    assert sum(r.events for r in stream.sessions(df).collect()) == 20
