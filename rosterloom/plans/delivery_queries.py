"""Delivery reports, checks of messages, and people who share an office."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import delivery, graph
from .base import query, table

AS_OF = "2024-01-25 00:00:00"
KINDS = ["Status: 5.1.1", "Status: 4.2.2", "Status: 5.7.1", "hello", "Status: 5.1.10"]


@query(f"""WITH s AS (SELECT user_id AS rep, 'm' || event_id AS message, 'p' || user_id || '@d' || user_id % 9 || '.example.com' AS address, '<' || event_id || '@x>' AS ref, ts FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY),
  r AS (SELECT user_id AS rep, event_id AS item, {KINDS!r}[event_id % 5 + 1] AS status, event_id % 7 = 0 AS wrong, [('<' || event_id + 1 || '@x>'), ('<' || event_id || '@x>')] AS refs FROM events
    WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 480 HOUR AND event_id % 3 <> 0 AND event_id % 11 <> 0),
  j AS (SELECT r.*, coalesce(a.message, b.message) AS message, coalesce(a.address, b.address) AS address FROM r LEFT JOIN s a ON a.rep = r.rep AND a.ref = refs[1] LEFT JOIN s b ON b.rep = r.rep AND b.ref = refs[2]),
  k AS (SELECT *, CASE WHEN status = 'hello' THEN 'not-a-bounce' WHEN message IS NULL THEN 'unmatched' WHEN wrong THEN 'recipient-mismatch' WHEN status LIKE '% 4%' THEN 'soft' WHEN status LIKE '% 5.7.1' THEN 'policy' ELSE 'hard' END AS outcome FROM j)
  SELECT rep, item, outcome, CASE WHEN status <> 'hello' THEN status[9:] END AS code, CASE WHEN outcome IN ('hard', 'soft', 'policy') THEN message END AS message, CASE WHEN outcome IN ('hard', 'soft', 'policy') THEN address END AS address,
    CASE WHEN outcome IN ('hard', 'soft', 'policy') THEN string_split(address, '@')[2] END AS domain, outcome = 'hard' AS act FROM k""")
def bounce_sweep(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    address = F.concat(F.lit("p"), F.col("user_id").cast("string"), F.lit("@d"), (F.col("user_id") % 9).cast("string"), F.lit(".example.com"))
    ref = lambda c: F.concat(F.lit("<"), c.cast("string"), F.lit("@X>"))
    sent = e.select(F.col("user_id").alias("rep"), ref(F.col("event_id")).alias("internet_id"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message"), address.alias("recipient"), F.col("ts").alias("at"))
    k = F.col("event_id")
    named = F.when(k % 7 == 0, F.lit("somebody@else.example.com")).otherwise(F.upper(address))
    reports = e.select(
        F.col("user_id").alias("rep"), F.lit("rep@ours.example.com").alias("mailbox"), k.alias("item"), F.col("ts").alias("received"),
        F.when(k % 3 == 0, "Rep@ours.example.com").otherwise("postmaster@d.example.com").alias("sender"), F.lit("Undeliverable: hello").alias("subject"), F.lit("text/plain").alias("content_type"), F.lit("").alias("flagged"),
        F.concat(F.get(F.array(*map(F.lit, KINDS)), (k % 5).cast("int")), F.lit("\nFinal-Recipient: rfc822;"), named, F.lit("\n")).alias("body"), F.array(ref(k + 1), ref(k)).alias("refs"),
    )
    seen = e.filter(k % 11 == 0).select(F.col("user_id").alias("rep"), k.alias("item"))
    return delivery.sweep(reports, sent, seen, F.lit(AS_OF).cast(e.schema["ts"].dataType), hours=480)


@query("""WITH m AS (SELECT o_custkey AS batch, o_orderkey AS message, CASE o_orderkey % 10 WHEN 0 THEN 'nobody' WHEN 1 THEN 'same@a.com' ELSE 'p' || o_orderkey % 500 || '@a.com' END AS recipient, CASE WHEN o_orderkey % 13 > 0 THEN 'Hello' ELSE ' ' END AS subject,
    CASE o_orderkey % 6 WHEN 0 THEN 'Dear {{ first_name }}' WHEN 1 THEN '{{image:Chart}} and {{ image:chrat }}' WHEN 2 THEN '' WHEN 3 THEN repeat('x', 60) ELSE '{{image:CHART}}' END AS body, o_orderkey % 4 = 0 AS known, floor(o_totalprice)::BIGINT AS size, o_orderkey % 5 AS doc, o_orderkey % 3 AS base FROM orders),
  t AS (SELECT *, count(*) OVER (PARTITION BY batch, recipient) > 1 AS twice, length(subject) + length(body) + ceil(size * 4 / 3)::BIGINT + 4096 AS estimated_bytes FROM m)
  SELECT batch, message, concat_ws(',', CASE WHEN recipient = 'nobody' THEN 'invalid_recipient' END, CASE WHEN twice THEN 'duplicate_recipient' END, CASE WHEN subject = ' ' THEN 'missing_subject' END, CASE WHEN body = '' THEN 'missing_body' END,
    CASE WHEN body LIKE 'Dear%' THEN 'unresolved_merge_fields' END, CASE WHEN known AND body LIKE '%chrat%' THEN 'unknown_image' END, CASE WHEN recipient LIKE 'p_@a.com' THEN 'permanent_bounce_suppression' END, CASE WHEN doc IN (1, 2) THEN 'attachment_unavailable' END,
    CASE WHEN size > 300000 THEN 'attachment_too_large' END, CASE WHEN estimated_bytes > 500000 THEN 'message_too_large' END, CASE WHEN length(body) > 50 THEN 'body_too_large' END) AS errors, base < 2 AS behind, estimated_bytes FROM t""")
def message_errors(spark, sf_dir):
    """What stops each message; an order is a message, its customer the batch."""
    k = F.col("o_orderkey")
    recipient = F.when(k % 10 == 0, "nobody").when(k % 10 == 1, "same@a.com").otherwise(F.concat(F.lit("p"), (k % 500).cast("string"), F.lit("@a.com")))
    body = F.when(k % 6 == 0, "Dear {{ first_name }}").when(k % 6 == 1, "{{image:Chart}} and {{ image:chrat }}").when(k % 6 == 2, "").when(k % 6 == 3, "x" * 60).otherwise("{{image:CHART}}")
    doc = F.struct((k % 5).alias("id"), F.lit(1).alias("version"), F.lit("s").alias("sha256"), F.floor("o_totalprice").cast("long").alias("size"), (k % 5 != 2).alias("approved"))
    messages = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("batch"), k.alias("message"), recipient.alias("recipient"), F.when(k % 13 > 0, "Hello").otherwise(" ").alias("subject"), body.alias("body"), body.alias("html"), F.lit(None).cast("string").alias("signature"),
        F.when(k % 4 == 0, F.array(F.lit("chart"))).alias("images"), (k % 3).alias("base_revision"), F.lit(2).alias("common_revision"), F.array(doc).alias("attachments"),
    )
    stopped = spark.range(10).select(F.concat(F.lit("p"), F.col("id").cast("string"), F.lit("@a.com")).alias("recipient"))
    documents = spark.range(5).select("id", F.when(F.col("id") == 1, 2).otherwise(1).alias("version"), F.lit("s").alias("sha256"))
    out = delivery.check(messages, stopped, documents, most_bytes=500000, most_attachment=300000, most_chars=50)
    return out.select("batch", "message", F.array_join("errors", ",").alias("errors"), "behind", "estimated_bytes")


@query(None)
def branch_groups(spark, sf_dir):
    """Firms by shared mail and street addresses; the people of a firm's accounts stand for its staff's mail."""
    s, l, o = (table(spark, sf_dir, t) for t in ("supplier", "lineitem", "orders"))
    pairs = l.join(o, l.l_orderkey == o.o_orderkey).filter("l_linenumber = 7").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.min("o_custkey").alias("staff"))
    rows = s.join(pairs, "s_suppkey", "left").select(
        "s_suppkey", F.when(F.col("staff").isNotNull(), F.array(F.concat((F.col("staff") % 40).cast("string"), F.lit("@a.com")))).alias("emails"),
        F.when(F.col("s_suppkey") % 5 == 0, F.concat((F.col("s_suppkey") % 35).cast("string"), F.lit(" Oak St., Suite 1"))).alias("address"), F.col("s_nationkey").cast("string").alias("zip"), F.lit("Town").alias("city"), F.col("s_nationkey").cast("string").alias("state"),
    )
    return graph.branches(rows, "s_suppkey", "s_suppkey")
