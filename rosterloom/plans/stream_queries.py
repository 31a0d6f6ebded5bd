"""Features that keep something between reads: sent messages, keyed tables, bitmaps, files of arrays, nested records."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import display
from ..operators import bitmaps, census, relational
from ..sources import arrays
from ..streaming import keyed_store, replies
from .base import query, table


@query("""WITH s AS (SELECT user_id % 7 AS rep, 'm' || event_id AS id, ts AS moment, 't' || user_id % 150 AS conv FROM events WHERE event_type = 'view'),
  r AS (SELECT user_id % 7 AS rep, 'r' || event_id AS id, ts AS moment, CASE WHEN event_id % 3 = 0 THEN 't' || user_id % 150 END AS conv, ['m' || (event_id - 1), 'm' || (event_id - 2), 'm' || (event_id - 9)] AS refs FROM events WHERE event_type = 'click'),
  p AS (SELECT rep, id, moment, 0 AS place, 'c' || conv AS key FROM r WHERE conv IS NOT NULL UNION ALL SELECT rep, id, moment, unnest([1, 2, 3]), 'i' || unnest(refs) FROM r),
  k AS (SELECT rep, id, moment, 'c' || conv AS key FROM s UNION ALL SELECT rep, id, moment, 'i' || id FROM s),
  m AS (SELECT p.rep, p.id AS reply, place, k.id AS sent FROM p JOIN k ON p.rep = k.rep AND p.key = k.key AND k.moment BETWEEN p.moment - INTERVAL 10 DAY AND p.moment QUALIFY row_number() OVER (PARTITION BY p.rep, p.id ORDER BY place, k.moment DESC, k.id DESC) = 1)
  SELECT r.rep, r.id AS reply, sent, CASE WHEN place IS NULL THEN 'sender_only' WHEN place = 0 THEN 'thread_match' ELSE 'references_match' END AS route FROM r LEFT JOIN m ON m.rep = r.rep AND m.reply = r.id""")
def reply_matches(spark, sf_dir):
    """What each reply answers: its conversation's latest message of ten days, else the first that it refers to."""
    e = table(spark, sf_dir, "events")
    k, rep, thread = F.col("event_id"), F.col("user_id") % 7, F.concat(F.lit("t"), (F.col("user_id") % 150).cast("string"))
    name = lambda c: F.concat(F.lit("m"), c.cast("string"))
    sent = e.filter("event_type = 'view'").select(rep.alias("rep"), name(k).alias("id"), F.col("ts").alias("at"), thread.alias("conversation"))
    got = e.filter("event_type = 'click'").select(rep.alias("rep"), F.concat(F.lit("r"), k.cast("string")).alias("id"), F.col("ts").alias("at"), F.when(k % 3 == 0, thread).alias("conversation"), F.array(name(k - 1), name(k - 2), name(k - 9)).alias("refers_to"))
    return replies.match(got, sent, days=10).select("rep", "reply", "sent", "route")


@query("SELECT event_id, user_id, event_type, value, props FROM events")
def array_file_events(spark, sf_dir):
    """The events written as files of one JSON array each, read back by byte ranges."""
    at = f"{relational.shared_folder(spark)}/arrays-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "user_id", "event_type", "value", "props")).alias("value"))

    def bracketed(batches):
        import pyarrow as pa

        texts = (t for b in batches for t in b.column("value").to_pylist())
        for i, t in enumerate(texts):
            yield pa.RecordBatch.from_pydict({"value": [("[" if i == 0 else ",") + t]})
        yield pa.RecordBatch.from_pydict({"value": ["]"]})

    rows.mapInArrow(bracketed, "value string").write.text(at)
    return arrays.read_array(spark, at, "event_id bigint, user_id bigint, event_type string, value double, props string", range_bytes=1 << 20).drop("place")


@query("""WITH h AS (SELECT DISTINCT s_nationkey AS nation, o_custkey AS person FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey)
  SELECT v AS viewport, count(DISTINCT person) AS people FROM range(10) x(v), h WHERE (nation * 7 + v * 3) % 10 < 4 GROUP BY 1""")
def viewport_people(spark, sf_dir):
    """Distinct people of ten overlapping viewports, all from one stored table of bitmaps by nation."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    held = bitmaps.store(lines.select(F.col("s_nationkey").alias("nation"), "o_custkey"), ["nation"], "o_custkey")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"))
    views = nations.withColumn("viewport", F.explode(F.sequence(F.lit(0), F.lit(9)))).filter((F.col("nation") * 7 + F.col("viewport") * 3) % 10 < 4)
    return bitmaps.distinct_in(held, views, ["nation"], ["viewport"], "people").select(F.col("viewport").cast("bigint").alias("viewport"), "people")


@query("""WITH f AS (SELECT 'props.k' AS path, 'number' AS kind, json_extract_string(props, '$.k') AS v FROM events UNION ALL SELECT 'who.type', 'string', event_type FROM events
    UNION ALL SELECT 'who.odd', 'boolean', CASE WHEN user_id % 2 = 1 THEN 'true' ELSE 'false' END FROM events UNION ALL SELECT 'tags[]', 'number', (user_id % 5)::VARCHAR FROM events UNION ALL SELECT 'tags[]', 'string', event_type FROM events),
  c AS (SELECT path, kind, v, count(*) AS n FROM f WHERE v IS NOT NULL GROUP BY ALL), t AS (SELECT path, v, sum(n)::BIGINT AS n FROM c GROUP BY ALL),
  p AS (SELECT path, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, sum(n) FILTER (kind <> 'boolean' OR v = 'true')::BIGINT AS filled FROM c GROUP BY 1),
  l AS (SELECT path, count(*) AS "distinct", string_agg(v || '=' || n, ' ' ORDER BY spot) FILTER (spot <= 4) AS "values" FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, v) AS spot FROM t) GROUP BY 1)
  SELECT path, kinds, filled, "distinct", greatest("distinct" - 4, 0)::BIGINT AS beyond, "values" FROM p JOIN l USING (path)""")
def nested_census(spark, sf_dir):
    """Every field of nested event records: kinds, how often it is filled, and its four commonest values."""
    e = table(spark, sf_dir, "events")
    quoted = F.concat(F.lit('"'), "event_type", F.lit('"'))
    record = F.concat(F.lit('{"props":'), "props", F.lit(',"who":{"type":'), quoted, F.lit(',"odd":'), (F.col("user_id") % 2 == 1).cast("string"), F.lit('},"tags":['), (F.col("user_id") % 5).cast("string"), F.lit(","), quoted, F.lit("]}"))
    out = census.census(e, record, vocabulary=4)
    values = F.array_join(F.transform("values", lambda v: F.concat(v["value"], F.lit("="), v["n"].cast("string"))), " ")
    return out.select("path", F.array_join("kinds", ",").alias("kinds"), "filled", "distinct", F.col("beyond").cast("bigint").alias("beyond"), values.alias("values"))


@query("""WITH o AS (SELECT o_custkey AS k, o_orderkey AS pos, o_totalprice AS v FROM orders)
  SELECT k, arg_max(v, pos) AS v, max(pos) AS pos FROM o GROUP BY 1""")
def keyed_orders(spark, sf_dir):
    """The latest order of each customer, put into a keyed table in three batches out of order, the second one twice."""
    at = f"{relational.shared_folder(spark)}/keyed-{uuid.uuid4().hex}"
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("pos"))
    write = keyed_store.sink(at, ["k"], "pos", buckets=16)
    for number, part in ((0, 2), (1, 0), (1, 0), (2, 1)):
        write(o.filter(F.col("pos") % 3 == part), number)
    return keyed_store.read(spark, at).select("k", "v", "pos")


@query("""WITH p AS (SELECT p_partkey AS id, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM part), c AS (SELECT *, upper(a[1]) || a[2:] AS ca, upper(b[1]) || b[2:] AS cb FROM p)
  SELECT id, CASE WHEN id % 4 = 2 THEN cb ELSE ca END || ' ' || CASE id % 3 WHEN 0 THEN 'O''' || cb || ' Jr.' WHEN 1 THEN 'Mc' || cb ELSE cb END AS person,
    ca || ' ' || cb || ' of the ' || id % 30 || 'th Mill, LLC' || CASE WHEN id % 2 = 0 THEN ' (GA, CRD ' || id || ')' ELSE '' END AS firm FROM c""")
def shown_names(spark, sf_dir):
    """People and firms as they are shown, from names in capitals with generations, qualifications and qualifiers."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ")[0].alias("a"), F.split("p_name", " ")[1].alias("b"))
    k = F.col("id")
    last = F.when(k % 3 == 0, F.concat(F.lit("O'"), F.upper("b"), F.lit(" JR"))).when(k % 3 == 1, F.concat(F.lit("MC"), F.upper("b"))).otherwise(F.concat("b", F.lit(", CFP, CFA")))
    used = F.when(k % 4 == 0, "(Bo)").when(k % 4 == 1, "jr").when(k % 4 == 2, F.col("b"))
    firm = F.concat(F.upper("a"), F.lit(" "), F.upper("b"), F.lit(" OF THE "), (k % 30).cast("string"), F.lit("TH MILL, LLC"), F.when(k % 2 == 0, F.concat(F.lit(" (ga, CRD "), k.cast("string"), F.lit(")"))).otherwise(""))
    return p.select("id", display.display_name(F.upper("a"), last, used).alias("person"), display.display_firm(firm).alias("firm"))
