"""Activity: folds, queues, delivery, limits, lists."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import activity, relational
from ..streaming import keyed_store, live_queue
from .base import LOG, log, query, table

AS_OF = "2024-01-25 00:00:00"


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


FOLD = f"""{LOG}, fold AS (SELECT rep, advisor, max(occurred_at) FILTER (direction = 'outbound') AS last_out, max(occurred_at) FILTER (direction = 'inbound') AS last_in,
  max(occurred_at) FILTER (classification = 'reply') AS last_reply, max(occurred_at) FILTER (classification = 'bounce') AS last_bounce,
  count(*) FILTER (direction = 'outbound' AND occurred_at >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY) AS out_recent,
  count(*) FILTER (direction = 'inbound' AND occurred_at >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY) AS in_recent FROM log GROUP BY 1, 2)"""


def _fold(spark, sf_dir):
    return activity.fold(log(spark, sf_dir), ["rep", "advisor"], _as_of(), 14)


@query(f"WITH {FOLD} SELECT rep, advisor, epoch_us(last_out)::VARCHAR AS last_out, epoch_us(last_in)::VARCHAR AS last_in, epoch_us(last_reply)::VARCHAR AS last_reply, epoch_us(last_bounce)::VARCHAR AS last_bounce, out_recent, in_recent FROM fold")
def engagement_fold(spark, sf_dir):
    stamps = [F.unix_micros(F.col(c).cast("timestamp")).cast("string").alias(c) for c in ("last_out", "last_in", "last_reply", "last_bounce")]
    return _fold(spark, sf_dir).select("rep", "advisor", *stamps, "out_recent", "in_recent")


DECIDED = f"""{FOLD}, kept AS (SELECT user_id % 7 AS rep, user_id % 40 AS advisor, max(ts) AS acted_at, CASE (user_id % 40) % 5 WHEN 0 THEN 'follow_up' WHEN 1 THEN 'done' END AS reply_state,
    CASE WHEN user_id % 40 % 6 = 0 THEN TIMESTAMP '2024-01-20' WHEN user_id % 40 % 6 = 1 THEN TIMESTAMP '2024-02-20' END AS next_action_at,
    CASE WHEN user_id % 40 % 11 = 0 THEN TIMESTAMP '2024-01-26' WHEN user_id % 40 % 11 = 1 THEN TIMESTAMP '2024-01-24' END AS snoozed_until, user_id % 40 % 2 = 0 AS bounce_dismissed
    FROM events WHERE event_type = 'purchase' GROUP BY ALL),
  state AS (SELECT fold.*, greatest(last_out, last_in) AS last_activity, next_action_at, snoozed_until, coalesce(bounce_dismissed, false) AS dismissed,
    CASE WHEN last_reply IS NULL THEN coalesce(reply_state, 'none') WHEN acted_at IS NULL OR last_reply > acted_at THEN 'new' ELSE coalesce(reply_state, 'reviewed') END AS said FROM fold LEFT JOIN kept USING (rep, advisor))"""


def _projection_decisions(spark, sf_dir):
    """What reps decided, taken from purchases."""
    a = F.col("user_id") % 40
    at = lambda day: F.lit(day).cast("timestamp")
    p = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(
        (F.col("user_id") % 7).alias("rep"), a.alias("advisor"), "ts", F.when(a % 5 == 0, "follow_up").when(a % 5 == 1, "done").alias("reply_state"),
        F.when(a % 6 == 0, at("2024-01-20")).when(a % 6 == 1, at("2024-02-20")).alias("next_action_at"),
        F.when(a % 11 == 0, at("2024-01-26")).when(a % 11 == 1, at("2024-01-24")).alias("snoozed_until"), (a % 2 == 0).alias("bounce_dismissed"),
    )
    return p.groupBy("rep", "advisor", "reply_state", "next_action_at", "snoozed_until", "bounce_dismissed").agg(F.max("ts").alias("acted_at"))


def _projection(spark, sf_dir):
    """The fold with what reps decided."""
    return activity.fold(log(spark, sf_dir), ["rep", "advisor"], _as_of(), 14, decisions=_projection_decisions(spark, sf_dir))


@query(f"""WITH {DECIDED}, r AS (SELECT rep, advisor, said AS reply_state, CASE WHEN snoozed_until > TIMESTAMP '{AS_OF}' THEN NULL WHEN said = 'new' AND last_reply IS NOT NULL THEN 'reply_new' WHEN said = 'follow_up' THEN 'reply_followup'
    WHEN next_action_at <= TIMESTAMP '{AS_OF}' THEN 'due' WHEN last_bounce IS NOT NULL AND NOT dismissed THEN 'bounced' WHEN last_reply IS NOT NULL AND last_activity < TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY THEN 'quiet_warm' END AS reason,
    last_activity FROM state)
  SELECT rep, advisor, reply_state, reason, row_number() OVER (PARTITION BY rep ORDER BY list_position(['reply_new', 'reply_followup', 'due', 'bounced', 'quiet_warm'], reason), last_activity, advisor) AS place FROM r WHERE reason IS NOT NULL""")
def attention_queue(spark, sf_dir):
    """Whom each rep should work now: one reason a person, the most urgent and longest waiting first."""
    w = Window.partitionBy("rep").orderBy("urgency", "last_activity", "advisor")
    return activity.attention(_projection(spark, sf_dir), _as_of(), 1).select("rep", "advisor", "reply_state", "reason", F.row_number().over(w).alias("place"))


LATER = "2024-02-10 00:00:00"


@query(f"""WITH {DECIDED}, r AS (SELECT rep, advisor, said AS reply_state, epoch_us(last_activity)::VARCHAR AS last_activity, CASE WHEN snoozed_until > TIMESTAMP '{LATER}' THEN NULL WHEN said = 'new' AND last_reply IS NOT NULL THEN 'reply_new'
    WHEN said = 'follow_up' THEN 'reply_followup' WHEN next_action_at <= TIMESTAMP '{LATER}' THEN 'due' WHEN last_bounce IS NOT NULL AND NOT dismissed THEN 'bounced'
    WHEN last_reply IS NOT NULL AND greatest(coalesce(last_out, last_in), coalesce(last_in, last_out)) < TIMESTAMP '{LATER}' - INTERVAL 12 DAY THEN 'quiet_warm' END AS reason FROM state)
  SELECT * FROM r WHERE reason IS NOT NULL""")
def live_attention_queue(spark, sf_dir):
    """The queue that the stream holds when its watermark has come to a day after the last event."""
    decided = _projection_decisions(spark, sf_dir)
    rows = live_queue.changes(log(spark, sf_dir).select("rep", "advisor", "occurred_at", "direction", "classification").withColumn("historic", F.lit(False)), decided)
    tick = rows.limit(0).sparkSession.createDataFrame([(-1, -1, "mail")], "rep bigint, advisor bigint, kind string").withColumn("occurred_at", F.lit(LATER).cast("timestamp") + F.expr("interval 1 hour"))
    at = f"{relational.shared_folder(spark)}/queue-{uuid.uuid4().hex}"
    rows.unionByName(tick, allowMissingColumns=True).write.parquet(f"{at}/in")
    changed = live_queue.live_queue(spark.readStream.schema(live_queue.CHANGES).parquet(f"{at}/in"), delay="1 hour", quiet_days=12)
    stream = changed.writeStream.outputMode("update").foreachBatch(keyed_store.sink(f"{at}/queue", ["rep", "advisor"], "seq")).option("checkpointLocation", f"{at}/checkpoint")
    stream.trigger(availableNow=True).start().awaitTermination()
    held = keyed_store.read(spark, f"{at}/queue").filter("reason is not null and rep >= 0")
    return held.select("rep", "advisor", "reply_state", "reason", F.unix_micros("last_activity").cast("string").alias("last_activity"))


@query(f"""WITH {LOG}, old AS (SELECT rep, advisor, max(occurred_at) FILTER (direction = 'outbound') AS o, max(occurred_at) FILTER (direction = 'inbound') AS i FROM log WHERE occurred_at < TIMESTAMP '{AS_OF}' GROUP BY 1, 2),
  new AS (SELECT rep, advisor, max(occurred_at) FILTER (direction = 'outbound') AS o, max(occurred_at) FILTER (direction = 'inbound') AS i FROM log GROUP BY 1, 2)
  SELECT rep, advisor, CASE WHEN old.o IS DISTINCT FROM new.o THEN 'last_out' ELSE 'last_in' END AS "column" FROM old JOIN new USING (rep, advisor) WHERE old.o IS DISTINCT FROM new.o OR old.i IS DISTINCT FROM new.i""")
def rebuild_drift(spark, sf_dir):
    """A stored projection of the log up to a day against one made anew from the whole log."""
    whole = log(spark, sf_dir)
    stored = activity.fold(whole.filter(F.col("occurred_at") < _as_of()), ["rep", "advisor"], _as_of(), 14)
    return activity.drift(stored, activity.fold(whole, ["rep", "advisor"], _as_of(), 14), ["rep", "advisor"], ["last_out", "last_in"])


REPORT = """CASE event_id % 8 WHEN 0 THEN '5.1.1' WHEN 1 THEN '5.7.1' WHEN 2 THEN '4.2.2' WHEN 3 THEN '5.1.8' WHEN 4 THEN '5.2.2' WHEN 5 THEN '2.0.0' WHEN 6 THEN '550' ELSE '' END"""


@query(f"""WITH r AS (SELECT event_id, {REPORT} AS code FROM events WHERE event_type = 'error')
  SELECT event_id, CASE WHEN code IN ('', '2.0.0') THEN NULL WHEN code LIKE '4.%' THEN 'soft' WHEN code IN ('5.2.2', '5.7.1') THEN 'policy' ELSE 'hard' END AS kind, CASE WHEN code NOT IN ('', '2.0.0') THEN code END AS code FROM r""")
def bounce_classify(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    codes = ["Status: 5.1.1", "status: 5.07.1", "Status: 4.2.2", "Status: 5.1.8", "Status: 5.2.2", "Status: 2.0.0", "smtp; 550 refused", "blocked as spam"]
    said = F.element_at(F.array(*map(F.lit, codes)), (F.col("event_id") % 8 + 1).cast("int"))
    return e.select("event_id", activity.bounce(F.concat(F.lit("The report says: "), said)).alias("b")).select("event_id", "b.kind", "b.code")


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS used FROM events""")
def rolling_limit(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("one", F.lit(1))
    return e.select("event_id", relational.rolling_sum(e, "user_id", "ts", "one", 86400).alias("used"))


@query("""WITH e AS (SELECT user_id, event_id, ts, (event_id % 5)::INT + 1 AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'),
  f AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS freed, sum(n) OVER (PARTITION BY user_id) AS used FROM e)
  SELECT user_id, epoch_us(min(ts + INTERVAL 1 DAY)) AS free_at FROM f WHERE used + 10 - 12 > 0 AND freed >= used + 10 - 12 GROUP BY 1""")
def capacity_returns(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("ts >= '2024-01-10' and ts < '2024-01-11'").withColumn("n", (F.col("event_id") % 5).cast("int") + 1)
    return activity.capacity_returns(e, "user_id", "ts", "event_id", "n", 10, 12).select("user_id", F.unix_micros(F.col("free_at").cast("timestamp")).alias("free_at"))


@query("""WITH e AS (SELECT event_id, event_type AS domain FROM events),
  r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY event_id) AS turn, count(*) OVER (PARTITION BY domain) AS size FROM e)
  SELECT event_id, domain, row_number() OVER (ORDER BY turn, size DESC, domain) AS position FROM r""")
def domain_interleave(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("domain"))
    return relational.interleave(e, "domain", "event_id")


@query("""WITH e AS (SELECT user_id % 7 AS rep, (event_id % 5)::VARCHAR AS domain, CASE WHEN event_type = 'view' THEN 'sent' WHEN event_type = 'signup' THEN 'unsubscribed' WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'hard' WHEN 1 THEN 'soft' ELSE 'policy' END END AS kind FROM events),
  g AS (SELECT rep, domain, count(*) FILTER (kind = 'sent') AS sent, count(*) FILTER (kind = 'hard') AS hard, count(*) FILTER (kind = 'soft') AS soft, count(*) FILTER (kind = 'policy') AS policy, count(*) FILTER (kind = 'unsubscribed') AS unsubscribed
    FROM e WHERE kind IS NOT NULL GROUP BY ROLLUP (rep, domain) HAVING rep IS NOT NULL)
  SELECT *, CASE WHEN sent < 30 THEN 'unknown' WHEN hard * 100 >= sent * 5 THEN 'bad' WHEN hard * 100 >= sent * 2 THEN 'warn' ELSE 'ok' END AS hard_level,
    CASE WHEN sent < 30 THEN 'unknown' WHEN soft * 100 >= sent * 25 THEN 'bad' WHEN soft * 100 >= sent * 10 THEN 'warn' ELSE 'ok' END AS soft_level,
    CASE WHEN sent < 30 THEN 'unknown' WHEN policy * 100 >= sent * 3 THEN 'bad' WHEN policy * 100 >= sent * 1 THEN 'warn' ELSE 'ok' END AS policy_level,
    CASE WHEN sent < 30 THEN 'unknown' WHEN unsubscribed * 100 >= sent * 3 THEN 'bad' WHEN unsubscribed * 100 >= sent * 1 THEN 'warn' ELSE 'ok' END AS unsubscribed_level FROM g""")
def sender_health(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("rep"), (F.col("event_id") % 5).alias("domain"), "event_type", "event_id")
    k = F.col("event_id") % 3
    reports = e.filter("event_type = 'error'").withColumn("kind", F.when(k == 0, "hard").when(k == 1, "soft").otherwise("policy"))
    return activity.health(e.filter("event_type = 'view'"), reports, e.filter("event_type = 'signup'"), "rep", "domain")


@query("""WITH n AS (SELECT user_id % 7 AS rep, '5.1.' || event_id % 13 AS code, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY n DESC, code) AS place FROM n)
  SELECT * FROM r WHERE place <= 8""")
def sender_codes(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    return activity.top_codes(e.select((F.col("user_id") % 7).alias("rep"), F.concat(F.lit("5.1."), (F.col("event_id") % 13).cast("string")).alias("code")), "rep", "code")


@query("""SELECT user_id AS member, arg_max(event_type, (ts, event_id)) AS outcome, count(*) AS touches FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1""")
def cycle_progress(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("ts >= '2024-01-15'")
    return e.groupBy(F.col("user_id").alias("member")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("outcome"), F.count("*").alias("touches"))


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  f AS (SELECT user_id, event_id, ts AS last, k, true AS admitted FROM o WHERE k = 1 UNION ALL
    SELECT o.user_id, o.event_id, CASE WHEN o.ts - f.last >= INTERVAL 6 HOUR THEN o.ts ELSE f.last END, o.k, o.ts - f.last >= INTERVAL 6 HOUR FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
  SELECT event_id, admitted FROM f""")
def pacing_gate(spark, sf_dir):
    """Events at least six hours after the last one that was let through."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return activity.admitted(e, "user_id", "ts", "event_id", 6 * 3600).select("event_id", "admitted")


CODES = "CASE user_id % 8 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN 'C' WHEN 3 THEN 'P' WHEN 4 THEN '3' WHEN 5 THEN 'N' WHEN 6 THEN 'NC' ELSE 'U' END"


@query(f"""WITH c AS (SELECT event_id % 500 AS address, {CODES} AS code FROM events WHERE event_type IN ('error', 'signup')),
  k AS (SELECT address, arg_max(code, (CASE code WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN 'C' THEN 1 WHEN 'P' THEN 2 WHEN '3' THEN 3 WHEN 'N' THEN 4 WHEN 'NC' THEN 5 ELSE 6 END, code)) AS code FROM c GROUP BY 1)
  SELECT c_custkey AS person, code FROM customer LEFT JOIN k ON address = c_custkey WHERE code IS NULL OR code IN ('1', '2', 'C')""")
def suppression_floor(spark, sf_dir):
    m = F.col("user_id") % 8
    code = F.element_at(F.array(*map(F.lit, ["1", "2", "C", "P", "3", "N", "NC", "U"])), (m + 1).cast("int"))
    c = table(spark, sf_dir, "events").filter("event_type in ('error', 'signup')").select((F.col("event_id") % 500).alias("person"), code.alias("code"))
    held = activity.strongest_code(c, "person", "code")
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person"))
    return people.join(held, "person", "left").filter("code is null or code in ('1', '2', 'C')")


@query("""WITH s AS (SELECT max(event_id) AS event_id, user_id, ts FROM events WHERE event_type = 'view' GROUP BY user_id, ts), r AS (SELECT event_id AS reply, user_id, ts FROM events WHERE event_type = 'click')
  SELECT reply, s.event_id::VARCHAR AS sent FROM r ASOF LEFT JOIN s ON r.user_id = s.user_id AND r.ts >= s.ts""")
def latest_sender(spark, sf_dir):
    """Each reply with the latest message sent to the same party before it."""
    e = table(spark, sf_dir, "events").filter("event_type in ('view', 'click')")
    sent = F.when(F.col("event_type") == "view", F.col("event_id"))
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type").desc(), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("sent", F.last(sent, ignorenulls=True).over(w)).filter("event_type = 'click'").select(F.col("event_id").alias("reply"), F.col("sent").cast("string").alias("sent"))


ROUTES = """m AS (SELECT event_id, user_id, event_id % 3 AS thread, event_id % 11 AS ref FROM events WHERE event_type = 'click'),
a AS (SELECT DISTINCT user_id, 0 AS thread, user_id + 1000 AS sender FROM events WHERE event_type = 'view'), b AS (SELECT DISTINCT event_id % 11 AS ref, event_id % 11 + 5000 AS sender FROM events WHERE event_type = 'signup' AND event_id % 11 < 4)"""


@query(f"WITH {ROUTES} SELECT event_id, coalesce(a.sender, b.sender)::VARCHAR AS sender, CASE WHEN a.sender IS NOT NULL THEN 'thread' WHEN b.sender IS NOT NULL THEN 'reference' ELSE 'none' END AS route FROM m LEFT JOIN a USING (user_id, thread) LEFT JOIN b USING (ref)")
def reply_routes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = e.filter("event_type = 'click'").select("event_id", "user_id", (F.col("event_id") % 3).alias("thread"), (F.col("event_id") % 11).alias("ref"))
    a = e.filter("event_type = 'view'").select("user_id", F.lit(0).alias("thread"), (F.col("user_id") + 1000).alias("sender")).distinct()
    b = e.filter("event_type = 'signup' and event_id % 11 < 4").select((F.col("event_id") % 11).alias("ref"), (F.col("event_id") % 11 + 5000).alias("sender")).distinct()
    return relational.first_route(m, ("thread", a, ["user_id", "thread"]), ("reference", b, ["ref"]), value="sender").select("event_id", F.col("sender").cast("string").alias("sender"), "route")


@query("""WITH l AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS pos FROM events WHERE event_type <> 'error')
  SELECT user_id, event_id, pos FROM l WHERE pos <= 20""")
def list_trim(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type <> 'error'")
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return e.withColumn("pos", F.row_number().over(w)).filter("pos <= 20").select("user_id", "event_id", "pos")


@query("""SELECT event_id, concat_ws(', ', CASE WHEN value > 90 THEN 'large' END, CASE WHEN event_type = 'error' THEN 'suppressed' END, CASE WHEN user_id % 10 = 0 THEN 'missing' END) AS errors FROM events""")
def batch_validation(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    found = F.array_compact(F.array(F.when(F.col("value") > 90, "large"), F.when(F.col("event_type") == "error", "suppressed"), F.when(F.col("user_id") % 10 == 0, "missing")))
    return e.select("event_id", F.array_join(found, ", ").alias("errors"))


@query("""WITH r AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'Message sent' WHEN 'click' THEN 'Reply received' WHEN 'error' THEN 'Delivery failed' ELSE 'Other: ' || event_type END AS label,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place FROM events) SELECT * FROM r WHERE place <= 50""")
def activity_timeline(spark, sf_dir):
    """The fifty latest events of every user."""
    e = table(spark, sf_dir, "events")
    label = F.when(F.col("event_type") == "view", "Message sent").when(F.col("event_type") == "click", "Reply received").when(F.col("event_type") == "error", "Delivery failed").otherwise(F.concat(F.lit("Other: "), "event_type"))
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    return e.select("user_id", "event_id", label.alias("label"), F.row_number().over(w).alias("place")).filter("place <= 50")


@query("""SELECT event_id FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id FROM events WHERE event_id % 2 = 0 AND event_id % 3 <> 0""")
def upsert_keep_existing(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    return relational.upsert(e.filter("event_id % 3 = 0"), e.filter("event_id % 2 = 0"), ["event_id"], replace=False)
