"""The queue as a stream must be the batch queue at any time, whatever the order and the restarts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rosterloom.operators import activity
from rosterloom.streaming import activity as stream
from rosterloom.streaming import live_queue as live

START = datetime(2024, 1, 1)
BACKFILL = START + timedelta(days=20)
DECISIONS = "rep long, advisor long, acted_at timestamp, reply_state string, next_action_at timestamp, snoozed_until timestamp, bounce_dismissed boolean"
MAIL = "rep long, advisor long, occurred_at timestamp, direction string, classification string, historic boolean"


def made(seed=4, keys=30, days=90):
    rng = random.Random(seed)
    stamp = lambda low=0, high=days: START + timedelta(seconds=rng.randrange(low * 86400, high * 86400), microseconds=rng.randrange(10**6))
    kinds = [("outbound", "sent"), ("inbound", "reply"), ("inbound", "bounce"), ("inbound", "auto_reply")]
    mail, decided = [], []
    for k in range(keys):
        high = 20 if k % 7 == 0 else days
        for _ in range(rng.randint(1, 6)):
            at = stamp(0, high)
            mail.append((k % 3, k, at, *rng.choices(kinds, (5, 3, 1, 1))[0], at < BACKFILL))
        for _ in range(rng.randint(0, 3)):
            at = stamp()
            later = lambda: rng.choice([None, at + timedelta(days=rng.randint(1, 40), microseconds=rng.randrange(10**6))])  # noqa: B023, E731
            decided.append((k % 3, k, at, rng.choice([None, "reviewed", "follow_up", "done"]), later(), later(), rng.random() < 0.5))
    return mail, decided


def batch(spark, mail, decided, now):
    said = {}
    for row in sorted(r for r in decided if r[2] <= now):
        said[row[:2]] = row
    log = spark.createDataFrame([r for r in mail if r[2] <= now], MAIL)
    at = F.lit(now.isoformat(sep=" ")).cast("timestamp")
    whole = activity.fold(log, ["rep", "advisor"], at, decisions=spark.createDataFrame(list(said.values()), DECISIONS), historic=F.col("historic"))
    return {(r.rep, r.advisor): (r.reply_state, r.reason, r.last_activity) for r in activity.attention(whole, at).collect() if r.reason}


def run(spark, folder, **more):
    q = live.live_queue(spark.readStream.schema(live.CHANGES).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in"), **more)
    q = q.writeStream.outputMode("update").foreachBatch(stream.upsert_into(f"{folder}/table", ["rep", "advisor"], "seq")).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    assert q.exception() is None
    return {(r.rep, r.advisor): (r.reply_state, r.reason, r.last_activity) for r in stream.current(spark, f"{folder}/table").collect() if r.reason and r.advisor >= 0}


def test_equal_to_the_batch_at_three_times_over_restarts(spark, tmp_path):
    mail, decided = made()
    rng = random.Random(1)
    since = datetime(2000, 1, 1)
    for day in (25, 61, 130):
        now = START + timedelta(days=day)
        parts = [[r for r in mail if since < r[2] <= now], [r for r in decided if since < r[2] <= now]]
        new = live.changes(spark.createDataFrame(parts[0], MAIL), spark.createDataFrame(parts[1], DECISIONS)).collect()
        rng.shuffle(new)  # any order within the delay; here the delay is as long as the step
        spark.createDataFrame(new, live.CHANGES).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        tick = now + timedelta(days=70)  # the watermark comes to this time when a row is so much later
        spark.createDataFrame([(0, -1, "mail", tick, "outbound", "sent", False, None, None, None, None)], live.CHANGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        assert run(spark, tmp_path, delay="70 days") == batch(spark, mail, decided, now)
        since = now


@pytest.mark.parametrize("held, days, want", [
    ({"last_reply": 89, "last_in": 89}, 90, ("new", "reply_new")),
    ({"last_in": 89}, 90, ("none", None)), ({"last_in": 89, "last_bounce": 89}, 90, ("none", "bounced")),
    ({"last_reply": 87, "last_in": 87, "decided_at": 89, "reply_state": "reviewed"}, 90, ("reviewed", None)),
    ({"last_reply": 89, "last_in": 89, "decided_at": 87, "reply_state": "reviewed"}, 90, ("new", "reply_new")),
    ({"last_reply": 50, "last_in": 50, "decided_at": 60, "reply_state": None}, 70, ("reviewed", None)),
    ({"last_in": 10, "last_reply": 10, "decided_at": 20, "reply_state": "done"}, 90, ("done", "quiet_warm")),
    ({"last_out": 0}, 90, ("none", None)), ({"next_action": 89, "decided_at": 80, "reply_state": "reviewed"}, 90, ("reviewed", "due")), ({"next_action": 91, "decided_at": 80}, 90, ("none", None)),
    ({"last_reply": 89, "last_in": 89, "last_bounce": 88, "next_action": 80}, 90, ("new", "reply_new")), ({"last_reply": 89, "last_in": 89, "snoozed": 91}, 90, ("new", None)),
    ({"last_bounce": 80, "last_in": 80, "dismissed": True}, 90, ("none", None)), ({"reply_state": "follow_up", "decided_at": 80, "next_action": 1}, 90, ("follow_up", "reply_followup")),
])
def test_reasons(held, days, want):
    scaled = {k: v * live._DAY if type(v) is int else v for k, v in held.items()}
    state = {**live._NEW, **scaled}
    said = live.reply_state(state, False)
    assert (said, live.reason(state, said, days * live._DAY, 30)) == want
