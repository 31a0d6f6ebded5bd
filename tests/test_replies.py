"""Replies and sent messages: one by one, as tables, and as two streams in any order."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rosterloom.streaming import keyed_store, replies

START = datetime(2024, 1, 1)


def made(seed=2, n=120):
    rng = random.Random(seed)
    at = lambda: START + timedelta(seconds=rng.randrange(200 * 86400))
    sent = [(rng.randrange(3), f"M{i}", at(), rng.choice([None, "", *(f"t{k}" for k in range(12))])) for i in range(n)]
    got = [(rng.randrange(3), f"R{i}", at(), rng.choice([None, "", *(f"t{k}" for k in range(12))]), rng.choice([None, [], [f"m{rng.randrange(n)}" for _ in range(3)], ["x", f"M{rng.randrange(n)}"]])) for i in range(n)]
    return got, sent


def one_by_one(got, sent, days=90):
    out = {}
    for rep, key, at, thread, refers in set((r[0], r[1], r[2], r[3], tuple(r[4] or ())) for r in got):
        able = [s for s in set(sent) if s[0] == rep and at - timedelta(days=days) <= s[2] <= at]
        hits = [s for s in able if thread and s[3] == thread]
        if hits:
            best = max(hits, key=lambda s: (s[2], s[1]))
            out[rep, key] = (best[1], "thread_match")
            continue
        first = next((s for r in refers for s in able if s[1].lower() == r.lower()), None)
        out[rep, key] = (first[1], "references_match") if first else (None, "sender_only")
    return out


def told(df):
    rows = df.collect()
    out = {(r.rep, r.reply): (r.sent, r.route) for r in rows}
    assert len(out) == len(rows)
    return out


def test_tables(spark):
    got, sent = made()
    a, b = spark.createDataFrame(got + got[:9], replies.REPLIES), spark.createDataFrame(sent + sent[:9], replies.SENT)
    want = one_by_one(got, sent)
    assert told(replies.match(a, b)) == want and {v[1] for v in want.values()} == {"thread_match", "references_match", "sender_only"}
    assert told(replies.match(a, b.limit(0))) == {k: (None, "sender_only") for k in want}
    assert told(replies.match(a.limit(0), b)) == {}


def start(spark, folder, sink=None):
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}")
    met = replies.stream(read("got", replies.REPLIES), read("sent", replies.SENT), delay="250 days")
    q = met.writeStream.outputMode("append").foreachBatch(sink or replies.sink(f"{folder}/out")).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return q


def test_streams_in_any_order_over_a_failure(spark, tmp_path):
    got, sent = made()
    rng = random.Random(5)
    for name, rows, schema in (("got", got, replies.REPLIES), ("sent", sent, replies.SENT)):
        mixed = rows + rng.sample(rows, 15)
        rng.shuffle(mixed)
        for k in range(0, len(mixed), 50):
            spark.createDataFrame(mixed[k : k + 50], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        late = START + timedelta(days=1000)  # closes the watermark
        row = (-1, "end", late, None, None) if name == "got" else (-1, "end", late, None)
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    write, seen = replies.sink(f"{tmp_path}/out"), []

    def failing(rows, number):
        seen.append(number)
        if number == 1:
            raise OSError("the store is away")
        write(rows, number)

    with pytest.raises(Exception, match="the store is away"):
        start(spark, tmp_path, failing)
    assert replies.ledger(spark, f"{tmp_path}/out").get("replies", -1) <= 0 and seen == [0, 1]
    q = start(spark, tmp_path)
    assert q.exception() is None and replies.ledger(spark, f"{tmp_path}/out")["replies"] >= 1
    assert told(replies.matches(spark, f"{tmp_path}/out").filter("rep >= 0")) == one_by_one(got, sent)
    assert keyed_store.read(spark, f"{tmp_path}/out/matches").filter(F.col("rep") >= 0).count() == len(got)
