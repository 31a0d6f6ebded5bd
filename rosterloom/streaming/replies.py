"""Which sent message a reply answers: by its conversation, else by the first message it refers to.

A reply meets the messages that its rep sent in the ``DAYS`` before it, under its conversation and
under each id that it refers to. The same join serves tables and streams: on streams both sides have
watermarks, so that the index of sent messages is bounded by time and a reply that answers nothing is
told so once nothing earlier can still arrive. Repeated messages count once.

The results go to a keyed table, a row a reply, where a better route replaces a worse one. A ledger
beside it names the last batch whose rows are all there; a batch that fails does not move it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import keyed_store

#: rep, id, at, conversation, refers_to (the ids that it refers to, in order)
REPLIES = "rep bigint, id string, at timestamp, conversation string, refers_to array<string>"
SENT = "rep bigint, id string, at timestamp, conversation string"
DAYS = 90
#: What the keyed table orders its rows by; the greatest is kept.
RANK = "rank"


def _places(replies: DataFrame) -> DataFrame:
    """(rep, reply, replied_at, place, key): place 0 is the conversation, the others what it refers to; -1 keeps every reply in sight."""
    refers = F.transform(F.coalesce("refers_to", F.array().cast("array<string>")), lambda x, i: F.struct((i + 1).alias("place"), F.concat(F.lit("i"), F.lower(x)).alias("key")))
    thread = F.array(F.struct(F.lit(0).alias("place"), F.concat(F.lit("c"), F.nullif("conversation", F.lit(""))).alias("key")))
    every = F.filter(F.concat(thread, refers), lambda p: p["key"].isNotNull())
    every = F.when(F.size(every) > 0, every).otherwise(F.array(F.struct(F.lit(-1).alias("place"), F.lit("").alias("key"))))
    return replies.select("rep", F.col("id").alias("reply"), F.col("at").alias("replied_at"), F.inline(every))


def _index(sent: DataFrame) -> DataFrame:
    """(sent_rep, sent, sent_at, sent_key): each message under its conversation and its id."""
    keys = F.array_compact(F.array(F.concat(F.lit("c"), F.nullif("conversation", F.lit(""))), F.concat(F.lit("i"), F.lower("id"))))
    return sent.select(F.col("rep").alias("sent_rep"), F.col("id").alias("sent"), F.col("at").alias("sent_at"), F.explode(keys).alias("sent_key"))


def meetings(replies: DataFrame, sent: DataFrame, days: int = DAYS) -> DataFrame:
    """(rep, reply, replied_at, sent, sent_at, route, rank): every meeting, and places of replies that meet nothing."""
    near = F.col("sent_at").between(F.col("replied_at") - F.expr(f"interval {days} days"), F.col("replied_at"))
    met = _places(replies).join(_index(sent), (F.col("rep") == F.col("sent_rep")) & (F.col("key") == F.col("sent_key")) & near, "left")
    found = F.col("sent").isNotNull()
    route = F.when(~found, "sender_only").when(F.col("place") == 0, "thread_match").otherwise("references_match")
    rank = F.struct(found.cast("int").alias("found"), F.when(found, -F.col("place")).otherwise(0).alias("first"), F.coalesce(F.unix_micros(F.col("sent_at").cast("timestamp")), F.lit(0)).alias("late"), F.coalesce("sent", F.lit("")).alias("id"))
    return met.select("rep", "reply", "replied_at", "sent", "sent_at", route.alias("route"), rank.alias(RANK))


def match(replies: DataFrame, sent: DataFrame, days: int = DAYS) -> DataFrame:
    """(rep, reply, replied_at, sent, sent_at, route): one row for each reply, its best meeting; among a conversation's messages the latest."""
    once = lambda df: df.dropDuplicates(["rep", "id"])
    best = meetings(once(replies), once(sent), days).groupBy("rep", "reply", "replied_at").agg(F.max_by(F.struct("sent", "sent_at", "route"), RANK).alias("b"))
    return best.select("rep", "reply", "replied_at", "b.*")


def stream(replies: DataFrame, sent: DataFrame, days: int = DAYS, delay: str = "2 hours") -> DataFrame:
    """``meetings`` of two streams, each message once however late within ``delay`` or often it comes."""
    once = lambda df: df.withWatermark("at", delay).dropDuplicatesWithinWatermark(["rep", "id"])
    return meetings(once(replies), once(sent), days)


def sink(path: str, name: str = "replies"):
    """A foreachBatch sink: the best meeting of each reply, then the ledger."""

    def write(rows: DataFrame, number: int) -> None:
        keyed_store.put(rows, f"{path}/matches", ["rep", "reply"], RANK, batch=number)
        upto = rows.agg(F.max("replied_at").alias("upto"), F.count("*").alias("rows"))
        said = upto.select(F.lit(name).alias("name"), F.lit(number).cast("bigint").alias("done"), "upto", "rows")
        keyed_store.put(said, f"{path}/ledger", ["name"], "done", batch=number, buckets=1)

    return write


def matches(spark, path: str) -> DataFrame:
    """The keyed table as ``match`` gives it."""
    return keyed_store.read(spark, f"{path}/matches").drop(RANK, keyed_store.ETAG)


def ledger(spark, path: str) -> dict[str, int]:
    """The last complete batch of each sweep."""
    if not keyed_store.versions(spark, f"{path}/ledger"):
        return {}
    return {r["name"]: r["done"] for r in keyed_store.read(spark, f"{path}/ledger").collect()}
