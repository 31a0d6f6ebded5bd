"""The attention queue as a stream: a state machine per (rep, advisor) that event time wakes.

State is what the batch projection (``operators.activity.fold``) comes to: the latest contact of each
kind, the latest decision, and whether all messages were imported. Each of these is a maximum or a
logical and, so the order of arrival does not matter. A key wakes when a snooze ends, a planned action
falls due, or its quiet days are over; timers run on event time, so a replay gives the same rows.

A key that can have no reason (nobody ever answered, nothing bounced, nothing was decided) is
forgotten ``FORGET_DAYS`` after its last activity; a later message begins it anew with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: One row for each message or decision; columns that a kind of row lacks are null.
CHANGES = (
    "rep bigint, advisor bigint, kind string, occurred_at timestamp, direction string, classification string, historic boolean, "
    "reply_state string, next_action_at timestamp, snoozed_until timestamp, bounce_dismissed boolean"
)
QUEUE = "rep bigint, advisor bigint, reply_state string, reason string, last_activity timestamp, seq bigint"
QUIET_DAYS = 30
FORGET_DAYS = 400
_DAY = 86_400_000_000
_STAMPS = ("last_out", "last_in", "last_reply", "last_bounce")
#: Stamps are microseconds, -1 for none.
_STATE = (
    "last_out long, last_in long, last_reply long, last_bounce long, messages long, current boolean, decided_at long, reply_state string, next_action long, snoozed long, dismissed boolean, "
    "told_reason string, told_state string, told_activity long, seq long"
)
_FIELDS = [part.split()[0] for part in _STATE.split(", ")]
_NEW = dict(zip(_FIELDS, (-1, -1, -1, -1, 0, False, -1, None, -1, -1, False, None, None, -1, 0)))


def _micros(stamps: pd.Series) -> pd.Series:
    """Whole microseconds, -1 for none."""
    return stamps.astype("datetime64[us]").astype("int64").where(stamps.notna(), -1)


def reply_state(held: dict, seeded: bool) -> str:
    """What the latest reply means beside the latest decision."""
    said = held["reply_state"] or "none"
    if held["last_reply"] < 0:
        return said
    if not seeded and held["last_reply"] > held["decided_at"]:
        return "new"
    return "reviewed" if said == "none" else said


def reason(held: dict, state: str, now: int, quiet_days: int) -> str | None:
    """The most urgent reason to be in the queue at ``now``."""
    if held["snoozed"] > now:
        return None
    if state == "new" and held["last_reply"] >= 0:
        return "reply_new"
    if state == "follow_up":
        return "reply_followup"
    if 0 <= held["next_action"] <= now:
        return "due"
    if held["last_bounce"] >= 0 and not held["dismissed"]:
        return "bounced"
    quiet = max(held["last_out"], held["last_in"]) < now - quiet_days * _DAY
    return "quiet_warm" if held["last_reply"] >= 0 and quiet else None


class LiveQueue(StatefulProcessor):
    """Emits a key's row whenever its reason, its reply state or its last activity has changed."""

    def __init__(self, quiet_days: int = QUIET_DAYS, forget_days: int = FORGET_DAYS):
        self.quiet_days, self.forget_days = quiet_days, forget_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = dict(zip(_FIELDS, self.held.get())) if self.held.exists() else dict(_NEW)
        for f in rows:
            self._take(held, f)
        yield from self._tell(key, held, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
            yield from self._tell(key, dict(zip(_FIELDS, self.held.get())), now * 1000)

    @staticmethod
    def _take(held: dict, f: pd.DataFrame) -> None:
        at = _micros(f["occurred_at"])
        mail = (f["kind"] == "mail").to_numpy()
        inbound = (f["direction"] == "inbound").to_numpy() & mail
        kinds = ((f["direction"] == "outbound").to_numpy() & mail, inbound, inbound & (f["classification"] == "reply").to_numpy(), inbound & (f["classification"] == "bounce").to_numpy())
        for name, mask in zip(_STAMPS, kinds):
            if mask.any():
                held[name] = max(held[name], int(at[mask].max()))
        held["messages"] += int(mail.sum())
        held["current"] |= bool((mail & ~(f["historic"].eq(True)).to_numpy()).any())
        decisions = f[(f["kind"] == "decision").to_numpy()]
        if len(decisions):
            stamps = _micros(decisions["occurred_at"])
            last = stamps.to_numpy().argmax()
            if int(stamps.iloc[last]) > held["decided_at"]:
                row = decisions.iloc[last]
                held["decided_at"], held["reply_state"] = int(stamps.iloc[last]), row["reply_state"] if isinstance(row["reply_state"], str) else None
                held["next_action"], held["snoozed"] = (int(_micros(decisions[c]).iloc[last]) for c in ("next_action_at", "snoozed_until"))
                held["dismissed"] = row["bounce_dismissed"] is True or bool(row["bounce_dismissed"] == True)  # noqa: E712  numpy's bool, None or NaN

    def _tell(self, key, held: dict, now: int) -> Iterator[pd.DataFrame]:
        seeded = held["messages"] > 0 and not held["current"]
        activity = max(held["last_out"], held["last_in"])
        state = reply_state(held, seeded)
        why = reason(held, state, now, self.quiet_days)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # a decision alone has no messages and no row in the projection; it waits for one
        idle = held["last_reply"] < 0 and held["last_bounce"] < 0 and held["decided_at"] < 0
        if idle and activity + self.forget_days * _DAY <= now:
            self.held.clear()
            return
        waits = [held["snoozed"], held["next_action"]]
        if held["last_reply"] >= 0:
            waits.append(activity + self.quiet_days * _DAY + 1)
        if idle:
            waits.append(activity + self.forget_days * _DAY)
        for at in {-(-w // 1000) for w in waits if w > now}:  # a timer is in whole milliseconds
            self.handle.registerTimer(int(at))
        changed = (why, state, activity) != (held["told_reason"], held["told_state"], held["told_activity"])
        if changed and held["messages"]:
            held |= {"told_reason": why, "told_state": state, "told_activity": activity, "seq": held["seq"] + 1}
        self.held.update(tuple(held[c] for c in _FIELDS))
        if changed and held["messages"]:
            row = [*key, state, why, pd.to_datetime(activity, unit="us") if activity >= 0 else pd.NaT, held["seq"]]
            yield pd.DataFrame([row], columns=["rep", "advisor", "reply_state", "reason", "last_activity", "seq"])

    def close(self) -> None:
        pass


def changes(mail: DataFrame, decisions: DataFrame) -> DataFrame:
    """Messages and decisions as one stream (``CHANGES``); a decision's ``acted_at`` is when it was made."""
    said = decisions.withColumnRenamed("acted_at", "occurred_at").withColumn("kind", F.lit("decision"))
    both = mail.withColumn("kind", F.lit("mail")).unionByName(said, allowMissingColumns=True)
    missing = {"historic": "boolean", "reply_state": "string", "next_action_at": "timestamp", "snoozed_until": "timestamp", "bounce_dismissed": "boolean"}
    both = both.withColumns({c: F.lit(None).cast(t) for c, t in missing.items() if c not in both.columns})
    return both.select(*[part.split()[0] for part in CHANGES.split(", ")])


def live_queue(stream: DataFrame, delay: str = "10 minutes", quiet_days: int = QUIET_DAYS, forget_days: int = FORGET_DAYS) -> DataFrame:
    """The queue's rows (``QUEUE``) as they change; ``seq`` orders those of a key, a null reason takes it off the queue.

    ``stream`` has the columns of ``CHANGES``. Timers and state need the RocksDB state store, which is
    set for the session if it has named no other.
    """
    conf = stream.sparkSession.conf
    if conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider"):
        conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keyed = stream.withWatermark("occurred_at", delay).groupBy("rep", "advisor")
    return keyed.transformWithStateInPandas(LiveQueue(quiet_days, forget_days), outputStructType=QUEUE, outputMode="Update", timeMode="EventTime")
