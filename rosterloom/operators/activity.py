"""Activity logs: engagement folds, queues, delivery, limits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import Rule, cascade

#: How strong a do-not-contact code is; a stronger one is never downgraded, 2 and C are equal.
CODE_STRENGTH = {"1": 0, "2": 1, "C": 1, "P": 2, "3": 3, "N": 4, "NC": 5, "U": 6}
#: Permanent failures that say nothing about the address.
POLICY_CODES = ["5.2.2", "5.2.3", "5.3.4", "5.7.1", "5.7.13", "5.7.26", "5.7.708"]
#: Subjects and senders of delivery reports.
REPORT_SUBJECT = r"(?i)^(undeliverable|delivery status notification|returned mail|mail delivery failed)"
REPORT_SENDER = r"(?i)^(postmaster|mailer-daemon|microsoftexchange[0-9a-f]*)@"
#: Reasons to be in the queue, the most urgent first, with what they are called.
REASONS = {
    "reply_new": "Replied — needs attention", "reply_followup": "Follow-up needed", "due": "Follow-up due",
    "bounced": "Email bounced — address needs fixing", "quiet_warm": "Warm, no contact in a while",
}
#: Percent of the messages sent from which a kind of report is a warning, and bad.
LEVELS = {"hard": (2, 5), "soft": (10, 25), "policy": (1, 3), "unsubscribed": (1, 3)}
DECISIONS = {"reply_state": "string", "acted_at": "timestamp", "next_action_at": "timestamp", "snoozed_until": "timestamp", "bounce_dismissed": "boolean"}


def fold(log: DataFrame, keys: list[str], as_of: Column, days: int = 30, decisions: DataFrame | None = None, historic: Column | None = None) -> DataFrame:
    """One row per key: last contacts each way, counts of the last days, reply state.

    ``log`` has (direction, classification, occurred_at). ``decisions`` has one row per key of what
    people decided (``DECISIONS``), which no log can tell again. A reply later than the last act is
    new; one that was acted on and has no state is reviewed. Where all of a key's rows are
    ``historic`` (imported), they count as acted on.
    """
    out_, in_ = F.col("direction") == "outbound", F.col("direction") == "inbound"
    reply, bounce = in_ & (F.col("classification") == "reply"), in_ & (F.col("classification") == "bounce")
    recent = F.col("occurred_at") >= as_of - F.make_dt_interval(F.lit(days))
    at = F.col("occurred_at")
    rolled = log.groupBy(*keys).agg(
        F.max(F.when(out_, at)).alias("last_out"),
        F.max(F.when(in_, at)).alias("last_in"),
        F.max(F.when(reply, at)).alias("last_reply"),
        F.max(F.when(bounce, at)).alias("last_bounce"),
        F.max(F.when(out_ | in_, at)).alias("last_activity"),
        F.count_if(out_ & recent).alias("out_recent"),
        F.count_if(in_ & recent).alias("in_recent"),
        F.coalesce(F.bool_and(F.lit(False) if historic is None else historic), F.lit(False)).alias("__seeded"),
    )
    known = rolled if decisions is None else rolled.join(decisions, keys, "left")
    known = known.withColumns({c: F.col(c) if decisions is not None and c in decisions.columns else F.lit(None).cast(t) for c, t in DECISIONS.items()})
    acted = F.when(F.col("__seeded"), as_of).otherwise(F.col("acted_at"))
    said = F.coalesce("reply_state", F.lit("none"))
    state = F.when(F.col("last_reply").isNull(), said).when(acted.isNull() | (F.col("last_reply") > acted), "new").when(said == "none", "reviewed").otherwise(said)
    known = known.withColumn("reply_state", state).withColumn("acted_at", acted).withColumn("bounce_dismissed", F.coalesce("bounce_dismissed", F.lit(False)))
    return known.withColumn("has_bounce", F.col("last_bounce").isNotNull()).withColumn("ever_replied", F.col("last_reply").isNotNull()).drop("__seeded")


def attention(projection: DataFrame, as_of: Column, quiet_days: int = 30) -> DataFrame:
    """One reason per row by urgency, with its label and rank; rows without a reason stay out.

    A snooze silences all reasons until it ends. Within a reason the longest without activity comes
    first (``orderBy("urgency", "last_activity")``).
    """
    reason = cascade([
        Rule("snoozed", F.col("snoozed_until") > as_of),
        Rule("reply_new", (F.col("reply_state") == "new") & F.col("last_reply").isNotNull()),
        Rule("reply_followup", F.col("reply_state") == "follow_up"),
        Rule("due", F.col("next_action_at") <= as_of),
        Rule("bounced", F.col("has_bounce") & ~F.col("bounce_dismissed")),
        Rule("quiet_warm", F.col("ever_replied") & (F.col("last_activity") < as_of - F.make_dt_interval(F.lit(quiet_days)))),
    ])
    out = projection.withColumn("reason", reason).filter(F.col("reason") != "snoozed")
    labels = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    return out.withColumn("label", F.element_at(labels, F.col("reason"))).withColumn("urgency", F.array_position(F.array(*map(F.lit, REASONS)), F.col("reason")))


def drift(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, column): the first column in which a projection made anew differs from the stored one."""
    again = after.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    first = F.coalesce(*[F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in columns])
    return before.select(*keys, *columns).join(again, keys).select(*keys, first.alias("column")).filter("column is not null")


def is_report(sender: Column, subject: Column, content_type: Column, flagged: Column) -> Column:
    """Whether a message looks like a delivery report at all."""
    tests = [sender.rlike(REPORT_SENDER), F.contains(F.lower(content_type), F.lit("report-type=delivery-status")), flagged != "", subject.rlike(REPORT_SUBJECT)]
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def bounce(report: Column) -> Column:
    """struct(kind, code) of a delivery report's text: hard, soft or policy; nulls where it is no bounce.

    An enhanced status decides; without one a bare 5xx reply of the server is hard.
    """
    part = lambda k: F.nullif(F.regexp_extract(report, r"(?i)\bStatus:\s*([245])\.(\d{1,3})\.(\d{1,3})", k), F.lit(""))
    code = F.concat_ws(".", part(1), part(2).cast("int").cast("string"), part(3).cast("int").cast("string"))
    bare = r"(?i)\b(5\d{2})[ -]\d\.\d\.\d\b|\bsmtp;\s*(5\d{2})\b"
    reply = F.coalesce(*[F.nullif(F.regexp_extract(report, bare, k), F.lit("")) for k in (1, 2)])
    kind = cascade([
        Rule("soft", part(1) == "4"), Rule("none", part(1) == "2"), Rule("policy", code.isin(*POLICY_CODES)), Rule("hard", (part(1) == "5") | reply.isNotNull()),
    ])
    real = kind.isNotNull() & (kind != "none")
    return F.struct(F.when(real, kind).alias("kind"), F.when(real, F.coalesce(F.nullif(code, F.lit("")), reply)).alias("code"))


def strongest_code(df: DataFrame, key: str, code: str) -> DataFrame:
    """The strongest code of each key; of two equally strong the later in the alphabet."""
    strength = F.element_at(F.create_map(*[F.lit(x) for kv in CODE_STRENGTH.items() for x in kv]), F.col(code))
    return df.groupBy(key).agg(F.max_by(code, F.struct(strength, F.col(code))).alias(code))


def health(sends: DataFrame, events: DataFrame, opt_outs: DataFrame, rep: str, domain: str, least: int = 30) -> DataFrame:
    """Per rep (a null domain), and per rep and domain: messages, reports of each kind and their levels.

    ``events`` has (rep, domain, kind). A level is unknown below ``least`` messages; rates are shares
    of the messages sent, and a bound that is reached counts.
    """
    there = lambda df: [F.col(rep), F.coalesce(F.col(domain).cast("string"), F.lit("(unknown)")).alias(domain)]
    rows = sends.select(*there(sends), F.lit("sent").alias("kind")).unionAll(events.select(*there(events), "kind")).unionAll(opt_outs.select(*there(opt_outs), F.lit("unsubscribed").alias("kind")))
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("sent", *LEVELS)]
    out = rows.filter(F.col(rep).isNotNull()).rollup(rep, domain).agg(*counts).filter(F.col(rep).isNotNull())
    for kind, (warn, bad) in LEVELS.items():
        level = F.when(F.col("sent") < least, "unknown").when(F.col(kind) * 100 >= F.col("sent") * bad, "bad").when(F.col(kind) * 100 >= F.col("sent") * warn, "warn").otherwise("ok")
        out = out.withColumn(f"{kind}_level", level)
    return out


def top_codes(events: DataFrame, rep: str, code: str, most: int = 8) -> DataFrame:
    """The commonest codes of each rep, by code among equals."""
    n = events.filter(F.col(code).isNotNull()).groupBy(rep, code).agg(F.count("*").alias("n"))
    w = Window.partitionBy(rep).orderBy(F.desc("n"), code)
    return n.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def admitted(df: DataFrame, key: str, stamp: str, tie: str, seconds: int) -> DataFrame:
    """``df`` with ``admitted``: whether the key's last admitted event was ``seconds`` or more ago.

    An event that was turned away does not count for the next. Rows of a key pass through one task
    in order and are not gathered, so a key may have any number of them.
    """
    rows = df.repartition(key).sortWithinPartitions(key, stamp, tie)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, admitted boolean"

    def run(frames):
        now, last = object(), None
        for f in frames:
            flags = []
            for k, at in zip(f[key], f[stamp]):
                if k != now:
                    now, last = k, None
                go = last is None or at - last >= pd.Timedelta(seconds=seconds)
                last = at if go else last
                flags.append(go)
            yield f.assign(admitted=flags)

    return rows.mapInPandas(run, schema)


def without_copied(df: DataFrame, batch: str, order: str, person: str, address: str, copies: str) -> DataFrame:
    """``df`` with ``kept``: a recipient goes whom an earlier kept one of the batch already copies.

    ``copies`` is an array of addresses. Batches are of the size that one person sends.
    """
    rows = df.repartition(batch).sortWithinPartitions(batch, order, person)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, kept boolean"

    def run(frames):
        now, copied = object(), set()
        for f in frames:
            flags = []
            for b, mine, also in zip(f[batch], f[address], f[copies]):
                if b != now:
                    now, copied = b, set()
                flags.append(not (mine and mine in copied))
                if flags[-1]:
                    copied.update(() if also is None else also)
            yield f.assign(kept=flags)

    return rows.mapInPandas(run, schema)


def call_history(calls: DataFrame, crm: DataFrame, written: str, crm_id: str, since: Column | None = None) -> DataFrame:
    """Calls of our own log and of the CRM as one history, without CRM rows that our log wrote there."""
    foreign = crm.join(calls.filter(F.col(written).isNotNull()).select(F.col(written).alias(crm_id)), crm_id, "left_anti")
    both = calls.unionByName(foreign, allowMissingColumns=True)
    return both if since is None else both.filter(F.col("occurred_at") >= since)


def set_flags(flags: DataFrame, changes: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Flags after changes: only those that a change names (not null) move; a row of no flag goes."""
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in names])
    both = flags.select(key, *names).join(new, key, "full")
    out = both.select(key, *[F.coalesce(F.col(f"__{c}"), F.col(c), F.lit(False)).alias(c) for c in names])
    return out.filter(F.greatest(*[F.col(c).cast("int") for c in names]) > 0)


def merge_settings(old: DataFrame, sent: DataFrame, key: str, column: str, allowed: dict[str, int]) -> DataFrame:
    """Settings (a map) after a change: only allowed keys, each cut to its length, keys not sent stay."""
    caps = F.create_map(*[F.lit(x) for kv in allowed.items() for x in kv])
    clean = F.transform_values(F.map_filter("__sent", lambda k, v: k.isin(*allowed)), lambda k, v: F.substring(v, F.lit(1), F.element_at(caps, k)))
    both = old.select(key, column).join(sent.select(key, F.col(column).alias("__sent")), key, "full")
    was = F.map_filter(F.coalesce(column, F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(F.coalesce(clean, F.create_map().cast("map<string,string>"))), k))
    return both.select(key, F.map_concat(was, F.coalesce(clean, F.create_map().cast("map<string,string>"))).alias(column))


def capacity_returns(df: DataFrame, key: str, stamp: str, tie: str, amount: str, need: int, limit: int) -> DataFrame:
    """Per key: when enough of the day's use will have aged out for ``need`` more."""
    w = Window.partitionBy(key).orderBy(stamp, tie).rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(amount).over(Window.partitionBy(key))
    freed = df.withColumn("__freed", F.sum(amount).over(w)).withColumn("__over", used + need - limit)
    first = freed.filter((F.col("__over") > 0) & (F.col("__freed") >= F.col("__over")))
    return first.groupBy(key).agg(F.min(F.col(stamp) + F.expr("interval 1 day")).alias("free_at"))


def oldest_pages(df: DataFrame, key: str, stamp: str, tie: str, since: Column, size: int = 100, pages: int = 10) -> DataFrame:
    """Each mailbox's rows from ``since`` on, oldest first, in ``pages`` pages of ``size`` at most.

    ``page`` counts from 1; ``truncated`` says that the mailbox holds more, which the next read takes up.
    """
    size = min(max(size, 1), 200)
    rows = df.filter(F.col(stamp) >= since)
    held = rows.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__n"))
    taken = rows.withColumn("__at", F.row_number().over(Window.partitionBy(key).orderBy(stamp, tie))).filter(F.col("__at") <= size * pages)
    out = taken.join(held, F.col(key).eqNullSafe(F.col("__k")))
    return out.withColumn("page", F.floor((F.col("__at") - 1) / size).cast("int") + 1).withColumn("truncated", F.col("__n") > size * pages).drop("__at", "__k", "__n")
