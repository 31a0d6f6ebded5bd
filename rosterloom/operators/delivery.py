"""Mail before and after it goes: what stops a message, and what a delivery report says of one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contacts
from ..functions.rules import Rule, cascade
from . import activity

#: The room that headers take, and the growth of an attachment as base64.
HEADER_BYTES = 4096


def sweep(reports: DataFrame, sent: DataFrame, seen: DataFrame, as_of: Column, hours: int = 48, days: int = 30) -> DataFrame:
    """(rep, item, outcome, code, message, address, domain, act) of each report that was not seen before.

    ``reports`` has (rep, mailbox, item, received, sender, subject, content_type, flagged, body, refs),
    ``sent`` (rep, internet_id, message, recipient, at), ``seen`` (rep, item). Reports of the last
    ``hours`` are read again, so that a late one is not lost. A report belongs to the first message of
    ``refs`` that the rep sent within ``days``. The address is always that of the sent message, never
    the report's: a report may be forged, so one that names somebody else is a mismatch. All matched
    kinds are recorded with their domain; only hard ones act.
    """
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    fresh = reports.filter(F.col("received") >= as_of - F.make_dt_interval(hours=F.lit(hours)))
    fresh = fresh.filter((low("sender") == "") | (low("sender") != low("mailbox")))
    fresh = fresh.filter(activity.is_report(F.col("sender"), F.col("subject"), F.col("content_type"), F.col("flagged"))).join(seen, ["rep", "item"], "left_anti")
    named = F.lower(F.regexp_extract(F.col("body"), r"(?i)(?:Final|Original)-Recipient:\s*(?:rfc822;)?\s*<?([^\s<>;]+@[^\s<>;]+?)>?(?:\s|$)", 1))
    judged = fresh.select("rep", "item", activity.bounce(F.col("body")).alias("b"), F.nullif(named, F.lit("")).alias("named"), "refs")
    recent = sent.filter(F.col("at") >= as_of - F.make_dt_interval(days=F.lit(days))).select("rep", F.lower("internet_id").alias("ref"), "message", F.lower("recipient").alias("address"))
    tried = judged.filter("b.kind is not null").select("rep", "item", F.posexplode("refs").alias("nth", "ref")).withColumn("ref", F.lower("ref"))
    ours = tried.join(recent, ["rep", "ref"]).groupBy("rep", "item").agg(F.min(F.struct("nth", "message", "address")).alias("ours"))
    out = judged.join(ours, ["rep", "item"], "left")
    outcome = cascade([
        Rule("not-a-bounce", F.col("b.kind").isNull()), Rule("unmatched", F.col("ours").isNull()), Rule("recipient-mismatch", F.col("named") != F.col("ours.address")),
    ])
    out = out.withColumn("outcome", F.coalesce(outcome, F.col("b.kind")))
    matched = F.col("outcome").isin("hard", "soft", "policy")
    address = F.when(matched, F.col("ours.address"))
    return out.select(
        "rep", "item", "outcome", F.col("b.code").alias("code"), F.when(matched, F.col("ours.message")).alias("message"), address.alias("address"),
        F.when(matched, F.coalesce(F.get(F.split(F.col("ours.address"), "@"), F.lit(1)), F.lit(""))).alias("domain"), (F.col("outcome") == "hard").alias("act"),
    )


def check(messages: DataFrame, suppressed: DataFrame, documents: DataFrame, most_bytes: int, most_attachment: int, most_chars: int) -> DataFrame:
    """``messages`` with ``errors`` (codes in order), ``behind`` and ``estimated_bytes``.

    A message has (batch, message, recipient, subject, body, html, signature, images, base_revision,
    common_revision, attachments); ``images`` are the known chart names (null: not known, then none is
    wrong), ``attachments`` an array of (id, version, sha256, size, approved). ``suppressed`` has
    (recipient), ``documents`` the current (id, version, sha256).
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    size = lambda c: F.octet_length(F.coalesce(F.col(c), F.lit("")))
    tokens = F.transform(F.regexp_extract_all(F.concat_ws("\n", F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit(""))), F.lit(r"\{\{\s*([^}]+)\s*\}\}")), F.trim)
    is_image = lambda t: F.lower(t).startswith("image:")
    wrong = F.filter(tokens, lambda t: is_image(t) & ~F.array_contains(F.transform("images", F.lower), F.trim(F.lower(F.substring(t, 7, 1000)))))
    # one row an attachment, so that documents are joined and never gathered
    files = messages.select("batch", "message", F.explode("attachments").alias("f")).select("batch", "message", "f.*")
    now = documents.select("id", F.struct("version", "sha256").alias("now"))
    held = files.join(now, "id", "left").groupBy("batch", "message").agg(
        F.sum(F.coalesce("size", F.lit(0))).alias("bytes"), F.max("size").alias("largest"),
        F.bool_and(F.coalesce(F.col("approved") & (F.col("now.version") == F.col("version")) & (F.col("now.sha256") == F.col("sha256")), F.lit(False))).alias("current"),
    )
    twice = messages.groupBy("batch", "recipient").agg((F.count("*") > 1).alias("twice"))
    stopped = suppressed.select("recipient", F.lit(True).alias("stopped")).distinct()
    out = messages.join(held, ["batch", "message"], "left").join(twice, ["batch", "recipient"], "left").join(stopped, "recipient", "left")
    estimated = size("subject") + size("html") + size("signature") + F.ceil(F.coalesce("bytes", F.lit(0)) * 4 / 3) + HEADER_BYTES
    tests = [
        ("invalid_recipient", contacts.email(F.col("recipient")).isNull()), ("duplicate_recipient", F.col("twice")), ("missing_subject", blank("subject")), ("missing_body", blank("body")),
        ("unresolved_merge_fields", F.exists(tokens, lambda t: ~is_image(t))), ("unknown_image", F.col("images").isNotNull() & (F.size(wrong) > 0)),
        ("permanent_bounce_suppression", F.col("stopped")), ("attachment_unavailable", ~F.col("current")), ("attachment_too_large", F.col("largest") > most_attachment),
        ("message_too_large", estimated > most_bytes), ("body_too_large", F.length("body") > most_chars),
    ]
    errors = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(code)) for code, t in tests]))
    behind = (F.coalesce("common_revision", F.lit(0)) > 0) & (F.coalesce("base_revision", F.lit(0)) < F.coalesce("common_revision", F.lit(0)))
    return out.withColumns({"errors": errors, "behind": behind, "estimated_bytes": estimated.cast("long")}).drop("bytes", "largest", "current", "twice", "stopped")
