"""Rows for people to decide on: the office that fits, the evidence, the order of work, and published names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import review
from ..functions.rules import Rule, cascade
from .relational import first_row


def best_branch(rows: DataFrame, branches: DataFrame, key: str, person: str, order: str) -> DataFrame:
    """``rows`` with ``street``, ``city``, ``state``, ``postal`` of the person's branch that fits, and ``branch_count``.

    A branch of our postal code (``our_postal``) is taken before one of our city (``our_city``); without
    either the row keeps the office it has. Among equals the least ``order`` wins.
    """
    fields = ["street", "city", "state", "postal"]
    fit = F.when(review.postals_agree(F.col("our_postal"), F.col("b.postal")) == "yes", 1).when(review.cities_agree(F.col("our_city"), F.col("b.city")) == "yes", 2)
    held = branches.select(person, F.struct(order, *fields).alias("b"))
    met = rows.select(key, person, "our_postal", "our_city").join(held, person)
    # one row a key, so that a person with many branches is never gathered
    best = met.withColumn("fit", fit).groupBy(key).agg(F.count("*").alias("branch_count"), F.min(F.when(F.col("fit").isNotNull(), F.struct("fit", "b"))).alias("best"))
    out = rows.join(best, key, "left")
    kept = {f: F.when(F.col("best").isNotNull(), F.col(f"best.b.{f}")).otherwise(F.col(f)) for f in fields}
    return out.withColumns(kept | {"branch_count": F.coalesce("branch_count", F.lit(0))}).drop("best")


def sheet(rows: DataFrame) -> DataFrame:
    """``rows`` with what agrees and a suggestion; a row has our_ and filed values and the chosen office."""
    out = rows.withColumns({
        "firms_agree": review.firms_agree(F.col("our_firm"), F.col("filed_firm")),
        "first_names_agree": review.first_names_agree(F.col("our_name"), F.col("filed_name"), F.col("legal_name")),
        "postals_agree": review.postals_agree(F.col("our_postal"), F.col("postal")),
        "cities_agree": review.cities_agree(F.col("our_city"), F.col("city")),
    })
    return out.withColumn("suggestion", review.suggestion(*[F.col(c) for c in ("firms_agree", "first_names_agree", "postals_agree", "cities_agree")]))


def work_order(assets: Column) -> list[Column]:
    """Sure tiers first, then by suggestion, the largest assets, the fewest namesakes, the widest gap."""
    tier = F.when(F.col("tier") == "high", 0).when(F.col("tier") == "review", 1).when(F.col("tier") == "none", 2).otherwise(3)
    say = F.when(F.col("suggestion") == "ACCEPT", 0).when(F.col("suggestion") == "REJECT", 1).when(F.col("suggestion") == "CHECK", 2).otherwise(3)
    return [tier.asc(), say.asc(), F.coalesce(assets, F.lit(-1)).desc(), F.col("namesakes").asc_nulls_last(), F.col("gap").desc_nulls_last()]


def _titled(text: Column) -> Column:
    """Every run of letters with a capital first."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+|[^a-z]+)")), F.initcap), "")


def published_names(people: DataFrame, contacts: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """(key, reason, preferred, replaced): whether a person is shown by the name that the firm publishes.

    ``people`` has first, middle, last and used names, ``contacts`` tier, name, email and url. Only a used
    name longer than the first name is reconsidered. A filed name needs one sign in the address or the
    url; a new one must shorten the used name (same first two letters) and needs both signs. Rows that
    are not reconsidered are left out; all others give 'shown' or the reason against. With ``most``,
    more changes than that are an error, for then something upstream is wrong.
    """
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    said = first_row(people, [key], *[F.col(c).asc_nulls_last() for c in ("first", "middle", "last", "used")]).select(key, *[low(c).alias(c) for c in ("first", "middle", "last", "used")])
    said = said.filter((F.col("first") != "") & (F.col("last") != "") & (F.length("used") > F.length("first")))
    held = contacts.select(key, "tier", low("email").alias("email"), low("url").alias("url"), F.split(low("name"), r"\s+").alias("words"))
    both = said.join(held, key).withColumns({"given": F.element_at("words", 1), "surname": F.when(F.size("words") > 1, F.element_at("words", -1)).otherwise("")})
    told = lambda c: F.array_contains(F.split(c, "[^a-z]+"), F.col("given"))
    filed = F.col("given").isin(F.col("first"), F.col("middle"))
    shorter = (F.length("given") < F.length("used")) & (F.substring("given", 1, 2) == F.substring("used", 1, 2))
    reason = cascade([
        Rule("tier", ~F.coalesce(F.col("tier").isin("confirmed", "high"), F.lit(False))),
        Rule("surname", F.col("surname") != F.col("last")),
        Rule("initial", F.length("given") < 2),
        Rule("not_in_filing", (F.col("given") == F.col("used")) | (~filed & ~shorter)),
        Rule("no_corroboration", F.when(filed, ~told(F.concat_ws(" ", "email", "url"))).otherwise(~(told("email") & told("url")))),
    ], "shown")
    name = F.when(filed, F.col("first")).otherwise(F.col("given"))
    shown = F.col("reason") == "shown"
    out = both.withColumn("reason", reason).select(key, "reason", F.when(shown, _titled(F.concat_ws(" ", name, "last"))).alias("preferred"), F.when(shown, _titled(F.concat_ws(" ", "used", "last"))).alias("replaced"))
    if most is not None and out.filter(shown).limit(most + 1).count() > most:
        raise ValueError(f"more than {most} names would change")
    return out
