"""Totals shared out over members and their rows, and books of shared accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import dealt


def allocate(rows: DataFrame, totals: DataFrame, owner: str, member: str, total: str, tasks: int | None = None) -> DataFrame:
    """total / members of the owner / rows of the member: sums back to the owner's total.

    With ``tasks`` the rows are dealt by owner into so many parts.
    """
    rows = dealt(rows, tasks, owner)
    members = rows.groupBy(owner).agg(F.count_distinct(member).alias("members"))
    per_member = rows.groupBy(owner, member).agg(F.count("*").alias("member_rows"))
    out = rows.join(totals.select(owner, total), owner, "left").join(members, owner).join(per_member, [owner, member])
    return out.withColumn("allocated", F.col(total) / F.col("members") / F.col("member_rows"))


def reconcile(allocated: DataFrame, totals: DataFrame, owner: str, total: str) -> DataFrame:
    """(stated, reconcilable, allocated): totals of all owners, of owners with rows, and shared out."""
    with_rows = totals.join(allocated.select(owner).distinct(), owner, "left_semi").agg(F.sum(total).alias("reconcilable"))
    return totals.agg(F.sum(total).alias("stated")).crossJoin(with_rows).crossJoin(allocated.agg(F.coalesce(F.sum("allocated"), F.lit(0.0)).alias("allocated")))


def latest_book(df: DataFrame, account: str, value: str, *stamps: Column, holder: Column | None = None) -> DataFrame:
    """One row per account: the value with the latest stamp.

    ``holders`` counts the distinct holders (rows without one given), ``conflict`` says that values
    differ, ``unresolved`` that they do and the latest stamp is not alone.
    """
    order = F.struct(*stamps)
    lead = F.struct(*stamps, F.col(value))
    top = df.groupBy(account).agg(
        F.max(order).alias("__stamp"), F.max(lead).alias("__lead"),
        (F.count("*") if holder is None else F.count_distinct(holder)).alias("holders"),
        (F.min(F.round(value, 2)) != F.max(F.round(value, 2))).alias("conflict"),
    )
    ties = df.select(F.col(account), order.alias("__stamp")).groupBy(account, "__stamp").agg(F.count("*").alias("__n"))
    out = top.join(ties, [account, "__stamp"])
    return out.select(account, F.col("__lead")[value].alias(value), "holders", "conflict", (F.col("conflict") & (F.col("__n") > 1)).alias("unresolved"))


def union_total(holdings: DataFrame, accounts: DataFrame, account: str, value: str) -> DataFrame:
    """Each account once, however many of the chosen holders share it."""
    return accounts.join(holdings.select(account).distinct(), account, "left_semi").agg(F.count("*").alias("accounts"), F.coalesce(F.sum(value), F.lit(0)).alias("total"))


def residual(total: Column, *parts: Column) -> Column:
    """What the parts leave of the total, at least zero."""
    left = total
    for p in parts:
        left = left - F.coalesce(p, F.lit(0))
    return F.greatest(left, F.lit(0))


def product_gaps(df: DataFrame, key: str, a: Column, b: Column) -> DataFrame:
    """How many keys have both products, only the one, only the other."""
    has = df.groupBy(key).agg(F.coalesce(F.bool_or(a), F.lit(False)).alias("a"), F.coalesce(F.bool_or(b), F.lit(False)).alias("b"))
    return has.agg(F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(F.col("b") & ~F.col("a")).alias("only_b"), F.count_if(F.col("a") & F.col("b")).alias("both"))


def place(rows: DataFrame, evidence_city: DataFrame, evidence_state: DataFrame, head: DataFrame, member: str, owner: str) -> DataFrame:
    """The best office of each (member, owner): 3 for the city, 2 for the state, 2 less at the head office.

    ``rows`` has (member, owner, office, city, state, has_street); evidence tables have (member,
    city) and (member, state), ``head`` has (owner, city). The less crowded office wins ties.
    """
    from .relational import corroborate

    crowd = rows.groupBy("office").agg(F.count_distinct(member).alias("crowd"))
    out = corroborate(corroborate(rows, evidence_city, [member, "city"], "in_city"), evidence_state, [member, "state"], "in_state")
    out = corroborate(out, head, [owner, "city"], "at_head").join(crowd, "office")
    points = F.when(F.col("in_city"), 3).when(F.col("in_state"), 2).otherwise(0) - F.when(F.col("at_head"), 2).otherwise(0)
    out = out.withColumn("score", F.greatest(points, F.lit(0)))
    w = Window.partitionBy(member, owner).orderBy(F.desc("score"), F.desc("has_street"), "crowd", "office")
    out = out.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
    kind = F.when(F.col("score") == 0, "uncertain").when(F.col("has_street"), "office").otherwise("remote")
    return out.withColumn("location_type", kind)


def sharing_kind(df: DataFrame, group: list[str], number: str, person: str, direct: int = 1, team: int = 4) -> DataFrame:
    """A number's reach by how many people of the group share it."""
    people = df.filter(F.col(number).isNotNull()).groupBy(*group, number).agg(F.count_distinct(person).alias("people"))
    return people.withColumn("kind", F.when(F.col("people") <= direct, "direct").when(F.col("people") <= team, "team").otherwise("office"))
