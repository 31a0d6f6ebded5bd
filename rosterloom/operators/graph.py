"""Ownership chains and connected groups, by joins that repeat until nothing changes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import cut, first_row


def strongest_parents(edges: DataFrame) -> DataFrame:
    """(child, parent): each node's heaviest edge, by name among equals."""
    return first_row(edges, ["child"], F.desc("weight"), F.asc("parent")).select("child", "parent")


def chains(edges: DataFrame, starts: DataFrame, hops: int = 12) -> DataFrame:
    """(node, chain): the walk up strongest edges, at most ``hops`` long, stopped before a repeat.

    Walks are doubled: the walk of a node is followed by the walk of its end, so twelve hops take four
    joins. A walk that ended above no longer looks for its end, so the few tops are not hot.
    """
    walks = strongest_parents(edges).select(F.col("child").alias("node"), F.array("parent").alias("walk"))
    reach = 1
    while reach < hops:
        going = F.size("walk") == reach  # shorter ones have met a top
        ends = walks.select(F.struct(F.lit(True).alias("going"), F.col("node").alias("at")).alias("end"), F.col("walk").alias("more"))
        walks = walks.withColumn("end", F.struct(going.alias("going"), F.when(going, F.element_at("walk", -1)).otherwise(F.col("node")).alias("at"))).join(ends, "end", "left")
        walks = walks.select("node", F.concat("walk", F.coalesce("more", F.slice("walk", 1, 0))).alias("walk"))
        reach *= 2
    whole = F.slice(F.concat(F.array("node"), F.coalesce("walk", F.slice(F.array("node"), 1, 0))), 1, hops + 1)
    out = starts.select("node").join(walks, "node", "left").select("node", whole.alias("chain"))
    again = F.array_position(F.transform("chain", lambda x, i: F.array_position("chain", x) <= i), True).cast("int")
    return out.select("node", F.when(again > 0, F.slice("chain", 1, again - 1)).otherwise(F.col("chain")).alias("chain"))


def parent_groups(walked: DataFrame) -> DataFrame:
    """Every node that is above more than one start."""
    above = walked.select("node", F.explode(F.slice("chain", 2, 1000)).alias("parent"))
    return above.groupBy("parent").agg(F.count_distinct("node").alias("members")).filter("members > 1")


def _local_stars(batches):
    """The links of a task's rows as stars around the least node of each local group."""
    for batch in batches:
        nodes, codes = np.unique(np.concatenate([batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")]), return_inverse=True)
        a, b = codes[: len(batch)], codes[len(batch) :]
        root = np.arange(len(nodes))
        while len(a):
            x, y = root[a], root[b]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
        kind = batch.schema.field("a").type
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(nodes[root], kind)], names=["a", "b"])


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges (a, b).

    The edges that a task reads together are first contracted to stars, so that hot nodes and long
    paths shrink before anything is shuffled. Then every node points to a node of its group, at first
    to its least neighbour. In each round a node and the node it points to both take the least
    grandparent among the node's neighbours, and pointers are shortened, so that long paths fold in a
    number of rounds like their logarithm. Each round is cut by a checkpoint; no row holds more than
    one edge.
    """
    known = edges.select("a", "b").filter("a is not null and b is not null")
    known = known.mapInArrow(_local_stars, known.schema)
    both = cut(known.unionAll(known.select("b", "a")).distinct())
    state = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).select("node", F.least("node", "up").alias("up")))
    for _ in range(rounds):
        known = state.join(state.select(F.col("node").alias("up"), F.col("up").alias("top")), "up")
        heard = both.join(known.select(F.col("node").alias("b"), "top"), "b").groupBy(F.col("a").alias("node")).agg(F.min("top").alias("heard"))
        own = F.struct(F.col("node").alias("node"), F.least("top", "heard").alias("low"), F.col("up").alias("was"))
        told = F.struct(F.col("up").alias("node"), F.col("heard").alias("low"), F.lit(None).cast(state.schema["node"].dataType).alias("was"))
        said = known.join(heard, "node").select(F.explode(F.array(own, told)).alias("x")).select("x.*")
        after = cut(said.groupBy("node").agg(F.min("low").alias("up"), F.max("was").alias("was")))
        state = after.select("node", "up")
        if after.filter("up < was").isEmpty():
            return state.withColumnRenamed("up", "component")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def branches(records: DataFrame, key: str, order: str) -> DataFrame:
    """(key, branch_id, branch_name, branch_size): people who share an address of mail or a street address.

    ``records`` has ``key``, emails (array), address, zip, city and state. A branch takes its id and its
    name from where its first record by ``order`` with a street address is, so that nobody's leaving
    renames it; without any such record the id comes from its least node. A branch of one has neither.
    Addresses join as nodes of the graph, so a common one makes no pairs.
    """
    folded = F.trim(F.regexp_replace(F.lower(F.coalesce("address", F.lit(""))), "[^a-z0-9]+", " "))
    place = F.when(folded != "", F.concat_ws("|", folded, F.substring(F.trim(F.coalesce("zip", F.lit(""))), 1, 5)))
    me = F.concat(F.lit("p:"), F.col(key).cast("string"))
    rows = records.filter(F.col(key).isNotNull()).withColumns({"__me": me, "__place": place})
    named = F.transform(F.filter(F.coalesce("emails", F.array().cast("array<string>")), lambda e: e.isNotNull()), lambda e: F.concat(F.lit("e:"), F.lower(e)))
    held = F.concat(named, F.array_compact(F.array(F.when(F.col("__place").isNotNull(), F.concat(F.lit("s:"), "__place")))))
    group = components(rows.select(F.col("__me").alias("a"), F.explode(held).alias("b"))).select(F.col("node").alias("__me"), "component")
    placed = rows.join(group, "__me")
    first = F.min_by(F.struct("__place", "address", "city", "state"), F.struct(F.col("__place").isNull().alias("bare"), order, F.col(key).alias("__k")))
    of = placed.groupBy("component").agg(F.count_distinct(key).alias("branch_size"), first.alias("at")).filter("branch_size > 1")
    street = F.trim(F.get(F.split(F.coalesce("at.address", F.lit("")), ","), F.lit(0)))
    name = F.concat(F.coalesce("at.city", F.lit("")), F.lit(", "), F.coalesce("at.state", F.lit("")), F.when(street != "", F.concat(F.lit(" ("), street, F.lit(")"))).otherwise(""))
    told = of.select("component", F.concat(F.lit("b-"), F.substring(F.sha1(F.coalesce("at.__place", "component")), 1, 10)).alias("branch_id"), name.alias("branch_name"), "branch_size")
    out = placed.select(key, "component").distinct().join(told, "component")
    return records.select(key).distinct().join(out.drop("component"), key, "left").withColumn("branch_size", F.coalesce("branch_size", F.lit(1).cast("long")))
