"""Joins, windows and set operations that the domain operators are made of."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo

#: Rows of one task, where rows are dealt by their number.
TASK_ROWS = 500_000


def task_count(df: DataFrame) -> int | None:
    """Into how many tasks the rows of ``df`` (a stored table, of which only the footers are read) are dealt; none where the session's number will do."""
    n = -(-df.count() // TASK_ROWS)
    return n if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``df`` by its keys in ``tasks`` parts, so that a task's memory does not grow with the table."""
    return df.repartition(tasks, *keys) if tasks else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints and passing tables.

    Only a local session, whose executors are the driver, gets one of its own where none is named.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or Path(tempfile.mkdtemp(prefix="rosterloom-")).as_uri())
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Computed once and kept in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``name``: the position (bigint from 1) of each row in a total order of all rows.

    Rows are range-partitioned and kept, each range is numbered by itself, and the sizes of the
    ranges before it (one row a range) are added, so that no task gets more than its range.
    """
    laid = cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = laid.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    out = laid.withColumn("__inside", inside).join(F.broadcast(starts), "__range")
    return out.withColumn(name, F.col("__before") + F.col("__inside")).drop("__range", "__inside", "__before")


def percent_ranks(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """``name``: average rank of ties over the group's size (see ``numeric.percent_rank_average``).

    Ranks come from positions over all rows, so a group of any size is spread over tasks.
    """
    placed = numbered(df, "__at", F.asc(group), F.asc(value))
    ties = placed.groupBy(F.col(group).alias("__g"), F.col(value).alias("__v")).agg(F.min("__at").alias("__low"), F.max("__at").alias("__high"))
    sizes = ties.groupBy(F.col("__g").alias("__h")).agg(F.min("__low").alias("__first"), F.sum(F.col("__high") - F.col("__low") + 1).alias("__n"))
    ranked = ties.join(sizes, F.col("__g").eqNullSafe(F.col("__h")))
    rank = (F.col("__low") - F.col("__first") + 1 + (F.col("__high") - F.col("__low")) / F.lit(2.0)) / F.col("__n")
    ranked = ranked.select("__g", "__v", rank.alias(name))
    return placed.join(ranked, F.col(group).eqNullSafe(F.col("__g")) & F.col(value).eqNullSafe(F.col("__v"))).drop("__at", "__g", "__v")


def first_row(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in a total order."""
    return top_n(df, keys, 1, *order)


def top_n(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("__rn") <= n).drop("__rn")


def restrict(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def missing_only(df: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    return df.join(known.select(*on), on, "left_anti")


def corroborate(df: DataFrame, evidence: DataFrame, on: list[str], name: str) -> DataFrame:
    """A flag: whether the key occurs in the evidence; rows stay as they are."""
    hit = evidence.select(*on).distinct().withColumn(name, F.lit(True))
    return df.join(hit, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def in_order(keys: DataFrame, df: DataFrame, on: list[str]) -> DataFrame:
    """All keys of the list, with nulls where ``df`` has no row."""
    return keys.join(df, on, "left")


def fill_null(df: DataFrame, overrides: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Overrides fill absent values only. Keys meet without regard to case and outer blanks.

    Of several overrides of one key the least row is taken, so no row of ``df`` is repeated.
    """
    fold = lambda frame: [(F.upper(F.trim(k)) if dict(frame.dtypes)[k] == "string" else F.col(k)).alias(f"__on{i}") for i, k in enumerate(on)]
    keys = [f"__on{i}" for i in range(len(on))]
    given = overrides.select(*fold(overrides), F.struct(*columns).alias("__given")).groupBy(*keys).agg(F.min("__given").alias("__given"))
    out = df.select("*", *fold(df)).join(given, keys, "left")
    return out.select(*[F.coalesce(c, f"__given.{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def upsert(old: DataFrame, new: DataFrame, on: list[str], replace: bool = True) -> DataFrame:
    """New rows replace old ones of the same key, or (``replace=False``) only add keys."""
    keep, add = (old.join(new.select(*on), on, "left_anti"), new) if replace else (old, new.join(old.select(*on), on, "left_anti"))
    return keep.unionByName(add, allowMissingColumns=True)


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def bridge(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str) -> DataFrame:
    """Pairs that are unambiguous in both directions.

    Each key is folded to the least and greatest id on either side before the join, so a key that
    many ids share makes one row for each of them and no pairs.
    """

    def partner(rows: DataFrame, own: str, others: DataFrame, other: str) -> DataFrame:
        ends = others.groupBy(*on).agg(F.min(other).alias("__low"), F.max(other).alias("__high"))
        met = rows.join(ends, on).groupBy(own).agg(F.min("__low").alias(other), F.max("__high").alias("__high"))
        return met.filter(F.col(other) == F.col("__high")).drop("__high")

    return partner(left, left_id, right, right_id).join(partner(right, right_id, left, left_id), [left_id, right_id])


def first_route(df: DataFrame, *routes: tuple[str, DataFrame, list[str]], value: str) -> DataFrame:
    """``value`` from the first lookup that has the key, and the name of that route."""
    out, found, label = df, [], None
    for name, lookup, on in routes:
        out = out.join(lookup.select(*on, F.col(value).alias(f"__{name}")), on, "left")
        found.append(F.col(f"__{name}"))
        test = F.col(f"__{name}").isNotNull()
        label = F.when(test, name) if label is None else label.when(test, name)
    out = out.withColumn(value, F.coalesce(*found)).withColumn("route", label.otherwise("none"))
    return out.drop(*[f"__{name}" for name, _, _ in routes])


def within_miles(points: DataFrame, others: DataFrame, radius: float, lat: str = "lat", lon: str = "lon", size: float = 1.0, shown: Column | None = None) -> DataFrame:
    """All pairs within ``radius`` miles: cells of ``size`` degrees meet their neighbours, then exact distance.

    ``others`` has columns o_id, o_lat, o_lon. Places are compared once, however many rows lie at
    them, and ``shown``, what is to be told of their ``miles``, is worked out once for them too.
    """
    pairs = near_places(points, others, radius, lat, lon, size).drop("held").withColumn("miles", F.col("miles") if shown is None else shown)
    # few bytes of places make very many rows, so their number of tasks does not follow their bytes
    tasks = 4 * points.sparkSession.sparkContext.defaultParallelism
    met = pairs.join(others, ["o_lat", "o_lon"]).repartition(tasks, lat, lon).join(points, [lat, lon])
    return met.select(*points.columns, *others.columns, "miles")


def count_within(points: DataFrame, others: DataFrame, radii: tuple[int, ...], lat: str = "lat", lon: str = "lon", size: float = 1.0) -> DataFrame:
    """(o_id, n25, ...): how many points lie within each of ``radii`` miles; no row of its own for a pair of rows."""
    # the rows at a place travel with it, so pairs are added up in the tasks that find them
    pairs = near_places(points, others, float(max(radii)), lat, lon, size)
    counts = pairs.groupBy("o_lat", "o_lon").agg(*[F.sum(F.when(F.col("miles") <= r, F.col("held")).otherwise(0)).alias(f"n{r}") for r in radii])
    return others.join(counts, ["o_lat", "o_lon"]).groupBy("o_id").agg(*[F.sum(f"n{r}").alias(f"n{r}") for r in radii])


def near_places(points: DataFrame, others: DataFrame, radius: float, lat: str, lon: str, size: float) -> DataFrame:
    """(lat, lon, held, o_lat, o_lon, miles): the distinct places within ``radius`` miles of each other; ``held`` points lie at the first.

    Cells near the poles reach as far as longitudes do there.
    """
    points, others = points.groupBy(lat, lon).agg(F.count("*").alias("held")), others.select("o_lat", "o_lon").distinct()
    reach = F.ceil(F.lit(radius / 69.0 / size)).cast("int")
    wide = F.ceil(F.lit(radius / 69.0 / size) / F.greatest(F.cos(F.radians(F.abs(F.col("o_lat")) + radius / 69.0)), F.lit(0.01))).cast("int")
    spread = others.withColumn("__i", F.floor(F.col("o_lat") / size)).withColumn("__j", F.floor(F.col("o_lon") / size))
    spread = spread.withColumn("__i", F.explode(F.sequence(F.col("__i") - reach, F.col("__i") + reach))).withColumn("__j", F.explode(F.sequence(F.col("__j") - wide, F.col("__j") + wide)))
    # few bytes of places make very many pairs, so their number of tasks does not follow their bytes
    tasks = 4 * points.sparkSession.sparkContext.defaultParallelism
    near = points.withColumn("__i", F.floor(F.col(lat) / size)).withColumn("__j", F.floor(F.col(lon) / size)).repartition(tasks, "__i", "__j").join(spread, ["__i", "__j"])
    near = near.withColumn("miles", geo.miles(F.col(lat), F.col(lon), F.col("o_lat"), F.col("o_lon")))
    return near.filter(F.col("miles") <= radius).drop("__i", "__j")


def interleave(df: DataFrame, group: str, order: str) -> DataFrame:
    """Round-robin over groups, the largest first; ``position`` from 1."""
    placed = numbered(df, "__at", F.asc(group), F.asc(order))
    groups = placed.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__size"), F.min("__at").alias("__first"))
    out = placed.join(groups, F.col(group).eqNullSafe(F.col("__g"))).withColumn("__turn", F.col("__at") - F.col("__first"))
    out = numbered(out, "position", F.asc("__turn"), F.desc("__size"), F.asc(group))
    return out.drop("__at", "__g", "__size", "__first", "__turn")


def runner_up(df: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """The best row per key with its lead over the next (the whole score if alone)."""
    w = Window.partitionBy(key).orderBy(F.desc(score), tie)
    out = df.withColumn("__rn", F.row_number().over(w)).withColumn("gap", F.col(score) - F.coalesce(F.lead(score).over(w), F.lit(0)))
    return out.filter("__rn = 1").drop("__rn")


def rolling_sum(df: DataFrame, key: str, stamp: str, value: str, seconds: int) -> Column:
    """Sum over the key's rows of the last ``seconds``, a row exactly that old included."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(stamp).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return F.sum(value).over(w)


def at_places(df: DataFrame, keys: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """Per key: values at places of the order of its values, from counts of equal values.

    ``places`` gives for each name a place from 0 as a column of ``n``, the number of rows of the
    key. No list of a key's values is built.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*keys).orderBy(value))
    ranked = counts.withColumn("__upto", upto).withColumn("n", F.sum("__c").over(Window.partitionBy(*keys)))
    return ranked.groupBy(*keys, "n").agg(*[F.min(F.when(F.col("__upto") > place, F.col(value))).alias(name) for name, place in places.items()])


def learned_map(df: DataFrame, key: str, value: str, least: int, share: float = 1.0) -> DataFrame:
    """key -> value where one value has ``share`` of at least ``least`` rows."""
    counts = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    total = counts.groupBy(key).agg(F.sum("n").alias("rows"), F.max_by(value, F.struct("n", F.col(value))).alias(value), F.max("n").alias("top"))
    return total.filter((F.col("rows") >= least) & (F.col("top") >= F.col("rows") * share)).select(key, value, "rows")


def capped(df: DataFrame, most: int, *order: Column) -> tuple[DataFrame, DataFrame]:
    """(the first ``most`` rows, one row with how many are shown, how many there are, and the rest)."""
    n = F.count("*")
    return df.orderBy(*order).limit(most), df.agg(F.least(n, F.lit(most)).alias("shown"), n.alias("total"), F.greatest(n - most, F.lit(0)).alias("more"))
