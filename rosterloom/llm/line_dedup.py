"""Site-relative line deduplication: lines that too many pages of one host share are dropped.

For each host the pages containing a line are divided by the host's pages; lines above ``ratio`` are
boilerplate and go from every page of that host. A line that one page alone has is repeated nowhere
and stays, however few pages its host has. Lines are compared after trimming white space; blank
lines are never boilerplate. A line counts once a page however often it stands there. Only
DataFrame and SQL functions are used.

A host has at most (distinct lines of a mean page) / ``ratio`` boilerplate lines, since each takes
more than ``ratio`` of its pages; so one list of them per host stays small however large the host.
Lines are keyed by two 64-bit hashes and their length.

Defined results: every page stays, with an empty text if all its lines go; pages of a null host
form one host of their own; a null text stays null; repeated page rows are pages of their own;
an empty table gives an empty table. ``n_lines`` and ``n_dropped`` replace input columns of these
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, cut

#: Lists of boilerplate lines are broadcast up to this size and joined by a shuffle beyond it.
BROADCAST_BYTES = 8 << 20


def _key(line: Column) -> Column:
    line = F.trim(line)
    return F.when(line != "", F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"), F.length(line).alias("n")))


def boilerplate(df: DataFrame, host: Column, text: str = "text", ratio: float = 0.1) -> DataFrame:
    """(host, keys): the keys of the lines to drop, one row for each host that has any."""
    keys = F.array_compact(F.array_distinct(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), _key)))
    pages = df.select(host.alias("host"), keys.alias("keys"))
    # one null key a page counts the pages of the host in the same aggregation
    lines = pages.select("host", F.explode(F.concat(F.array(F.lit(None).cast("struct<a:bigint,b:bigint,n:int>")), "keys")).alias("key"))
    counts = lines.groupBy("host", "key").agg(F.count("*").alias("pages"))
    total = counts.filter("key is null").select(F.col("host").alias("h"), F.col("pages").alias("all_pages"))
    common = counts.filter(F.col("key").isNotNull() & (F.col("pages") > 1))
    found = common.join(total, F.col("host").eqNullSafe(F.col("h"))).filter(F.col("pages") > F.col("all_pages") * F.lit(ratio))
    return found.groupBy("host").agg(F.collect_list("key").alias("keys"))


def drop_lines(df: DataFrame, host: Column, text: str = "text", ratio: float = 0.1) -> DataFrame:
    """``df`` with boilerplate lines gone from ``text``, and ``n_lines`` and ``n_dropped`` (int)."""
    inner = lambda rows, body, site: _drop_lines(rows, F.col(site), body, ratio).drop(site)
    return carried(df, [F.col(f"`{text}`"), host], inner, {0: text})


def _drop_lines(kept: DataFrame, host: Column, text: str, ratio: float) -> DataFrame:
    found = cut(boilerplate(kept, host, text, ratio).select(F.col("host").alias("__h"), F.col("keys").alias("__keys")))
    size = found.agg(F.sum(F.size("__keys") * 40 + 64)).first()[0] or 0
    found = F.broadcast(found) if size <= BROADCAST_BYTES else found
    joined = kept.withColumn("__host", host).join(found, F.col("__host").eqNullSafe(F.col("__h")), "left")
    lines = F.split(F.col(text), "\n")
    stay = F.when(F.col("__keys").isNull(), lines).otherwise(F.filter(lines, lambda x: F.coalesce(~F.array_contains("__keys", _key(x)), F.lit(True))))
    joined = joined.withColumn("__stay", stay)
    out = joined.withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0))).withColumn("n_dropped", F.coalesce(F.size(lines) - F.size("__stay"), F.lit(0)))
    out = out.withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.col("n_lines"))).withColumn("n_dropped", F.when(F.col(text).isNull(), 0).otherwise(F.col("n_dropped")))
    return out.withColumn(text, F.array_join("__stay", "\n")).drop("__h", "__host", "__keys", "__stay")
