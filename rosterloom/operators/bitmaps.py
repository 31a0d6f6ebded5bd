"""Distinct counts of any subset from stored bitmaps.

A member is a bit of a bitmap of 32,768 members; a row of the store is the bitmap of one key and one
bucket of members. Bitmaps of a subset of keys are or-ed and their bits counted, so a total of any
viewport or set of holders is exact whoever is in several of its parts, and costs its keys and not
their rows. One store serves every subset; new rows join it by an or.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET, BITS = "bucket", "bits"


def store(df: DataFrame, keys: list[str], member: str) -> DataFrame:
    """(keys, bucket, bits): who is in each key; ``member`` is a whole number, nulls are nobody."""
    m = F.col(member).cast("bigint")
    rows = df.filter(F.col(member).isNotNull()).select(*keys, F.bitmap_bucket_number(m).alias(BUCKET), F.bitmap_bit_position(m).alias("__at"))
    return rows.groupBy(*keys, BUCKET).agg(F.bitmap_construct_agg("__at").alias(BITS))


def merged(held: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Two stores as one; it is the store of both tables' rows, whatever they share."""
    return held.unionByName(more).groupBy(*keys, BUCKET).agg(F.bitmap_or_agg(BITS).alias(BITS))


def distinct_in(held: DataFrame, subsets: DataFrame, keys: list[str], by: list[str], name: str = "members") -> DataFrame:
    """(by, name): the members of each subset, which ``subsets`` gives as rows (by, keys); a subset of unknown keys has none."""
    wanted = subsets.select(*by, *keys).distinct()
    parts = wanted.join(held, keys, "left").groupBy(*by, BUCKET).agg(F.bitmap_or_agg(BITS).alias(BITS))
    return parts.groupBy(*by).agg(F.coalesce(F.sum(F.bitmap_count(BITS)), F.lit(0)).alias(name))


def members(held: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, member): the rows that a store of positive members stands for, for those who must see them."""
    bytes_ = F.sequence(F.lit(0), F.lit(4095))
    byte = lambda i: F.conv(F.hex(F.substring(BITS, i + 1, F.lit(1))), 16, 10).cast("int")
    places = F.flatten(F.transform(bytes_, lambda i: F.filter(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: F.when(F.getbit(byte(i), b) == 1, i * 8 + b)), lambda p: p.isNotNull())))
    return held.select(*keys, BUCKET, F.explode(places).alias("__p")).select(*keys, ((F.col(BUCKET) - 1) * 32768 + F.col("__p") + 1).alias("member"))
