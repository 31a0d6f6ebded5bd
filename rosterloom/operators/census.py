"""A census of records whose fields nobody has listed: every path of nested data, how often it is filled, and with what.

Records are variants. A level of objects and arrays is opened at a time, all records together, until
no level is left, so the number of steps is the deepest nesting and not the number of fields.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import cut

#: Values of a field that are listed, and the characters of each that are kept.
VOCABULARY, SHOWN = 60, 40


def leaves(df: DataFrame, record: Column) -> DataFrame:
    """(path, kind, value): the scalars of all records; ``a.b`` is a field of a field, ``a[]`` the members of an array.

    Kinds are ``string``, ``number``, ``boolean`` and ``null``; values are text. A record that is no
    JSON has none.
    """
    spark = df.sparkSession
    level = df.select(F.lit("").alias("path"), F.try_parse_json(record).alias("value")).filter("value is not null")
    found = []
    while True:
        level = cut(level.withColumn("shape", F.schema_of_variant("value")))
        nested = F.startswith("shape", F.lit("OBJECT")) | F.startswith("shape", F.lit("ARRAY"))
        kind = F.when(F.col("shape") == "STRING", "string").when(F.col("shape") == "BOOLEAN", "boolean").when(F.col("shape") == "VOID", "null").otherwise("number")
        found.append(level.filter(~nested).select("path", kind.alias("kind"), F.col("value").cast("string").alias("value")))
        inner = level.filter(nested).select(F.col("path").alias("above"), F.col("value").alias("outer"), F.startswith("shape", F.lit("ARRAY")).alias("listed"))
        if inner.isEmpty():
            return reduce(DataFrame.unionByName, found)
        opened = inner.lateralJoin(spark.tvf.variant_explode(F.col("outer").outer()))
        joined = F.when(F.col("listed"), F.concat("above", F.lit("[]"))).when(F.col("above") == "", F.col("key")).otherwise(F.concat("above", F.lit("."), "key"))
        level = opened.select(joined.alias("path"), "value")


def census(df: DataFrame, record: Column, vocabulary: int = VOCABULARY) -> DataFrame:
    """(path, kinds, filled, distinct, beyond, values): one row for each path.

    Nulls and empty texts do not fill a field, and a boolean only if it is true. ``values`` lists the
    commonest values with their counts (of equally common ones the first in the alphabet); ``beyond``
    is how many distinct values are not listed, 0 where the vocabulary is complete.
    """
    rows = leaves(df, record)
    there = (F.col("kind") != "null") & (F.col("value") != "")
    counts = rows.groupBy("path", "kind", F.substring("value", 1, SHOWN).alias("value"), there.alias("there")).agg(F.count("*").alias("n"))
    filled = F.when(F.col("there") & ((F.col("kind") != "boolean") | (F.col("value") == "true")), F.col("n")).otherwise(0)
    fields = counts.groupBy("path").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.sum(filled).alias("filled"))
    values = counts.filter("there").groupBy("path", "value").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("n"), "value"))
    # the cap bounds what a row holds; all values are counted
    listed = values.withColumn("at", place).groupBy("path").agg(
        F.count("*").alias("distinct"), F.array_sort(F.collect_list(F.when(F.col("at") <= vocabulary, F.struct("at", "value", "n")))).alias("values"))
    out = fields.join(listed, "path", "left")
    some = F.coalesce("distinct", F.lit(0))
    return out.select("path", "kinds", "filled", some.alias("distinct"), F.greatest(some - vocabulary, F.lit(0)).alias("beyond"), F.transform(F.coalesce("values", F.array().cast("array<struct<at:int,value:string,n:bigint>>")), lambda v: F.struct(v["value"].alias("value"), v["n"].alias("n"))).alias("values"))
