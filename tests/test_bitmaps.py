"""Totals from stored bitmaps against distinct counts over the rows."""

import random

from pyspark.sql import functions as F

from rosterloom.operators import bitmaps


def test_any_subset(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(12), rng.choice("xy"), rng.choice([rng.randrange(50), rng.randrange(10**6), 32768, 32769, None])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "cell int, firm string, person long")
    held = bitmaps.store(df, ["cell", "firm"], "person")
    views = [(v, c, f) for v in range(10) for c in range(12) for f in "xy" if (c * 7 + v * 3) % 10 < 4] + [(10, 99, "x"), (0, 0, "x")]
    got = {r.view: r.members for r in bitmaps.distinct_in(held, spark.createDataFrame(views, "view int, cell int, firm string"), ["cell", "firm"], ["view"]).collect()}
    want = {v: len({p for c, f, p in rows if p is not None and (v, c, f) in set(views)}) for v in range(11)}
    assert got == want and want[10] == 0


def test_stores_join(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id"))
    both = bitmaps.merged(bitmaps.store(df.filter("id < 3000"), ["k"], "id"), bitmaps.store(df.filter("id > 2000"), ["k"], "id"), ["k"])
    assert {r.k: r.n for r in both.groupBy("k").agg(F.sum(F.bitmap_count("bits")).alias("n")).collect()} == {r.k: r.n for r in df.filter("id <> -1").groupBy("k").agg(F.count("*").alias("n")).collect()}


def test_members_come_back(spark):
    df = spark.createDataFrame([(1, 1), (1, 32768), (1, 32769), (2, 7), (2, 7), (3, None), (4, 70000)], "k int, id long")
    got = sorted(tuple(r) for r in bitmaps.members(bitmaps.store(df, ["k"], "id"), ["k"]).collect())
    assert got == [(1, 1), (1, 32768), (1, 32769), (2, 7), (4, 70000)]
