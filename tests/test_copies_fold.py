"""Equal rows are worked on once: each case here is some hundred million comparisons if they are not."""

import time

from pyspark.sql import functions as F

from rosterloom.operators import kmeans, matching, relational, search
from rosterloom.plans import base


def quick(df, most=60):
    began = time.time()
    rows = df.collect()
    assert time.time() - began < most
    return rows


def test_searches_of_copies(spark):
    people = spark.range(40_000).select("id", F.lit("Bill Kane").alias("name"), F.array(F.lit("bo")).alias("alternates"))
    near = spark.range(40_000).select("id", F.lit("Bill Kane UBS Atlanta").alias("text"))
    terms = spark.range(40_000).select(F.col("id").alias("q"), F.when(F.col("id") == 3, "bill kane").otherwise("bill kaiser").alias("term"))
    got = quick(search.field(terms, people, near.filter("id < 20000")).groupBy("q", "source").count())
    assert {(r.q, r.source): r["count"] for r in got} == {(3, "near"): 20_000, (3, "index"): 20_000}


def test_a_question_of_two_terms_and_a_person_of_two_names(spark):
    people = spark.createDataFrame([(1, "Ann Lee", []), (1, "Zoe Lee", []), (2, "Zoe Lee", None)], "id int, name string, alternates array<string>")
    near = spark.createDataFrame([(2, "zoe lee"), (2, "other")], "id int, text string")
    terms = spark.createDataFrame([(7, "ann lee"), (7, "zoe lee"), (8, "zoe lee")], "q int, term string")
    got = sorted(tuple(r) for r in search.field(terms, people, near).collect())
    assert got == [(7, 1, "index"), (7, 2, "near"), (8, 1, "index"), (8, 2, "near")]


def test_one_name_that_a_firm_shares(spark):
    people = spark.range(40_000).select("id", F.lit("f").alias("firm"), F.lit("Bill Kane").alias("name"))
    people = people.unionByName(spark.createDataFrame([(-1, "f", "Zoe Kane"), (-2, "f", "Zed Moe")], "id long, firm string, name string"))
    roster = spark.range(40_000).select(F.col("id").alias("member"), F.lit("f").alias("firm"), F.lit("kane").alias("last_key"), F.array(F.lit("bil")).alias("forms"))
    roster = roster.unionByName(spark.createDataFrame([(99_999, "f", "kane", ["zoe"])], "member long, firm string, last_key string, forms array<string>"))
    got = quick(matching.single_hits(people, roster, "id", "member", "firm").groupBy("status").agg(F.count("*").alias("n"), F.max("member").alias("member")))
    assert {r.status: (r.n, r.member) for r in got} == {"ambiguous": (40_000, None), "matched": (1, 99_999), "unmatched": (1, None)}


def test_one_term_that_many_ask_for(spark):
    terms = spark.range(20_000).select(F.col("id").alias("q"), F.lit(" 1 ").alias("term"))
    zips = spark.range(20_000).select((F.col("id") + 100_000).cast("string").alias("zip"), F.lit("N1").alias("state"))
    states = spark.createDataFrame([("N1", "Nowhere")], "code string, name string")
    cities = spark.createDataFrame([], "city string, state string, n long")
    got = quick(search.places(terms, states, zips, cities).groupBy("label").count())
    assert {r.label: r["count"] for r in got} == {str(100_000 + i): 20_000 for i in range(10)}


def test_places_that_many_share(spark):
    points = spark.range(20_000).select("id", F.lit(40.0).alias("lat"), F.lit(-90.0).alias("lon"))
    others = spark.range(20_000).select(F.col("id").alias("o_id"), F.lit(40.2).alias("o_lat"), F.lit(-90.0).alias("o_lon"))
    got = quick(relational.count_within(points, others, (5, 25)).groupBy("n5", "n25").count())
    assert [tuple(r) for r in got] == [(0, 20_000, 20_000)]
    # what is told of a distance is worked out before rows are paired
    some = relational.within_miles(points.limit(3), others.limit(2), 25.0, shown=F.round("miles"))
    assert [tuple(r)[6:] for r in some.collect()] == [(14.0,)] * 6


def test_clusters_keep_one_row_for_a_place(spark, monkeypatch):
    sizes, made = [], kmeans.cut
    monkeypatch.setattr(kmeans, "cut", lambda df: sizes.append(made(df)) or sizes[-1])
    df = spark.range(3_000).select((F.col("id") % 5).cast("double").alias("lat"), F.lit(1.0).alias("lon"), F.lit(2.0).alias("w"))
    found = kmeans.fit(df, "lat", "lon", "w", k=5, restarts=3)
    assert sizes[0].count() == 5 and sizes[0].agg(F.sum("weight")).first()[0] == 6_000.0 and found.inertia < 1e-12


def test_large_tables_are_dealt_into_more_tasks(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i // 2, i % 3, i % 4, 1.5, "N") for i in range(40)], "l_orderkey int, l_suppkey int, l_linenumber int, l_extendedprice double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, i % 5) for i in range(20)], "o_orderkey int, o_custkey int").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, f"s{i}", 1, 0.5) for i in range(4)], "s_suppkey int, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    read = lambda: [sorted(map(tuple, f(spark, str(tmp_path)).collect()), key=str) for f in (base.firms, base.offices)]
    before = read()
    monkeypatch.setattr(relational, "TASK_ROWS", 4)
    assert read() == before and base.offices(spark, str(tmp_path)).rdd.getNumPartitions() == 10
