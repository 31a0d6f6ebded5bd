"""Checks that ride on a write: no job more, the same verdicts."""

from pyspark.sql import functions as F

from rosterloom.operators import audit


def jobs(spark, run):
    spark.sparkContext.setJobGroup(name := f"g{run.__name__}", name)
    run()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_twenty_checks_add_no_job(spark, tmp_path):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("kind"), F.when(F.col("id") % 10 == 0, None).otherwise(F.lit("x")).alias("name"))
    checks = [audit.Passing(f"kind {k} is unknown", F.col("kind") == k, most=142) for k in range(18)] + [audit.Passing("no name", F.col("name").isNull()), audit.Passing("no such column", F.col("other") > 1)]
    told = {}

    def plain():
        df.write.parquet(f"{tmp_path}/a")

    def checked():
        told["x"] = audit.write_checked(df, lambda d: d.write.parquet(f"{tmp_path}/b"), checks, {"rows": F.count("*"), "sum": F.sum("id"), "kinds": F.sort_array(F.collect_set("kind"))})

    assert jobs(spark, plain) == jobs(spark, checked)
    rows, failed, totals = told["x"]
    states = {n: (s, k) for n, s, k in rows}
    assert states["no name"] == ("failed", 100) and states["no such column"] == ("skipped", 0) and states["kind 9 is unknown"] == ("ok", 0)
    assert states["kind 0 is unknown"] == ("failed", 143) and states["kind 6 is unknown"] == ("ok", 142)
    assert failed == 1 + sum(len([i for i in range(1000) if i % 7 == k]) > 142 for k in range(7))
    assert totals == {"rows": 1000, "sum": 499500, "kinds": list(range(7))}
    assert spark.read.parquet(f"{tmp_path}/b").count() == 1000


def test_an_empty_table_and_no_checks(spark, tmp_path):
    df = spark.range(5)
    assert audit.write_checked(df.limit(0), lambda d: d.write.parquet(f"{tmp_path}/a"), [audit.Passing("bad", F.col("id") > 1)]) == ([("bad", "ok", 0)], 0, {})
    assert audit.write_checked(df, lambda d: d.write.parquet(f"{tmp_path}/b"), []) == ([], 0, {})
