"""The keyed table: bytes follow the batch, writers do not overwrite each other, replays change nothing."""

import os

import pytest
from pyspark.sql import functions as F

from rosterloom.streaming import keyed_store as store


def size(path):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def rows(spark, at, version=None):
    return {r.k: (r.v, r.at, r.etag) for r in store.read(spark, at, version).collect()}


def test_bytes_follow_the_batch(spark, tmp_path):
    at = str(tmp_path)
    many = spark.range(40_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit(1).alias("at"))
    store.put(many, at, ["k"], "at", keep=5)
    whole = size(f"{at}/data")
    few = spark.createDataFrame([(7, "new", 2), (50_000, "more", 2)], "k long, v string, at int")
    store.put(few, at, ["k"], "at", keep=5)
    assert size(f"{at}/data") - whole <= 0.06 * whole  # two of 64 buckets
    assert store.read(spark, at).count() == 40_001 and store.read(spark, at, 1).count() == 40_000
    assert {r.k: r.v for r in store.read(spark, at).filter("k in (7, 8, 50000)").collect()}[7] == "new"


def test_latest_row_of_a_key_and_nulls(spark, tmp_path):
    at = str(tmp_path)
    store.put(spark.createDataFrame([(1, "a", 1), (1, "b", 3), (None, "n", 1)], "k long, v string, at int"), at, ["k"], "at")
    store.put(spark.createDataFrame([(1, "late", 2), (None, "m", 2), (2, None, 1)], "k long, v string, at int"), at, ["k"], "at")
    assert rows(spark, at) == {1: ("b", 3, 1), None: ("m", 2, 2), 2: (None, 1, 2)}


def test_merge_and_replace(spark, tmp_path):
    at = str(tmp_path)
    store.put(spark.createDataFrame([(1, "a", 1)], "k long, v string, at int"), at, ["k"])
    store.put(spark.createDataFrame([(1, None, 2)], "k long, v string, at int"), at, ["k"], merge=True)
    assert rows(spark, at) == {1: ("a", 2, 2)}
    store.put(spark.createDataFrame([(1, None, 3)], "k long, v string, at int"), at, ["k"])
    assert rows(spark, at) == {1: (None, 3, 3)}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    at = str(tmp_path)
    write = store.sink(at, ["k"], "at")
    write(spark.createDataFrame([(1, "a", 1)], "k long, v string, at int"), 0)
    write(spark.createDataFrame([(1, "b", 2)], "k long, v string, at int"), 1)
    before = rows(spark, at)
    write(spark.createDataFrame([(1, "b", 2)], "k long, v string, at int"), 1)
    write(spark.createDataFrame([(1, "x", 9)], "k long, v string, at int"), 0)
    assert rows(spark, at) == before and store.versions(spark, at) == [1, 2]


def test_two_writers(spark, tmp_path, monkeypatch):
    at = str(tmp_path)
    row = lambda v: spark.createDataFrame([(1, v, 1)], "k long, v string, at int")
    store.put(row("a"), at, ["k"])
    with pytest.raises(store.Conflict):
        store.put(row("b"), at, ["k"], expect=0)
    commit = store._commit

    def slow(session, path, new):  # another writer commits between this one's read and its commit
        monkeypatch.setattr(store, "_commit", commit)
        store.put(row("other"), at, ["k"])
        commit(session, path, new)

    monkeypatch.setattr(store, "_commit", slow)
    with pytest.raises(store.Conflict):
        store.put(row("mine"), at, ["k"])
    assert rows(spark, at) == {1: ("other", 1, 2)}


def test_guarded_rows(spark, tmp_path):
    at = str(tmp_path)
    schema = "k long, v string, at int, seen long"
    refused = store.put(spark.createDataFrame([(1, "a", 1, None), (2, "b", 1, None)], schema), at, ["k"], guard="seen")
    assert refused.collect() == []
    refused = store.put(spark.createDataFrame([(1, "c", 1, 1), (2, "d", 1, 0), (2, "x", 1, None), (3, "e", 1, 4)][:2] + [(3, "e", 1, 4)], schema), at, ["k"], guard="seen")
    assert {tuple(r) for r in refused.collect()} == {(2, "d", 1, 0), (3, "e", 1, 4)}
    assert rows(spark, at) == {1: ("c", 1, 2), 2: ("b", 1, 1)}


def test_old_versions_go(spark, tmp_path):
    at = str(tmp_path)
    for n in range(5):
        store.put(spark.createDataFrame([(n % 2, "a" * n, n)], "k long, v string, at int"), at, ["k"], "at", buckets=2)
    assert store.versions(spark, at) == [4, 5]
    assert len({f for v in (4, 5) for f in store.manifest(spark, at, v).folders.values()}) == sum(len([x for x in os.listdir(f"{at}/data/{d}") if x.startswith("__bucket")]) for d in os.listdir(f"{at}/data"))
