"""Operators on inputs whose columns have the names that they use inside."""

import pytest
from pyspark.sql import functions as F

from rosterloom.llm import line_dedup, shuffle_shards, simhash, suffix_dedup

INNER = "block upto n node __block __rank __order __part __h __host __keys __stay __t __tid __tid_of __copies_of __gone_of __carried __u0 __u1 label component a b m".split()


def frame(spark):
    rows = [(i, f"line one\nline {i % 3}\ncommon", "h") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.select("*", *[(F.col("doc_id") * 100 + k).alias(c) for k, c in enumerate(INNER)])


def check(out, added, changed=()):
    rows = {r["doc_id"]: r for r in out.collect()}
    assert len(rows) == 12 and len(set(out.columns)) == len(out.columns) and set(added) <= set(out.columns)
    for i, r in rows.items():
        assert all(r[c] == i * 100 + k for k, c in enumerate(INNER) if c not in changed)


def test_shards(spark):
    check(shuffle_shards.shard(frame(spark), ["doc_id", "block", "upto"], 3), ["shard", "slot"])


def test_lines(spark):
    out = line_dedup.drop_lines(frame(spark), F.col("source"), ratio=0.5)
    check(out, ["n_lines", "n_dropped", "text", "source"])
    assert {r.n_dropped for r in out.collect()} == {2}
    check(line_dedup.drop_lines(frame(spark), F.col("__keys")), ["n_lines"])


@pytest.mark.parametrize("keep", [True, False])
def test_suffixes(spark, keep):
    out = suffix_dedup.drop_repeated(frame(spark), keep_text=keep)
    check(out, ["n_bytes", "n_removed", "n_spans", "kept"])
    assert ("text" in out.columns) == keep


def test_components_under_any_key(spark):
    for key in ("node", "__t", "m", "label"):
        df = frame(spark).select(F.col("doc_id").alias(key), "text")
        assert {(r[key], r.component_id) for r in simhash.near_duplicates(df, key=key).collect()} == {(i, i % 3) for i in range(12)}
