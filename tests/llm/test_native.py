"""Sharding and line dedup, held to their laws and to brute force."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rosterloom.llm import line_dedup, shuffle_shards
from rosterloom.llm import queries as q


@pytest.mark.parametrize("rows,blocks,per_block", [(5000, 64, 10**6), (3000, 150, 200), (7, 64, 10**6), (0, 64, 10**6)])
def test_shards_are_exact_and_gapless(spark, rows, blocks, per_block):
    df = spark.range(rows).withColumn("shard", F.lit("old"))
    got = shuffle_shards.shard(df, ["id"], 7, rows_per_block=per_block, blocks=blocks).collect()
    assert Counter(r.shard for r in got) == Counter(k for k in range(7) for _ in range(rows // 7 + (k < rows % 7)))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {r.id for r in got} == set(range(rows))


def test_result_depends_on_rows_and_seed_only(spark):
    df = spark.range(500)
    one = lambda d, s: {r.id: (r.shard, r.slot) for r in shuffle_shards.shard(d, ["id"], 5, seed=s).collect()}
    assert one(df.repartition(3), 1) == one(df.repartition(7), 1) != one(df, 2)


def test_nulls_and_repeated_rows_are_placed(spark):
    df = spark.createDataFrame([(None, "x")] * 5 + [(1, "y")] * 6 + [(2, None)], "k int, t string")
    got = shuffle_shards.shard(df, ["k", "t"], 3).collect()
    assert Counter(r.shard for r in got) == Counter({0: 4, 1: 4, 2: 4})


def test_matrix_has_the_margins_and_the_moments_of_a_uniform_shuffle(spark):
    counts = spark.createDataFrame([(k, 10 + k % 7) for k in range(200)], "block long, n long")
    cells = []
    for seed in range(3):
        rows = shuffle_shards.communication_matrix(counts, 4, seed * 10, 200).collect()
        parts = {r.block: [b - a for a, b in zip([0, *r.upto], r.upto)] for r in rows}
        assert all(sum(parts[k]) == 10 + k % 7 for k in range(200))
        total = sum(10 + k % 7 for k in range(200))
        assert [sum(p[s] for p in parts.values()) for s in range(4)] == [total // 4 + (s < total % 4) for s in range(4)]
        cells += [(p[s], 10 + k % 7) for k, p in parts.items() for s in range(4)]
    excess = sum((c - n / 4) ** 2 / (n * 3 / 16) for c, n in cells) / len(cells)
    assert 0.85 < excess < 1.15  # the variance of a hypergeometric draw, nearly binomial here


@pytest.mark.parametrize("blocks,n", [(4200, 3), (70, 3_000_000)])
def test_matrix_of_a_deep_tree_and_of_large_counts(spark, blocks, n):
    shards, total = 3, blocks * n
    rows = shuffle_shards.communication_matrix(spark.range(blocks).select(F.col("id").alias("block"), F.lit(n).cast("long").alias("n")), shards, 5, blocks).collect()
    parts = {r.block: [b - a for a, b in zip([0, *r.upto], r.upto)] for r in rows}
    assert set(parts) == set(range(blocks)) and all(sum(p) == n and min(p) >= 0 for p in parts.values())
    assert [sum(p[s] for p in parts.values()) for s in range(shards)] == [total // shards + (s < total % shards) for s in range(shards)]
    excess = sum((p[s] - n / shards) ** 2 for p in parts.values() for s in range(shards)) / (blocks * shards * n * (1 / shards) * (1 - 1 / shards))
    assert 0.7 < excess < 1.35


@pytest.mark.parametrize("total,marked,drawn", [(20, 7, 9), (6, 5, 4), (1000, 3, 400)])
def test_draws_follow_the_distribution(spark, total, marked, drawn):
    from math import comb

    us = [(k + 0.5) / 400 for k in range(400)]
    draw = shuffle_shards._hypergeometric(f"{total}L", f"{marked}L", f"{drawn}L", "u")
    got = [r.k for r in spark.createDataFrame([(u,) for u in us], "u double").select("u", F.expr(draw).alias("k")).orderBy("u").collect()]
    mass = [comb(marked, k) * comb(total - marked, drawn - k) / comb(total, drawn) if 0 <= drawn - k <= total - marked else 0.0 for k in range(marked + 1)]
    assert got == [next(k for k in range(marked + 1) if sum(mass[: k + 1]) >= u - 1e-12) for u in us]


def brute_lines(rows, ratio):
    pages, seen = Counter(h for h, _ in rows), defaultdict(set)
    for k, (h, t) in enumerate(rows):
        for x in (t or "").split("\n"):
            if x.strip(" "):
                seen[h, x.strip(" ")].add(k)
    drop = {key for key, v in seen.items() if len(v) > 1 and len(v) > ratio * pages[key[0]]}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(" ")) not in drop) for h, t in rows]


def test_lines_against_brute_force(spark):
    rows = [(f"h{k % 3}" if k % 17 else None, "\n".join(["menu", f"own {k}", " menu " if k % 2 else "", f"rare {k % 9}"])) for k in range(80)]
    rows += [("h0", None), ("h0", ""), ("h1", "menu"), ("lonely", "only"), ("h0", "x" * 100_000)]
    df = spark.createDataFrame([(k, *r, 9) for k, r in enumerate(rows)], "id int, host string, text string, N_LINES int")
    for ratio in (0.3, 0.05, 0.9):
        got = {r.id: r.text for r in line_dedup.drop_lines(df, F.col("host"), ratio=ratio).collect()}
        assert [got[k] for k in range(len(rows))] == brute_lines(rows, ratio)


def test_lines_by_shuffle_instead_of_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([("h", f"menu\n{k}") for k in range(20)], "host string, text string")
    want = sorted(r.text for r in line_dedup.drop_lines(df, F.col("host")).collect())
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    assert sorted(r.text for r in line_dedup.drop_lines(df, F.col("host")).collect()) == want == sorted(str(k) for k in range(20))


def test_empty_table(spark):
    df = spark.createDataFrame([], "host string, text string")
    assert line_dedup.drop_lines(df, F.col("host")).collect() == []


def test_shard_query_on_whole_and_odd_rows(spark, tmp_path):
    import zlib

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(10**6, None), (10**6, ""), (None, "é"), (None, "é")], "doc_id long, text string").withColumn("SIZE", F.lit("old")).withColumn("shard", F.lit(9))
    docs.unionByName(odd, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text").collect()
    got = q.op2_shards(spark, str(tmp_path)).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1 and {r.law for r in got} == {"rows"}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_line_query_without_a_guard_for_small_hosts(spark):
    df = spark.createDataFrame([("small", "menu\nown a"), ("small", "menu\nown b"), ("lonely", "menu\nonly")], "host string, text string")
    assert sorted(r.text for r in line_dedup.drop_lines(df, F.col("host")).collect()) == ["menu\nonly", "own a", "own b"]
