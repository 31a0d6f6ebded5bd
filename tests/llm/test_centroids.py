"""Clusters by annulus search against all distances in Python's integers."""

import duckdb
import numpy as np
import pytest

from rosterloom.llm import centroids, queries


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    return sorted((tuple(r) for r in centroids.cluster(df, **more).collect()), key=str)


def expected(rows, **more):
    return sorted(centroids.brute_force(rows, **more), key=str)


def test_random_rings_and_ties(spark):
    """Small integers on few norms, so that many centroids are equally near, with odd rows."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-2, 3, 4) / 1024).tolist()) for i in range(300)] + [(7, [0.5, 0.5, 0.5, 0.5])] * 40
    rows += [(900, None), (901, []), (902, [1.0, 2.0, 3.0]), (903, [1.0, None, 2.0, 3.0]), (904, [float("nan"), 0.0, 0.0, 0.0]), (905, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.1, 0.2, 0.3, 0.4]), (906, [0.0] * 5)]
    for k in (1, 3, 8, 40):
        assert found(spark, rows, dims=4, clusters=k, rounds=4) == expected(rows, dims=4, clusters=k, rounds=4)


def test_negative_floors_and_large_numbers(spark):
    rows = [(i, [x, -x]) for i, x in enumerate([0.0001, -0.0001, 1e6, 3e5, 1e30, -1e38, 12.5, 7e-320])]
    assert found(spark, rows, dims=2, clusters=3, rounds=3) == expected(rows, dims=2, clusters=3, rounds=3)
    got = found(spark, rows, dims=2, clusters=1, rounds=3)
    assert got == expected(rows, dims=2, clusters=1, rounds=3)
    assert any(r[2] is None for r in got)


def test_fewer_vectors_than_clusters_and_none(spark):
    assert found(spark, [(1, [1.0, 2.0])], dims=2) == expected([(1, [1.0, 2.0])], dims=2)
    assert found(spark, [(1, [1.0])], dims=2) == []
    assert found(spark, [], dims=2) == []


def test_annulus_finds_the_nearest(spark):
    rng = np.random.default_rng(1)
    c = [row.tolist() for row in rng.integers(-300, 300, (50, 6))] + [[1, 2, 3, 4, 5, 6]] * 3
    v = rng.integers(-300, 300, (500, 6))
    number, best = centroids.Annulus(c).nearest(v)
    whole = ((v[:, None] - np.array(c)[None]) ** 2).sum(axis=2)
    assert (number == whole.argmin(axis=1)).all() and (best == whole.min(axis=1)).all()


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_equals_sql_and_brute_force(spark, sf):
    at = f"/root/testdata/{sf}"
    got = sorted((tuple(r) for r in queries.op12_centroids(spark, at).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{at}/embeddings.parquet'")
    rows = con.execute("select vec_id, embedding from embeddings").fetchall()
    assert got == expected(rows)
    made = con.execute(queries.OP12_SQL)
    names = [c[0] for c in made.description]
    assert got == sorted((tuple(dict(zip(names, r))[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in made.fetchall()), key=str)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "x")], "hash long, vector array<double>, cluster string")
    assert [tuple(r)[:3] for r in centroids.cluster(df, key="hash", column="vector", dims=2).collect()] == [(1, 0, 0)]
