"""Clusters with restarts against a plain run on one machine."""

import math

import numpy as np

from rosterloom.operators import kmeans, territory


def plain(xy, w, k, restarts, seed):
    """The least inertia of as many restarts with weighted seeds, one after another."""
    rng = np.random.default_rng(seed)
    best = math.inf
    for _ in range(restarts):
        centres = xy[[rng.choice(len(xy), p=w / w.sum())]]
        while len(centres) < k:
            p = ((xy[:, None] - centres) ** 2).sum(-1).min(1) * w
            centres = np.vstack([centres, xy[rng.choice(len(xy), p=p / p.sum())]])
        for _ in range(120):
            near = ((xy[:, None] - centres) ** 2).sum(-1).argmin(1)
            after = np.array([np.average(xy[near == c], axis=0, weights=w[near == c]) if (near == c).any() else centres[c] for c in range(k)])
            if np.allclose(after, centres):
                break
            centres = after
        best = min(best, float((((xy[:, None] - centres) ** 2).sum(-1).min(1) * w).sum()))
    return best


def places(n, seed):
    rng = np.random.default_rng(seed)
    middles = rng.uniform([25, -120], [48, -70], (9, 2))
    at = middles[rng.integers(0, 9, n)] + rng.normal(0, 1.5, (n, 2))
    return at, rng.uniform(1, 50, n)


def test_no_worse_than_a_plain_run(spark):
    for seed in (1, 2):
        at, w = places(600, seed)
        df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(at, w)], "lat double, lon double, w double").repartition(4)
        found = kmeans.fit(df, "lat", "lon", "w", k=7, restarts=40)
        shrink = math.cos(math.radians(np.average(at[:, 0], weights=w)))
        xy = np.stack([at[:, 1] * shrink, at[:, 0]], axis=1)
        assert found.shrink == shrink or math.isclose(found.shrink, shrink)
        real = float((((xy[:, None] - found.centres) ** 2).sum(-1).min(1) * w).sum())
        assert math.isclose(found.inertia, real, rel_tol=1e-6) and found.inertia == min(found.every)
        assert found.inertia <= plain(xy, w, 7, 40, 7) * (1 + 1e-6)
        got = kmeans.assigned(df, found, "lat", "lon").collect()
        assert all(r.territory == int(((np.array([r.lon * shrink, r.lat]) - found.centres) ** 2).sum(1).argmin()) for r in got)


def test_few_places_and_none(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (1.0, 1.0, 2.0), (9.0, 9.0, 1.0), (None, 1.0, 1.0), (5.0, 5.0, 0.0)], "lat double, lon double, w double")
    found = kmeans.fit(df, "lat", "lon", "w", k=7, restarts=5)
    assert len(found.centres) == 2 and found.inertia < 1e-12
    rows = territory.clusters(df, "lat", "lon", "w", k=7, restarts=5).collect()
    assert rows[0].territory == rows[1].territory != rows[2].territory and rows[3].territory is None
    assert territory.clusters(df.limit(0), "lat", "lon", "w").collect() == []


def test_same_seed_same_clusters(spark):
    at, w = places(200, 5)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(at, w)], "lat double, lon double, w double")
    a, b = (kmeans.fit(df.repartition(n), "lat", "lon", "w", k=3, restarts=4) for n in (1, 5))
    assert np.allclose(a.centres, b.centres)
