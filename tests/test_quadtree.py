"""The quadtree against every place one by one, on places as uneven as cities."""

import math

import numpy as np
from pyspark.sql import functions as F

from rosterloom.functions import geo
from rosterloom.operators import quadtree


def places(n, seed=1):
    rng = np.random.default_rng(seed)
    at = np.concatenate([rng.normal([40.7, -74], 0.01, (n // 2, 2)), rng.normal([34, -118], 0.3, (n // 4, 2)), rng.uniform([-89, -180], [89, 180], (n // 8, 2)), rng.uniform([-20, 178], [20, 182], (n - n // 2 - n // 4 - n // 8, 2))])
    at[:, 1] = (at[:, 1] + 180) % 360 - 180
    at[5] = at[4]
    return [(i, float(a), float(b)) for i, (a, b) in enumerate(at)]


def tree_of(spark, rows, most=40):
    return quadtree.build(spark.createDataFrame(rows, "id long, lat double, lon double").repartition(4), "lat", "lon", most)


def miles(a, b):
    y1, x1, y2, x2 = map(math.radians, (*a, *b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * geo.EARTH_MILES * math.asin(min(1.0, math.sqrt(h)))


def test_leaves_are_bounded_and_hold_all(spark):
    rows = places(2000)
    tree = tree_of(spark, rows + [(9999, None, 1.0)])
    sizes = {(r.level, r.cell): r["count"] for r in tree.groupBy("level", "cell").count().collect()}
    assert sum(sizes.values()) == 2000 and max(sizes.values()) <= 40
    alike = tree_of(spark, [(i, 1.0, 1.0) for i in range(100)])
    assert alike.count() == 100 and alike.select("level").distinct().count() == 1
    assert tree_of(spark, []).count() == 0


def test_nearest_against_all(spark):
    rows = places(1500)
    ask = [(i, *rows[i * 37][1:]) for i in range(30)] + [(100, 0.0, 179.99), (101, 89.0, 0.0), (102, -89.9, 10.0), (103, 40.7, -74.0), (104, 10.0, -30.0), (105, None, 1.0)]
    queries = spark.createDataFrame(ask, "q int, q_lat double, q_lon double")
    tree = tree_of(spark, rows)
    for k in (1, 12):
        got: dict = {}
        for r in quadtree.nearest(queries, tree, "id", "lat", "lon", k).collect():
            got.setdefault(r.q, {})[r.place] = r.id
        for q, y, x in ask:
            if y is None:
                assert q not in got
                continue
            want = [i for _, i in sorted((round(miles((y, x), (a, b)), 6), i) for i, a, b in rows)[:k]]
            assert [got[q][p] for p in range(1, k + 1)] == want, q
    few = quadtree.nearest(queries, tree_of(spark, rows[:3]), "id", "lat", "lon", 5)
    assert {r.q: r["count"] for r in few.groupBy("q").count().collect()} == {q: 3 for q, y, _ in ask if y is not None}


def test_two_hundred_polygons_against_all(spark):
    rng = np.random.default_rng(4)
    rows = places(1200)
    rings = []
    for pid in range(200):
        middle = rows[int(rng.integers(0, 1200))][1:] if pid % 3 else rng.uniform([-60, -170], [60, 170])
        turns = np.sort(rng.uniform(0, 2 * math.pi, int(rng.integers(3, 9))))
        far = rng.uniform(0.002, 6.0, len(turns)) * (0.05 if pid % 2 else 1.0)
        rings.append((pid, [float(middle[0] + f * math.sin(t)) for f, t in zip(far, turns)], [float(middle[1] + f * math.cos(t)) for f, t in zip(far, turns)]))
    rings.append((200, [40.0, 40.0, 41.0, 41.0], [-75.0, -73.0, -73.0, -75.0]))
    rings.append((201, [1.0, 2.0], [1.0, 2.0]))
    points = spark.createDataFrame(rows, "id long, lat double, lon double")
    got = sorted(tuple(r) for r in quadtree.in_polygons(points, spark.createDataFrame(rings, "pid int, lats array<double>, lons array<double>"), "id", "lat", "lon").collect())

    def inside(y, x, ys, xs):
        odd = False
        for a, b, c, d in zip(ys, xs, ys[1:] + ys[:1], xs[1:] + xs[:1]):
            if (a > y) != (c > y) and x < (d - b) * (y - a) / (c - a) + b:
                odd = not odd
        return odd and len(ys) > 2

    assert got == sorted((pid, i) for pid, ys, xs in rings for i, y, x in rows if inside(y, x, ys, xs))
    one = points.filter(geo.in_polygon(F.col("lat"), F.col("lon"), list(zip(*rings[200][1:])))).count()
    assert one == sum(pid == 200 for pid, _ in got) > 100
