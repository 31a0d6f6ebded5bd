"""Territories: weighted clusters, capacity, and greedy choices over bounded tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kmeans

#: Rows that a greedy choice may take to the driver; states and candidate bases are far fewer.
MOST_ROWS = 5000


def clusters(df: DataFrame, lat: str, lon: str, weight: str, k: int = 7, seed: int = 7, restarts: int = 40) -> DataFrame:
    """``df`` with ``territory``, the cluster of its place; the same seed gives the same clusters."""
    return kmeans.assigned(df, kmeans.fit(df, lat, lon, weight, k, restarts, seed), lat, lon)


def weighted_centre(df: DataFrame, group: str, lat: str, lon: str, weight: str) -> DataFrame:
    total = F.sum(weight)
    return df.groupBy(group).agg((F.sum(F.col(lat) * F.col(weight)) / F.nullif(total, F.lit(0))).alias(lat), (F.sum(F.col(lon) * F.col(weight)) / F.nullif(total, F.lit(0))).alias(lon), total.alias(weight))


def _bounded(df: DataFrame, *columns: str) -> list:
    rows = df.select(*columns).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a greedy choice takes at most {MOST_ROWS} rows")
    return rows


def miles(a: tuple[float, float], b: tuple[float, float]) -> float:
    y1, x1, y2, x2 = np.radians([*a, *b])
    h = np.sin((y2 - y1) / 2) ** 2 + np.cos(y1) * np.cos(y2) * np.sin((x2 - x1) / 2) ** 2
    return float(2 * 3958.8 * np.arcsin(min(1.0, np.sqrt(h))))


def spread_out(df: DataFrame, key: str, lat: str, lon: str, weight: str, apart: float, most: int) -> list:
    """Heaviest first, skipping any within ``apart`` miles of one already taken."""
    chosen: list = []
    for r in sorted(_bounded(df, key, lat, lon, weight), key=lambda r: (-r[weight], r[key])):
        if len(chosen) < most and all(miles((r[lat], r[lon]), (c[lat], c[lon])) >= apart for c in chosen):
            chosen.append(r)
    return [c[key] for c in chosen]


def balanced(states: DataFrame, bases: dict[int, tuple[float, float]], key: str, lat: str, lon: str, weight: str, slack: float = 1.06) -> dict:
    """Each state to its nearest base with room; the heaviest states choose first."""
    rows = sorted(_bounded(states, key, lat, lon, weight), key=lambda r: (-r[weight], r[key]))
    room = {b: slack * sum(r[weight] for r in rows) / len(bases) for b in bases}
    out = {}
    for r in rows:
        near = sorted(bases, key=lambda b: (miles((r[lat], r[lon]), bases[b]), b))
        pick = next((b for b in near if room[b] >= r[weight]), max(near, key=lambda b: room[b]))
        room[pick] -= r[weight]
        out[r[key]] = pick
    return out


def detached(states: set[str], borders: set[tuple[str, str]]) -> list[set[str]]:
    """Connected parts of a set of states under shared borders, the largest first."""
    left, parts = set(states), []
    while left:
        part, edge = set(), {min(left)}
        while edge:
            part |= edge
            edge = {b for a, b in [*borders, *[(y, x) for x, y in borders]] if a in edge and b in states} - part
        parts.append(part)
        left -= part
    return sorted(parts, key=lambda p: (-len(p), min(p)))


def dimension_faults(owners: DataFrame, states: DataFrame, state: str, owner: str) -> DataFrame:
    """(state, fault): states without an owner, with several, or unknown."""
    n = owners.groupBy(state).agg(F.count_distinct(owner).alias("n"))
    both = states.select(state, F.lit(True).alias("known")).join(n, state, "full")
    fault = F.when(F.col("known").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "shared")
    return both.select(state, fault.alias("fault")).filter("fault is not null")


def geocode_tier(*tiers: tuple[str, Column, Column]) -> dict[str, Column]:
    """lat, lon and precision from the best tier that has a place; (name, lat, lon) from best to worst."""
    name = None
    for label, lat, lon in tiers:
        test = lat.isNotNull() & lon.isNotNull()
        name = F.when(test, label) if name is None else name.when(test, label)
    pick = lambda k: F.coalesce(*[F.when(t[1].isNotNull() & t[2].isNotNull(), t[k]) for t in tiers])
    return {"lat": pick(1), "lon": pick(2), "precision": name.otherwise("none")}


def neighbour_numbers(addresses: DataFrame, reference: DataFrame, reach: int = 6) -> DataFrame:
    """Addresses placed by the nearest house number of the same street and postal code.

    Offsets go out by ``reach``, the number itself first and the same side of the street (an even
    offset) before the other. ``addresses`` has (id, number, street, postal), ``reference`` has
    (number, street, postal, lat, lon).
    """
    offsets = [0] + [s * d for d in range(2, reach + 1, 2) for s in (1, -1)] + [s * d for d in range(1, reach + 1, 2) for s in (1, -1)]
    tries = addresses.select("id", "street", "postal", F.posexplode(F.array(*[F.lit(o) for o in offsets])).alias("rank", "off"), "number")
    tries = tries.withColumn("number", F.col("number") + F.col("off"))
    hits = tries.join(reference, ["number", "street", "postal"])
    return hits.groupBy("id").agg(F.min_by(F.struct("lat", "lon", "off"), "rank").alias("x")).select("id", "x.lat", "x.lon", F.when(F.col("x.off") == 0, "exact").otherwise("neighbour").alias("precision"))
