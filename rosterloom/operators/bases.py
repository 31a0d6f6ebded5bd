"""Which cities hold the territories, and which territory each state belongs to.

States and candidate cities are few (``territory.MOST_ROWS`` at most) once people are summed, so a
search is a small local computation. Searches from different starts are independent: each is a task.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .territory import _bounded, miles

#: Fixed values of the design: miles of travel worth as much as the calls themselves, the widest ratio
#: of efforts, territories that may hold one detached state, and the prices of breaking these.
MILES_PER_DAY, BAND, MOST_DETACHED = 300.0, 1.35, 3
SHAPE_PRICE, BAND_PRICE = 1e6, 600.0


class Design:
    """The cost of giving states (bits of an integer) to bases: mean miles, plus prices of broken rules."""

    def __init__(self, weights, distance, borders: list[int]):
        self.weights, self.distance, self.total = list(map(float, weights)), distance.tolist(), float(sum(weights))
        self.parts = lru_cache(None)(lambda group: self._parts(group, borders))

    @staticmethod
    def _parts(group: int, borders: list[int]) -> tuple[int, int]:
        """(detached, illegal): one extra part of one state is detached, all other extra parts are illegal."""
        sizes = []
        while group:
            part = edge = group & -group
            while edge:
                low = edge & -edge
                fresh = borders[low.bit_length() - 1] & group & ~part
                part, edge = part | fresh, (edge ^ low) | fresh
            sizes.append(part.bit_count())
            group &= ~part
        if len(sizes) == 2 and min(sizes) == 1:
            return 1, 0
        return 0, max(0, len(sizes) - 1)

    def cost(self, load: list[float], travel: list[float], groups: list[int]) -> float:
        if not all(groups):
            return float("inf")
        effort = [w + t / MILES_PER_DAY for w, t in zip(load, travel)]
        shapes = [self.parts(g) for g in groups]
        broken = sum(s[1] for s in shapes) + max(0, sum(s[0] for s in shapes) - MOST_DETACHED)
        over = max(0.0, max(effort) / min(effort) - BAND) if min(effort) > 0 else float("inf")
        return sum(travel) / self.total + SHAPE_PRICE * broken + BAND_PRICE * over

    def improved(self, bases: list[int], owner: list[int], passes: int) -> tuple[float, list[int]]:
        """States moved one at a time to the base that lowers the cost most, until none does."""
        owner, k = list(owner), len(bases)
        load, travel, groups = [0.0] * k, [0.0] * k, [0] * k

        def shift(i: int, c: int, sign: int) -> None:
            load[c] += sign * self.weights[i]
            travel[c] += sign * self.weights[i] * self.distance[i][bases[c]]
            groups[c] ^= 1 << i

        for i, c in enumerate(owner):
            shift(i, c, 1)
        best = self.cost(load, travel, groups)
        for _ in range(passes):
            before = best
            for i in range(len(owner)):
                home = owner[i]
                shift(i, home, -1)
                tried = []
                for c in range(k):
                    shift(i, c, 1)
                    tried.append((self.cost(load, travel, groups), c != home, c))
                    shift(i, c, -1)
                found, _, owner[i] = min(tried)
                shift(i, owner[i], 1)
                best = found
            if best >= before - 1e-9:
                break
        return best, owner

    def nearest(self, bases: list[int]) -> list[int]:
        return [min(range(len(bases)), key=lambda c: row[bases[c]]) for row in self.distance]

    def search(self, k: int, seed: int, rounds: int = 12, tries: int = 20) -> tuple[float, list[int], list[int]]:
        """(cost, bases, owner of each state) from one random start: bases are swapped while that helps."""
        rng = np.random.default_rng(seed)
        n = len(self.distance[0])
        bases = rng.choice(n, k, replace=False).tolist()
        best, owner = self.improved(bases, self.nearest(bases), 2)
        for _ in range(rounds):
            before = best
            for slot in range(k):
                for city in set(range(n)) - set(bases):
                    other = [*bases[:slot], city, *bases[slot + 1 :]]
                    cost, told = self.improved(other, self.nearest(other), 2)
                    if cost < best - 1e-9:
                        best, owner, bases = cost, told, other
            if best >= before - 1e-9:
                break
        for start in [owner, *rng.integers(0, k, (tries, len(self.weights))).tolist()]:
            cost, told = self.improved(bases, start, 20)
            if cost < best - 1e-9:
                best, owner = cost, told
        return best, bases, owner


def choose(states: DataFrame, cities: DataFrame, borders: DataFrame, k: int = 7, starts: int = 6) -> DataFrame:
    """(state, base, cost): the cheapest of ``starts`` searches.

    ``states`` has (state, lat, lon, weight), ``cities`` (city, lat, lon), ``borders`` (a, b). Travel is
    the cost; efforts beyond the band and territories in more parts than allowed are priced. Fewer
    states or cities than ``k`` make ``k`` smaller; without any the result is empty.
    """
    spark: SparkSession = states.sparkSession
    rows = sorted(_bounded(states.filter("weight > 0"), "state", "lat", "lon", "weight"), key=lambda r: r["state"])
    places = sorted(_bounded(cities, "city", "lat", "lon"), key=lambda r: r["city"])
    k = min(k, len(rows), len(places))
    kinds = f"state {states.schema['state'].dataType.simpleString()}, base {cities.schema['city'].dataType.simpleString()}, cost double"
    if not k:
        return spark.createDataFrame([], kinds)
    at = {r["state"]: i for i, r in enumerate(rows)}
    beside = [0] * len(rows)
    for r in _bounded(borders.distinct(), "a", "b"):
        if r["a"] in at and r["b"] in at:
            beside[at[r["a"]]] |= 1 << at[r["b"]]
            beside[at[r["b"]]] |= 1 << at[r["a"]]
    weights = [float(r["weight"]) for r in rows]
    distance = np.array([[miles((r["lat"], r["lon"]), (c["lat"], c["lon"])) for c in places] for r in rows])

    def run(frames):
        for f in frames:
            for seed in f["id"]:
                cost, bases, owner = Design(weights, distance, beside).search(k, int(seed))
                yield pd.DataFrame({"seed": [seed], "cost": [cost], "owner": [[bases[c] for c in owner]]})

    found = spark.range(starts).repartition(starts, "id").mapInPandas(run, "seed long, cost double, owner array<int>")
    best = found.orderBy("cost", "seed").limit(1).collect()
    return spark.createDataFrame([(r["state"], places[c]["city"], best[0]["cost"]) for r, c in zip(rows, best[0]["owner"])], kinds)


def recentred(states: DataFrame, bases: dict, key: str, lat: str, lon: str, weight: str, slack: float = 1.06, rounds: int = 25) -> tuple[dict, dict]:
    """(base of each state, place of each base): states go to the nearest base with room, bases to their states' centre, until they rest.

    Room is an equal share times ``slack``; heavy states choose first; without room anywhere the least loaded base takes the state.
    """
    rows = sorted(_bounded(states, key, lat, lon, weight), key=lambda r: (-r[weight], r[key]))
    places, room, out = dict(bases), slack * sum(r[weight] for r in rows) / len(bases), {}
    for _ in range(rounds):
        load = dict.fromkeys(places, 0.0)
        for r in rows:
            near = sorted(places, key=lambda b: (miles((r[lat], r[lon]), places[b]), b))
            out[r[key]] = next((b for b in near if load[b] + r[weight] <= room), min(load, key=lambda b: (load[b], b)))
            load[out[r[key]]] += r[weight]
        moved = dict(places)
        for b in places:
            own = [r for r in rows if out[r[key]] == b and r[weight] > 0]
            if own:
                moved[b] = tuple(np.average([[r[lat], r[lon]] for r in own], axis=0, weights=[r[weight] for r in own]).tolist())
        if all(np.allclose(moved[b], places[b]) for b in places):
            break
        places = moved
    return out, places
