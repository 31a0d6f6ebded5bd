"""Weighted clusters of places with many restarts, all of them in each pass.

Longitudes are shortened by the cosine of the weighted mean latitude, so that the plane is true to
distance. Every restart draws its seeds by weight and squared distance (a draw is the least of one
exponential variate a row, so it needs no total and no order of rows), then all centres of all
restarts move together: a task sums weight and place for each centre of each restart, Spark adds
these sums up, and the driver holds the centres alone (restarts x k x 2 numbers). A restart that
no longer moves leaves the passes. The restart with the least inertia is kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import cut

ROUNDS = 120
#: Rows whose distances to all centres of all restarts are held at once.
BLOCK = 4096


@dataclass
class Clusters:
    """``centres`` (k x 2) in the plane, the inertia of the kept restart, and of all."""

    centres: np.ndarray
    inertia: float
    every: list[float]
    shrink: float


def _uniform(digest: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit digests and a salt (the finaliser of splitmix64)."""
    z = digest + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def _blocks(batches, shrink: float):
    for batch in batches:
        y, x, w, d = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("lat", "lon", "weight", "digest"))
        plane = np.stack([x * shrink, y], axis=1)
        for a in range(0, len(w), BLOCK):
            yield plane[a : a + BLOCK], w[a : a + BLOCK], d[a : a + BLOCK].view(np.uint64)


def _squares(plane: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rows x (any shape of centres)."""
    gap = plane.reshape(len(plane), *[1] * (centres.ndim - 1), 2) - centres[None]
    return (gap * gap).sum(axis=-1)


def _seeds(points: DataFrame, k: int, restarts: int, seed: int, shrink: float) -> np.ndarray:
    """restarts x k' x 2: seeds by weight and squared distance; fewer than k where there are fewer places."""
    chosen = np.zeros((restarts, 0, 2))
    for step in range(k):

        def run(batches, chosen=chosen, step=step):
            best = [(math.inf, 0.0, 0.0)] * restarts
            for plane, w, digest in _blocks(batches, shrink):
                far = _squares(plane, chosen).min(axis=2) if chosen.shape[1] else np.ones((len(plane), restarts))
                for r in range(restarts):
                    heavy = far[:, r] * w
                    wait = np.where(heavy > 0, -np.log(_uniform(digest, (seed * restarts + r) * k + step)) / np.where(heavy > 0, heavy, 1), np.inf)
                    at = int(wait.argmin())
                    best[r] = min(best[r], (float(wait[at]), float(plane[at, 0]), float(plane[at, 1])))
            rows = [(r, *b) for r, b in enumerate(best) if b[0] < math.inf]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, (pa.int32(), *[pa.float64()] * 3))], names=["r", "wait", "x", "y"])

        drawn = points.mapInArrow(run, "r int, wait double, x double, y double").groupBy("r").agg(F.min(F.struct("wait", "x", "y")).alias("b")).collect()
        if len(drawn) < restarts:  # every place is a seed already
            break
        chosen = np.concatenate([chosen, np.array([[r["b"]["x"], r["b"]["y"]] for r in sorted(drawn, key=lambda r: r["r"])]).reshape(restarts, 1, 2)], axis=1)
    return chosen


def _moved(points: DataFrame, centres: np.ndarray, shrink: float) -> tuple[np.ndarray, np.ndarray]:
    """(sums of weight, x and y by restart and centre, inertia by restart) of the nearest centres."""
    restarts, k, _ = centres.shape

    def run(batches):
        sums, away = np.zeros((restarts, k, 3)), np.zeros(restarts)
        for plane, w, _ in _blocks(batches, shrink):
            squares = _squares(plane, centres)
            near = squares.argmin(axis=2)
            away += (np.take_along_axis(squares, near[:, :, None], 2)[:, :, 0] * w[:, None]).sum(axis=0)
            for r in range(restarts):
                for i, v in enumerate((w, w * plane[:, 0], w * plane[:, 1])):
                    sums[r, :, i] += np.bincount(near[:, r], v, k)
        flat = np.concatenate([sums.reshape(restarts, -1), away[:, None]], axis=1)
        rows = np.argwhere(np.ones_like(flat))
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0].astype(np.int32)), pa.array(rows[:, 1].astype(np.int32)), pa.array(flat.ravel())], names=["r", "at", "v"])

    flat = np.zeros((restarts, 3 * k + 1))
    for row in points.mapInArrow(run, "r int, at int, v double").groupBy("r", "at").agg(F.sum("v").alias("v")).collect():
        flat[row["r"], row["at"]] = row["v"]
    return flat[:, :-1].reshape(restarts, k, 3), flat[:, -1]


def fit(df: DataFrame, lat: str, lon: str, weight: str, k: int = 7, restarts: int = 40, seed: int = 7, rounds: int = ROUNDS) -> Clusters:
    """Centres of the best of ``restarts``; rows without a place or a positive weight take no part."""
    points = df.select(F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"), F.col(weight).cast("double").alias("weight"))
    # rows at one place always move together: one row for each place, kept for all passes
    points = points.filter("lat is not null and lon is not null and weight > 0").groupBy("lat", "lon").agg(F.sum("weight").alias("weight"))
    points = cut(points.withColumn("digest", F.xxhash64("lat", "lon")).repartition(df.sparkSession.sparkContext.defaultParallelism, "lat", "lon"))
    middle = points.agg((F.sum(F.col("lat") * F.col("weight")) / F.sum("weight")).alias("m")).first()["m"]
    if middle is None:
        return Clusters(np.zeros((0, 2)), 0.0, [], 1.0)
    shrink = math.cos(math.radians(middle))
    centres = _seeds(points, k, restarts, seed, shrink)
    inertia = np.full(restarts, math.inf)
    going = np.arange(restarts)
    for _ in range(rounds):
        sums, inertia[going] = _moved(points, centres[going], shrink)
        heavy = sums[:, :, :1]
        after = np.where(heavy > 0, sums[:, :, 1:] / np.where(heavy > 0, heavy, 1), centres[going])
        still = np.isclose(after, centres[going]).all(axis=(1, 2))
        centres[going] = np.where(still[:, None, None], centres[going], after)
        going = going[~still]
        if not len(going):
            break
    best = int(inertia.argmin())
    return Clusters(centres[best], float(inertia[best]), inertia.tolist(), shrink)


def assigned(df: DataFrame, found: Clusters, lat: str, lon: str, name: str = "territory") -> DataFrame:
    """``df`` with the number of the nearest centre (int; the first of equally near ones), null without a place."""
    if not len(found.centres):
        return df.withColumn(name, F.lit(None).cast("int"))
    squares = [F.pow(F.col(lon) * found.shrink - float(x), F.lit(2.0)) + F.pow(F.col(lat) - float(y), F.lit(2.0)) for x, y in found.centres]
    nearest = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(squares)]))["i"]
    return df.withColumn(name, F.when(F.col(lat).isNotNull() & F.col(lon).isNotNull(), nearest))
