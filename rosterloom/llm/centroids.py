"""Centroid clustering by annulus search, in exact integers.

Components become the integers floor(1024 x). Centroids are sorted by norm. A vector's distance u to
the centroid whose norm is next to its own (found by binary search) bounds its least distance from
above; by the triangle inequality only centroids with norms within u of the vector's own can be as
near. Two more binary searches give that annulus; its members are compared exactly, so that ties,
also those on the border, go to the smaller number. Norms are floating point and the annulus is
widened by more than their error, so it only ever holds too many.

A round is one pass over the table: a task keeps counts, sums and distances for each centroid, which
Spark adds up; the driver holds the centroids alone (``clusters`` x ``dims`` integers). No vector is
moved, a very common one included.

Defined results: vectors of another length, with a null or with a non-finite component have no row.
Starts with equal hashes are ordered by their components; a null id has no hash and starts only after
all others. With fewer vectors than ``clusters`` there are fewer centroids; an empty table gives an
empty result. Repeated rows are vectors of their own. Integers of any size are exact; a distance or
inertia beyond 64 bits is null. Extra columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE = 1024
#: Components below this keep squared distances of 4,096 dimensions within 64 bits.
SMALL = 1 << 24
LONG = (1 << 63) - 1
#: Bits of the digits in which sums leave a task, so that sums of any size add up as whole numbers.
DIGIT = 30


def integers(batch: pa.RecordBatch, column: str, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a batch that hold ``dims`` finite numbers, and their integers (int64, or Python's if large)."""
    lists = batch.column(column)
    right = pc.fill_null(pc.equal(pc.list_value_length(lists), dims), False).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(right)
    flat = lists.take(pa.array(rows)).flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)  # a null is a NaN here
    whole = np.isfinite(values).all(axis=1)
    rows, values = rows[whole], values[whole]
    if not values.size or np.abs(values).max() < SMALL / SCALE:
        return rows, np.floor(values * SCALE).astype(np.int64)
    exact = [[(SCALE * n) // d for n, d in (x.as_integer_ratio() for x in row)] for row in values.tolist()]
    return rows, np.array(exact, object).reshape(-1, dims)


class Annulus:
    """Centroids in the order of their norms."""

    def __init__(self, centroids: list[list[int]]):
        whole = np.array(centroids, object).reshape(len(centroids), len(centroids[0]) if centroids else 0)
        self.small = len(whole) == 0 or np.abs(whole).max() < SMALL
        whole = whole.astype(np.int64) if self.small else whole
        norms = np.sqrt((whole * whole).sum(axis=1).astype(np.float64)) if self.small else np.zeros(len(whole))
        self.order = np.lexsort((np.arange(len(norms)), norms))
        self.norms, self.centroids = norms[self.order], whole[self.order]

    def distances(self, vectors: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Exact squared distances of each vector to the centroid at its place in the order."""
        gap = vectors - self.centroids[places]
        return (gap * gap).sum(axis=1)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid (ties: the smaller) and the squared distance."""
        if not len(vectors):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not self.small or vectors.dtype == object:  # squares may have no floating point: all are in the annulus
            at = np.zeros(len(vectors), np.int64)
            return self._compared(vectors, at, at, np.full(len(vectors), len(self.order)))
        norms = np.sqrt((vectors * vectors).sum(axis=1).astype(np.float64))
        at = np.clip(np.searchsorted(self.norms, norms), 0, len(self.norms) - 1)
        below = np.maximum(at - 1, 0)
        at = np.where(np.abs(self.norms[below] - norms) < np.abs(self.norms[at] - norms), below, at)
        bound = np.sqrt(self.distances(vectors, at).astype(np.float64))
        slack = 1e-9 * (norms + bound + 1)
        low = np.searchsorted(self.norms, norms - bound - slack, "left")
        high = np.searchsorted(self.norms, norms + bound + slack, "right")
        return self._compared(vectors, at, low, high)

    def _compared(self, vectors: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest of the centroids at places ``low`` to ``high`` and ``at``, which is among them."""
        best, number = self.distances(vectors, at), self.order[at]
        for step in range(int((high - low).max())):
            rows = np.flatnonzero((low + step < high) & (low + step != at))
            places = low[rows] + step
            away, name = self.distances(vectors[rows], places), self.order[places]
            nearer = (away < best[rows]) | ((away == best[rows]) & (name < number[rows]))
            taken = rows[nearer]
            best[taken], number[taken] = away[nearer], name[nearer]
        return number, best


def _digits(value: int) -> list[int]:
    """A whole number in base 2**DIGIT, least first; the last holds the rest and the sign. Most have one."""
    out = []
    while not -(1 << 62) < value < 1 << 62:
        out.append(value & ((1 << DIGIT) - 1))
        value >>= DIGIT
    return [*out, value]


def _sums(df: DataFrame, column: str, dims: int, centroids: list[list[int]]) -> tuple[list[tuple[int, list[int]]], list[int]]:
    """((count, sums) by centroid, the distances summed by centroid) over all vectors."""
    count = len(centroids)

    def run(batches):
        search, sums, sizes, away = Annulus(centroids), np.zeros((count, dims), object), np.zeros(count, object), np.zeros(count, object)
        for batch in batches:
            _, vectors = integers(batch, column, dims)
            number, distance = search.nearest(vectors)
            for k in np.unique(number):
                mine = number == k
                sums[k] += vectors[mine].sum(axis=0)
                sizes[k] += int(mine.sum())
                away[k] += sum(distance[mine].tolist())
        rows = [(k, pos, i, digit) for k in range(count) if sizes[k] for pos, x in enumerate([sizes[k], away[k], *sums[k]]) for i, digit in enumerate(_digits(int(x)))]
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["k", "pos", "i", "digit"])

    parts = df.select(column).mapInArrow(run, "k bigint, pos bigint, i bigint, digit bigint")
    found: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("k", "pos", "i").agg(F.sum(F.col("digit").cast("decimal(38,0)")).alias("digit")).collect():
        found[r["k"], r["pos"]] = found.get((r["k"], r["pos"]), 0) + (int(r["digit"]) << (DIGIT * r["i"]))
    return [(found.get((k, 0), 0), [found.get((k, p + 2), 0) for p in range(dims)]) for k in range(count)], [found.get((k, 1), 0) for k in range(count)]


def starts(df: DataFrame, key: str, column: str, dims: int, clusters: int, seed: int = 3) -> list[list[int]]:
    """The integers of the vectors with the least hashes of ``seed:id``."""

    def run(batches):
        for batch in batches:
            rows, vectors = integers(batch, "vector", dims)
            floors = pa.array([list(map(float, v)) if abs(max(v, key=abs)) < 2**1023 else None for v in vectors.tolist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("hash").take(pa.array(rows)), floors, batch.column("vector").take(pa.array(rows))], names=["hash", "floors", "vector"])

    hashed = df.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256).alias("hash"), F.col(column).alias("vector"))
    first = hashed.mapInArrow(run, T.StructType([T.StructField("hash", T.StringType()), T.StructField("floors", T.ArrayType(T.DoubleType())), T.StructField("vector", df.schema[column].dataType)]))
    rows = first.orderBy(F.asc_nulls_last("hash"), F.asc_nulls_last("floors"), "vector").limit(clusters).collect()
    return [[(SCALE * n) // d for n, d in (float(x).as_integer_ratio() for x in r["vector"])] for r in rows]


def centres(df: DataFrame, key: str = "vec_id", column: str = "embedding", dims: int = 64, clusters: int = 8, rounds: int = 10, seed: int = 3) -> list[list[int]]:
    """The centroids after ``rounds`` rounds."""
    found = starts(df, key, column, dims, clusters, seed)
    for _ in range(rounds if found else 0):
        sums, _ = _sums(df, column, dims, found)
        after = [[s // n for s in parts] if n else old for old, (n, parts) in zip(found, sums)]
        if after == found:  # every later round is the same
            break
        found = after
    return found


def _long(value: int) -> int | None:
    return value if -LONG <= value <= LONG else None


def cluster(df: DataFrame, key: str = "vec_id", column: str = "embedding", dims: int = 64, clusters: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """(key, cluster int, distance, cluster_inertia, inertia, centroid_sha256): one row for each kept vector."""
    found = centres(df, key, column, dims, clusters, rounds, seed)
    away = _sums(df, column, dims, found)[1] if found else []
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found]
    parts, whole = [_long(x) for x in away], _long(sum(away))

    def run(batches):
        search = Annulus(found)
        for batch in batches:
            rows, vectors = integers(batch, column, dims)
            if not len(rows):  # so there is a centroid
                continue
            number, distance = search.nearest(vectors)
            number = number.tolist()
            yield pa.RecordBatch.from_arrays([
                batch.column(key).take(pa.array(rows)), pa.array(number, pa.int32()), pa.array(map(_long, map(int, distance)), pa.int64()),
                pa.array([parts[k] for k in number], pa.int64()), pa.array([whole] * len(number), pa.int64()), pa.array([digests[k] for k in number], pa.string()),
            ], names=[key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    long = T.LongType()
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("cluster", T.IntegerType()), *[T.StructField(n, long) for n in ("distance", "cluster_inertia", "inertia")], T.StructField("centroid_sha256", T.StringType())])
    return df.select(key, column).mapInArrow(run, schema)


def brute_force(rows: list[tuple], dims: int = 64, clusters: int = 8, rounds: int = 10, seed: int = 3) -> list[tuple]:
    """All vectors against all centroids in Python's integers; for tests."""
    kept = []
    for key, v in rows:
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v):
            kept.append((key, [(SCALE * n) // d for n, d in (float(x).as_integer_ratio() for x in v)]))
    named = sorted((hashlib.sha256(f"{seed}:{k}".encode()).hexdigest() if k is not None else "~", v) for k, v in kept)
    found = [v for _, v in named[:clusters]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), k) for k, c in enumerate(found))

    for _ in range(rounds):
        groups: dict[int, list] = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        found = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else c for k, c in enumerate(found)]
    last = [(key, *nearest(v)) for key, v in kept]
    parts = [sum(d for _, d, k in last if k == j) for j in range(len(found))]
    return [(key, k, _long(d), _long(parts[k]), _long(sum(parts)), hashlib.sha256(",".join(map(str, found[k])).encode()).hexdigest()) for key, d, k in last]
