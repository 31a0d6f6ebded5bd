"""Near-duplicates by SimHash: tiled exact comparison of fingerprints, then connected components.

A fingerprint sums the bits of the 64-bit hashes of a text's word shingles. Equal fingerprints are
folded first, so that a group of copies is one entry however large. The distinct fingerprints are
dealt to cells by their population counts, over as many stretches of bits as keep cells small; only
cells whose counts differ by no more than the radius meet, so the copies of a fingerprint do not
grow with their number. Inside a cell, fingerprints are ordered by population count and cut into
tiles, tile pairs whose population counts cannot lie within the radius are skipped, and the rest is
compared with exclusive-or and bit counts. Bounds on
the counts of the whole fingerprint and of its eight bytes both skip tiles; both are exact. A cell
hands on only a spanning forest of its links. Components are the smallest label reachable, found by
rounds of hooking and pointer jumping, each round cut by a checkpoint.

Defined results: a text without words (empty, null, blanks only) has fingerprint zero and links
like any other; texts with fewer words than a shingle hash their whole word sequence; rows with a
null id are left out of links and get a null component; repeated ids are one document of the
component of each of their texts; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import graph
from .common import cut, without

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Fingerprints at home in one cell; with visitors a task holds some times as many, 8 bytes each.
GROUP = 1 << 16
TILE = 256
#: Shingles hashed and counted at once in a task.
BLOCK = 1 << 17
_LOWER = {c: c + 32 for c in range(65, 91)}
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the shingle hashes (XXH64 of UTF-8, seed 42)."""
    words = _WORD.findall(text.translate(_LOWER))
    if not words:
        return 0
    joined = " ".join(words).encode()
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    gaps = [-1, *np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20).tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    total, count = np.zeros(64, np.int64), len(words) - shingle + 1
    for a in range(0, count, BLOCK):
        b = min(a + BLOCK, count)
        hashes = np.array([digest(joined[i + 1 : j], SEED) for i, j in zip(gaps[a:b], gaps[a + shingle : b + shingle])], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > count, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", keep_text: bool = True, shingle: int = SHINGLE) -> DataFrame:
    """``df`` with ``out`` (bigint, the 64 bits as a signed number)."""
    kept = without(df, out).withColumn("__t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    kept = kept if keep_text else without(kept, text)
    names = [c for c in kept.columns if c != "__t"]

    def run(batches):
        for batch in batches:
            marks = np.array([fingerprint(t, shingle) for t in batch.column("__t").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(marks, pa.int64())], names=[*names, out])

    return kept.mapInArrow(run, T.StructType([*[kept.schema[c] for c in names], T.StructField(out, T.LongType())]))


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member position of each node's component under the links a-b."""
    parent = np.arange(n)
    while len(a):
        x, y = parent[a], parent[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(parent, high, low)
        parent = _roots(parent)
        open_ = parent[a] != parent[b]
        a, b = a[open_], b[open_]
    return parent


def cell_links(marks: np.ndarray, side: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Star links (member, root) among ``marks``; sides 0 and 1 are compared across, side 2 within and with 1."""
    counts = np.bitwise_count(marks.view(np.uint8).reshape(-1, 8)).astype(np.int16)
    total = counts.sum(axis=1)
    order = np.lexsort((marks, counts[:, 2], counts[:, 1], counts[:, 0], total))
    marks, side, counts, total = marks[order], side[order], counts[order], total[order]
    tiles = []
    for kind in np.unique(side):
        rows = np.flatnonzero(side == kind)
        tiles += [(kind, rows[i : i + TILE]) for i in range(0, len(rows), TILE)]
    low, high = np.array([counts[r].min(0) for _, r in tiles]), np.array([counts[r].max(0) for _, r in tiles])
    least, most = np.array([total[r].min() for _, r in tiles]), np.array([total[r].max() for _, r in tiles])
    kinds = np.array([k for k, _ in tiles])
    found_a, found_b = [], []
    for i, (kind, rows) in enumerate(tiles):
        apart = np.maximum(0, np.maximum(low - high[i], low[i] - high)).sum(axis=1)
        near = (apart <= radius) & (least - most[i] <= radius) & (least[i] - most <= radius)
        mates = ((kinds == 2) & (np.arange(len(tiles)) >= i)) | (kinds == 1) if kind == 2 else (kinds == 1) & (kind == 0)
        near &= mates
        mine = marks[rows]
        for j in np.flatnonzero(near):
            other = tiles[j][1]
            hit = np.bitwise_count(mine[:, None] ^ marks[other][None, :]) <= radius
            if j == i:
                hit = np.triu(hit, 1)
            if hit.any():
                x, y = np.nonzero(hit)
                found_a.append(rows[x])
                found_b.append(other[y])
        if sum(map(len, found_a)) > 4_000_000:  # a forest takes the place of the links so far
            root = _forest(len(marks), np.concatenate(found_a), np.concatenate(found_b))
            moved = np.flatnonzero(root != np.arange(len(root)))
            found_a, found_b = [moved], [root[moved]]
    if not found_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    root = _forest(len(marks), np.concatenate(found_a), np.concatenate(found_b))
    moved = np.flatnonzero(root != np.arange(len(root)))
    return marks[moved], marks[root[moved]]


def _part_counts(parts: int):
    """Population counts of ``parts`` equal stretches of the bits of column m."""
    width = 64 // parts
    mask = -1 if width == 64 else (1 << width) - 1
    return [F.bit_count(F.shiftrightunsigned("m", k * width).bitwiseAND(F.lit(mask).cast("long"))).cast("int") for k in range(parts)]


def _moves(parts: int, radius: int) -> list[list[int]]:
    """All changes of the counts by ``radius`` in sum, zero first; of two opposite ones the greater only."""
    found = [[]]
    for _ in range(parts):
        found = [[*m, d] for m in found for d in range(-radius, radius + 1) if sum(map(abs, m)) + abs(d) <= radius]
    zero = [0] * parts
    return [zero, *[m for m in found if m > zero]]


def _dealt_by_counts(distinct: DataFrame, radius: int) -> DataFrame | None:
    """(m, cell, side): each fingerprint at home in the cell of its counts, and a visitor in nearby cells.

    Fingerprints within the radius differ by no more than that in the sum over the stretches, so
    every link is met in one cell. The fewest stretches are taken that keep cells within ``GROUP``;
    None if even bytes do not.
    """
    for parts in (1, 2, 4, 8):
        key = F.array(*_part_counts(parts))
        most = distinct.groupBy(key.alias("k")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= GROUP:
            moves = _moves(parts, radius)
            cells = [F.struct(F.array(*[c + d for c, d in zip(_part_counts(parts), m)]).alias("cell"), F.lit(2 if not any(m) else 1).alias("side")) for m in moves]
            dealt = distinct.select("m", F.explode(F.array(*cells)).alias("c")).select("m", "c.cell", "c.side")
            return dealt.filter(F.forall("cell", lambda x: x.between(0, 64 // parts)))
    return None


def links(marks: DataFrame, column: str = "fingerprint", radius: int = RADIUS, groups: int | None = None) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints within the radius.

    Cells are made of population counts. Where those leave a cell beyond ``GROUP`` (or with
    ``groups``), fingerprints are dealt to groups by hash and every pair of groups is a cell.
    """
    distinct = cut(marks.select(F.col(column).alias("m")).filter("m is not null").distinct())

    def run(key, rows):
        side = rows.column("side").to_numpy()
        if 2 not in side and len(np.unique(side)) < 2:  # visitors without anyone at home
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        a, b = cell_links(rows.column("m").to_numpy().view(np.uint64), side, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = None if groups else _dealt_by_counts(distinct, radius)
    if dealt is not None:
        return dealt.groupBy("cell").applyInArrow(run, "a bigint, b bigint")
    groups = groups or max(6, math.ceil(distinct.count() / GROUP))
    own = F.pmod(F.xxhash64("m"), F.lit(groups)).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.struct(F.least(g, own).alias("i"), F.greatest(g, own).alias("j"), F.when(g == own, 2).when(own < g, 0).otherwise(1).alias("side")))
    dealt = distinct.select("m", F.explode(cells).alias("c")).select("m", "c.i", "c.j", "c.side")
    return dealt.repartition(groups * (groups + 1) // 2, "i", "j").groupBy("i", "j").applyInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label): the smallest label that each node can reach over the edges (a, b)."""
    groups = graph.components(edges)
    # kept, so that both sides of the next join come straight from an exchange and a large group can be split
    least = cut(groups.join(labels, "node").groupBy("component").agg(F.min("label").alias("label")))
    return groups.join(least, "component").select("node", "label")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(key, fingerprint bigint, component_id): one row for each row of ``df``."""
    name, key = key, "__key"
    marks = cut(fingerprints(df.select(F.col(f"`{name}`").alias(key), F.col(f"`{text}`").alias("__text")), "__text", keep_text=False, shingle=shingle))
    first = marks.filter(F.col(key).isNotNull()).groupBy(F.col("fingerprint").alias("node")).agg(F.min(key).alias("label"))
    known = cut(first)
    edges = cut(links(known, "node", radius))
    reached = components(edges, known)
    final = cut(known.join(reached.select("node", F.col("label").alias("reached")), "node", "left").select("node", F.coalesce("reached", "label").alias("component_id")))
    out = marks.join(final, marks["fingerprint"] == final["node"], "left")
    return out.select(F.col(key).alias(name), "fingerprint", F.when(F.col(key).isNotNull(), F.col("component_id")).alias("component_id"))
