"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix.

The rows lie in source blocks (a hash of the key columns). The number of rows that each block sends
to each shard is drawn first: the matrix whose row sums are the block sizes and whose column sums
are the shard sizes, distributed as under a uniform permutation of all rows. Each block is then
permuted by itself and cut at those counts, the pieces are exchanged, and each shard is permuted
again. Only DataFrame and SQL functions are used; no step holds more than ``rows_per_block`` rows
or the matrix rows of ``FAN`` children of one tree node in a task.

Defined results: shard sizes differ by at most one (the first ``n mod shards`` are the larger);
slots run gapless from 0 in every shard; the same rows, seed and parameters give the same result
whatever the partitioning. Equal texts are no unit here: a uniform shuffle places each row by
itself. Rows alike in all key columns are interchangeable; null keys are keys like any other. An
empty table gives an empty result. ``shard`` and ``slot`` replace input columns of these names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, cut, without

#: Children of a tree node, whose matrix rows one task draws, one after another.
FAN = 64
#: The matrix is broadcast up to this size and joined by a shuffle beyond it.
BROADCAST_BYTES = 8 << 20
_UNIT = 2.0**-53


def _bind(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _hypergeometric(total: str, marked: str, drawn: str, u: str) -> str:
    """Marked items among ``drawn`` of ``total``: the inverse distribution function at ``u``.

    The walk starts 12 standard deviations and 12 items below the mean and ends as far above it,
    beyond which less than 1e-30 of the mass lies, and stays inside the exact bounds of the
    distribution. Weights are relative to the first one; a first walk sums them, a second one stops
    at the share ``u`` of that sum, so no factorial is taken and large counts lose no digits.
    """
    step = "s.p * (q.c - k) * (q.n - k) / ((k + 1d) * (q.t - q.c - q.n + k + 1d))"
    whole = f"""aggregate(sequence(q.a, q.b - 1L), named_struct('p', 1d, 'cum', 1d),
        (s, k) -> {_bind(step, "p", "named_struct('p', p, 'cum', s.cum + p)")}, s -> s.cum * q.u)"""
    walk = f"""aggregate(sequence(q.a, q.b - 1L), named_struct('p', 1d, 'cum', 1d, 'k', q.a),
        (s, k) -> if(s.cum >= goal, s, {_bind(step, "p", "named_struct('p', p, 'cum', s.cum + p, 'k', k + 1L)")}), s -> s.k)"""
    half = "12d * sqrt(greatest(0d, w.n * (w.c / w.t) * (1d - w.c / w.t) * ((w.t - w.n) / greatest(w.t - 1d, 1d)))) + 12d"
    bounds = f"""named_struct('t', w.t, 'c', w.c, 'n', w.n, 'u', w.u,
        'a', greatest(0L, cast(w.n + w.c - w.t as bigint), cast(floor(w.n * w.c / w.t - ({half})) as bigint)),
        'b', least(cast(w.n as bigint), cast(w.c as bigint), cast(ceil(w.n * w.c / w.t + ({half})) as bigint)))"""
    inner = _bind(bounds, "q", f"if(q.a >= q.b, q.b, {_bind(whole, 'goal', walk)})")
    given = f"named_struct('t', cast({total} as double), 'c', cast({marked} as double), 'n', cast({drawn} as double), 'u', {u})"
    return f"if({marked} = 0L or {drawn} = 0L, 0L, if({marked} = {total}, {drawn}, {_bind(given, 'w', inner)}))"


def _matrix(sizes: str, columns: str, node: str, seed: int) -> str:
    """array<array<bigint>>: for each size, the counts it sends to each column."""
    u = f"(shiftrightunsigned(xxhash64({seed}L, {node}, i, j), 11) * {_UNIT!r}d)"
    draw = _hypergeometric("r.total", f"element_at(m.left, j)", "r.n", u)
    one = f"""aggregate(sequence(1, size(m.left)),
        named_struct('n', element_at({sizes}, i), 'total', aggregate(m.left, 0L, (x, y) -> x + y), 'out', cast(array() as array<bigint>)),
        (r, j) -> {_bind(draw, "d", "named_struct('n', r.n - d, 'total', r.total - element_at(m.left, j), 'out', array_append(r.out, d))")}, r -> r.out)"""
    return f"""aggregate(sequence(1, size({sizes})), named_struct('left', {columns}, 'out', cast(array() as array<array<bigint>>)),
        (m, i) -> {_bind(one, "row", "named_struct('left', zip_with(m.left, row, (x, y) -> x - y), 'out', array_append(m.out, row))")}, m -> m.out)"""


def communication_matrix(counts: DataFrame, shards: int, seed: int, blocks: int) -> DataFrame:
    """(block, upto): upto[s] is the rows of the block that go to shards 0 to s.

    ``counts`` holds (block, n) for blocks below ``blocks``. The matrix is drawn down a tree: each
    node shares its own row among at most ``FAN`` children, all nodes of a level in parallel, so a
    task draws one node at a time however many blocks there are.
    """
    levels, nodes, width = [], counts.select(F.col("block").alias("node"), "n"), blocks
    while not levels or width > 1:
        above = nodes.groupBy(F.expr(f"cast(floor(node / {FAN}) as bigint)").alias("node"))
        levels.append(above.agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("members"), F.sum("n").alias("n")))
        nodes, width = levels[-1].select("node", "n"), math.ceil(width / FAN)
    columns = f"transform(sequence(0, {shards - 1}), s -> cast(floor(n / {shards}) as bigint) + if(s < n % {shards}, 1L, 0L))"
    rows = nodes.filter("n > 0").select("node", F.expr(columns).alias("columns"))
    for depth, level in enumerate(reversed(levels)):
        drawn = level.select("node", "members").join(rows, "node").select("members", F.expr(_matrix("transform(members, g -> g.n)", "columns", "node", seed + depth)).alias("drawn"))
        rows = drawn.select(F.explode(F.arrays_zip(F.col("members.node").alias("node"), F.col("drawn"))).alias("x")).select("x.node", F.col("x.drawn").alias("columns"))
    return rows.select(F.col("node").alias("block"), F.expr("transform(columns, (c, i) -> aggregate(slice(columns, 1, i + 1), 0L, (x, y) -> x + y))").alias("upto"))


def shard(df: DataFrame, keys: list[str], shards: int, seed: int = 1, rows_per_block: int = 1_000_000, blocks: int | None = None) -> DataFrame:
    """``df`` with ``shard`` (int from 0) and ``slot`` (bigint from 0 in each shard)."""
    inner = lambda rows, *names: _shard(rows, list(names), shards, seed, rows_per_block, blocks)
    return carried(without(df, "shard", "slot"), [F.col(f"`{k}`") for k in keys], inner, dict(enumerate(keys)))


def _shard(rows: DataFrame, keys: list[str], shards: int, seed: int, rows_per_block: int, blocks: int | None) -> DataFrame:
    count = rows.count()
    blocks = blocks or max(FAN, math.ceil(count / rows_per_block))
    tie = [F.col(k) for k in keys]
    rows = rows.withColumn("__block", F.pmod(F.xxhash64(F.lit(seed), *tie), F.lit(blocks)))
    # one row a block, kept, so that the levels of the tree do not read the table again
    counts = cut(rows.groupBy(F.col("__block").alias("block")).agg(F.count("*").alias("n")))
    matrix = communication_matrix(counts, shards, seed, blocks)
    if blocks * shards * 8 <= BROADCAST_BYTES:
        matrix = F.broadcast(matrix)
    local = Window.partitionBy("__block").orderBy(F.xxhash64(F.lit(seed + 2), *tie), *tie)
    sent = rows.withColumn("__rank", F.row_number().over(local) - 1).join(matrix, F.col("__block") == F.col("block"))
    sent = sent.withColumn("shard", F.expr("size(filter(upto, x -> x <= __rank))")).drop("block", "upto", "__rank", "__block")
    return _slots(sent, tie, shards, seed, max(1, math.ceil(count / shards / rows_per_block)))


def _slots(sent: DataFrame, tie: list, shards: int, seed: int, ranges: int) -> DataFrame:
    """The second permutation: rows of a shard ordered by a fresh hash, in ``ranges`` parts of its range."""
    sent = sent.withColumn("__order", F.xxhash64(F.lit(seed + 3), *tie))
    if ranges == 1:
        slot = F.row_number().over(Window.partitionBy("shard").orderBy("__order", *tie)) - 1
        return sent.withColumn("slot", slot.cast("long")).drop("__order")
    part = F.least(F.floor((F.shiftrightunsigned("__order", 11) * F.lit(_UNIT)) * ranges), F.lit(ranges - 1))
    sent = sent.withColumn("__part", part)
    sizes = sent.groupBy(F.col("shard").alias("__s"), F.col("__part").alias("__p")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__s").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__s", "__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    sizes = F.broadcast(sizes) if ranges * shards * 24 <= BROADCAST_BYTES else sizes
    unsigned = F.shiftrightunsigned("__order", 1)
    inside = F.row_number().over(Window.partitionBy("shard", "__part").orderBy(unsigned, "__order", *tie)) - 1
    placed = sent.withColumn("__inside", inside).join(sizes, (F.col("shard") == F.col("__s")) & (F.col("__part") == F.col("__p")))
    return placed.withColumn("slot", (F.col("__before") + F.col("__inside")).cast("long")).drop("__order", "__part", "__s", "__p", "__n", "__before", "__inside")
