"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may match with up to floor(n * ``error_rate``) edits. It is split into
one piece more than that, so a match must hold at least one piece unchanged. All pieces are looked
for in one pass over a text, each hit gives the stretch in which its item could lie, overlapping
stretches of an item are joined, and Myers' bit-parallel distance decides inside them.

Texts and items are compared lower-cased with white space folded to one blank; places are counted
in that form. Items are taken in blocks of ``BLOCK_CHARS`` characters (by a hash of their id), each
block a pass of its own, so what is sent to executors is bounded.

Defined results: a hit is the place with the fewest edits, leftmost end first, and the latest
start among equals; null or empty items match nothing; a null text is the empty text; items with a
null id are left out; items repeated under one id count once a distinct text, the best of them
being reported; an empty table gives an empty table. ``hits`` replaces an input column of that name. Item ids
are integers.
"""

from __future__ import annotations

import math
import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import without

ERROR_RATE = 0.05
BLOCK_CHARS = 4_000_000
HIT = "array<struct<item_id:bigint,edits:int,start:int,end:int>>"


def fold_text(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces of near-equal length."""
    cuts = [i * len(item) // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_end(table: dict[str, int], size: int, text: str) -> tuple[int, int]:
    """(fewest edits, first end reaching them) of a pattern anywhere in ``text``."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    best, at = size, 0
    get = table.get
    for i, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | (full & ~(xh | plus)), plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1, mh << 1
        plus, minus = (mh | (full & ~(xv | ph))) & full, ph & xv & full
        if score < best:
            best, at = score, i
    return best, at


class Block:
    """One block of items, ready to be looked for."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        self.items = [(i, t, int(len(t) * error_rate)) for i, t in sorted({(i, fold_text(t)) for i, t in items}) if t]
        self.tables = [(masks(t), masks(t[::-1])) for _, t, _ in self.items]
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, budget) in enumerate(self.items):
            for at, piece in pieces(t, budget):
                found.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def hits(self, text: str) -> list[dict]:
        if not self.items:
            return []
        text = fold_text(text)
        spans: dict[int, list[list[int]]] = {}
        for end, (size, uses) in self.automaton.iter(text):
            for n, at in uses:
                _, item, budget = self.items[n]
                a = end + 1 - size - at - budget
                b = a + len(item) + 2 * budget
                held = spans.setdefault(n, [])
                if held and a <= held[-1][1] and b >= held[-1][0]:
                    held[-1][0], held[-1][1] = min(a, held[-1][0]), max(b, held[-1][1])
                else:
                    held.append([a, b])
        best: dict[int, tuple[int, int, int]] = {}
        for n, held in spans.items():
            number, item, budget = self.items[n]
            joined: list[list[int]] = []
            for a, b in sorted([max(0, a), b] for a, b in held):
                if joined and a <= joined[-1][1]:
                    joined[-1][1] = max(b, joined[-1][1])
                else:
                    joined.append([a, b])
            for a, b in joined:
                edits, end = best_end(self.tables[n][0], len(item), text[a:b])
                if edits <= budget:
                    back = text[max(0, a + end - len(item) - budget) : a + end][::-1]
                    start = a + end - best_end(self.tables[n][1], len(item), back)[1]
                    new = (edits, a + end, -start)
                    if number not in best or new < best[number]:
                        best[number] = new
        return [{"item_id": i, "edits": e, "start": -s, "end": at} for i, (e, at, s) in sorted(best.items())]


_built: dict[str, Block] = {}


def _block(sent: tuple[str, float, list[tuple[int, str]]]) -> Block:
    """The automaton of a broadcast block, built once in a Python worker; the block brings its own name."""
    name, error_rate, items = sent
    if name not in _built:
        _built.clear()
        _built[name] = Block(items, error_rate)
    return _built[name]


def _one_block(kept: DataFrame, items: list[tuple[int, str]], text: str, error_rate: float, last: bool, keep_text: bool) -> DataFrame:
    sent = kept.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, error_rate, items))
    names = [c for c in kept.columns if c != "__t"] + ([] if last else ["__t"])
    names = [c for c in names if c not in ("hits",) and (keep_text or c != text)]
    schema = T.StructType([*[kept.schema[c] for c in names], T.StructField("hits", T._parse_datatype_string(HIT))])
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        block = _block(sent.value)
        for batch in batches:
            old = batch.column("hits").to_pylist() if "hits" in batch.schema.names else [[]] * len(batch)
            got = [[*a, *block.hits(t)] for a, t in zip(old, batch.column("__t").to_pylist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(got, kind)], names=[*names, "hits"])

    return kept.mapInArrow(run, schema)


def find_hits(docs: DataFrame, items: DataFrame, key: str = "item_id", item: str = "text", text: str = "text", error_rate: float = ERROR_RATE, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``hits``: the items that lie in the text, their edits and best places."""
    items = items.select(F.col(key).cast("long").alias("i"), F.col(item).cast("string").alias("t")).filter("i is not null and t is not null").distinct()
    blocks = max(1, math.ceil((items.agg(F.sum(F.length("t"))).first()[0] or 0) / BLOCK_CHARS))
    out = without(docs, "hits").withColumn("__t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)
        out = _one_block(out, [(r.i, r.t) for r in part.collect()], text, error_rate, b == blocks - 1, keep_text)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a test item."""
    return find_hits(docs, items, **options).filter(F.size("hits") == 0).drop("hits")
