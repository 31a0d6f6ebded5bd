"""Filter interaction audit: what each of five filters removes in each of their 120 orders.

Filters fail a text (null counts as empty; words are maximal runs of anything but ASCII blanks) if
A: it has under 50 words; B: its distinct words are under 65 % of its words; C: over 5 % of its code
points are capitals A-Z; D: it holds one of ``#$%&*|``; E: a smaller id has the same text.

E is decided by fingerprint-routed RDD: a text's XXH64 routes it to a partition, which keeps for each
fingerprint a chain of colliding texts in full, each with its least id so far, and emits every id
that is not the least. Copies that a task reads together are folded there: only the least id of
a text leaves the task with the text, so a text that a third of all rows share sends one row a task.
There are as many partitions as the bytes of all texts ask for.
Each is sorted by fingerprint (on disk beyond ``spark.python.worker.memory``), so that one
chain at a time is in memory. A task folds at most ``HELD`` characters of texts before it sends them.

Every row then is (id, part, mask of failed filters). Labels join these small rows; ``combineByKey``
folds them to one vector of counts by mask for each part, and the 120 x 5 steps of a part are sums
over its vector. Nothing is collected.

Defined results: a row whose id equals the least id of its text does not fail E, repeated rows
included; a null id counts as larger than all others. A label is 1 if any row of the labels says so;
a null id has no label. A null part is the empty string, and joins the part of empty strings. An
empty table gives an empty result. Extra columns play no part.
"""

from __future__ import annotations

import math
import re
from itertools import permutations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
LEAST_WORDS = 50
#: Characters of texts that a task folds before it sends them on.
HELD = 16 << 20
#: Bytes of texts that a partition of fingerprints may get, whatever the session's number of partitions.
PART_BYTES = 64 << 20
SEED = 42
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_MARKED = re.compile(r"[#$%&*|]")
_NOT_CAPITALS = bytes(c for c in range(256) if not 65 <= c <= 90)
_MASKS = 1 << len(FILTERS)
_E = 1 << FILTERS.index("E")

SCHEMA = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def text_mask(text: str) -> int:
    """The bits of the filters A to D that the text fails."""
    words = _WORDS.findall(text)
    capitals = len(text.encode("utf-8", "replace").translate(None, _NOT_CAPITALS))
    fails = (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < 65 * len(words),
        100 * capitals > 5 * len(text),
        _MARKED.search(text) is not None,
    )
    return sum(1 << i for i, bad in enumerate(fails) if bad)


def _place(key: int | None) -> tuple[bool, int]:
    return (key is None, key or 0)


class Chains:
    """Texts by fingerprint: [text, least id, the rows (part, mask, count) that have this id]."""

    def __init__(self):
        self.chains: dict[int, list[list]] = {}
        self.held = 0

    def add(self, digest: int, text: str, key, rows: dict):
        """The rows that are now known to have a smaller id beside them, as ((key), part, mask) counts."""
        chain = self.chains.setdefault(digest, [])
        link = next((x for x in chain if x[0] == text), None)
        if link is None:
            chain.append([text, key, dict(rows)])
            self.held += len(text) + 64
            return
        if link[1] == key:
            for k, n in rows.items():
                link[2][k] = link[2].get(k, 0) + n
            return
        late_key, late = key, rows
        if _place(key) < _place(link[1]):
            late_key, late = link[1], link[2]
            link[1], link[2] = key, dict(rows)
        for (part, mask), n in late.items():
            yield late_key, part, mask | _E, n

    def drain(self):
        for digest, chain in self.chains.items():
            for text, key, rows in chain:
                yield digest, text, key, rows
        self.chains, self.held = {}, 0


def _spread(late):
    """Decided rows, routed by their ids, so that many copies do not meet again."""
    key, part, mask, n = late
    return (xxhash.xxh64_intdigest(repr((key, part)).encode(), SEED), 0), (None, key, part, mask, n)


def _folded(held: int):
    def run(rows):
        here = Chains()
        for key, part, text in rows:
            digest = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), SEED)
            yield from map(_spread, here.add(digest, text, key, {(part, text_mask(text)): 1}))
            if here.held > held:
                for d, *link in here.drain():
                    yield (d, 1), link
        for d, *link in here.drain():
            yield (d, 1), link

    return run


def _decided(pairs):
    """(id, part, mask, count): the rows of one partition, which come in order of their fingerprints."""
    here, last = Chains(), None
    for (digest, open_), payload in pairs:
        if not open_:
            yield tuple(payload[1:])
            continue
        if digest != last:
            yield from ((key, part, mask, n) for _, _, key, rows in here.drain() for (part, mask), n in rows.items())
            last = digest
        yield from here.add(digest, *payload)
    yield from ((key, part, mask, n) for _, _, key, rows in here.drain() for (part, mask), n in rows.items())


def failed_masks(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", held: int = HELD) -> DataFrame:
    """(id, part, mask, n): the filters that rows fail, as bits; rows alike in id, part and mask may share one row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sent = rows.rdd.mapPartitions(_folded(held))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(sent.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PART_BYTES))
    routed = sent.repartitionAndSortWithinPartitions(parts, lambda k: k[0] % parts)
    return spark.createDataFrame(routed.mapPartitions(_decided), "id bigint, part string, mask int, n bigint", verifySchema=False)


def order_steps() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """The (order, step) pairs, and for each figure the 0/1 weights of the masks (pairs x masks)."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    masks = np.arange(_MASKS)
    names = [(order, step) for order in orders for step in range(1, len(FILTERS) + 1)]
    out = {k: np.zeros((len(names), _MASKS), np.int64) for k in ("kept", "removed", "redundant", "unique_fails", "shapley")}
    for i, (order, step) in enumerate(names):
        before = sum(1 << FILTERS.index(f) for f in order[: step - 1])
        own = 1 << FILTERS.index(order[step - 1])
        fails, gone = (masks & own) != 0, (masks & before) != 0
        out["kept"][i] = (masks & (before | own)) == 0
        out["removed"][i] = fails & ~gone
        out["redundant"][i] = fails & gone
        out["unique_fails"][i] = masks == own
    for f in FILTERS:
        mine = np.array([order[step - 1] == f for order, step in names])
        out["shapley"][mine] = out["removed"][mine].sum(axis=0)
    return names, out


def _vector(value) -> np.ndarray:
    vector = np.zeros((3, _MASKS), np.int64)
    return _added(vector, value)


def _added(vector: np.ndarray, value) -> np.ndarray:
    mask, n, good, toxic = value
    vector[:, mask] += (n, n * good, n * toxic)
    return vector


def _figures(pairs):
    names, weights = order_steps()
    for part, (every, good, toxic) in pairs:
        columns = [weights[k] @ every for k in ("kept", "removed", "redundant", "unique_fails")]
        columns += [weights["removed"] @ good, weights["removed"] @ toxic, weights["shapley"] @ every]
        for (order, step), *row in zip(names, *(c.tolist() for c in columns)):
            yield (part, order, step, *row)


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", held: int = HELD) -> DataFrame:
    """One row for each part, order of the filters and step, zeros included."""
    spark = docs.sparkSession
    said = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("of")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    masks = failed_masks(docs, key, text, part, held)
    rows = masks.join(said, F.col("id") == F.col("of"), "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))
    vectors = rows.rdd.map(lambda r: (r[0], r[1:])).combineByKey(_vector, _added, np.add, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.createDataFrame(vectors.mapPartitions(_figures), SCHEMA, verifySchema=False)


def brute_force(rows: list[tuple], labels: dict[int, tuple[int, int]]) -> set[tuple]:
    """What the audit of (id, text, part) rows must be, filter by filter; for tests."""
    rows = [(k, t or "", p or "") for k, t, p in rows]

    def fails(letter: str, key, text: str) -> bool:
        words = _WORDS.findall(text)
        return {
            "A": lambda: len(words) < 50,
            "B": lambda: 100 * len(set(words)) < 65 * len(words),
            "C": lambda: 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": lambda: any(c in "#$%&*|" for c in text),
            "E": lambda: any(t == text and _place(k) < _place(key) for k, t, _ in rows),
        }[letter]()

    out = set()
    for part in {p for *_, p in rows}:
        mine = [(labels.get(k, (0, 0)), {f for f in FILTERS if fails(f, k, t)}) for k, t, p in rows if p == part]
        shapley = dict.fromkeys(FILTERS, 0)
        found = []
        for order in map("".join, permutations(FILTERS)):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                failing = sum(f in bad for _, bad in mine)
                found.append((part, order, step, len(left), len(gone), failing - len(gone), sum(bad == {f} for _, bad in mine), sum(x[0][0] for x in gone), sum(x[0][1] for x in gone)))
        out |= {(*x, shapley[x[1][x[2] - 1]]) for x in found}
    return out
