"""Exact removal of repeated byte strings with sharded suffix orders.

A byte goes if it lies in a string of ``width`` bytes that also starts anywhere else. Three steps
keep the suffix sorting to what can matter, without losing a string:

1. Equal texts are folded to one (by 128 bits of their SHA-256), and a text that occurs twice goes
   as a whole.
2. Every window of ``width`` bytes is given to the k-gram in it that has the smallest hash. Equal
   windows hold equal k-grams, so they have the same owner; a k-gram that owns windows at one place
   only owns no repeated window. The windows of one owner at one place form a fragment.
3. Fragments that are equal byte for byte are folded. A window reaches half of its other bytes or
   more to the left or to the right of its owner, so only fragments that agree with another on such
   a half can share one. Those are dealt out by owner, and ``suffix_sort`` (external induced
   sorting) sorts them, where suffixes that share ``width`` bytes lie side by side.

An owner whose fragments are more than one shard is dealt again: its fragments become the texts of
steps 2 and 3 under another hash, where their windows mostly get other owners. After ``DEPTH`` such
rounds what is left is sorted as it is; the sort holds ``suffix_sort``'s memory parameter and keeps
the rest on the task's disk, so an owner may have any size. All verdicts come from equal texts,
equal fragments and suffix orders. What step 3 finds is judged on the input texts.

Defined results: a null text is the empty text; texts shorter than ``width`` lose nothing; a text
that is there twice loses all its bytes if it has ``width`` or more; matches never cross texts;
every row stays, repeated rows included, and gets the result of its text; an empty table gives an
empty table. Result columns replace input columns of the same names. ``kept`` holds the bytes that
remain (they need not be valid UTF-8).
"""

from __future__ import annotations

import hashlib
import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import suffix_sort
from .common import carried, checkpoint_dir, forget, without, written

GRAM = 32
#: Bytes of fragments that are sorted together, and beyond which an owner is dealt again.
SHARD_BYTES = 4_000_000
#: How often an owner is dealt again at most.
DEPTH = 3
#: Bytes whose windows are worked on at once in a task.
BLOCK = 4_000_000
_BASE = 0x9E3779B97F4A7C15
SPANS = "array<struct<a:int,b:int>>"


def gram_hashes(data: np.ndarray, salt: int = 0) -> np.ndarray:
    """A mixed 64-bit hash of the GRAM bytes from each position (shorter by GRAM - 1)."""
    rng = np.random.default_rng(20 + salt)
    h = rng.integers(1, 1 << 63, 256, dtype=np.uint64)[data]
    size, base = 1, _BASE
    while size < GRAM:
        h = h[:-size] * np.uint64(base) + h[size:]
        base, size = base * base % (1 << 64), size * 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def owners(data: np.ndarray, width: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window, place) of each owner in order; ``data`` has width bytes or more.

    The order of k-grams is by 40 bits of their hash and then by place, so one pass of least values
    finds both hash and place of the leftmost least k-gram of every window.
    """
    h = gram_hashes(data, salt)
    key = (h & np.uint64(~((1 << 24) - 1) & (1 << 64) - 1)) | np.arange(len(h), dtype=np.uint64)
    span, size = width - GRAM + 1, 1
    while size * 2 <= span:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < span:
        key = np.minimum(key[: len(key) - (span - size)], key[span - size :])
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    at = (key[new] & np.uint64((1 << 24) - 1)).astype(np.int64)
    return h[at].view(np.int64), new, np.append(new[1:], len(key)) - 1, at


def _runs(batches, width: int, salt: int):
    for batch in batches:
        ids, texts = batch.column("tid"), batch.column("t").cast(pa.binary()).to_pylist()
        rows, found = [], []
        for row, text in enumerate(texts):
            data = np.frombuffer(text, np.uint8)
            for a in range(0, len(data) - width + 1, BLOCK):
                h, lo, hi, place = owners(data[a : a + BLOCK + width - 1], width, salt)
                rows.append(np.full(len(h), row))
                found.append((h, lo + a, hi + a, place + a))
        if rows:
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[0] for f in found])), ids.take(take), *[pa.array(np.concatenate([f[k] for f in found]).astype(np.int32)) for k in (1, 2, 3)]], names=["h", "tid", "lo", "hi", "at"])


def _fragments(batches, width: int):
    """A row for each window run of each text: digests of its fragment and of the owner's two sides."""
    half = (width - GRAM) // 2
    names = ["h", "mark", "tid", "lo", "hi", "left", "right"]
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    digest = lambda x: xxhash.xxh64_intdigest(x) - (1 << 63)
    for batch in batches:
        texts = batch.column("t").cast(pa.binary()).to_pylist()
        out: list[tuple] = []
        for tid, text, runs in zip(batch.column("tid").to_pylist(), texts, batch.column("runs").to_pylist()):
            for r in runs:
                lo, hi, at = r["lo"], r["hi"], r["at"]
                left = digest(text[at - half : at + GRAM]) if at - half >= lo else None
                right = digest(text[at : at + GRAM + half]) if at + GRAM + half <= hi + width else None
                out.append((r["h"], hashlib.blake2b(text[lo : hi + width], digest_size=16).digest(), tid, lo, hi, left, right))
            if len(out) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def _flag_runs(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"a": int(a), "b": int(b) - 1} for a, b in zip(edge[::2], edge[1::2])]


class _Shard:
    """Fragments that are sorted together; their symbols go to a file of the task beyond the memory."""

    def __init__(self, memory: int):
        self.memory, self.marks, self.single, self.sizes = memory, [], [], []
        self.parts, self.held, self.bytes, self.file = [], 0, 0, None

    def add(self, mark: bytes, n: int, part: bytes) -> None:
        self.marks.append(mark)
        self.single.append(n == 1)
        self.sizes.append(len(part))
        self.parts.append(part)
        self.held += len(part) + 1
        self.bytes += len(part)
        if self.held > self.memory:
            self.file = self.file or tempfile.TemporaryFile()
            suffix_sort.join_parts(self.parts)[0].tofile(self.file)
            self.parts, self.held = [], 0

    def symbols(self) -> np.ndarray:
        if not self.file:
            return suffix_sort.join_parts(self.parts)[0]
        if self.parts:
            suffix_sort.join_parts(self.parts)[0].tofile(self.file)
            self.parts = []
        self.file.flush()
        return np.memmap(self.file, np.int16, "r+")

    def spans(self, width: int) -> pa.RecordBatch:
        flags, at, marks, spans = suffix_sort.repeated(self.symbols(), width, memory=self.memory), 0, [], []
        for mark, single, size in zip(self.marks, self.single, self.sizes):
            if single and (runs := _flag_runs(np.asarray(flags[at : at + size - width + 1]))):
                marks.append(mark)
                spans.append(runs)
            at += size + 1
        return pa.RecordBatch.from_arrays([pa.array(marks, pa.binary()), pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], names=["mark", "spans"])


def _sort_shards(batches, width: int, shard_bytes: int, memory: int):
    """Fragments come ordered by owner; an owner is never split over two sorts."""
    shard, owner = _Shard(memory), None
    for batch in batches:
        for h, mark, n, part in zip(*[batch.column(c).to_pylist() for c in ("h", "mark", "n", "part")]):
            if h != owner and shard.bytes >= shard_bytes:
                yield shard.spans(width)
                shard = _Shard(memory)
            owner = h
            shard.add(mark, n, part)
    if shard.marks:
        yield shard.spans(width)


def _cut_texts(batches, width: int):
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("t").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
            change = np.zeros(len(text) + 1, np.int64)
            for s in spans:
                change[s["a"]] += 1
                change[s["b"] + width] -= 1
            gone = np.cumsum(change[:-1]) > 0
            starts = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
            out.append((int(gone.sum()), starts, np.frombuffer(text, np.uint8)[~gone].tobytes()))
        cols = list(zip(*out)) if out else [[], [], []]
        yield pa.RecordBatch.from_arrays([batch.column("tid"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["tid", "gone", "runs", "left"])


def _open_marks(parts: DataFrame) -> DataFrame:
    """Marks of the distinct fragments that agree with another of their owner on a side, some of them single."""
    sides = parts.select("h", "mark", "n", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("m")), F.struct(F.lit(1).alias("side"), F.col("right").alias("m")))).alias("s"))
    sides = sides.select("h", "mark", "n", "s.side", "s.m").filter("m is not null")
    again = sides.groupBy("h", "side", "m").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1")
    return sides.join(again.select("h", "side", "m"), ["h", "side", "m"]).select("mark").distinct()


def _repeated_windows(texts: DataFrame, width: int, at: str, shard_bytes: int, memory: int, salt: int = 0) -> tuple[DataFrame, DataFrame]:
    """((tid, t) of the texts that may hold repeated windows, (tid, spans) of those windows).

    ``texts`` has (tid, t binary), where rows of one tid hold the same text.
    """
    at = f"{at}/{salt}"
    places = written(texts.mapInArrow(lambda b: _runs(b, width, salt), "h bigint, tid binary, lo int, hi int, at int").distinct(), f"{at}-places")
    # written, so that both sides of the join come straight from an exchange and hot owners can be split
    shared = written(places.groupBy("h").agg(F.count("*").alias("places")).filter("places > 1").select(F.col("h").alias("owner")), f"{at}-shared")
    marked = places.join(shared, F.col("h") == F.col("owner")).groupBy("tid").agg(F.collect_list(F.struct("h", "lo", "hi", "at")).alias("runs"))
    once = texts.groupBy("tid").agg(F.first("t").alias("t"))
    open_ = written(once.join(marked, "tid"), f"{at}-open")
    forget(places, f"{at}-places", f"{at}-shared")  # all that later steps need is in the open texts
    pieces = written(open_.mapInArrow(lambda b: _fragments(b, width), "h bigint, mark binary, tid binary, lo int, hi int, left bigint, right bigint"), f"{at}-pieces")
    first = F.min(F.struct("tid", "lo", "hi", "left", "right")).alias("f")
    parts = written(pieces.groupBy("h", "mark").agg(F.count("*").alias("n"), first).select("h", "mark", "n", "f.*"), f"{at}-parts")
    body = F.substring(F.col("t"), F.col("lo") + 1, F.col("hi") - F.col("lo") + width).alias("part")
    chosen = parts.join(_open_marks(parts), "mark").select("h", "mark", "n", "tid", "lo", "hi")
    dealt = written(open_.select("tid", "t").join(chosen, "tid").select("h", "mark", "n", body), f"{at}-dealt")
    sizes = dealt.groupBy("h").agg(F.sum(F.octet_length("part")).alias("bytes"))
    total, most = sizes.agg(F.sum("bytes"), F.max("bytes")).first()
    whole = parts.filter("n > 1").select("mark", F.lit(None).cast(SPANS).alias("spans"))
    found, again = [whole], salt < DEPTH and (most or 0) > shard_bytes
    if again:
        hot = written(sizes.filter(F.col("bytes") > shard_bytes).select(F.col("h").alias("hot")), f"{at}-hot")
        more = dealt.join(hot, F.col("h") == F.col("hot"), "left_semi").select(F.col("mark").alias("tid"), F.col("part").alias("t"))
        found.append(_repeated_windows(more, width, at, shard_bytes, memory, salt + 1)[1].withColumnRenamed("tid", "mark"))
        single = dealt.filter("n = 1").select(F.col("mark").alias("one"))
        found[1] = found[1].join(single, F.col("mark") == F.col("one"), "left_semi")  # the others go as a whole
        dealt = dealt.join(hot, F.col("h") == F.col("hot"), "left_anti")
    shards = max(12, math.ceil((total or 0) / shard_bytes))
    found.append(dealt.repartition(shards, "h").sortWithinPartitions("h").mapInArrow(lambda b: _sort_shards(b, width, shard_bytes, memory), f"mark binary, spans {SPANS}"))
    verdicts = found[0]
    for f in found[1:]:
        verdicts = verdicts.unionByName(f)
    verdicts = written(verdicts, f"{at}-verdicts")
    forget(parts, f"{at}-dealt", f"{at}-parts", *([f"{at}-hot"] if again else []))
    placed = pieces.select("mark", "tid", "lo", "hi").join(verdicts, "mark")
    spans = F.when(F.col("spans").isNull(), F.array(F.struct(F.col("lo").alias("a"), F.col("hi").alias("b")))).otherwise(F.transform("spans", lambda s: F.struct((F.col("lo") + s["a"]).alias("a"), (F.col("lo") + s["b"]).alias("b"))))
    return open_.select("tid", "t"), placed.groupBy("tid").agg(F.flatten(F.collect_list(spans)).alias("spans"))


def drop_repeated(df: DataFrame, text: str = "text", width: int = 400, keep_text: bool = True, shard_bytes: int = SHARD_BYTES, memory: int = 1 << 23) -> DataFrame:
    """``df`` with ``n_bytes``, ``n_removed``, ``n_spans`` (bigint) and ``kept`` (binary).

    ``memory`` is the number of symbols that a sort may hold in a task.
    """
    inner = lambda rows, body: _drop_repeated(rows, body, width, keep_text, shard_bytes, memory)
    return carried(df, [F.col(f"`{text}`")], inner, {0: text})


def _drop_repeated(df: DataFrame, text: str, width: int, keep_text: bool, shard_bytes: int, memory: int) -> DataFrame:
    spark = df.sparkSession
    at = f"{checkpoint_dir(spark)}/suffix-{uuid.uuid4().hex}"
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    tid = F.substring(F.unhex(F.sha2(body, 256)), 1, 16)
    texts = df.select(tid.alias("tid"), body.cast("binary").alias("t"))
    open_, spans = _repeated_windows(texts.filter(F.octet_length("t") >= width), width, f"{at}/work", shard_bytes, memory)
    changed = open_.join(spans, "tid").mapInArrow(lambda b: _cut_texts(b, width), "tid binary, gone bigint, runs bigint, left binary")
    copies = texts.groupBy("tid").agg(F.count("*").alias("copies"))
    verdict = copies.join(changed, "tid", "left").filter("copies > 1 or gone is not null")
    verdict = written(verdict.select(*[F.col(c).alias(f"__{c}_of") for c in ("tid", "copies", "gone", "runs", "left")]), f"{at}/verdict")
    forget(verdict, f"{at}/work")
    kept = without(df, "n_bytes", "n_removed", "n_spans", "kept").withColumn("__tid", tid).withColumn("n_bytes", F.octet_length(body).cast("long"))
    out = kept.join(verdict, F.col("__tid") == F.col("__tid_of"), "left")
    all_gone = (F.coalesce("__copies_of", F.lit(1)) > 1) & (F.col("n_bytes") >= width)
    out = out.withColumn("n_removed", F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("__gone_of", F.lit(0))))
    out = out.withColumn("n_spans", F.when(all_gone, 1).otherwise(F.coalesce("__runs_of", F.lit(0))).cast("long"))
    out = out.withColumn("kept", F.when(all_gone, F.lit(b"")).otherwise(F.coalesce("__left_of", body.cast("binary"))))
    return without(out, "__tid", *verdict.columns, *([] if keep_text else [text]))


def brute_force(texts: list[str | None], width: int = 400) -> list[tuple[int, int, int, str]]:
    """What the digest columns must be, by counting every window; for tests."""
    data = [(t or "").encode() for t in texts]
    count: dict[bytes, int] = {}
    for d in data:
        for i in range(len(d) - width + 1):
            count[d[i : i + width]] = count.get(d[i : i + width], 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - width + 1):
            if count[d[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        out.append((len(d), sum(gone), bytes(gone).count(b"\0\1") + (gone[:1] == b"\1"), hashlib.sha256(bytes(c for c, g in zip(d, gone) if not g)).hexdigest()))
    return out
