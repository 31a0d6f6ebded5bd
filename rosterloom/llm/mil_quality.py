"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes, and only bags have labels. Every passage is
described by its byte make-up and by how much of it repeats, encoded by a learned layer, weighted
by gated attention that is learned together with it, and the weighted passage representation gives
the score. Training runs on the driver over a bounded sample of labelled documents
(``train_docs`` rows, every passage of each: the driver holds 408 bytes a passage of 256 bytes);
scoring runs in tasks, over every passage of every document, in blocks of bounded size.

Defined results: a null or empty text is one empty passage and gets a score; labels other than 0
and 1 and null labels are not learned from; a document labelled more than once counts once for
each label row; without any labelled document of either kind every score is the share of label 1
(0.5 without labels); an empty table gives an empty table. ``score`` replaces an input column of
that name. Only the text is an input of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import without

PASSAGE = 256
#: Passages worked on at once in a task (1 MB of text).
BLOCK = 4096
_ASCII = 96
N_FEATURES = _ASCII + 6


def passage_counts(sizes: np.ndarray) -> np.ndarray:
    return np.maximum(1, -(-sizes // PASSAGE))


def features(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Features of passages given as zero-padded byte rows and their sizes."""
    n = len(rows)
    inside = np.arange(PASSAGE)[None, :] < sizes[:, None]
    column = np.where(rows >= 0x80, _ASCII + 1, np.where(rows < 0x20, _ASCII, rows - np.minimum(rows, 0x20))).astype(np.int32)
    column[~inside] = _ASCII + 2
    counts = np.bincount((column + (np.arange(n, dtype=np.int32) * (_ASCII + 3))[:, None]).ravel(), minlength=n * (_ASCII + 3)).reshape(n, -1)[:, : _ASCII + 2]
    size = np.maximum(1, sizes)[:, None]
    out = np.zeros((n, N_FEATURES), np.float32)
    out[:, : _ASCII + 2] = np.sqrt(counts / size)
    wide = rows.astype(np.uint32)
    grams = (wide[:, :-3] << 24) | (wide[:, 1:-2] << 16) | (wide[:, 2:-1] << 8) | wide[:, 3:]
    held = np.maximum(0, sizes - 3)
    grams[np.arange(PASSAGE - 3)[None, :] >= held[:, None]] = 0xFFFFFFFF
    grams.sort(axis=1)
    fresh = (grams[:, 1:] != grams[:, :-1]) & (grams[:, 1:] != 0xFFFFFFFF)
    out[:, _ASCII + 2] = (fresh.sum(axis=1) + (held > 0)) / np.maximum(1, held)
    space = (rows == 0x20) | (rows == 0x0A)
    words = (space & inside).sum(axis=1) + 1
    out[:, _ASCII + 3] = np.log1p(sizes / words)
    out[:, _ASCII + 4] = np.log1p(sizes) / 6
    upper = (rows >= 65) & (rows <= 90)
    out[:, _ASCII + 5] = upper.sum(axis=1) / size[:, 0]
    return out


def text_passages(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte rows, row sizes, rows of each text) of texts that lie in ``data``."""
    count = passage_counts(sizes)
    first = np.repeat(np.cumsum(count) - count, count)
    nth = np.arange(int(count.sum())) - first
    at = np.repeat(starts, count) + nth * PASSAGE
    held = np.minimum(PASSAGE, np.repeat(sizes, count) - nth * PASSAGE)
    low, high = (int(starts.min()), int((starts + sizes).max())) if len(starts) else (0, 0)
    padded = np.concatenate([data[low:high], np.zeros(PASSAGE, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, PASSAGE)[np.minimum(at - low, high - low)]
    rows[np.arange(PASSAGE)[None, :] >= held[:, None]] = 0
    return rows, held, count


@dataclass
class Model:
    """Weights: passage encoder (w, b), gated attention (v, u, a), bag classifier (c, d)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodings and attention logits of passages."""
        p = self.weights
        h = np.tanh((x - self.mean) / self.scale @ p["w"] + p["b"])
        return h, (np.tanh(h @ p["v"]) / (1 + np.exp(-(h @ p["u"])))) @ p["a"]

    def bag(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z @ self.weights["c"] + self.weights["d"], -30, 30)))


def _start(dims: int, hidden: int, gate: int, bias: float, rng) -> dict[str, np.ndarray]:
    r = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    return {"w": r(dims, hidden), "b": np.zeros(hidden), "v": r(hidden, gate), "u": r(hidden, gate), "a": r(gate), "c": r(hidden) * 0.1, "d": np.array(bias)}


def gradients(p: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, bag: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over bags and its gradient; passages of bag i start at row first[i]."""
    h = np.tanh(x @ p["w"] + p["b"])
    tv, su = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
    e = (tv * su) @ p["a"]
    w = np.exp(e - np.maximum.reduceat(e, first)[bag])
    w /= np.add.reduceat(w, first)[bag]
    z = np.add.reduceat(w[:, None] * h, first)
    s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
    loss = -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))
    ds = (s - y) / len(y)
    dz = ds[:, None] * p["c"]
    dw = (dz[bag] * h).sum(1)
    de = w * (dw - np.add.reduceat(w * dw, first)[bag])
    dg = de[:, None] * p["a"]
    dtv, dsu = dg * su * (1 - tv**2), dg * tv * su * (1 - su)
    dh = w[:, None] * dz[bag] + dtv @ p["v"].T + dsu @ p["u"].T
    dq = dh * (1 - h**2)
    return loss, {"w": x.T @ dq, "b": dq.sum(0), "v": h.T @ dtv, "u": h.T @ dsu, "a": (tv * su).T @ de, "c": z.T @ ds, "d": ds.sum()}


def fit(x: np.ndarray, counts: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 12, rate: float = 0.01, decay: float = 1e-4, seed: int = 1) -> Model:
    """Adam over mini-batches of bags."""
    rng = np.random.default_rng(seed)
    share = float(y.mean()) if len(y) else 0.5
    mean, scale = (x.mean(0), x.std(0) + 0.02) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    p = _start(N_FEATURES, hidden, gate, float(np.log(max(share, 1e-3) / max(1 - share, 1e-3))), rng)
    if len(np.unique(y)) < 2:
        p["c"][:] = 0
        return Model(mean, scale, p)
    x = np.clip((x - mean) / scale, -20, 20)
    ends = np.cumsum(counts)
    m, v, t = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for part in np.array_split(order, max(1, len(y) // 64)):
            rows = np.concatenate([np.arange(ends[i] - counts[i], ends[i]) for i in part])
            n = counts[part]
            _, g = gradients(p, x[rows], np.cumsum(n) - n, np.repeat(np.arange(len(part)), n), y[part])
            t += 1
            for k in p:
                grad = g[k] + decay * p[k] * (k != "d")
                m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad**2
                p[k] = p[k] - rate * 0.85**epoch * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, p)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, sizes) of a string column without nulls, not copied."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data, offsets[:-1], np.diff(offsets)


def score_texts(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, model: Model) -> np.ndarray:
    """Scores of texts; attention sums run on from block to block, so a text may have any length."""
    n = len(sizes)
    count = passage_counts(sizes)
    upto = np.cumsum(count)
    top, weight, z = np.full(n, -np.inf), np.zeros(n), np.zeros((n, model.weights["b"].shape[0]))
    for a in range(0, int(upto[-1]) if n else 0, BLOCK):
        b = min(a + BLOCK, int(upto[-1]))
        i, j = np.searchsorted(upto, a, side="right"), np.searchsorted(upto, b - 1, side="right")
        skip = a - (upto[i] - count[i])
        at, held = starts[i : j + 1].copy(), sizes[i : j + 1].copy()
        at[0], held[0] = at[0] + skip * PASSAGE, held[0] - skip * PASSAGE
        over = upto[j] - b
        if over:
            held[-1] = (count[j] - over - (skip if i == j else 0)) * PASSAGE
        rows, width, here = text_passages(data, at, held)
        h, e = model.encode(np.clip(features(rows, width), -1e6, 1e6))
        first = np.cumsum(here) - here
        now = np.maximum(top[i : j + 1], np.maximum.reduceat(e, first))
        w = np.exp(e - np.repeat(now, here))
        past = np.exp(np.where(np.isinf(top[i : j + 1]), -np.inf, top[i : j + 1] - now))
        weight[i : j + 1] = weight[i : j + 1] * past + np.add.reduceat(w, first)
        z[i : j + 1] = z[i : j + 1] * past[:, None] + np.add.reduceat(w[:, None] * h, first)
        top[i : j + 1] = now
    return model.bag(z / weight[:, None]) if n else np.zeros(0)


def _clean(df: DataFrame, text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", train_docs: int = 6000) -> Model:
    """Fit on at most ``train_docs`` label rows, those with the smallest key hashes."""
    sample = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(label).cast("double").alias("__y"))
    sample = sample.orderBy(F.xxhash64("__key"), "__key", "__y").limit(train_docs)
    rows = docs.select(F.col(key).alias("__k"), _clean(docs, text).alias("__t")).join(F.broadcast(sample), F.col("__k") == F.col("__key"))

    def describe(batches):
        for batch in batches:
            data, starts, sizes = _bytes_of(batch.column("__t"))
            out = []
            for a, s in zip(starts.tolist(), sizes.tolist()):
                parts = []
                for at in range(a, a + max(s, 1), BLOCK * PASSAGE):
                    rows, width, _ = text_passages(data, np.array([at]), np.array([min(BLOCK * PASSAGE, a + s - at)]))
                    parts.append(features(rows, width).tobytes())
                out.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([batch.column("__k").cast(pa.int64()), batch.column("__y"), pa.array(out, pa.binary())], names=["k", "y", "x"])

    got = rows.select(F.xxhash64("__k").alias("__k"), "__y", "__t").mapInArrow(describe, "k bigint, y double, x binary").toPandas()
    got = got.assign(n=got["x"].map(len)).sort_values(["k", "y", "n"], kind="stable")
    x = [np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for b in got["x"]]
    return fit(np.concatenate(x).astype(np.float64) if x else np.zeros((0, N_FEATURES)), np.array([len(a) for a in x], np.int64), got["y"].to_numpy())


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``score`` (double, 0 to 1: the chance of label 1)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = without(docs, "score").withColumn("__t", _clean(docs, text))
    kept = kept if keep_text else without(kept, text)
    names = [c for c in kept.columns if c != "__t"]

    def run(batches):
        for batch in batches:
            got = score_texts(*_bytes_of(batch.column("__t")), sent.value)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(np.round(got, 6))], names=[*names, "score"])

    return kept.mapInArrow(run, T.StructType([*[kept.schema[c] for c in names], T.StructField("score", T.DoubleType())]))


def fold(key: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key falls into fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds, F.lit(0)).cast("int")
