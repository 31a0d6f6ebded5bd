"""Audio columns: lossless 8-bit storage, log-mel features and energy segments.

``store`` writes bytes as the samples of an 8-bit mono WAV file. ``describe`` reads stored files
back and computes features in bounded blocks: polyphase resampling, overlapped windows, log-mel
filterbanks and a hysteresis over the frame energies. Features come as an Arrow stream whose
``mel`` column is a fixed-shape tensor of ``TENSOR_FRAMES`` by ``MELS``, each with its time span.

Defined results: a null text is the empty text; a text is padded with blanks to a positive multiple
of ``UNIT`` bytes, so no file is empty; the last tensor is padded with ``FLOOR``; equal texts give
equal bytes and features; bytes that are no such WAV file raise; a row whose stored media are null
stays, with null features; an empty table gives an empty table. The columns that the functions add replace input columns of the same names.
"""

from __future__ import annotations

import io
import wave
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import without

UNIT = 192
RATE, TO_RATE = 16_000, 12_000
UP, DOWN = 3, 4
TAPS = 16
WINDOW, HOP, MELS = 256, 128, 40
TENSOR_FRAMES = 64
FLOOR = -10.0
#: Frames computed at once, about 0.7 MB of samples.
BLOCK = 4096
#: A segment opens above the mean energy plus OPEN deviations and closes below it by CLOSE.
OPEN, CLOSE = 0.5, -0.5


def pad(data: bytes) -> bytes:
    return data + b" " * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as f:
        if (f.getnchannels(), f.getsampwidth(), f.getframerate()) != (1, 1, RATE):
            raise ValueError("not an 8-bit mono file of the expected rate")
        return f.readframes(f.getnframes())


@cache
def phase_filters() -> np.ndarray:
    """A windowed-sinc low pass of UP * TAPS points, split into UP phases."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    cut = 0.5 / max(UP, DOWN)
    h = 2 * cut * np.sinc(2 * cut * n) * np.hamming(UP * TAPS) * UP
    return h.reshape(TAPS, UP).T[:, ::-1].astype(np.float32).copy()


def resampled_size(samples: int) -> int:
    return -(-samples * UP // DOWN)


def resample(samples: np.ndarray, first: int, count: int) -> np.ndarray:
    """Outputs first .. first + count of the resampled signal (first a multiple of UP)."""
    groups = -(-count // UP)
    base = first // UP * DOWN
    a, b = base - TAPS + 1, base + groups * DOWN + 1
    part = np.zeros(b - a, np.float32)
    lo, hi = max(a, 0), min(b, len(samples))
    if hi > lo:
        part[lo - a : hi - a] = samples[lo:hi].astype(np.float32) / 128 - 1
    out = np.empty((groups, UP), np.float32)
    for j in range(UP):
        shift, phase = j * DOWN // UP, j * DOWN % UP
        windows = np.lib.stride_tricks.sliding_window_view(part[shift:], TAPS)[: groups * DOWN : DOWN]
        out[:, j] = windows @ phase_filters()[phase]
    return out.reshape(-1)[:count]


@cache
def mel_filters() -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60), mel(TO_RATE / 2), MELS + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(WINDOW, 1 / TO_RATE)
    up = (bins[None, :] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - bins[None, :]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)).T.astype(np.float32).copy()


def log_mel(samples: np.ndarray):
    """Blocks of (log-mel frames, frame energies in log10 units)."""
    size = resampled_size(len(samples))
    frames = max(1, 1 + -(-max(0, size - WINDOW) // HOP))
    window = np.hanning(WINDOW).astype(np.float32)
    for f in range(0, frames, BLOCK):
        n = min(BLOCK, frames - f)
        first, count = f * HOP, (n - 1) * HOP + WINDOW
        start = first // UP * UP
        signal = np.zeros(count, np.float32)
        got = resample(samples, start, max(0, min(count + first - start, size - start)))[first - start :]
        signal[: len(got)] = got
        power = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(signal, WINDOW)[::HOP] * window, axis=1)).astype(np.float32) ** 2
        yield np.log10(np.maximum(power @ mel_filters(), 1e-10)), np.log10(np.maximum(power.sum(axis=1), 1e-10))


def segments(energy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end frames of the active stretches: opened by loud frames, held until a quiet one."""
    middle, spread = energy.mean(), energy.std()
    say = np.where(energy > middle + OPEN * spread, 1, np.where(energy < middle + CLOSE * spread, 0, -1))
    last = np.maximum.accumulate(np.where(say >= 0, np.arange(len(say)), -1))
    on = np.concatenate([[0], np.where(last >= 0, say[last], 0), [0]])
    return np.flatnonzero(np.diff(on) == 1), np.flatnonzero(np.diff(on) == -1)


def tensor_stream(mel: np.ndarray) -> bytes:
    """An Arrow stream: start_s, end_s and the frames as float16 tensors of fixed shape."""
    n = -(-len(mel) // TENSOR_FRAMES)
    full = np.full((n * TENSOR_FRAMES, MELS), FLOOR, np.float16)
    full[: len(mel)] = mel
    flat = pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), TENSOR_FRAMES * MELS)
    tensors = pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float16(), (TENSOR_FRAMES, MELS)), flat)
    start = np.arange(n) * TENSOR_FRAMES * HOP / TO_RATE
    end = (np.minimum((np.arange(n) + 1) * TENSOR_FRAMES, len(mel)) * HOP + WINDOW - HOP) / TO_RATE
    batch = pa.RecordBatch.from_arrays([pa.array(start), pa.array(end), tensors], names=["start_s", "end_s", "mel"])
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as f:
        f.write_batch(batch)
    return out.getvalue()


def read_tensors(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(stream).read_all()


def store(df: DataFrame, text: str = "text", media: str = "media", keep_text: bool = False) -> DataFrame:
    """``df`` with ``n_bytes`` (bigint, unpadded) and ``media`` (binary, a WAV file)."""
    kept = without(df, media, "n_bytes").withColumn("__t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    kept = kept if keep_text else without(kept, text)
    names = [c for c in kept.columns if c != "__t"]

    def run(batches):
        for batch in batches:
            raw = batch.column("__t").cast(pa.binary()).to_pylist()
            files = [to_wav(pad(x)) for x in raw]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array([len(x) for x in raw], pa.int64()), pa.array(files, pa.binary())], names=[*names, "n_bytes", media])

    return kept.mapInArrow(run, T.StructType([*[kept.schema[c] for c in names], T.StructField("n_bytes", T.LongType()), T.StructField(media, T.BinaryType())]))


ADDED = T.StructType([
    T.StructField("payload", T.BinaryType()),
    T.StructField("n_frames", T.LongType()),
    T.StructField("segments", T.ArrayType(T.StructType([T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())]))),
    T.StructField("tensors", T.BinaryType()),
])


def describe(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with ``payload`` (the samples read back), ``n_frames``, ``segments`` and ``tensors``."""
    kept = without(df, *ADDED.names)
    names = kept.columns

    def one(file: bytes | None) -> tuple:
        if file is None:
            return (None,) * len(ADDED)
        payload = from_wav(file)
        parts = list(log_mel(np.frombuffer(payload, np.uint8)))
        energy = np.concatenate([e for _, e in parts])
        start, end = segments(energy)
        spans = [{"start_s": a * HOP / TO_RATE, "end_s": (b * HOP + WINDOW - HOP) / TO_RATE} for a, b in zip(start.tolist(), end.tolist())]
        return payload, len(energy), spans, tensor_stream(np.concatenate([m for m, _ in parts]))

    def run(batches):
        kinds = [pa.binary(), pa.int64(), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])), pa.binary()]
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                got = [one(x) for x in part.column(media).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(x, k) for x, k in zip(zip(*got), kinds)]], names=[*names, *ADDED.names])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *ADDED.fields]))
