"""Language of texts and of spans in mixed texts: scripts, word scores and a Viterbi path.

A word is a run of letters. Its script narrows the candidate languages, character trigrams and the
whole word score it under each, and the best path over the words of a text, with a penalty for
every switch of language, labels spans. Word scores and paths are computed for many texts together
with array operations: texts are cut into chunks of ``CHUNK`` words, each chunk is solved for every
language of its first word, chunk results are joined in order, and the path is then read back, so
the result is the best path of the whole text and a text may have any length.

The model is fitted on a bounded sample of labelled texts (``train_docs``, those with the smallest
key hashes); counts are folded in the tasks and only their sums reach the driver.

Defined results: texts that are null or without a letter get ``und``, score 0 and no span; without
any labelled text every text is ``und``; ties go to the language first in order; the score is the
share of the text's letters in spans of the predicted language; an empty table gives an empty
table. ``lang_pred``, ``lang_score`` and ``spans`` replace input columns of these names. Spans
count characters of the lower-cased text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import LETTER, char_kinds, groups
from .common import without

#: First code points of script ranges and the script that begins there.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "burmese"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"),
    (0x1800, "mongolian"), (0x1900, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1D00, "latin"),
    (0x1F00, "greek"), (0x2000, "latin"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"),
    (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7FC, "other"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"),
    (0x10000, "other"), (0x20000, "han"), (0x32000, "other"),
]
NAMES = sorted({name for _, name in SCRIPTS})
_FIRST = np.array([a for a, _ in SCRIPTS], np.uint32)
_SCRIPT = np.array([NAMES.index(name) for _, name in SCRIPTS], np.int64)
GRAMS, WORDS = 1 << 16, 1 << 17
CHUNK = 256
#: Log-odds that one more switch of language costs.
PENALTY = 8.0
#: A script is a language's own if it has this share of the language's letters.
SCRIPT_SHARE = 0.01
GROUP_CHARS = 3_000_000
_A, _B = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


@dataclass
class Words:
    """The words of texts laid end to end: letter rows, and for each word its place and text."""

    grams: np.ndarray
    first: np.ndarray
    size: np.ndarray
    word: np.ndarray
    script: np.ndarray
    place: np.ndarray
    text: np.ndarray


def find_words(texts: list[str]) -> Words:
    texts = [t.lower() for t in texts]
    chars = np.array([len(t) for t in texts], np.int64)
    cps = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)
    starts = np.cumsum(chars + 1) - chars - 1
    letter = char_kinds()[cps] == LETTER
    edge = np.flatnonzero(np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    at = np.flatnonzero(letter)
    c = np.where(letter, cps, 0).astype(np.uint32)
    before, after = np.concatenate([[0], c[:-1]]).astype(np.uint32), np.concatenate([c[1:], [0]]).astype(np.uint32)
    mixed = ((before[at] * _A + c[at]) * _B) ^ (after[at] * _A)
    grams = ((mixed * _B) >> np.uint32(32 - 16)).astype(np.int64)
    size = end - begin
    first = np.cumsum(size) - size
    nth = (np.arange(len(at)) - np.repeat(first, size)).astype(np.uint32)
    spread = (c[at] + np.uint32(1)) * ((nth * np.uint32(2) + np.uint32(1)) * _A) ^ (nth * _B)
    word = np.add.reduceat(spread, first, dtype=np.uint32) if len(first) else np.zeros(0, np.uint32)
    word = ((word * _B) >> np.uint32(32 - 17)).astype(np.int64)
    script = _SCRIPT[np.searchsorted(_FIRST, cps[begin], side="right") - 1]
    text = np.searchsorted(starts, begin, side="right") - 1
    return Words(grams, first, size, word, script, begin - starts[text], text)


@dataclass
class Model:
    langs: list[str]
    grams: np.ndarray
    words: np.ndarray
    allowed: np.ndarray

    def word_scores(self, w: Words) -> np.ndarray:
        """Log-odds of every word under every language, against the mean of all."""
        if not len(w.first):
            return np.zeros((0, len(self.langs)), np.float32)
        scores = np.add.reduceat(self.grams[w.grams], w.first, axis=0) + self.words[w.word]
        scores += np.where(self.allowed[w.script], 0, -1e4).astype(np.float32)
        return scores


def learn(counts: np.ndarray, langs: list[str]) -> Model:
    """``counts``: for each language, trigram buckets, word buckets and letters by script."""

    def logs(part: np.ndarray, smooth: float) -> np.ndarray:
        if not len(part):
            return np.zeros((part.shape[1], 0), np.float32)
        p = (part + smooth) / (part.sum(axis=1, keepdims=True) + smooth * part.shape[1])
        out = np.log(p)
        return (out - out.mean(axis=0)).T.astype(np.float32).copy()

    scripts = counts[:, GRAMS + WORDS :]
    own = (scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=1, keepdims=True))).T
    own = np.where(own.any(axis=1, keepdims=True), own, True)
    return Model(langs, logs(counts[:, :GRAMS], 0.5) * 0.5, logs(counts[:, GRAMS : GRAMS + WORDS], 0.5) * 0.5, own)


def _advance(value: np.ndarray, penalty: float) -> np.ndarray:
    """The best value before each language: staying, or switching from the best."""
    return np.maximum(value, value.max(axis=-1, keepdims=True) - penalty)


def best_paths(scores: np.ndarray, words: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The language of each word on the best path of each text; ``words`` words a text, in order."""
    n, langs = scores.shape
    chunks = -(-words // CHUNK)
    owner = np.repeat(np.arange(len(words)), chunks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    start = (np.cumsum(words) - words)[owner] + nth * CHUNK
    size = np.minimum(CHUNK, words[owner] - nth * CHUNK)
    order = np.argsort(-size, kind="stable")
    active = np.searchsorted(-size[order], -np.arange(CHUNK), side="left")  # chunks with over t words
    start_o = start[order]
    through = np.full((len(order), langs, langs), -np.inf, np.float32)  # first language, last language
    if len(order):
        through[:, np.arange(langs), np.arange(langs)] = scores[start_o]
    for t in range(1, CHUNK):
        k = active[t]
        if not k:
            break
        through[:k] = _advance(through[:k], penalty) + scores[start_o[:k] + t][:, None, :]
    table = np.empty_like(through)
    table[order] = through
    # join the chunks of each text, all texts side by side
    entry, leave = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
    lead = np.cumsum(chunks) - chunks
    deep = np.argsort(-chunks, kind="stable")
    live = [deep[: np.searchsorted(-chunks[deep], -k, side="left")] for k in range(int(chunks.max()) if len(chunks) else 0)]
    value, froms, firsts = np.zeros((len(words), langs), np.float32), [], []
    for k, docs in enumerate(live):
        into = np.zeros((len(docs), langs), np.float32)
        if k:
            top = value[docs].argmax(axis=1)
            best = value[docs].max(axis=1, keepdims=True)
            stay = value[docs] >= best - penalty
            froms.append(np.where(stay, np.arange(langs)[None, :], top[:, None]))
            into = np.where(stay, value[docs], best - penalty)
        whole = into[:, :, None] + table[lead[docs] + k]
        firsts.append(whole.argmax(axis=1))
        value[docs] = whole.max(axis=1)
    last = value.argmax(axis=1)
    for k in range(len(live) - 1, -1, -1):
        docs = live[k]
        leave[lead[docs] + k] = last[docs]
        entry[lead[docs] + k] = firsts[k][np.arange(len(docs)), last[docs]]
        if k:
            last[docs] = froms[k - 1][np.arange(len(docs)), entry[lead[docs] + k]]
    return _read_back(scores, start_o, active, entry[order], leave[order], penalty, n)


def _read_back(scores, start, active, entry, leave, penalty, n) -> np.ndarray:
    """The path inside chunks of which the first and last language are known."""
    langs = scores.shape[1]
    value = np.full((len(start), langs), -np.inf, np.float32)
    value[np.arange(len(start)), entry] = scores[start, entry] if len(start) else 0
    steps = []
    for t in range(1, CHUNK):
        k = active[t]
        if not k:
            break
        v = value[:k]
        top = v.argmax(axis=1)
        best = v[np.arange(k), top][:, None] - penalty
        stay = v >= best
        steps.append(np.where(stay, np.arange(langs, dtype=np.int16)[None, :], top[:, None].astype(np.int16)))
        value[:k] = np.where(stay, v, best) + scores[start[:k] + t]
    path, now = np.zeros(n, np.int64), leave.copy()
    for t in range(len(steps), 0, -1):
        k = active[t]
        path[start[:k] + t] = now[:k]
        now[:k] = steps[t - 1][np.arange(k), now[:k]]
    path[start] = now
    return path


def label_texts(texts: list[str], model: Model, penalty: float = PENALTY):
    """For each text: (language position or -1, share, span rows of (start, end, language, text))."""
    w = find_words(texts)
    words = np.bincount(w.text, minlength=len(texts)) if len(w.text) else np.zeros(len(texts), np.int64)
    if not model.langs or not len(w.first):
        return np.full(len(texts), -1), np.zeros(len(texts)), np.zeros((0, 4), np.int64)
    path = best_paths(model.word_scores(w), words, penalty)
    n = len(model.langs)
    letters = np.bincount(w.text * n + path, weights=w.size, minlength=len(texts) * n).reshape(len(texts), n)
    total = letters.sum(axis=1)
    lang = np.where(total > 0, letters.argmax(axis=1), -1)
    share = np.where(total > 0, letters.max(axis=1) / np.maximum(1, total), 0.0)
    new = np.ones(len(path), bool)
    new[1:] = (path[1:] != path[:-1]) | (w.text[1:] != w.text[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(path)) - 1
    return lang, share, np.stack([w.place[begin], w.place[end] + w.size[end], path[begin], w.text[begin]], axis=1)


def train(docs: DataFrame, lang: str = "lang", key: str = "doc_id", text: str = "text", train_docs: int = 4000) -> Model:
    """Fit on the texts of at most ``train_docs`` labelled rows, those with the smallest key hashes."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("t"))
    sample = rows.select("k").orderBy(F.xxhash64("k"), "k").limit(train_docs).distinct()
    rows = rows.join(F.broadcast(sample), "k", "left_semi").select("lang", "t")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names, texts = batch.column("lang").to_pylist(), batch.column("t").to_pylist()
            for part in groups([len(t) for t in texts], GROUP_CHARS):
                w = find_words(texts[part])
                labels = np.array(names[part], object)
                for name in set(names[part]):
                    mine = (labels == name)[w.text]
                    row = sums.setdefault(name, np.zeros(GRAMS + WORDS + len(NAMES), np.int64))
                    row[:GRAMS] += np.bincount(w.grams[np.repeat(mine, w.size)], minlength=GRAMS)
                    row[GRAMS : GRAMS + WORDS] += np.bincount(w.word[mine], minlength=WORDS)
                    row[GRAMS + WORDS :] += np.bincount(w.script[mine], weights=w.size[mine], minlength=len(NAMES)).astype(np.int64)
        for name, row in sums.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at])], names=["lang", "at", "n"])

    sums = rows.mapInArrow(count, "lang string, at int, n bigint").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    got = sums.toPandas()
    langs = sorted(got["lang"].unique().tolist())
    counts = np.zeros((len(langs), GRAMS + WORDS + len(NAMES)))
    counts[got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=np.int64), got["at"].to_numpy(dtype=np.int64)] = got["n"]
    return learn(counts, langs)


def label(docs: DataFrame, model: Model, text: str = "text", penalty: float = PENALTY, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` and ``spans`` (array of start, end, lang)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = without(docs, "lang_pred", "lang_score", "spans").withColumn("__t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    kept = kept if keep_text else without(kept, text)
    names = [c for c in kept.columns if c != "__t"]
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())])
    schema = T.StructType([*[kept.schema[c] for c in names], T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])
    most = max(100_000, GROUP_CHARS * 16 // max(4, len(model.langs)) ** 2)

    def run(batches):
        for batch in batches:
            texts = batch.column("__t").to_pylist()
            for part in groups([len(t) for t in texts], most):
                lang, share, spans = label_texts(texts[part], sent.value, penalty)
                known = np.array([*sent.value.langs, "und"], object)
                offsets = np.searchsorted(spans[:, 3], np.arange(len(lang) + 1)).astype(np.int32)
                inner = pa.StructArray.from_arrays([pa.array(spans[:, 0]), pa.array(spans[:, 1]), pa.array(known[spans[:, 2]], pa.string())], names=["start", "end", "lang"])
                added = [pa.array(known[lang], pa.string()), pa.array(np.round(share, 6)), pa.ListArray.from_arrays(pa.array(offsets), inner)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c)[part] for c in names], *added], names=[*names, "lang_pred", "lang_score", "spans"])

    return kept.mapInArrow(run, schema)
