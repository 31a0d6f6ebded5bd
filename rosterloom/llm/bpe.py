"""Byte-level BPE encoding and decoding on padded numpy matrices.

``encode`` finds the pieces of a batch of texts with array operations on code points, keeps each
distinct piece once, and merges all of them together: pieces of like length share a padded matrix,
every row merges its leftmost minimum-rank pair each round through a hashed pair table, and
finished rows leave the matrix. A piece of ``LONG_PIECE`` bytes or more is a matrix of one row whose
rounds merge all pairs of the least rank that come next in that order. ``decode`` turns ids back into bytes.

Defined results: a null text is the empty text and gives no ids; an empty table gives an empty
table; equal texts give equal ids wherever they stand; texts are never cut. ``token_ids`` (or the
name given) replaces an input column of that name. A null id list decodes to empty bytes; ids
outside the vocabulary raise.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import without

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
NO_RANK = np.int32(2**31 - 1)
#: Bytes from which a piece is a matrix of one row, which merges many pairs in a round.
LONG_PIECE = 512
#: Characters worked on at once in a task; a longer text makes a group of its own.
GROUP_CHARS = 400_000
#: Ids decoded at once in a task.
GROUP_IDS = 100_000
_HASH = np.uint64(0x9E3779B97F4A7C15)
_kinds: np.ndarray | None = None


def char_kinds() -> np.ndarray:
    """The class of every code point under the split pattern's three properties."""
    global _kinds
    if _kinds is None:
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        table = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}")):
            table[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = kind
        _kinds = table
    return _kinds


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a rank file (base64 token and rank on each line)."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


class Vocabulary:
    """Arrays derived from the ranks; small (a few MB) and sent to executors once."""

    def __init__(self, tokens: list[bytes]):
        ranks = {t: i for i, t in enumerate(tokens) if t}
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self._build(np.fromiter(pairs.keys(), np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing: each key goes to the first free slot after its hash."""
        self.bits = max(8, int(np.ceil(np.log2(max(1, 4 * len(keys))))))
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.full(1 << self.bits, NO_RANK, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        self.probes = 1
        while len(left):
            free = self.keys[slot[left]] == np.iinfo(np.uint64).max
            _, first = np.unique(slot[left], return_index=True)
            take = np.zeros(len(left), bool)
            take[first] = True
            take &= free
            won = left[take]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], values[won]
            left = left[~take]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            self.probes += bool(len(left))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _HASH) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each concatenated pair, NO_RANK where it is no token; negative ids never pair."""
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint32).astype(np.uint64)
        out = np.full(len(keys), NO_RANK, np.int32)
        open_, slot = np.flatnonzero((a >= 0) & (b >= 0)), None
        slot = self._slot(keys[open_])
        for _ in range(self.probes):
            if not len(open_):
                break
            seen = self.keys[slot]
            hit = seen == keys[open_]
            out[open_[hit]] = self.values[slot[hit]]
            go = ~hit & (seen != np.iinfo(np.uint64).max)
            open_, slot = open_[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out


def piece_starts(cps: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Code-point positions at which a piece begins, for texts laid end to end."""
    n = len(cps)
    kind = char_kinds()[cps]
    first = np.zeros(n + 1, bool)
    first[doc_starts] = True
    first[n] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # the last white space before other text: a blank joins what follows, any other stands alone
    tail = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n])
    start[tail] = True
    blank = tail[cps[tail] == 0x20]
    start[blank + 1] = False
    mark = np.flatnonzero((cps == 0x27) & start[:n])
    if len(mark):
        padded = np.concatenate([cps, np.zeros(3, cps.dtype)])
        ends = np.append(doc_starts, n)
        room = ends[np.searchsorted(ends, mark, side="right")] - mark - 1
        one, two = padded[mark + 1], padded[mark + 2]
        single = np.isin(one, [ord(c) for c in "stmd"]) & (room >= 1)
        double = (room >= 2) & (((np.isin(one, [ord("r"), ord("v")])) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for hits, size in ((single, 1), (double & ~single, 2)):
            at = mark[hits]
            start[at + 1] = False
            after = at + 1 + size
            after = after[after < n]
            start[after] |= ~space[after] | first[after] | (kind[after] != kind[after - 1])
    return np.flatnonzero(start)


def _distinct(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row of a first occurrence for each distinct tuple of words, and each row's class."""
    mixed = words[0]
    if len(words) > 1:
        mixed = words[0] * _HASH
        for w in words[1:]:
            mixed = (mixed ^ (mixed >> np.uint64(29)) ^ w) * _HASH
    _, first, inverse = np.unique(mixed, return_index=True, return_inverse=True)
    if len(words) > 1 and any((w[first][inverse] != w).any() for w in words):
        order = np.lexsort(words)
        new = np.concatenate([[True], np.any([w[order][1:] != w[order][:-1] for w in words], axis=0)])
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        first = order[new]
    return first, inverse


def merge_rows(rows: np.ndarray, lengths: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of padded byte rows: (matrix of ids, ids in each row)."""
    n, width = rows.shape
    out, counts = vocabulary.byte_ids[rows], lengths.astype(np.int64).copy()
    columns = np.arange(width)
    out[columns[None, :] >= lengths[:, None]] = -1
    if width < 2 or not n:
        return out, counts
    live, ids = np.arange(n), out.copy()
    ranks = vocabulary.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
    while len(live):
        at = ranks.argmin(axis=1)
        best = ranks[np.arange(len(live)), at]
        go = best != NO_RANK
        if not go.all():
            out[live[~go], : ids.shape[1]], out[live[~go], ids.shape[1] :] = ids[~go], -1
            live, ids, ranks, at, best = live[go], ids[go], ranks[go], at[go], best[go]
            if not len(live):
                break
        k, w = np.arange(len(live)), ids.shape[1]
        ids[k, at] = best
        counts[live] -= 1
        move = np.minimum(np.arange(w)[None, :] + (np.arange(w)[None, :] > at[:, None]), w - 1)
        ids = np.take_along_axis(ids, move, 1)
        ids[:, -1] = -1
        ranks = np.take_along_axis(ranks, move[:, : w - 1].clip(max=w - 2), 1)
        ranks[:, -1] = NO_RANK
        inner = at < w - 1
        ranks[k[inner], at[inner]] = vocabulary.pair_ranks(ids[k[inner], at[inner]], ids[k[inner], at[inner] + 1])
        left = at > 0
        ranks[k[left], at[left] - 1] = vocabulary.pair_ranks(ids[k[left], at[left] - 1], ids[k[left], at[left]])
        most = int(counts[live].max())
        if most < w and most > 1:  # columns that every row has left empty
            ids, ranks = ids[:, :most], ranks[:, : most - 1]
        elif most <= 1:
            out[live, :1], out[live, 1:] = ids[:, :1], -1
            break
    return out, counts


def merge_long(piece: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """The ids of one long row: the merges of ``merge_rows``, many in a round.

    A round takes the least rank and merges all its pairs from the left, as far as merging them one
    by one would do: it stops after the first merge that makes a pair of lower rank, which then is
    next.
    """
    ids = vocabulary.byte_ids[piece]
    ranks = vocabulary.pair_ranks(ids[:-1], ids[1:])
    while len(ranks) and (best := ranks.min()) != NO_RANK:
        at = np.flatnonzero(ranks == best)
        order = np.arange(len(at))
        run = np.ones(len(at), bool)
        run[1:] = at[1:] != at[:-1] + 1
        at = at[(order - np.maximum.accumulate(np.where(run, order, 0))) % 2 == 0]  # of overlapping pairs every second
        token = np.full(len(at), best, ids.dtype)
        right = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
        left = np.where(at > 0, ids[np.maximum(at - 1, 0)], -1)
        left[1:] = np.where(at[1:] == at[:-1] + 2, best, left[1:])
        early = np.flatnonzero((vocabulary.pair_ranks(token, right) < best) | (vocabulary.pair_ranks(left, token) < best))
        if len(early):
            at = at[: early[0] + 1]
        stay = np.ones(len(ids), bool)
        stay[at + 1] = False
        ids[at] = best
        place = at - np.arange(len(at))  # of the merged tokens after the others have gone
        ids, ranks = ids[stay], ranks[stay[1:]]
        for fresh in (place, place - 1):
            fresh = fresh[(fresh >= 0) & (fresh < len(ids) - 1)]
            ranks[fresh] = vocabulary.pair_ranks(ids[fresh], ids[fresh + 1])
    return ids


def _encode_pieces(buffer: np.ndarray, at: np.ndarray, size: np.ndarray, vocabulary: Vocabulary):
    """Class of every piece, and the ids of the classes as (flat, start, count)."""
    classes = np.empty(len(at), np.int64)
    flats, counts, base = [], [], 0
    padded = np.concatenate([buffer, np.zeros(40, np.uint8)])
    word = np.ndarray((len(buffer) + 32,), "<u8", padded, strides=(1,))
    keep = np.array([(1 << 8 * k) - 1 for k in range(8)], np.uint64)

    def add(rows: np.ndarray, first: np.ndarray, inverse: np.ndarray, width: int) -> None:
        nonlocal base
        a, s = at[rows[first]], size[rows[first]]
        spread = a[:, None] + np.arange(width)[None, :]
        matrix = padded[np.minimum(spread, len(padded) - 1)]
        got, n = merge_rows(matrix, s, vocabulary)
        flats.append(got[np.arange(got.shape[1])[None, :] < n[:, None]])
        counts.append(n)
        classes[rows] = inverse + base
        base += len(n)

    for words in (1, 2, 3):
        rows = np.flatnonzero((size >= 8 * (words - 1)) & (size < 8 * words))
        if len(rows):
            tail = size[rows] - 8 * (words - 1)
            keys = [word[at[rows] + 8 * k] for k in range(words - 1)]
            last = word[at[rows] + 8 * (words - 1)] & keep[tail]
            first, inverse = _distinct([*keys, last | (tail.astype(np.uint64) << np.uint64(56))])
            add(rows, first, inverse, max(1, int(size[rows].max())))
    rows = np.flatnonzero(size >= 24)
    if len(rows):
        seen: dict[bytes, int] = {}
        raw = buffer.tobytes()
        inverse = np.array([seen.setdefault(raw[a : a + s], len(seen)) for a, s in zip(at[rows].tolist(), size[rows].tolist())], np.int64)
        first = np.unique(inverse, return_index=True)[1]
        lengths = size[rows[first]]
        width = 32
        while width < 2 * LONG_PIECE:
            part = np.flatnonzero((lengths <= width) & (lengths > width // 2) & (lengths < LONG_PIECE))
            if len(part):
                picked = np.flatnonzero(np.isin(inverse, part))
                _, once, again = np.unique(inverse[picked], return_index=True, return_inverse=True)
                add(rows[picked], once, again, width)
            width *= 2
        for k in np.flatnonzero(lengths >= LONG_PIECE):
            a, s = at[rows[first[k]]], lengths[k]
            ids = merge_long(buffer[a : a + s], vocabulary)
            flats.append(ids)
            counts.append(np.array([len(ids)]))
            classes[rows[inverse == k]] = base
            base += 1
    flat = np.concatenate(flats) if flats else np.zeros(0, np.int32)
    count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return classes, flat, np.cumsum(count) - count, count


def gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The slices flat[start : start + count] end to end."""
    ends = np.cumsum(count)
    return flat[np.repeat(start - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)]


def encode_texts(texts: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, number of ids of each text)."""
    chars = np.array([len(t) for t in texts], np.int64)
    joined = "".join(texts)
    if not joined:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum(chars)
    starts = piece_starts(cps, np.unique((ends - chars)[chars > 0]))
    width = (1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000)).astype(np.int8)
    at_byte = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
    at = at_byte[starts]
    size = np.diff(np.append(at, at_byte[-1]))
    classes, flat, start, count = _encode_pieces(np.frombuffer(joined.encode("utf-8"), np.uint8), at, size, vocabulary)
    ids = gather(flat, start[classes], count[classes])
    upto = np.concatenate([[0], np.cumsum(count[classes])])
    first_piece = np.searchsorted(starts, np.concatenate([[0], ends]))
    return ids.astype(np.int32), np.diff(upto[first_piece])


def groups(lengths: list[int], most: int = GROUP_CHARS):
    """Slices of consecutive rows with at most ``most`` characters each, or one row."""
    a, held = 0, 0
    for i, n in enumerate(lengths):
        if i > a and held + n > most:
            yield slice(a, i)
            a, held = i, 0
        held += n
    if a < len(lengths):
        yield slice(a, len(lengths))


def encode(df: DataFrame, ranks_path: str, text: str = "text", ids: str = "token_ids", keep_text: bool = True) -> DataFrame:
    """``df`` with ``ids`` (array<int>), the tokens of the whole text; all other columns stay.

    ``keep_text=False`` leaves the text column behind, which halves what tasks hand back.
    """
    vocabulary = df.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(ranks_path)))
    kept = without(df, ids).withColumn("__piece_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    kept = kept if keep_text else without(kept, text)
    names = [c for c in kept.columns if c != "__piece_text"]
    schema = T.StructType([*[kept.schema[c] for c in names], T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("__piece_text"))
            rest = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != "__piece_text"]
            lengths = pa.compute.utf8_length(column).to_pylist()
            for part in groups(lengths):
                got, n = encode_texts(column[part].to_pylist(), vocabulary.value)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(got, pa.int32()))
                yield pa.RecordBatch.from_arrays([*[x[part] for x in rest], lists], names=[*names, ids])

    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with ``decoded`` (binary), the bytes of the ids; all other columns stay."""
    vocabulary = df.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(ranks_path)))
    kept = without(df, decoded)
    schema = T.StructType([*kept.schema.fields, T.StructField(decoded, T.BinaryType(), False)])

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            counts = pa.compute.fill_null(pa.compute.list_value_length(batch.column(at)), 0).to_pylist()
            for part in groups(counts, GROUP_IDS):
                rows = batch.slice(part.start, part.stop - part.start)
                v, tokens = vocabulary.value, rows.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if len(tokens) and (tokens.min() < 0 or tokens.max() >= len(v.lengths) or not v.lengths[tokens].all()):
                    raise ValueError("an id is not in the vocabulary")
                size = v.lengths[tokens]
                upto = np.concatenate([[0], np.cumsum(size)])
                offsets = upto[np.concatenate([[0], np.cumsum(counts[part])]).astype(np.int64)].astype(np.int64)
                data = gather(v.flat, v.starts[tokens], size)
                out = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([*rows.columns, out.cast(pa.binary())], names=[*rows.schema.names, decoded])

    return kept.mapInArrow(run, schema)
