"""Suffix order and common-prefix lengths of one shard by external induced sorting.

Suffixes are typed as falling (L) or rising (S). The leftmost rising ones are the seeds. Their
substrings are named by an external sort, and where names repeat, the sequence of names is a shorter
text that is sorted in the same way, down to a sequence that fits the memory parameter. Two scans
then induce all other suffixes from the ordered seeds, the L suffixes upwards and the S suffixes
downwards. Both scans are driven by a priority queue on disk: an entry is a suffix tuple, made of
its first symbol (the key), its place, the length that it shares with the entry before it, and the
symbols that stand before it, so that no scan goes back to the text for each suffix. Shared lengths
are carried through the recursion (so many names, then the symbols of the names that differ) and
through the induction: a length is one more than the least between the two inducing suffixes, and
those least values are kept for each possible length, of which there are as many as the cap.

``memory`` is the number of rows that the queue, a log or a sort may hold; what goes beyond it lies
in files of one temporary folder of the task, which is deleted with the sort. Nobody but the task
reads them. Shards of fewer symbols than that never touch the disk.
"""

from __future__ import annotations

import heapq
import os
import tempfile
from collections.abc import Iterator

import numpy as np

SEPARATOR = 1
#: Bits of a symbol of a byte text: 256 bytes, the separator and zero for the end.
BYTE_BITS = 9
#: Runs on disk that a queue keeps before it merges them.
FAN = 16


def join_parts(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, starts) of byte strings laid end to end, each closed by a separator."""
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    starts = np.cumsum(sizes) - sizes
    symbols = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int16) + 2
    symbols[starts + sizes - 1] = SEPARATOR
    return symbols, starts


class Scratch:
    """Arrays in memory up to ``memory`` rows, and files of one temporary folder beyond."""

    def __init__(self, memory: int):
        self.memory, self.folder, self.files = memory, None, 0

    def path(self) -> str:
        self.folder = self.folder or tempfile.TemporaryDirectory(prefix="suffixes-")
        self.files += 1
        return os.path.join(self.folder.name, str(self.files))

    def array(self, n: int, dtype, fill: int = 0) -> np.ndarray:
        if n <= self.memory:
            return np.full(n, fill, dtype)
        out = np.memmap(self.path(), dtype, "w+", shape=(n,))
        if fill:
            for a in range(0, n, self.memory):
                out[a : a + self.memory] = fill
        return out

    def close(self) -> None:
        if self.folder:
            self.folder.cleanup()


class Log:
    """Rows of int64 columns in the order of their arrival, readable from either end."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.held, self.rows, self.file, self.spots = scratch, [], 0, None, []

    def push(self, rows: np.ndarray) -> None:
        self.held.append(rows)
        self.rows += rows.shape[1]
        if self.rows > self.scratch.memory:
            self.file = self.file or self.scratch.path()
            whole = np.concatenate(self.held, axis=1)
            with open(self.file, "ab") as f:
                for a in range(0, whole.shape[1], self.scratch.memory):
                    part = whole[:, a : a + self.scratch.memory]
                    self.spots.append((f.tell(), part.shape))
                    np.ascontiguousarray(part).tofile(f)
            self.held, self.rows = [], 0

    def _read(self, spot) -> np.ndarray:
        at, shape = spot
        return np.fromfile(self.file, np.int64, shape[0] * shape[1], offset=at).reshape(shape)

    def forwards(self) -> Iterator[np.ndarray]:
        for spot in self.spots:
            yield self._read(spot)
        yield from self.held

    def backwards(self) -> Iterator[np.ndarray]:
        yield from reversed(self.held)
        for spot in reversed(self.spots):
            yield self._read(spot)


class _Run:
    """A sorted file of rows (letter and three more columns), read block by block."""

    def __init__(self, path: str, rows: int, chunk: int, sign: int):
        self.path, self.left, self.chunk, self.sign, self.at = path, rows, chunk, sign, 0
        self.block = np.zeros((0, 4), np.int64)
        self._fill()

    def _fill(self) -> None:
        while not len(self.block) and self.left:
            n = min(self.chunk, self.left)
            self.block = np.fromfile(self.path, np.int64, 4 * n, offset=self.at).reshape(n, 4)
            self.at, self.left = self.at + 32 * n, self.left - n

    @property
    def head(self) -> int | None:
        return int(self.block[0, 0]) if len(self.block) else None

    def take(self, letter: int) -> np.ndarray:
        end = int(np.searchsorted(self.sign * self.block[:, 0], self.sign * letter, side="right"))
        out, self.block = self.block[:end, 1:].T, self.block[end:]
        if not len(self.block):
            self._fill()
        return out


class Queue:
    """Priority queue of suffix tuples (place, shared, symbols before) by their letter.

    The least letter comes first (``sign`` 1) or the greatest (-1), and the oldest among equals.
    Beyond the memory limit, entries lie in sorted runs on disk; runs are older than what is held.
    """

    def __init__(self, scratch: Scratch, chunk: int, sign: int = 1):
        self.scratch, self.chunk, self.sign = scratch, chunk, sign
        self.held: dict[int, list[np.ndarray]] = {}
        self.heap: list[int] = []
        self.size, self.runs = 0, []

    def push(self, letter: int, rows: np.ndarray) -> None:
        parts = self.held.get(letter)
        if parts is None:
            self.held[letter] = [rows]
            heapq.heappush(self.heap, self.sign * letter)
        else:
            parts.append(rows)
        self.size += rows.shape[1]

    def settle(self) -> None:
        """Spills what is over the limit; called between pushes of one batch and the next pop."""
        if self.size <= self.scratch.memory:
            return
        path, rows = self.scratch.path(), 0
        with open(path, "wb") as f:
            for key in sorted(self.held, key=lambda c: self.sign * c):
                for part in self.held[key]:
                    np.vstack([np.full((1, part.shape[1]), key), part]).T.astype(np.int64).tofile(f)
                    rows += part.shape[1]
        self.runs.append(_Run(path, rows, self.chunk, self.sign))
        self.held, self.heap, self.size = {}, [], 0
        if len(self.runs) > FAN:
            self._merge()

    def _merge(self) -> None:
        path, rows = self.scratch.path(), 0
        with open(path, "wb") as f:
            while heads := [r.head for r in self.runs if r.head is not None]:
                letter = self.sign * min(self.sign * h for h in heads)
                for run in self.runs:
                    while run.head == letter:
                        part = run.take(letter)
                        np.vstack([np.full((1, part.shape[1]), letter), part]).T.astype(np.int64).tofile(f)
                        rows += part.shape[1]
        for run in self.runs:
            os.remove(run.path)
        self.runs = [_Run(path, rows, self.chunk, self.sign)]

    def next(self) -> int | None:
        keys = [self.sign * h for r in self.runs if (h := r.head) is not None]
        if self.heap:
            keys.append(self.heap[0])
        return self.sign * min(keys) if keys else None

    def pop(self, letter: int) -> np.ndarray | None:
        """The oldest entries of the letter, which is the next one; None if there are no more."""
        for run in self.runs:
            if run.head == letter:
                return run.take(letter)
        if not self.heap or self.heap[0] != self.sign * letter:
            return None
        parts = self.held[letter]
        n = size = 0
        while n < len(parts) and (not n or size + parts[n].shape[1] <= self.chunk):
            size += parts[n].shape[1]
            n += 1
        out = np.concatenate(parts[:n], axis=1) if n > 1 else parts[0]
        self.size -= size
        if n < len(parts):
            self.held[letter] = parts[n:]
        else:
            del self.held[letter]
            heapq.heappop(self.heap)
        return out


class Sorter:
    """External sort of int64 rows by their first two columns."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.held, self.rows, self.runs = scratch, [], 0, []

    @staticmethod
    def _ordered(rows: np.ndarray) -> np.ndarray:
        return rows[:, np.lexsort((rows[1], rows[0]))]

    def push(self, rows: np.ndarray) -> None:
        self.held.append(rows)
        self.rows += rows.shape[1]
        if self.rows > self.scratch.memory:
            whole, path = self._ordered(np.concatenate(self.held, axis=1)), self.scratch.path()
            np.ascontiguousarray(whole.T).tofile(path)
            self.runs.append([path, whole.shape[1], 0])
            self.held, self.rows, self.columns = [], 0, whole.shape[0]

    def sorted(self) -> Iterator[np.ndarray]:
        if not self.runs:
            if self.held:
                yield self._ordered(np.concatenate(self.held, axis=1))
            return
        if self.held:
            whole, path = self._ordered(np.concatenate(self.held, axis=1)), self.scratch.path()
            np.ascontiguousarray(whole.T).tofile(path)
            self.runs.append([path, whole.shape[1], 0])
            self.held = []
        size = max(1, self.scratch.memory // len(self.runs))
        blocks = [np.zeros((self.columns, 0), np.int64) for _ in self.runs]
        while True:
            for i, (path, rows, at) in enumerate(self.runs):
                if not blocks[i].shape[1] and at < rows:
                    n = min(size, rows - at)
                    blocks[i] = np.fromfile(path, np.int64, n * self.columns, offset=8 * at * self.columns).reshape(n, self.columns).T
                    self.runs[i][2] = at + n
            ends = [(int(b[0, -1]), int(b[1, -1])) for b, r in zip(blocks, self.runs) if b.shape[1] and r[2] < r[1]]
            if not ends:  # every run is in memory to its end
                if any(b.shape[1] for b in blocks):
                    yield self._ordered(np.concatenate(blocks, axis=1))
                return
            low, word = min(ends)  # rows up to the least block end cannot be undercut
            out = []
            for i, b in enumerate(blocks):
                k = int(np.searchsorted(b[0], low, side="left"))
                k += int(np.searchsorted(b[1, k : int(np.searchsorted(b[0], low, side="right"))], word, side="right"))
                out.append(b[:, :k])
                blocks[i] = b[:, k:]
            yield self._ordered(np.concatenate(out, axis=1))


def _least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least of values[a .. b] for each pair a <= b."""
    span = b - a + 1
    level = np.floor(np.log2(span)).astype(np.int64) if len(span) else span
    out = np.empty(len(a), values.dtype)
    table, width = values, 1
    for k in range(int(level.max()) + 1 if len(level) else 0):
        here = level == k
        out[here] = np.minimum(table[a[here]], table[b[here] - width + 1])
        if len(table) > width:
            table = np.minimum(table[:-width], table[width:])
        width *= 2
    return out


def _by_letter(chunks: Iterator[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(letter, rows) stretches of a log whose rows of one letter lie together."""
    for rows in chunks:
        edges = np.flatnonzero(np.diff(rows[0])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), rows.shape[1]]):
            if b > a:
                yield int(rows[0, a]), rows[:, a:b]


class Text:
    """A text of symbols from 1 up, its seeds, and its suffixes in order."""

    def __init__(self, symbols: np.ndarray, cap: int, bits: int, scratch: Scratch, chunk: int):
        self.t, self.n, self.cap, self.bits, self.scratch, self.chunk = symbols, len(symbols), cap, bits, scratch, chunk
        self.span, self.mask = 63 // bits, (1 << bits) - 1
        self.words = None
        if self.n <= scratch.memory:  # the words of all places, in one go
            padded = np.concatenate([symbols.astype(np.int64), np.zeros(self.span, np.int64)])
            self.words = np.zeros(self.n + 1, np.int64)
            for k in range(self.span):
                self.words |= padded[k : self.n + 1 + k] << (bits * (self.span - 1 - k))

    def _symbols(self, at: np.ndarray) -> np.ndarray:
        inside = (at >= 0) & (at < self.n)
        return np.where(inside, self.t[np.clip(at, 0, max(self.n - 1, 0))], 0).astype(np.int64)

    def _word(self, at: np.ndarray) -> np.ndarray:
        """The symbols from each place on, packed; zeros past the end."""
        if self.words is not None:
            return self.words[np.minimum(at, self.n)]
        out = np.zeros(len(at), np.int64)
        for k in range(self.span):
            out |= self._symbols(at + k) << (self.bits * (self.span - 1 - k))
        return out

    def _before(self, at: np.ndarray) -> np.ndarray:
        """The symbols before each place, packed with the nearest lowest; zeros before the start."""
        out = np.zeros(len(at), np.int64)
        for k in range(self.span):
            out |= self._symbols(at - 1 - k) << (self.bits * k)
        return out

    def _seeds(self) -> np.ndarray:
        """Places of the leftmost rising suffixes in order, found block by block from the right."""
        found, later, after = [], False, False  # types of the place after the block and of the one after that border
        upper = self.n
        while upper:
            lower = max(0, upper - self.scratch.memory)
            t = np.asarray(self.t[lower : min(upper + 1, self.n)]).astype(np.int64)
            size = upper - lower
            if len(t) == size:  # the end of the text is smaller than any symbol
                t = np.append(t, 0)
            differs = np.flatnonzero(t[:-1] != t[1:])
            change = np.full(size, size, np.int64)
            change[differs] = differs
            change = np.minimum.accumulate(change[::-1])[::-1]
            known = change < size
            rising = np.full(size, later)
            rising[known] = t[change[known]] < t[change[known] + 1]
            kinds = np.append(rising, after if upper < self.n else False)
            found.append(np.flatnonzero(kinds[1:] & ~kinds[:-1]) + 1 + lower)
            later = after = bool(rising[0])
            upper = lower
        out = self.scratch.array(sum(map(len, found)), np.int64)
        at = 0
        for part in reversed(found):
            out[at : at + len(part)] = part
            at += len(part)
        return out

    def _pieces(self, n: int) -> Iterator[slice]:
        for a in range(0, n, self.chunk):
            yield slice(a, min(a + self.chunk, n))

    def shared(self, a: np.ndarray, b: np.ndarray, at: np.ndarray | int = 0) -> np.ndarray:
        """Common-prefix lengths of pairs of suffixes, up to the cap; the first ``at`` symbols are known to agree."""
        done = np.minimum(np.zeros(len(a), np.int64) + at, self.cap)
        live = np.flatnonzero(done < self.cap)
        while len(live):
            x, y = self._word(a[live] + done[live]), self._word(b[live] + done[live])
            differ = x ^ y
            lead = np.zeros(len(live), np.int64)
            for k in range(self.span):
                lead += (differ >> (self.bits * (self.span - 1 - k))) == 0
            done[live] += lead
            live = live[(lead == self.span) & (done[live] < self.cap)]
        return np.minimum(done, self.cap)

    def _names(self, seeds: np.ndarray) -> tuple[np.ndarray, int]:
        """(rank of each seed's substring from 1 up, equal for equal ones; how many differ)."""
        m = len(seeds)
        rank, distinct = self.scratch.array(m, np.int64), 0
        live, at = Log(self.scratch), 0
        for part in self._pieces(m):
            live.push(np.stack([np.zeros(part.stop - part.start, np.int64), np.arange(part.start, part.stop)]))
        while True:
            sorter = Sorter(self.scratch)
            for old, spot in live.forwards():
                start, following = seeds[spot], np.where(spot + 1 < m, seeds[np.minimum(spot + 1, m - 1)], self.n)
                left = np.clip(following - start + 1 - at, 0, self.span)
                # past its end a substring counts as greater than a longer one that begins alike
                word = self._word(start + at) | np.where(left < self.span, (1 << (self.bits * (self.span - left))) - 1, 0)
                sorter.push(np.stack([old, word, spot, following - start + 1]))
            live, any_left, at = Log(self.scratch), False, at + self.span
            last, base, first_of_word, row = None, 0, 0, 0
            chunks = sorter.sorted()
            rows = next(chunks, None)
            while rows is not None:
                after = next(chunks, None)
                old, word, spot, size = rows
                k = rows.shape[1]
                group, fresh = np.ones(k, bool), np.ones(k, bool)
                group[1:] = old[1:] != old[:-1]
                fresh[1:] = group[1:] | (word[1:] != word[:-1])
                if last is not None:
                    group[0], fresh[0] = old[0] != last[0], (int(old[0]), int(word[0])) != last
                here = np.arange(row, row + k)
                first = np.maximum.accumulate(np.where(group, here, base))
                start = np.maximum.accumulate(np.where(fresh, here, first_of_word))
                rank[spot] = old + start - first
                tied = ~fresh
                tied[:-1] |= ~fresh[1:]
                if after is not None:
                    tied[-1] |= int(after[0, 0]) == int(old[-1]) and int(after[1, 0]) == int(word[-1])
                go = tied & (size >= at)  # a row that has just ended still differs from longer ones
                if go.any():
                    live.push(np.stack([(old + start - first)[go], spot[go]]))
                    any_left = True
                last, base, first_of_word, row = (int(old[-1]), int(word[-1])), int(first[-1]), int(start[-1]), row + k
                rows = after
            if not any_left:
                break
        return self._dense(rank)

    def _dense(self, rank: np.ndarray) -> tuple[np.ndarray, int]:
        """Ranks (the number of lesser ones) as names from 1 up without gaps."""
        m = len(rank)
        seen = self.scratch.array(m, np.int64)
        for part in self._pieces(m):
            seen[rank[part]] = 1
        upto = 0
        for part in self._pieces(m):
            seen[part] = np.cumsum(seen[part]) + upto
            upto = int(seen[part.stop - 1])
        for part in self._pieces(m):
            rank[part] = seen[rank[part]]
        return rank, upto

    def _order_in_memory(self, names: np.ndarray) -> np.ndarray:
        """Order of the suffixes of a sequence of names as far as the cap, by pairs of twice the reach.

        Only suffixes that are still tied are sorted again. A name spans two symbols or more, so ties
        left when the reach is half the cap share at least ``cap`` symbols.
        """
        m, reach = len(names), 1
        by_name = np.argsort(names, kind="stable")
        ordered = names[by_name]
        rank = np.empty(m, np.int64)
        rank[by_name] = np.searchsorted(ordered, ordered, side="left")
        same = ordered[1:] == ordered[:-1]
        live = by_name[np.append(same, False) | np.concatenate([[False], same])]
        while len(live) and 2 * reach < self.cap + 2:
            after = np.where(live + reach < m, rank[np.minimum(live + reach, m - 1)] + 1, 0)
            key = rank[live] * (m + 1) + after
            move = np.argsort(key)
            live, key, old = live[move], key[move], rank[live[move]]
            spot = np.arange(len(live))
            group, fresh = np.ones(len(live), bool), np.ones(len(live), bool)
            group[1:], fresh[1:] = old[1:] != old[:-1], key[1:] != key[:-1]
            rank[live] = old + np.maximum.accumulate(np.where(fresh, spot, 0)) - np.maximum.accumulate(np.where(group, spot, 0))
            live = live[~fresh | np.append(~fresh[1:], False)]
            reach *= 2
        return np.argsort(rank, kind="stable")

    def _seed_order(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """(seeds by number in suffix order, names each shares with the one before or None for not known)."""
        m = len(seeds)
        names, distinct = self._names(seeds)
        order = self.scratch.array(m, np.int64)
        if distinct == m:
            for part in self._pieces(m):
                order[names[part] - 1] = np.arange(part.start, part.stop)
            return order, None
        if m <= self.scratch.memory:
            return self._order_in_memory(names), None
        common, at = self.scratch.array(m, np.int64), 0
        bits = max(1, int(distinct).bit_length())
        for suffix, shared in Text(names, self.cap // 2 + 1, bits, self.scratch, self.chunk).sorted_chunks():
            order[at : at + len(suffix)], common[at : at + len(suffix)] = suffix, shared
            at += len(suffix)
        return order, common

    def _ordered_seeds(self) -> Iterator[tuple[int, np.ndarray]]:
        """(letter, tuples) of the seeds in suffix order, each with the length it shares with the seed before."""
        seeds = self._seeds()
        m = len(seeds)
        if not m:
            return
        order, common = self._seed_order(seeds)
        for part in self._pieces(m):
            now = order[part]
            past = order[max(part.start - 1, 0) : part.stop - 1]
            past = past if part.start else np.concatenate([now[:1], past])
            place, known = seeds[now], 0
            if common is None:
                length = self.shared(seeds[past], place)
            else:
                same = np.minimum(common[part], m - 1 - np.maximum(now, past))
                known = seeds[now + same] - place
                length = self.shared(seeds[past], place, known)
            if part.start == 0:
                length[0] = 0
            rows = np.stack([self._symbols(place), place, length, self._before(place)])
            yield from _by_letter(iter([rows]))

    def _induce(self, letter: int, rows: np.ndarray, queue: Queue, state: _Since, rule: str) -> None:
        """Push the suffixes that those in ``rows`` induce."""
        place, shared, before = rows
        ahead = before & self.mask
        keep = {"falling": ahead >= letter, "rising": (ahead <= letter) & (ahead > 0), "first": (ahead < letter) & (ahead > 0)}[rule]
        at = np.flatnonzero(keep)
        letters = ahead[at]
        order = np.argsort(letters.astype(np.int16) if self.bits <= BYTE_BITS else letters, kind="stable")
        at, letters = at[order], letters[order]
        head = np.ones(len(at), bool)
        head[1:] = letters[1:] != letters[:-1]
        begin = np.where(head, 0, np.concatenate([[0], at[:-1] + 1]))
        least = _least(shared, begin, at)
        least[head] = np.minimum(least[head], state.since(letters[head]))
        rest = before[at] >> self.bits
        empty = np.flatnonzero((rest == 0) & (place[at] > 1))
        if len(empty):
            rest[empty] = self._before(place[at[empty]] - 1)
        new = np.stack([place[at] - 1, np.minimum(least + 1, self.cap), rest])
        edges = np.append(np.flatnonzero(head), len(at)).tolist()
        for a, b in zip(edges[:-1], edges[1:]):
            queue.push(int(letters[a]), new[:, a:b])
        state.note(shared, letters[edges[:-1]], at[np.array(edges[1:], np.int64) - 1])
        queue.settle()

    def sorted_chunks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(suffixes, length each shares with the one before) in order, chunk by chunk."""
        if not self.n:
            return
        top = int(max(int(np.max(self.t[p])) for p in self._pieces(self.n))) + 1
        last_of = self.scratch.array(top, np.int64, -1)  # the greatest L suffix of each letter
        meets = self.scratch.array(top, np.int64)
        fallen, risen = Log(self.scratch), Log(self.scratch)
        queue, state = Queue(self.scratch, self.chunk), _Since(self.scratch, top, self.cap)
        end = np.array([self.n - 1])
        queue.push(int(self.t[self.n - 1]), np.stack([end, [0], self._before(end)]))
        seeds = self._ordered_seeds()
        seed = next(seeds, None)
        seeded = -1
        while (letter := queue.next()) is not None or seed is not None:
            if letter is not None and (seed is None or letter <= seed[0]):
                fresh = True
                while (rows := queue.pop(letter)) is not None:
                    if fresh:
                        rows[1, 0], fresh = 0, False
                    fallen.push(np.vstack([np.full((1, rows.shape[1]), letter), rows]))
                    last_of[letter] = rows[0, -1]
                    self._induce(letter, rows, queue, state, "falling")
            letter = seed[0] if seed is not None and (letter is None or seed[0] <= letter) else None
            while seed is not None and seed[0] == letter:
                rows = seed[1][1:].copy()
                if letter != seeded:
                    before, seeded = int(last_of[letter]), letter
                    rows[1, 0] = 0 if before < 0 else self.shared(np.array([before]), rows[0, :1])[0]
                self._induce(letter, rows, queue, state, "falling")
                seed = next(seeds, None)
        queue, state = Queue(self.scratch, self.chunk, -1), _Since(self.scratch, top, self.cap)
        falls = _by_letter(rows[:, ::-1] for rows in fallen.backwards())
        fall = next(falls, None)
        while (letter := queue.next()) is not None or fall is not None:
            letter = max(x for x in (letter, fall and fall[0]) if x is not None)
            fresh, low = True, -1
            while queue.next() == letter and (rows := queue.pop(letter)) is not None:
                if fresh:
                    rows[1, 0], fresh = 0, False
                risen.push(np.vstack([np.full((1, rows.shape[1]), letter), rows[:2]]))
                low = int(rows[0, -1])
                self._induce(letter, rows, queue, state, "rising")
            follow = 0
            if low >= 0 and last_of[letter] >= 0:
                follow = meets[letter] = int(self.shared(last_of[letter : letter + 1], np.array([low]))[0])
            while fall is not None and fall[0] == letter:
                rows = fall[1][1:].copy()  # each length belongs to the greater of its two suffixes
                follow, rows[1] = rows[1, -1], np.concatenate([[follow], rows[1, :-1]])
                self._induce(letter, rows, queue, state, "first")
                fall = next(falls, None)
        falls, rises = _by_letter(fallen.forwards()), _by_letter(rows[:, ::-1] for rows in risen.backwards())
        fall, rise = next(falls, None), next(rises, None)
        while fall is not None or rise is not None:
            letter = min(x[0] for x in (fall, rise) if x is not None)
            while fall is not None and fall[0] == letter:
                yield fall[1][1], fall[1][2]
                fall = next(falls, None)
            carry = meets[letter]
            while rise is not None and rise[0] == letter:
                rows = rise[1]
                yield rows[1], np.concatenate([[carry], rows[2, :-1]])
                carry = rows[2, -1]
                rise = next(rises, None)


class _Since:
    """Least shared length since the last push of each letter.

    For every possible length the last entry that had no more than it is known; the least length
    since some entry is then the first whose last entry came later.
    """

    def __init__(self, scratch: Scratch, letters: int, cap: int):
        self.last, self.pushed, self.seen = np.full(cap + 1, -1, np.int64), scratch.array(letters, np.int64, -1), 0

    def since(self, letters: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.last, self.pushed[letters], side="right"), len(self.last) - 1)

    def note(self, shared: np.ndarray, letters: np.ndarray, at: np.ndarray) -> None:
        """``shared`` has been seen; its entries ``at`` were the last to push to the letters."""
        np.maximum.at(self.last, shared, np.arange(self.seen, self.seen + len(shared)))
        np.maximum.accumulate(self.last, out=self.last)
        self.pushed[letters] = self.seen + at
        self.seen += len(shared)


def repeated(symbols: np.ndarray, width: int, memory: int = 1 << 23, chunk: int = 1 << 17) -> np.ndarray:
    """Flags of the positions whose next ``width`` symbols also start elsewhere; on disk beyond the memory."""
    scratch = Scratch(memory)
    try:
        flags = Scratch(memory).array(len(symbols), bool) if len(symbols) <= memory else np.memmap(tempfile.TemporaryFile(), bool, "w+", shape=(len(symbols),))
        before = -1
        for suffix, shared in Text(symbols, width, BYTE_BITS, scratch, chunk).sorted_chunks():
            hit = np.flatnonzero(shared >= width)
            flags[suffix[hit]] = True
            flags[suffix[hit[hit > 0] - 1]] = True
            if len(hit) and hit[0] == 0 and before >= 0:
                flags[before] = True
            before = int(suffix[-1])
        return flags
    finally:
        scratch.close()
