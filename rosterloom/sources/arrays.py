"""Large JSON arrays of objects, read by byte ranges.

An array in one file has no line to cut at, and a range may begin inside a string. So it is read twice.
The first pass notes of every range, for both cases (it begins inside a string or not), how quotes
and brackets change the state; the states at all borders follow from these few numbers. In the second
pass each range gives the objects that begin in it, reading past its end for the last one. Both passes
are tasks of a Python data source; a task holds a chunk and one object.

Files are opened through ``pyarrow.fs``, so a path may be local or in any store that it knows. Only
objects of the outer array are rows; an object at any depth, escapes and brackets in strings are
handled; a file that is not closed gives the objects that are whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 32 << 20
CHUNK = 4 << 20
NAME = "json_array_ranges"


def _opened(path: str):
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store, at


def _files(path: str) -> list[tuple[str, int]]:
    """The files at a path, which is a file or a folder, with their sizes."""
    from pyarrow import fs

    store, at = _opened(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(at))
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ("file://" if path.startswith("file:") else "")
    return sorted((prefix + f.path, f.size) for f in found if f.is_file and f.base_name[:1] not in "_.")


@dataclass
class State:
    """Where a scan stands: inside a string or not, how deep, and how many backslashes came last."""

    inside: bool = False
    depth: int = 0
    slashes: int = 0


def brackets(chunk: bytes, slashes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """(places, steps, quotes before each place, quotes in all, backslashes at the end) of a chunk.

    Steps are 1 for an opening bracket and -1 for a closing one; quotes are those that no backslash
    precedes. With an even number of quotes before it, a place is as the chunk began: in a string or not.
    """
    a = np.frombuffer(chunk, np.uint8)
    at = np.arange(len(a))
    other = np.maximum.accumulate(np.where(a != 92, at, -1 - slashes))  # the last place that is no backslash
    quotes = np.flatnonzero(a == 34)
    run = np.where(quotes > 0, quotes - 1 - other[quotes - 1], slashes)
    quotes = quotes[run % 2 == 0]
    opening = (a == 123) | (a == 91)
    places = np.flatnonzero(opening | (a == 125) | (a == 93))
    return places, np.where(opening[places], 1, -1), np.searchsorted(quotes, places), len(quotes), int(len(a) - 1 - other[-1])


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int
    size: int
    inside: bool = False
    depth: int = 0


def _chunks(part: Range, upto: int) -> Iterator[tuple[int, bytes]]:
    store, at = _opened(part.path)
    with store.open_input_file(at) as f:
        here = part.begin
        while here < upto:
            f.seek(here)
            data = f.read(min(CHUNK, upto - here))
            if not data:
                return
            yield here, data
            here += len(data)


def _slashes_before(part: Range) -> int:
    """Backslashes that end right where the range begins."""
    store, at = _opened(part.path)
    count = 0
    with store.open_input_file(at) as f:
        while count < part.begin:
            f.seek(part.begin - count - 1)
            if f.read(1) != b"\\":
                break
            count += 1
    return count


def summary(part: Range) -> tuple[int, int, int]:
    """(quotes, depth gained if the range begins outside a string, depth gained if inside)."""
    quotes, gained, slashes = 0, [0, 0], _slashes_before(part)
    for _, data in _chunks(part, part.end):
        _, steps, before, more, slashes = brackets(data, slashes)
        odd = (quotes + before) % 2
        gained[0] += int(steps[odd == 0].sum())
        gained[1] += int(steps[odd == 1].sum())
        quotes += more
    return quotes, *gained


def objects(part: Range) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of each object of the outer array that begins in the range."""
    inside, depth, slashes = part.inside, part.depth, _slashes_before(part)
    open_at, held = None, []
    for here, data in _chunks(part, part.size):
        if here >= part.end and open_at is None:
            return
        places, steps, before, quotes, slashes = brackets(data, slashes)
        real = (before % 2 == 0) != inside
        places, steps = places[real], steps[real]
        depths = depth + np.cumsum(steps)
        first = 0
        for i in np.flatnonzero(((steps > 0) & (depths == 2)) | ((steps < 0) & (depths == 1))):
            at = int(places[i])
            if steps[i] > 0:
                if here + at >= part.end and open_at is None:
                    return
                if data[at] == 123:
                    open_at, first = here + at, at
            elif open_at is not None:
                held.append(data[first : at + 1])
                yield open_at, b"".join(held)
                open_at, held = None, []
        if open_at is not None:
            held.append(data[first:])
        depth = int(depths[-1]) if len(depths) else depth
        inside ^= quotes % 2 == 1


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def _ranges(self) -> list[Range]:
        size = int(self.options.get("range_bytes", RANGE_BYTES))
        return [Range(path, a, min(a + size, whole), whole) for path, whole in _files(self.options["path"]) for a in range(0, whole, size)]

    def partitions(self):
        ranges = self._ranges()
        for part, (inside, depth) in zip(ranges, json.loads(self.options.get("states", "[]"))):
            part.inside, part.depth = inside, depth
        return ranges or [Range("", 0, 0, 0)]

    def read(self, part: Range):
        if part.end == 0:
            return
        if "states" not in self.options:
            quotes, outside, inside = summary(part)
            yield pa.RecordBatch.from_pydict({"path": [part.path], "place": [part.begin], "quotes": [quotes], "outside": [outside], "inside": [inside]})
            return
        batch, size = [], 0
        for place, data in objects(part):
            batch.append((place, data.decode()))
            size += len(data)
            if size > CHUNK:
                yield self._batch(part, batch)
                batch, size = [], 0
        if batch:
            yield self._batch(part, batch)

    @staticmethod
    def _batch(part: Range, rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"path": [part.path] * len(rows), "place": [p for p, _ in rows], "json": [t for _, t in rows]})


class JsonArrayRanges(DataSource):
    """``spark.read.format("json_array_ranges")``: summaries of ranges, or with ``states`` their objects."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, place bigint, json string" if "states" in self.options else "path string, place bigint, quotes bigint, outside bigint, inside bigint"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options)


def read_array(spark: SparkSession, path: str, schema: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(place, the columns of ``schema``): the objects of the JSON arrays at a path; ``place`` is where one begins in its file."""
    spark.dataSource.register(JsonArrayRanges)
    read = spark.read.format(NAME).option("path", path).option("range_bytes", range_bytes)
    # a row a range; the states at the borders are their running sums
    found = {(r["path"], r["place"]): r for r in read.load().collect()}
    states, last = [], None
    for key in sorted(found):
        inside, depth = states[-1][1] if last == key[0] else (False, 0)
        r = found[key]
        after = (inside ^ (r["quotes"] % 2 == 1), depth + (r["inside"] if inside else r["outside"]))
        states.append(((inside, depth), after))
        last = key[0]
    rows = read.option("states", json.dumps([s for s, _ in states])).load()
    return rows.select("place", F.from_json("json", schema).alias("o")).select("place", "o.*")
