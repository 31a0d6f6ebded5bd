"""Chat formatting by minimum-cost role repair.

A conversation is legal if it is an optional system turn, then user and assistant turns by turns,
ending with an assistant turn. Dynamic programming over that automaton finds the cheapest repair:
a turn may be merged into the turn before it (``MERGE``), get another role (``RELABEL``), and empty
turns may be put in (``INSERT``); among repairs of equal cost the one with the fewest turns wins.
The repaired sequence is rendered in pieces, one for each input or inserted turn; the pieces of a
conversation in the order of ``piece`` are its whole text.

Rows are range-partitioned by conversation, turn and content, so a conversation of any length is
spread over tasks. Only a partition's first and last conversation can go on elsewhere: a first pass
gives for those the cheapest cost from each state to each state, the driver joins these few rows
(two a partition) into the states at the borders, and a second pass repairs every stretch.

Defined results: roles are compared trimmed and lower-cased; any other or null role must be
relabelled; a null text is empty; turns are ordered by ``turn`` (nulls first), rows with the same
turn by the hash of role and text, and repeated rows are turns of their own; ``<|`` inside a text
is rendered as ``<\\|``, so that no text opens or closes a turn; rows with a null
conversation id form one conversation; an empty table gives an empty table. The result has columns
of its own, so extra input columns cannot clash.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

ROLES = ["start", "system", "user", "assistant"]
LEGAL = {(0, 1), (0, 2), (1, 2), (2, 3), (3, 2)}
MERGE, RELABEL, INSERT = 1, 3, 2
END = 3
#: A cost is three counts in one integer: cost, output turns, inserted turns.
_COST, _TURN, _PUT = 1 << 96, 1 << 48, 1
_NEVER = 1 << 200


def _insertions() -> dict[tuple[int, int], tuple[int, ...]]:
    """The fewest empty turns that lead from a state to a state."""
    found = {(q, q): () for q in range(4)}
    for _ in range(4):
        for (a, b), path in list(found.items()):
            for c in range(4):
                if (b, c) in LEGAL and ((a, c) not in found or len(found[a, c]) > len(path) + 1):
                    found[a, c] = (*path, c)
    return found


PATHS = _insertions()


def _moves(role: int) -> list[list[tuple[int, int, tuple[int, ...], bool]]]:
    """For each state before: the best (cost, state after, inserted turns, merged) for each state after."""
    out = []
    for q in range(4):
        row = []
        for to in (1, 2, 3):
            change = 0 if role == to else RELABEL * _COST
            options = [(change + len(path) * (INSERT * _COST + _TURN + _PUT) + _TURN, path, False) for (a, b), path in PATHS.items() if a == q and (b, to) in LEGAL]
            if q == to:
                options.append((change + MERGE * _COST, (), True))
            if options:
                best = min(options, key=lambda o: (o[0], o[1], o[2]))
                row.append((best[0], to, best[1], best[2]))
        out.append(row)
    return out


MOVES = {role: _moves(role) for role in range(4)}
FINISH = [len(PATHS[q, END]) * (INSERT * _COST + _TURN + _PUT) if q else _NEVER for q in range(4)]


def role_number(role: str | None) -> int:
    name = (role or "").strip().lower()
    return ROLES.index(name) if name in ROLES[1:] else 0


def step(costs: list[int], role: int) -> list[int]:
    out = [_NEVER] * 4
    for q, held in enumerate(costs):
        if held < _NEVER:
            for cost, to, _, _ in MOVES[role][q]:
                out[to] = min(out[to], held + cost)
    return out


def repair(roles: list[int], entry: int, leave: int) -> list[tuple[tuple[int, ...], int, bool]]:
    """(turns to insert before, role, merged) for each turn, from a state to a state."""
    layers = [[_NEVER] * 4]
    layers[0][entry] = 0
    for r in roles:
        layers.append(step(layers[-1], r))
    out, state = [], leave
    for k in range(len(roles) - 1, -1, -1):
        options = [(layers[k][q] + cost, q, path, merged) for q in range(4) if layers[k][q] < _NEVER for cost, to, path, merged in MOVES[roles[k]][q] if to == state]
        _, before, path, merged = min(options)
        out.append((path, state, merged))
        state = before
    return out[::-1]


def _stretches(batches):
    """(conversation, [(turn, role, text)]) of each run of rows of one conversation."""
    now, rows, begun = None, [], False
    for batch in batches:
        for c, t, r, x in zip(*[batch.column(k).to_pylist() for k in ("c", "t", "r", "x")]):
            if begun and c != now:
                yield now, rows
                rows = []
            now, begun = c, True
            rows.append((t, r, x))
    if begun:
        yield now, rows


def _border_rows(batches):
    """For a partition's first and last conversation: its costs from each state to each state."""
    part, first, last = TaskContext.get().partitionId(), None, None
    for c, rows in _stretches(batches):
        last = (c, rows)
        first = first or last
    for where, held in ((0, first), (1, last)):
        if held is None or (where and first is last):
            continue
        table = []
        for q in range(4):
            costs = [_NEVER] * 4
            costs[q] = 0
            for _, r, _ in held[1]:
                costs = step(costs, role_number(r))
            table += [str(x) for x in costs]
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([where]), pa.array([None if held[0] is None else str(held[0])], pa.string()), pa.array([len(held[1])]), pa.array([table])], names=["part", "place", "c", "n", "costs"])


def join_borders(rows: list) -> dict[tuple[int, int], tuple[int, int, int, int, bool]]:
    """(partition, place) -> (entry, leave, pieces before, turns before, whether it ends there)."""
    chains: dict = {}
    for r in sorted(rows, key=lambda r: (r["part"], r["place"])):
        chains.setdefault(r["c"], []).append(r)
    out = {}
    for chain in chains.values():
        layers, tables = [[0, _NEVER, _NEVER, _NEVER]], []
        for r in chain:
            table = [[int(x) for x in r["costs"][4 * q : 4 * q + 4]] for q in range(4)]
            tables.append(table)
            layers.append([min(layers[-1][q] + table[q][to] for q in range(4)) for to in range(4)])
        state = min(range(4), key=lambda q: (layers[-1][q] + FINISH[q], q))
        states = [state]
        for k in range(len(chain) - 1, -1, -1):
            states.append(min(range(4), key=lambda q: (layers[k][q] + tables[k][q][states[-1]], q)))
        states.reverse()
        pieces = turns = 0
        for k, r in enumerate(chain):
            out[r["part"], r["place"]] = (states[k], states[k + 1], pieces, turns, k == len(chain) - 1)
            cost = tables[k][states[k]][states[k + 1]]
            pieces += r["n"] + cost % _TURN
            turns += cost % _COST // _TURN
    return out


RESULT = "piece bigint, out_turn bigint, turn bigint, role_in string, role string, action string, rendered string"


def _render(conv, rows, entry, leave, piece, turn, ends):
    """Output rows of one stretch."""
    roles = [role_number(r) for _, r, _ in rows]
    fresh = entry == 0

    def add(role: int, text: str, merged: bool, given, action: str):
        nonlocal piece, turn, fresh
        head = "\n" if merged else ("" if fresh else "<|end|>\n") + f"<|{ROLES[role]}|>\n"
        turn += not merged
        fresh = False
        piece += 1
        return (conv, piece - 1, turn - 1, *given, ROLES[role], action, head + text.replace("<|", "<\\|"))

    out = []
    for (t, r, x), (path, role, merged), number in zip(rows, repair(roles, entry, leave), roles):
        out += [add(p, "", False, (None, None), "insert") for p in path]
        action = ("merge" if merged else "keep") if number == role else ("merge_relabel" if merged else "relabel")
        out.append(add(role, x or "", merged, (t, r), action))
    if ends:
        out += [add(p, "", False, (None, None), "insert") for p in PATHS[leave, END]]
        out[-1] = (*out[-1][:-1], out[-1][-1] + "<|end|>\n")
    return out


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", partitions: int | None = None) -> DataFrame:
    """The repaired and rendered conversations, a row for each piece."""
    spark = df.sparkSession
    rows = df.select(F.col(conv).alias("c"), F.col(turn).cast("long").alias("t"), F.col(role).cast("string").alias("r"), F.col(text).cast("string").alias("x"))
    order = ["c", "t", "h", "r", "x"]
    rows = rows.withColumn("h", F.xxhash64("r", "x"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = cut(rows.repartitionByRange(n, "c", "t", "h").sortWithinPartitions(*order))
    borders = join_borders([r.asDict() for r in laid.mapInArrow(_border_rows, "part bigint, place bigint, c string, n bigint, costs array<string>").collect()])
    sent = spark.sparkContext.broadcast(borders)
    kind = rows.schema["c"].dataType
    schema = T.StructType([T.StructField(conv, kind), *T._parse_datatype_string(RESULT).fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, part, held = to_arrow_schema(schema), TaskContext.get().partitionId(), []
        before, k = None, 0

        def solve(c, stretch, place):
            if place is not None:
                entry, leave, pieces, turns, ends = sent.value[part, place]
                return _render(c, stretch, entry, leave, pieces, turns, ends)
            costs = [0, _NEVER, _NEVER, _NEVER]
            for _, r, _ in stretch:
                costs = step(costs, role_number(r))
            return _render(c, stretch, 0, min(range(4), key=lambda q: (costs[q] + FINISH[q], q)), 0, 0, True)

        def flush():
            cols = list(zip(*held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cols, arrow)], schema=arrow)

        for c, stretch in _stretches(batches):
            if before is not None:
                held += solve(*before, 0 if k == 1 else None)
            before, k = (c, stretch), k + 1
            if len(held) >= 5000:
                yield flush()
        if before is not None:
            held += solve(*before, 0 if k == 1 else 1)
        if held:
            yield flush()

    return laid.select("c", "t", "r", "x").mapInArrow(run, schema)
