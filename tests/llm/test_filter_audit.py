"""The audit of filters against filter-by-filter brute force."""

import duckdb
import pytest

from rosterloom.llm import filter_audit, queries

WORDS = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, WORDS, "a"), (2, WORDS, "b"), (2, WORDS, "b"), (3, "SHORT", "a"), (4, WORDS + " #", "a"), (5, " ".join(["x"] * 60), "a"), (6, None, "a"), (7, "", None),
    (None, WORDS, "a"), (8, "UPPER " * 55, ""), (9, WORDS.upper(), "b"), (1, "other", "c"), (10, "a\x0bb\x0cc " * 30, "c"), (11, "é" * 200000 + " $", "c"), (None, "alone", "c"),
    *[(100 + i, "copy | of many", "hot") for i in range(40)],
]
LABELS = [(1, 1, 0), (2, 0, 1), (3, 1, 1), (5, None, 1), (5, 1, None), (None, 1, 1), (105, 1, 0), (100, 1, 1)]


def found(spark, rows, labels, parts=5, held=filter_audit.HELD):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return [tuple(r) for r in filter_audit.audit(docs, said, held=held).collect()]


@pytest.mark.parametrize("parts, held", [(1, 1 << 20), (7, 1 << 20), (3, 10)])
def test_every_order_and_step(spark, parts, held):
    got = found(spark, ROWS, LABELS, parts, held)
    want = filter_audit.brute_force(ROWS, {1: (1, 0), 2: (0, 1), 3: (1, 1), 5: (1, 1), 105: (1, 0), 100: (1, 1)})
    assert len(got) == len(set(got)) == 5 * 600
    assert set(got) == want


def test_colliding_fingerprints_keep_their_texts(spark, monkeypatch):
    """All texts under one fingerprint: the chain tells them apart."""
    chains = filter_audit.Chains()
    late = [*chains.add(1, "x", 5, {("p", 0): 1}), *chains.add(1, "y", 4, {("p", 1): 1}), *chains.add(1, "x", 3, {("p", 0): 1}), *chains.add(1, "x", 9, {("q", 0): 2})]
    assert late == [(5, "p", 16, 1), (9, "q", 16, 2)]
    assert sorted((t, k) for _, t, k, _ in chains.drain()) == [("x", 3), ("y", 4)]


def test_empty_tables(spark):
    assert found(spark, [], []) == []
    assert len(found(spark, ROWS[:1], [])) == 600


def test_shapley_adds_up(spark):
    rows = found(spark, ROWS, LABELS)
    for part in {r[0] for r in rows}:
        once = {r[1][r[2] - 1]: r[9] for r in rows if r[0] == part}
        removed = {r[1]: 0 for r in rows if r[0] == part}
        for r in rows:
            if r[0] == part:
                removed[r[1]] += r[4]
        assert len(set(removed.values())) == 1
        assert sum(once.values()) == 120 * next(iter(removed.values()))


def test_query_equals_sql(spark):
    at = "/root/testdata/sf0.001"
    got = {tuple(r) for r in queries.op13_filter_audit(spark, at).collect()}
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{at}/{t}.parquet'")
    want = con.execute(queries.OP13_SQL)
    names = [c[0] for c in want.description]
    rows = {tuple(dict(zip(names, r))[c] for c in ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in want.fetchall()}
    assert got == rows
