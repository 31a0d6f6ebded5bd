"""SimHash groups and benchmark hits against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterloom.llm import decontaminate, simhash
from rosterloom.llm import queries as q

DATA = "/root/testdata/sf0.001"


def brute_print(text):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(ids, marks, radius=2):
    label = dict(zip(ids, ids))
    moved = True
    while moved:
        moved = False
        for a, x in zip(ids, marks):
            for b, y in zip(ids, marks):
                if bin(x ^ y).count("1") <= radius and label[b] < label[a]:
                    label[a], moved = label[b], True
    return label


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").toPandas()
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in q.op6_simhash(spark, DATA).collect()}
    marks = [brute_print(t) for t in docs.text]
    label = brute_groups(docs.doc_id.tolist(), marks)
    assert got == {d: (m, label[d]) for d, m in zip(docs.doc_id.tolist(), marks)}


def test_cells_find_every_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    flip = lambda x: x ^ (np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64))
    marks = np.unique(np.concatenate([base, flip(base[:400]), flip(flip(base[:300])), flip(flip(flip(base[:100])))]))
    pairs = np.argwhere(np.triu(np.bitwise_count(marks[:, None] ^ marks[None, :]) <= 2, 1))
    want = simhash._forest(len(marks), pairs[:, 0], pairs[:, 1])
    place = {m: i for i, m in enumerate(marks.tolist())}
    side = rng.integers(0, 2, len(marks))
    links = [simhash.cell_links(marks, side), simhash.cell_links(marks[side == 0], np.full((side == 0).sum(), 2)), simhash.cell_links(marks[side == 1], np.full((side == 1).sum(), 2))]
    a = np.array([place[m] for x, _ in links for m in x.tolist()])
    b = np.array([place[m] for _, y in links for m in y.tolist()])
    assert (simhash._forest(len(marks), a, b) == want).all() and len(pairs) > 500


def test_edge_rows(spark):
    rows = [(5, "One two three four"), (3, "one TWO three four"), (9, None), (8, ""), (7, " \t\n"), (None, "one two three four"), (5, "one two three four"), (1, "word " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Fingerprint", F.lit("old"))
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 7), (8, 7), (7, 7), (None, None), (5, 3), (1, 1)], key=str)
    assert simhash.near_duplicates(df.filter("false")).collect() == []


def test_long_chain_of_links(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    labels = spark.range(41).select(F.col("id").alias("node"), (100 - F.col("id")).alias("label"))
    assert {r.label for r in simhash.components(edges, labels).collect()} == {60}


def lev(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row), row.index(min(row))


def test_bit_parallel_distance():
    r = random.Random(1)
    for _ in range(300):
        p, t = ("".join(r.choice("abc") for _ in range(r.randint(a, b))) for a, b in ((1, 80), (0, 90)))
        assert decontaminate.best_end(decontaminate.masks(p), len(p), t) == lev(p, t)


@pytest.mark.parametrize("rate", [0.05, 0.2])
def test_hits_against_brute_force(rate):
    r = random.Random(2)
    text = lambda n: "".join(r.choice("abcd ") for _ in range(n))
    items = [(k, text(r.randint(10, 60))) for k in range(8)]
    block = decontaminate.Block(items, rate)
    for _ in range(60):
        _, item = r.choice(items)
        near = "".join(c if r.random() > rate / 2 else r.choice("abcd") for c in item)
        body = text(50) + near + text(50)
        want = {(i, lev(decontaminate.fold_text(t), decontaminate.fold_text(body))[0]) for i, t in items}
        want = {(i, e) for i, e in want if e <= int(len(decontaminate.fold_text(dict(items)[i])) * rate)}
        assert {(h["item_id"], h["edits"]) for h in block.hits(body)} == want


def test_contamination_edge_rows(spark, monkeypatch):
    passage = "the quick brown fox jumps over the lazy dog near the river bank"
    docs = spark.createDataFrame([(1, f"so  {passage.upper()}\n end"), (2, passage.replace("lazy", "laxy")), (3, None), (4, ""), (None, passage), (6, "clean " * 20_000), (1, passage)], "doc_id long, text string").withColumn("HITS", F.lit(0))
    items = spark.createDataFrame([(7, passage), (7, passage), (8, None), (9, "  "), (None, "clean clean")], "item_id long, text string")
    for size in (4_000_000, 40):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", size)
        found = decontaminate.find_hits(docs, items).collect()
        assert sorted((str(r.doc_id), [(h.item_id, h.edits) for h in r.hits]) for r in found) == sorted([("1", [(7, 0)]), ("2", [(7, 1)]), ("3", []), ("4", []), ("None", [(7, 0)]), ("6", []), ("1", [(7, 0)])])
        assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()) == [3, 4, 6]
    assert decontaminate.find_hits(docs.filter("false"), items).collect() == []
    assert all(r.hits == [] for r in decontaminate.find_hits(docs, items.filter("false")).collect())


def brute_hits(text, items):
    """Edit distance of every item to the best place of the whole folded text, row by row."""
    out = []
    text = decontaminate.fold_text(text or "")
    for number, item in items:
        item, budget = decontaminate.fold_text(item or ""), int(len(decontaminate.fold_text(item or "")) * decontaminate.ERROR_RATE)
        if not item:
            continue
        row = np.zeros(len(text) + 1, np.int64)
        for i, c in enumerate(item, 1):
            change = row[:-1] + np.array([x != c for x in text], np.int64)
            new = np.minimum(np.concatenate([[i], change]), np.concatenate([[i], row[1:] + 1]))
            new = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
            row = new
        if row.min() <= budget:
            out.append((number, int(row.min()), int(row.argmin())))
    return sorted(out)


def test_decontamination_query_against_whole_tables(spark, tmp_path):
    r = random.Random(6)
    items = [(k, " ".join("".join(r.choice("abcdefg") for _ in range(r.randint(2, 6))) for _ in range(12))) for k in range(12)]
    damaged = lambda t, n: "".join(r.choice("xyz") if i in set(r.sample(range(len(t)), n)) else c for i, c in enumerate(t))
    texts = [f"Lead in. {damaged(t, e).upper()}  and\nout" for _, t in items for e in (0, 1, 2, 3)] + [None, "", "unrelated words"]
    spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, __t string, hits int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*items, (None, "no id"), (50, None), (51, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((x.doc_id, x.item_id, x.edits, x.end) for x in q.op3_decontaminate(spark, str(tmp_path)).collect())
    assert got == sorted((k, *h) for k, t in enumerate(texts) for h in brute_hits(t, items))
    spark_items = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, HITS int")
    found = decontaminate.find_hits(docs, spark_items)
    assert sum(len(x.hits) for x in found.collect()) == len(got)


@pytest.mark.parametrize("group", [1 << 16, 300, 40, 1])
def test_cells_by_counts_find_every_link(spark, monkeypatch, group):
    """Few and many stretches of bits, and the fall back to groups by hash, give the same components."""
    monkeypatch.setattr(simhash, "GROUP", group)
    r = random.Random(group)
    base = [r.getrandbits(64) for _ in range(250)]
    marks = sorted({0, 2**64 - 1, *base, *[b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base[:80]], *[b ^ (7 << r.randrange(60)) for b in base[:40]]})
    df = spark.createDataFrame([(m - 2**64 if m >= 2**63 else m,) for m in marks], "fingerprint long")
    pairs = [(x, y) for i, x in enumerate(marks) for y in marks[:i] if bin(x ^ y).count("1") <= 2]
    spot = {m: k for k, m in enumerate(marks)}
    want = simhash._forest(len(marks), np.array([spot[a] for a, _ in pairs]), np.array([spot[b] for _, b in pairs]))
    rows = simhash.links(df, groups=7 if group == 1 else None).collect()
    got = simhash._forest(len(marks), np.array([spot[x.a % 2**64] for x in rows]), np.array([spot[x.b % 2**64] for x in rows]))
    assert (got == want).all()
