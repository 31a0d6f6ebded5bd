"""The quality classifier and the language identifier."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterloom.llm import language_id, mil_quality
from rosterloom.llm import queries as q

DATA = "/root/testdata/sf0.01"


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    p = mil_quality._start(5, 4, 3, 0.2, rng)
    x, first, bag, y = rng.normal(size=(7, 5)), np.array([0, 3, 4]), np.array([0, 0, 0, 1, 2, 2, 2]), np.array([1.0, 0.0, 1.0])
    _, g = mil_quality.gradients(p, x, first, bag, y)
    for k, v in p.items():
        for i in np.ndindex(v.shape):
            moved = {n: a.astype(float).copy() for n, a in p.items()}
            moved[k][i] += 1e-6
            up = mil_quality.gradients(moved, x, first, bag, y)[0]
            moved[k][i] -= 2e-6
            assert abs((up - mil_quality.gradients(moved, x, first, bag, y)[0]) / 2e-6 - g[k][i]) < 1e-5


def test_blocks_do_not_change_scores(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(32, 120, n).astype(np.uint8)) for n in (0, 5, 256, 257, 5000, 40, 9000)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    model = mil_quality.Model(np.zeros(mil_quality.N_FEATURES), np.ones(mil_quality.N_FEATURES), mil_quality._start(mil_quality.N_FEATURES, 6, 4, 0.0, rng))
    whole = mil_quality.score_texts(data, np.cumsum(sizes) - sizes, sizes, model)
    for block in (1, 3, 7):
        monkeypatch.setattr(mil_quality, "BLOCK", block)
        assert np.allclose(mil_quality.score_texts(data, np.cumsum(sizes) - sizes, sizes, model), whole)


def test_scores_are_the_attention_sum_written_out():
    """One softmax over all passages of a text, without blocks or running sums."""
    rng = np.random.default_rng(2)
    p = mil_quality._start(mil_quality.N_FEATURES, 6, 4, 0.3, rng)
    model = mil_quality.Model(rng.normal(size=mil_quality.N_FEATURES), rng.random(mil_quality.N_FEATURES) + 0.5, p)
    for n in (0, 5, 256, 3000):
        text = bytes(rng.integers(32, 120, n).astype(np.uint8))
        parts = [text[i : i + mil_quality.PASSAGE] for i in range(0, max(1, n), mil_quality.PASSAGE)]
        x = np.concatenate([mil_quality.features(np.frombuffer(t.ljust(mil_quality.PASSAGE, b"\0"), np.uint8)[None, :], np.array([len(t)])) for t in parts])
        h = np.tanh((x - model.mean) / model.scale @ p["w"] + p["b"])
        e = (np.tanh(h @ p["v"]) / (1 + np.exp(-(h @ p["u"])))) @ p["a"]
        w = np.exp(e) / np.exp(e).sum()
        want = 1 / (1 + np.exp(-(w @ h @ p["c"] + p["d"])))
        got = mil_quality.score_texts(np.frombuffer(text, np.uint8), np.array([0]), np.array([n]), model)[0]
        assert abs(got - want) < 1e-6


def test_quality_on_the_held_out_fold(spark):
    got = q.op4_quality(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.93
    assert got.score.between(0, 1).all()


def test_quality_edge_rows(spark):
    docs = spark.createDataFrame([(1, "fine words here"), (2, None), (3, ""), (None, "x"), (1, "fine words here")], "doc_id long, text string").withColumn("SCORE", F.lit("old"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (4, 7)], "doc_id long, quality int")
    model = mil_quality.train(docs, labels)
    rows = mil_quality.score(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    none = mil_quality.train(docs, labels.filter("false"))
    assert {r.score for r in mil_quality.score(docs, none).collect()} == {0.5}
    assert mil_quality.score(docs.filter("false"), model).collect() == []


@pytest.mark.parametrize("chunk", [3, 5, 256])
def test_paths_are_best(monkeypatch, chunk):
    monkeypatch.setattr(language_id, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    words = np.array([0, 1, 7, 3, 12, 0, 40])
    scores = rng.normal(0, 3, (words.sum(), 3)).astype(np.float32)
    path, a = language_id.best_paths(scores, words, 4.0), 0
    for n in words:
        s, p = scores[a : a + n].astype(float), path[a : a + n]
        a += n
        if n:
            v = s[0].copy()
            for t in range(1, n):
                v = np.maximum(v, v.max() - 4) + s[t]
            assert abs(s[np.arange(n), p].sum() - 4 * (p[1:] != p[:-1]).sum() - v.max()) < 1e-3


def test_language_on_the_held_out_fold(spark):
    got = q.op5_language(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97


def test_mixed_text_and_edge_rows(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog " * 30, "en"), (2, "der hund und die katze " * 30, "de"), (3, "это собака и кошка " * 30, "ru")], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    tests = spark.createDataFrame([(1, "the dog and the cat " * 5 + "die katze und der hund " * 9), (2, None), (3, "123 !!"), (4, "собака"), (5, "")], "doc_id long, text string").withColumn("Spans", F.lit(1))
    got = {r.doc_id: r for r in language_id.label(tests, model).collect()}
    assert [s.lang for s in got[1].spans] == ["en", "de"] and got[1].lang_pred == "de" and got[1].spans[1].start == 100
    assert [got[k].lang_pred for k in (2, 3, 4, 5)] == ["und", "und", "ru", "und"] and got[2].spans == []
    empty = language_id.train(docs.filter("false"))
    assert {r.lang_pred for r in language_id.label(tests, empty).collect()} == {"und"}
    assert language_id.label(tests.filter("false"), model).collect() == []
