"""JSON arrays by byte ranges against json.load, whatever the ranges."""

import json
import random

import pytest

from rosterloom.sources import arrays

SCHEMA = "id int, text string, inner struct<a: array<int>, b: string>"


def made(n, seed=1):
    rng = random.Random(seed)
    bits = ['"', "\\", "{", "}", "[", "]", ",", ":", "\n", "é", "\\\\", '\\"', "plain words ", "},{", '{"id": 9}', " ", "😀"]
    return [{"id": i, "text": "".join(rng.choices(bits, k=rng.randrange(12))), "inner": {"a": [rng.randrange(9) for _ in range(rng.randrange(4))], "b": rng.choice(bits)}} for i in range(n)]


def told(df):
    return [{"id": r.id, "text": r.text, "inner": {"a": r.inner.a, "b": r.inner.b}} for r in sorted(df.collect(), key=lambda r: r.place)]


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 1 << 20])
def test_any_cut(spark, tmp_path, size):
    rows = made(25 if size < 64 else 300)
    for indent, ascii_ in ((None, True), (2, False)):
        at = tmp_path / f"a{indent}.json"
        at.write_text(json.dumps(rows, indent=indent, ensure_ascii=ascii_))
        parts = [arrays.Range(str(at), a, min(a + size, at.stat().st_size), at.stat().st_size) for a in range(0, at.stat().st_size, size)]
        inside, depth, got = False, 0, []
        for part in parts:
            part.inside, part.depth = inside, depth
            got += [json.loads(t) for _, t in arrays.objects(part)]
            quotes, outside, within = arrays.summary(part)
            depth += within if inside else outside
            inside ^= quotes % 2 == 1
        assert got == rows and not inside and depth == 0


def test_chunks_inside_ranges(tmp_path, monkeypatch):
    rows = made(200)
    at = tmp_path / "a.json"
    at.write_text(json.dumps(rows))
    for chunk in (1, 3, 50):
        monkeypatch.setattr(arrays, "CHUNK", chunk)
        part = arrays.Range(str(at), 0, at.stat().st_size, at.stat().st_size)
        assert [json.loads(t) for _, t in arrays.objects(part)] == rows


def test_a_folder_of_arrays_in_many_tasks(spark, tmp_path):
    rows = made(5000)
    for k in range(3):
        (tmp_path / f"part-{k}.json").write_text(json.dumps(rows[k::3]))
    (tmp_path / "_SUCCESS").write_text("")
    size = sum(f.stat().st_size for f in tmp_path.glob("part-*"))
    df = arrays.read_array(spark, str(tmp_path), SCHEMA, range_bytes=size // 20)
    assert df.rdd.getNumPartitions() >= 20
    key = lambda r: r["id"]
    assert sorted(told(df), key=key) == rows
    assert sorted(told(arrays.read_array(spark, f"file://{tmp_path}", SCHEMA)), key=key) == rows


def test_empty_and_unfinished(spark, tmp_path):
    for k, (text, want) in enumerate([("[]", []), ("", []), (' [ {"id": 1}, {"id": 2', [1]), ('[{"id": 1}, 5, "x{", [1, {"id": 7}], {"id": 3}]', [1, 3])]):
        at = tmp_path / f"{k}.json"
        at.write_text(text)
        assert [r.id for r in sorted(arrays.read_array(spark, str(at), "id int", range_bytes=4).collect(), key=lambda r: r.place)] == want
    with pytest.raises(Exception, match="nowhere"):
        arrays.read_array(spark, str(tmp_path / "nowhere"), "id int")
