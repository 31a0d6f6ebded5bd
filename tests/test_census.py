"""The census of nested records against a plain walk."""

import json
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from rosterloom.operators import census


def made(rng, depth=0):
    pick = rng.random()
    if depth < 4 and pick < 0.35:
        return {rng.choice(["a", "b", "c d", "e.f"]): made(rng, depth + 1) for _ in range(rng.randrange(4))}
    if depth < 4 and pick < 0.5:
        return [made(rng, depth + 1) for _ in range(rng.randrange(3))]
    return rng.choice([None, "", "x", "y" * 50, True, False, 7, -3, 10**12, "true"])


def walk(value, path, out):
    if isinstance(value, dict):
        for k, v in value.items():
            walk(v, k if path == "" else f"{path}.{k}", out)
    elif isinstance(value, list):
        for v in value:
            walk(v, f"{path}[]", out)
    else:
        out.append((path, value))


def expected(records, cap):
    found = []
    for r in records:
        walk(r, "", found)
    kinds, filled, values = defaultdict(set), Counter(), defaultdict(Counter)
    for path, v in found:
        kinds[path].add("null" if v is None else "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "number")
        shown = (str(v).lower() if isinstance(v, bool) else str(v))[:40]
        if v is not None and v != "":
            values[path][shown] += 1
            filled[path] += v is not False
    listed = {p: sorted(values[p].items(), key=lambda x: (-x[1], x[0])) for p in kinds}
    return {p: (sorted(kinds[p]), filled[p], len(listed[p]), max(0, len(listed[p]) - cap), listed[p][:cap]) for p in kinds}


def test_random_records(spark):
    rng = random.Random(6)
    records = [{"id": i, "x": made(rng), "y": made(rng)} for i in range(150)]
    df = spark.createDataFrame([(json.dumps(r),) for r in records] + [("no json",), (None,), ("{}",), ("[]",)], "j string").repartition(3)
    for cap in (3, 60):
        got = {r.path: (r.kinds, r.filled, r.distinct, r.beyond, [(v.value, v.n) for v in r["values"]]) for r in census.census(df, F.col("j"), cap).collect()}
        assert got == expected(records, cap)


def test_no_records(spark):
    assert census.census(spark.createDataFrame([], "j string"), F.col("j")).collect() == []
