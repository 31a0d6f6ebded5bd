"""Filed numbers, name shards, fills, choices and files on literal rows."""

import zipfile

import pytest
from pyspark.sql import functions as F

from rosterloom.functions import text
from rosterloom.operators import relational, search, territory
from rosterloom.sources import files


def test_filed_numbers(spark):
    want = {"1100 Ridgeway": "1100", "ONE PPG PLACE": "1", "N14 W23833 Stone Ridge": "N14W23833", "n14w23833 Stone": "N14W23833", "N14, Stone": "N14", "Oak St": None, "": None, "12A Oak": None, "eleven Oak": None}
    got = spark.createDataFrame([(k,) for k in want], "line string").select("line", text.filed_number(F.col("line")).alias("n")).collect()
    assert {r.line: r.n for r in got} == want
    assert spark.range(1).select(text.filed_number(F.lit(None).cast("string")).alias("n")).first().n is None


def test_name_shards_split_where_heavy(spark):
    rows = [(1, "William Kaiser"), (2, "Jane O'Hara Jr"), (3, "Jack Ash"), (4, "Ja Bo"), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "id int, name string")
    got = search.name_shards(df, "id", "name").collect()
    at = {(r.prefix, r.id) for r in got}
    assert {("wi", 1), ("bi", 1), ("ka", 1), ("ja", 2), ("oh", 2), ("ja", 3), ("ja", 4), ("bo", 4)} <= at and not {5, 6} & {k for _, k in at} and len(at) == len(got)
    assert "bill" in next(r.alt for r in got if r.id == 1).split() and "kaiser" not in next(r.alt for r in got if r.id == 1).split() and ("jr", 2) not in at
    split = {(r.prefix, r.id) for r in search.name_shards(df, "id", "name", split_above=2).collect()}
    assert {("jan", 2), ("jac", 3)} <= split and not {("ja", 2), ("ja", 3), ("ja", 4)} & split and ("bo", 4) in split


def test_name_shards_are_read_by_prefix(spark, tmp_path):
    df = spark.createDataFrame([(1, "William Kaiser"), (3, "Jack Ash")], "id int, name string")
    files.write_name_shards(search.name_shards(df, "id", "name"), f"{tmp_path}/names")
    assert {r.id for r in files.fetch(spark, f"{tmp_path}/names", "prefix", ["ka", "zz"]).collect()} == {1}
    assert "PartitionFilters: [isnotnull" in files.fetch(spark, f"{tmp_path}/names", "prefix", ["ka"])._jdf.queryExecution().toString()


def test_fills_absent_values_only_and_repeats_no_row(spark):
    df = spark.createDataFrame([("1 Oak", 1.0, None), ("2 elm ", None, None), ("3 Ash", None, 5.0), (None, None, None)], "street string, lat double, lon double")
    given = spark.createDataFrame([("1 OAK", 9.0, 9.0), ("2 Elm", 2.0, 3.0), ("2 ELM", 4.0, 4.0), (None, 7.0, 7.0)], "street string, lat double, lon double")
    got = relational.fill_null(df, given, ["street"], ["lat", "lon"])
    assert got.columns == df.columns
    assert {tuple(r) for r in got.collect()} == {("1 Oak", 1.0, 9.0), ("2 elm ", 2.0, 3.0), ("3 Ash", None, 5.0), (None, None, None)} and got.count() == 4


def test_keys_without_rows_stay(spark):
    keys, df = spark.createDataFrame([(3,), (1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    assert {tuple(r) for r in relational.in_order(keys, df, ["k"]).collect()} == {(1, "a"), (2, None), (3, None)}


def test_heaviest_places_apart(spark, monkeypatch):
    df = spark.createDataFrame([("a", 40.0, -75.0, 5), ("b", 40.1, -75.0, 9), ("c", 45.0, -75.0, 1), ("d", 30.0, -75.0, 1)], "k string, lat double, lon double, w int")
    assert territory.spread_out(df, "k", "lat", "lon", "w", 50, 9) == ["b", "c", "d"]
    assert territory.spread_out(df, "k", "lat", "lon", "w", 50, 2) == ["b", "c"] and territory.spread_out(df, "k", "lat", "lon", "w", 1, 9) == ["b", "a", "c", "d"]
    monkeypatch.setattr(territory, "MOST_ROWS", 3)
    with pytest.raises(ValueError, match="at most 3"):
        territory.spread_out(df, "k", "lat", "lon", "w", 50, 9)


def test_parts_of_a_set_of_states():
    assert territory.detached({"a", "b", "c", "x"}, {("a", "b"), ("c", "b"), ("x", "y")}) == [{"a", "b", "c"}, {"x"}]
    assert territory.detached(set(), {("a", "b")}) == []


def test_balanced_states_have_room(spark):
    df = spark.createDataFrame([("a", 40.0, -75.0, 5), ("b", 40.0, -75.5, 5), ("c", 40.0, -90.0, 4)], "k string, lat double, lon double, w int")
    assert territory.balanced(df, {1: (40.0, -75.0), 2: (40.0, -91.0)}, "k", "lat", "lon", "w") == {"a": 1, "b": 2, "c": 2}


def test_zipped_rosters(spark, tmp_path):
    for name, rows in (("a", 'id,Näme\n1,"x, y"\n2,\n'), ("b", "id,Näme\n3,z\n")):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr(f"{name}.csv", rows.encode("latin-1"))
            z.writestr("readme.txt", "no table")
    got = files.zipped_csv(spark, f"{tmp_path}/*.zip")
    assert got.columns == ["id", "Näme"] and {tuple(r) for r in got.collect()} == {("1", "x, y"), ("2", None), ("3", "z")}


def test_newest_file_of_each_roster():
    found = files.newest_by_slug(["oak_2026-01-02.csv", "oak_2025-12-31.csv", "elm_01_02_2026.csv", "elm.csv", "oak_2027-01-01.txt"])
    assert found == {"elm": "elm_01_02_2026.csv", "oak": "oak_2026-01-02.csv"}


def test_states_come_from_file_names(spark, tmp_path):
    for state, k in (("NY", 1), ("TX", 2)):
        spark.createDataFrame([(k,)], "id int").toPandas().to_parquet(tmp_path / f"places_{state}.parquet")
    spark.createDataFrame([(3,)], "id int").toPandas().to_parquet(tmp_path / "places_all.parquet")
    assert {tuple(r) for r in files.by_state(spark, str(tmp_path)).collect()} == {(1, "NY"), (2, "TX")}


def test_territories_file(spark, tmp_path):
    (tmp_path / "t.yaml").write_text("# notes\npeople:\n  AB:  {name: Ann Bee,   email: ann@example.com}\n  CD: {name: Cy Dee, email: cy@example.com, inactive: true}\n\nterritories:\n  AB: [NY, NJ]   # east\n  EF: [TX]\nlast: 1\n")
    assert {tuple(r) for r in files.territories(spark, str(tmp_path / "t.yaml")).collect()} == {("NY", "AB", "Ann Bee", "ann@example.com"), ("NJ", "AB", "Ann Bee", "ann@example.com"), ("TX", "EF", None, None)}


def test_exports_begin_with_a_mark(spark, tmp_path):
    files.write_export(spark.createDataFrame([("é",)], "name string").coalesce(1), f"{tmp_path}/e", "made for a test")
    part = next(tmp_path.glob("e/part-*"))
    assert part.read_bytes().startswith("﻿name,provenance\né,".encode())
