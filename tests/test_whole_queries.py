"""Queries that must answer for all rows, on small tables of their own."""

import os

import duckdb
import pytest

from rosterloom.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def rows(frame):
    return sorted(map(repr, frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None)))


def wanted(sql):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con.execute(sql).df()


@pytest.mark.parametrize("name", ["entity_match_tiers", "match_demotion", "match_calibration"])
def test_every_published_name_is_matched(spark, name):
    want = wanted(ORACLE_SQL[f"{name}_all"])
    assert len(want) == (4 if name == "match_calibration" else 200)
    assert rows(QUERIES[f"{name}_all"](spark, DATA).toPandas()) == rows(want)


def test_branches_with_large_part_keys_stay_apart(spark, tmp_path):
    rows = [(1, 1, 1, 100007), (1, 1, 5, 3), (2, 1, 2, 7), (3, 1, 2, 250000)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["connected_branches"](spark, str(tmp_path)).collect()
    sizes = sorted(sum(r.component == c for r in got) for c in {r.component for r in got})
    assert len(got) == 4 and sizes == [1, 1, 2]


def test_every_person_has_a_radius(spark):
    got = QUERIES["near_me_widening"](spark, DATA).toPandas()
    people = duckdb.connect().execute(f"SELECT count(DISTINCT c_custkey) FROM '{DATA}/customer.parquet'").fetchall()[0][0]
    assert len(got) == people and rows(got) == rows(wanted(ORACLE_SQL["near_me_widening"]))


def test_radius_around_people_who_share_places(spark, tmp_path):
    """Keys 120,000 apart lie at one place, so each place here has its person and two more."""
    keys = [k + n * 120_000 for k in (1, 7, 20, 33) for n in range(3)]
    spark.createDataFrame([(k, "n", 0, 0.0, "s") for k in keys], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    got = QUERIES["near_me_widening"](spark, str(tmp_path)).toPandas()
    assert sorted(got.o_id) == sorted(keys) and rows(got) == rows(con.execute(ORACLE_SQL["near_me_widening"]).df())
