"""Expressions on literal rows: nulls, ties, rounding, keys."""

import pytest
from pyspark.sql import functions as F

from rosterloom.functions import geo, names, numeric, text
from rosterloom.functions.rules import FilterSpec, Rule, cascade


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("said,value", [(" 1,234", 1234.0), (".00", 0.0), ("", None), ("n/a", None), (None, None)])
def test_number(spark, said, value):
    assert one(spark, numeric.number(F.lit(said).cast("string"))) == value


def test_ratio_keeps_absent_apart_from_zero(spark):
    assert one(spark, numeric.ratio(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, numeric.ratio(F.lit(0.0), F.lit(2.0))) == 0.0
    assert one(spark, numeric.clip(F.lit(None).cast("double"))) is None
    assert one(spark, numeric.present(F.lit(None).cast("double"), F.lit(2.0))) == 2.0


def test_half_even_and_bands(spark):
    assert one(spark, numeric.half_even(F.lit(2.5), 0)) == 2.0
    assert one(spark, numeric.band(F.lit(2.0), [2, 4], ["a", "b", "c"])) == "a"
    assert one(spark, numeric.band(F.lit(2.0), [2, 4], ["a", "b", "c"], right=False)) == "b"
    assert one(spark, numeric.band(F.lit(None).cast("double"), [2], ["a", "b"])) is None


def test_log_scale_ends(spark):
    assert [one(spark, numeric.log_scale(F.lit(v), 10, 1000)) for v in (0.0, -5.0, 10.0, 100.0, 1e9)] == [0, 0, 0, 0.5, 1]


def test_medians(spark):
    values = F.array(*[F.lit(v) for v in (4, 1, 3, 2)])
    assert one(spark, numeric.upper_median(values)) == 3
    assert one(spark, numeric.floor_quantile(values, 0.5)) == 2


def test_percent_rank_shares_ties(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 3)], "g string, v int")
    got = df.select("v", numeric.percent_rank_average(F.col("v"), "g").alias("p")).orderBy("v").collect()
    assert [r["p"] for r in got] == [0.25, 0.625, 0.625, 1.0]


def test_cascade_takes_the_first_rule_and_null_does_not_hold(spark):
    df = spark.createDataFrame([(None,), (0.005,), (0.5,)], "share double")
    rules = [Rule("absent", F.col("share").isNull()), Rule("small", F.col("share") < 0.01)]
    assert [r["x"] for r in df.select(cascade(rules, "rest").alias("x")).collect()] == ["absent", "small", "rest"]
    assert one(spark, cascade([Rule("a", F.lit(None).cast("boolean"))])) is None


@pytest.mark.parametrize("line,want", [("12 North Oak Street, Suite 4", "12 N OAK ST"), ("12 n. oak st", "12 N OAK ST"), ("Oak Street", None), ("PO Box 7", None), (None, None)])
def test_street(spark, line, want):
    assert one(spark, text.street(F.lit(line).cast("string"))) == want


@pytest.mark.parametrize("said,want", [("$5.7B", 5.7e9), ("250M", 250e6), ("900K", 9e5), ("1,200", 1200.0), ("none", None)])
def test_money(spark, said, want):
    assert one(spark, text.money(F.lit(said))) == want


@pytest.mark.parametrize("said,want", [("+1 (212) 555-0100", "2125550100"), ("212.555.0100", "2125550100"), ("555-0100", None)])
def test_phone(spark, said, want):
    assert one(spark, text.phone_digits(F.lit(said))) == want


def test_firm_key_and_loose_search(spark):
    assert one(spark, text.firm_key(F.lit("Oak & Elm, Inc."))) == one(spark, text.firm_key(F.lit("OAK AND ELM LLC"))) == "OAK AND ELM"
    assert one(spark, text.loose_contains(F.lit("Blue-Sky Partners"), F.lit("bluesky")))
    assert not one(spark, text.loose_contains(F.lit("Blue-Sky Partners"), F.lit("xy")))


def test_quotes(spark):
    body = F.lit("He said “we hold  all assets” — and then, much later, that fees are low.")
    assert one(spark, text.quote_present(body, F.lit('"we hold all assets"')))
    assert one(spark, text.quote_present(body, F.lit("we hold all assets ... that fees are low")))
    assert not one(spark, text.quote_present(body, F.lit("we hold no assets")))


def test_csv_guard(spark):
    assert [one(spark, text.csv_guard(F.lit(v))) for v in ("=1+1", "-2", "plain")] == ["'=1+1", "'-2", "plain"]


def test_names(spark):
    assert one(spark, names.surname(F.lit("Ann B. Example Jr."))) == "example"
    assert one(spark, names.given(F.lit("Ann B. Example Jr."))) == ["ann", "b"]
    assert one(spark, names.generation_agrees(F.lit("A Example Jr"), F.lit("A Example Sr"))) == -1
    assert one(spark, names.generation_agrees(F.lit("A Example"), F.lit("A Example Sr"))) == 0
    score = lambda a, b: one(spark, names.given_score(F.lit(a), F.lit(b)))
    assert [score("ann", "ann"), score("ann", "anne"), score("a", "ann"), score("ann", "bob")] == [1.0, 0.8, 0.45, 0.0]
    assert one(spark, names.best_given_score(names.forms(F.lit("Bob")), names.forms(F.lit("Robert")))) == 1.0
    assert one(spark, names.overlap(F.array().cast("array<string>"), F.array(F.lit("x")))) is None


def test_geography(spark):
    assert round(one(spark, geo.miles(F.lit(40.0), F.lit(-74.0), F.lit(41.0), F.lit(-74.0))), 1) == 69.1
    assert [one(spark, geo.cell(F.lit(v))) for v in (0.125, 0.375)] == [0, 2]
    square = [(0, 0), (0, 10), (10, 10), (10, 0)]
    assert one(spark, geo.in_polygon(F.lit(5.0), F.lit(5.0), square)) and not one(spark, geo.in_polygon(F.lit(5.0), F.lit(15.0), square))


def test_filter_spec(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "b", None), (3, None, 50.0)], "id int, kind string, size double")
    assert [r.id for r in df.filter(FilterSpec(members={"kind": []}).predicate()).collect()] == [1, 2, 3]
    assert [r.id for r in df.filter(FilterSpec(members={"kind": ["a", "b"]}, bands={"size": [(None, 10)]}).predicate()).collect()] == [1]
    hidden = FilterSpec(members={"kind": ["a"]}, bands={"size": [(0, 10)]}).hiding(df, F.col("id") == 2).first()
    assert hidden["kind"] and hidden["band_size"]
