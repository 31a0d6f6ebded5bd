"""Firms: coercion, derived features, rule cascades, scores, allocation, books."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numeric, text
from ..functions.rules import Component, Rule, cascade, weighted
from ..operators import allocation, relational
from .base import FIRMS, OFFICES, accounts, firms, holdings, offices, query, table


def _dec(c, places=4):
    return F.bround(c.cast("decimal(28,8)"), places).cast("double")


def _share():
    return numeric.clip(numeric.ratio(F.col("retail_rows").cast("double"), F.col("rows").cast("double")))


def scored(spark, sf_dir):
    """Firms with motion, points and score; the flagship pipeline builds on it."""
    f = firms(spark, sf_dir).withColumn("retail_share", _share())
    motion = cascade([
        Rule("insufficient_data", F.col("assets").isNull()),
        Rule("negative_balance", F.col("balance") < 0),
        Rule("retail_led", F.col("retail_share") >= 0.52),
        Rule("institutional", F.col("people") < F.col("accounts") * 0.93),
    ], "mixed")
    points, total = weighted([
        Component("size_pts", 40, numeric.log_scale(F.col("assets").cast("double"), 1e5, 1e9)),
        Component("reach_pts", 35, numeric.log_scale(F.col("people").cast("double"), 1, 1000)),
        Component("retail_pts", 25, F.coalesce("retail_share", F.lit(0.0))),
    ], lambda c: _dec(c, 3))
    return f.withColumn("motion", motion).withColumns(points).withColumn("score", total)


SCORED = f"""{FIRMS}, shared AS (
  SELECT *, least(greatest(retail_rows::DOUBLE / nullif(rows, 0), 0), 1) AS retail_share FROM firms),
pts AS (SELECT *, CASE WHEN assets IS NULL THEN 'insufficient_data' WHEN balance < 0 THEN 'negative_balance'
    WHEN retail_share >= 0.52 THEN 'retail_led' WHEN people < accounts * 0.93 THEN 'institutional' ELSE 'mixed' END AS motion,
  40 * CASE WHEN assets > 0 THEN least(greatest((log10(greatest(assets::DOUBLE, 1e5)) - 5) / 4, 0), 1) ELSE 0 END AS p1,
  35 * CASE WHEN people > 0 THEN least(greatest((log10(greatest(people::DOUBLE, 1)) - 0) / 3, 0), 1) ELSE 0 END AS p2,
  25 * coalesce(retail_share, 0) AS p3 FROM shared),
scored AS (SELECT *, round_even(p1::DECIMAL(28,8), 3)::DOUBLE AS size_pts, round_even(p2::DECIMAL(28,8), 3)::DOUBLE AS reach_pts,
  round_even(p3::DECIMAL(28,8), 3)::DOUBLE AS retail_pts, round_even((p1 + p2 + p3)::DECIMAL(28,8), 3)::DOUBLE AS score FROM pts)"""


@query(f"WITH {SCORED} SELECT crd, name, motion, size_pts, reach_pts, retail_pts, score FROM scored")
def firm_score_cascade(spark, sf_dir):
    return scored(spark, sf_dir).select("crd", "name", "motion", "size_pts", "reach_pts", "retail_pts", "score")


@query(f"""WITH {SCORED} SELECT crd, motion,
  round_even(((rank() OVER (PARTITION BY motion ORDER BY score) + (count(*) OVER (PARTITION BY motion, score) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY motion))::DECIMAL(28,8), 6)::DOUBLE AS pct
  FROM scored""")
def score_pct_in_motion(spark, sf_dir):
    ranked = relational.percent_ranks(scored(spark, sf_dir).select("crd", "motion", "score"), "motion", "score", "share")
    return ranked.select("crd", "motion", _dec(F.col("share"), 6).alias("pct"))


@query(f"""WITH {SCORED} SELECT crd, CASE WHEN abs(retail_share - 0.52) < 0.01 THEN 'near_retail_cut' WHEN abs(balance) < 500 THEN 'near_zero_balance' END AS review FROM scored""")
def review_flags(spark, sf_dir):
    flags = [Rule("near_retail_cut", F.abs(F.col("retail_share") - 0.52) < 0.01), Rule("near_zero_balance", F.abs("balance") < 500)]
    return scored(spark, sf_dir).select("crd", cascade(flags).alias("review"))


@query(f"""WITH {SCORED} SELECT crd, CASE WHEN size_pts >= 30 AND retail_pts >= 12.5 THEN 'both' WHEN size_pts >= 30 THEN 'size_only'
  WHEN retail_pts >= 12.5 THEN 'retail_only' ELSE 'neither' END AS product_motion FROM scored""")
def product_motion(spark, sf_dir):
    a, b = F.col("size_pts") >= 30, F.col("retail_pts") >= 12.5
    return scored(spark, sf_dir).select("crd", F.when(a & b, "both").when(a, "size_only").when(b, "retail_only").otherwise("neither").alias("product_motion"))


@query(f"WITH {SCORED} SELECT crd, score FROM scored ORDER BY score DESC, crd LIMIT 20")
def top_firms(spark, sf_dir):
    return scored(spark, sf_dir).select("crd", "score").orderBy(F.desc("score"), "crd").limit(20)


@query(f"""WITH {SCORED} SELECT n_regionkey AS territory, count(*) AS firms, count(*) FILTER (motion = 'retail_led') AS retail_led,
  sum(assets)::DOUBLE AS assets, string_agg(DISTINCT n_name, '|' ORDER BY n_name) AS states
  FROM scored JOIN nation ON state = n_nationkey GROUP BY 1""")
def state_territory_rollup(spark, sf_dir):
    n = F.broadcast(table(spark, sf_dir, "nation"))  # 25 rows, a fixed dimension
    f = scored(spark, sf_dir).join(n, F.col("state") == F.col("n_nationkey"))
    return f.groupBy(F.col("n_regionkey").alias("territory")).agg(F.count("*").alias("firms"), F.count_if(F.col("motion") == "retail_led").alias("retail_led"), F.sum("assets").cast("double").alias("assets"), text.sorted_set(F.collect_set("n_name")).alias("states"))


ALLOCATED = f"""{FIRMS}, {OFFICES}, m AS (SELECT firm, count(DISTINCT person) AS members FROM offices GROUP BY 1),
r AS (SELECT firm, person, count(*) AS member_rows FROM offices GROUP BY 1, 2),
allocated AS (SELECT o.firm, o.person, o.office, assets::DOUBLE / members / member_rows AS allocated
  FROM offices o JOIN m USING (firm) JOIN r USING (firm, person) LEFT JOIN firms f ON f.crd = o.firm)"""


def _allocated(spark, sf_dir):
    totals = firms(spark, sf_dir).select(F.col("crd").alias("firm"), F.col("assets").cast("double").alias("assets"))
    tasks = relational.task_count(table(spark, sf_dir, "lineitem"))
    return allocation.allocate(offices(spark, sf_dir), totals, "firm", "person", "assets", tasks), totals


@query(f"WITH {ALLOCATED} SELECT firm, person, office, round_even(allocated::DECIMAL(28,8), 4)::DOUBLE AS allocated FROM allocated")
def allocate_by_branch(spark, sf_dir):
    return _allocated(spark, sf_dir)[0].select("firm", "person", "office", _dec(F.col("allocated")).alias("allocated"))


@query(f"""WITH {ALLOCATED} SELECT round_even((SELECT sum(assets) FROM firms)::DECIMAL(28,8), 0)::DOUBLE AS stated,
  round_even((SELECT sum(assets) FROM firms WHERE crd IN (SELECT firm FROM offices))::DECIMAL(28,8), 0)::DOUBLE AS reconcilable,
  round_even((SELECT sum(allocated) FROM allocated)::DECIMAL(28,8), 0)::DOUBLE AS allocated""")
def allocation_reconciles(spark, sf_dir):
    rows, totals = _allocated(spark, sf_dir)
    return allocation.reconcile(rows, totals, "firm", "assets").select(*[_dec(F.col(c), 0).alias(c) for c in ("stated", "reconcilable", "allocated")])


@query("""SELECT o_orderkey AS account, o_custkey AS person FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
  AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def universe_semi(spark, sf_dir):
    a = accounts(spark, sf_dir).select("account", "person")
    poor = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("person"))
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("account"))
    return relational.restrict(relational.restrict(a, poor, ["person"]), returned, ["account"])


@query("SELECT o_orderkey AS account FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_anti(spark, sf_dir):
    known = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("account"))
    return relational.missing_only(accounts(spark, sf_dir).select("account"), known, ["account"])


@query("SELECT o_custkey AS person, min(o_orderdate) AS first_date, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_account FROM orders GROUP BY 1")
def first_exam_argmin(spark, sf_dir):
    return accounts(spark, sf_dir).groupBy("person").agg(F.min("stamp").alias("first_date"), F.min_by("account", F.struct("stamp", "account")).alias("first_account"))


@query("""WITH f AS (SELECT o_custkey AS person, date_diff('day', min(o_orderdate)::DATE, DATE '1998-12-31') AS days FROM orders GROUP BY 1),
  y AS (SELECT person, round_even((days / 365.25)::DECIMAL(28,8), 1)::DOUBLE AS years FROM f)
  SELECT person, years, CASE WHEN years <= 2 THEN 'new' WHEN years <= 4 THEN 'settled' WHEN years <= 6 THEN 'senior' ELSE 'veteran' END AS band FROM y""")
def experience_bands(spark, sf_dir):
    days = F.datediff(F.lit("1998-12-31").cast("date"), F.min("stamp").cast("date"))
    f = accounts(spark, sf_dir).groupBy("person").agg(_dec(days / F.lit(365.25), 1).alias("years"))
    return f.withColumn("band", numeric.band(F.col("years"), [2, 4, 6], ["new", "settled", "senior", "veteran"]))


@query("""SELECT p_partkey AS id, p_name || CASE WHEN count(*) OVER (PARTITION BY p_name) > 1 THEN ' (' || p_brand || ', ' || p_partkey || ')' ELSE '' END AS display FROM part""")
def unique_display_name(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    twice = F.count("*").over(Window.partitionBy("p_name")) > 1
    return p.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.when(twice, F.concat(F.lit(" ("), "p_brand", F.lit(", "), F.col("p_partkey").cast("string"), F.lit(")"))).otherwise("")).alias("display"))


@query("""WITH b AS (SELECT l_orderkey AS account, l_extendedprice AS value, (l_shipdate, l_linenumber) AS stamp, l_suppkey FROM lineitem),
  t AS (SELECT account, max(stamp) AS top, count(DISTINCT l_suppkey) AS holders, min(round(value, 2)) <> max(round(value, 2)) AS conflict FROM b GROUP BY 1)
  SELECT account, max(value) AS value, any_value(holders) AS holders, any_value(conflict) AS conflict, any_value(conflict) AND count(*) > 1 AS unresolved FROM b JOIN t USING (account) WHERE stamp = top GROUP BY 1""")
def book_dedupe_latest(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("account"), F.col("l_extendedprice").alias("value"), "l_shipdate", "l_linenumber", "l_suppkey")
    return allocation.latest_book(l, "account", "value", F.col("l_shipdate"), F.col("l_linenumber"), holder=F.col("l_suppkey"))


@query("""SELECT p_brand AS grp, p_type AS label, count(*) AS n, sum(p_retailprice::DECIMAL(18,2))::DOUBLE AS value FROM part GROUP BY ROLLUP (p_brand, p_type) HAVING p_brand IS NOT NULL""")
def book_group_rollup(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    out = p.rollup("p_brand", "p_type").agg(F.count("*").alias("n"), F.sum(F.col("p_retailprice").cast("decimal(18,2)")).cast("double").alias("value"))
    return out.filter("p_brand is not null").select(F.col("p_brand").alias("grp"), F.col("p_type").alias("label"), "n", "value")


@query("""WITH h AS (SELECT DISTINCT l_orderkey AS account, l_suppkey AS holder FROM lineitem)
  SELECT count(*) AS accounts, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders WHERE o_orderkey IN (SELECT account FROM h WHERE holder % 3 = 0)""")
def shared_account_union(spark, sf_dir):
    chosen = holdings(spark, sf_dir).filter(F.col("holder") % 3 == 0)
    return allocation.union_total(chosen, accounts(spark, sf_dir), "account", "value").select("accounts", F.col("total").cast("double").alias("total"))


@query("""WITH h AS (SELECT DISTINCT l_orderkey AS account, l_suppkey AS holder FROM lineitem)
  SELECT holder, count(*) AS accounts, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS attributed FROM h JOIN orders ON o_orderkey = account GROUP BY 1""")
def full_attribution(spark, sf_dir):
    a = accounts(spark, sf_dir).select("account", "value")
    return holdings(spark, sf_dir).join(a, "account").groupBy("holder").agg(F.count("*").alias("accounts"), F.sum("value").cast("double").alias("attributed"))


@query("""WITH p AS (SELECT l_suppkey AS k, bool_or(l_returnflag = 'R') AS a, bool_or(l_discount > 0.09) AS b FROM lineitem GROUP BY 1)
  SELECT count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b, count(*) FILTER (a AND b) AS both FROM p""")
def product_gaps(spark, sf_dir):
    return allocation.product_gaps(table(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_returnflag") == "R", F.col("l_discount") > 0.09)


@query("""SELECT l_orderkey AS account, greatest(sum(l_extendedprice::DECIMAL(18,2)) - coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice::DECIMAL(18,2) END), 0)
  - coalesce(sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice::DECIMAL(18,2) END), 0), 0)::DOUBLE AS midcap FROM lineitem GROUP BY 1""")
def residual_split(spark, sf_dir):
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    parts = [F.sum(F.when(F.col("l_returnflag") == f, price)) for f in ("R", "A")]
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("account")).agg(allocation.residual(F.sum(price), *parts).cast("double").alias("midcap"))


@query("""SELECT p_partkey AS id, try_cast(replace(trim('  ' || (p_size * 1234)::VARCHAR || ',000 '), ',', '') AS DOUBLE) AS amount,
  try_cast(replace(trim(p_brand), ',', '') AS DOUBLE) AS bad, upper(trim(substr(p_type, 1, 1))) IN ('S') AS flagged,
  coalesce(CASE WHEN trim(substr(p_name, 1, 0)) <> '' THEN substr(p_name, 1, 0) END, p_type) AS filled FROM part""")
def coercions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    padded = F.concat(F.lit("  "), (F.col("p_size") * 1234).cast("string"), F.lit(",000 "))
    return p.select(F.col("p_partkey").alias("id"), numeric.number(padded).alias("amount"), numeric.number(F.col("p_brand")).alias("bad"), numeric.flag(F.substring("p_type", 1, 1), ("S",)).alias("flagged"), text.first_filled(F.substring("p_name", 1, 0), F.col("p_type")).alias("filled"))


@query("""SELECT l_suppkey AS firm, count(*) AS n, list_sort(list(l_quantity))[len(list(l_quantity)) // 2 + 1] AS upper_median,
  list_sort(list(l_quantity))[floor((len(list(l_quantity)) - 1) * 0.12)::INT + 1] AS low, mode(l_linenumber ORDER BY l_linenumber) AS line_mode
  FROM lineitem GROUP BY 1""")
def medians_and_modes(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("firm"), "l_quantity", "l_linenumber")
    values = relational.at_places(l, ["firm"], "l_quantity", {"upper_median": F.floor(F.col("n") / 2), "low": F.floor((F.col("n") - 1) * F.lit(0.12))})
    modes = l.groupBy("firm").agg(F.expr("mode() WITHIN GROUP (ORDER BY l_linenumber)").alias("line_mode"))
    return values.join(modes, "firm").select("firm", "n", "upper_median", "low", "line_mode")
