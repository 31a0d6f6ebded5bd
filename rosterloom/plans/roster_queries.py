"""Owners, places of people, exports, pages, verdicts, crosswalk checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import audit, matching, relational, rosters
from ..sources import html
from . import match_queries
from .base import FIRMS, OFFICES, PEOPLE, accounts, firms, holdings, offices, people, query, table

CODE_SQL = "substr('FEDCBA', (l_linenumber - 1) % 6 + 1, 1)"
OWNERS = f"""owners AS (SELECT l_suppkey AS firm, o_custkey AS owner, min({CODE_SQL}) AS code, bool_or(l_linestatus = 'F') AS control FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2)"""


def _owners(spark, sf_dir):
    """(firm, owner, code, control): ownership bands from A (least) to F."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("firm"), F.substring(F.lit("FEDCBA"), (F.col("l_linenumber") - 1) % 6 + 1, F.lit(1)).alias("code"), (F.col("l_linestatus") == "F").alias("control"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("owner"))
    return l.join(o, "l_orderkey").groupBy("firm", "owner").agg(F.min("code").alias("code"), F.bool_or("control").alias("control"))


@query(f"""WITH {OWNERS} SELECT firm, owner, code, control, row_number() OVER (PARTITION BY firm ORDER BY code DESC, control DESC, c_name, owner) AS place FROM owners JOIN customer ON c_custkey = owner""")
def owner_rows(spark, sf_dir):
    """The owners of a firm by band from the strongest, control persons first, then by name."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), "c_name")
    w = Window.partitionBy("firm").orderBy(F.desc("code"), F.desc("control"), "c_name", "owner")
    return _owners(spark, sf_dir).join(c, "owner").select("firm", "owner", "code", "control", F.row_number().over(w).alias("place"))


@query(f"""WITH {OWNERS} SELECT owner, count(*) AS roles, count(*) FILTER (control) AS controlled, max(code) AS strongest FROM owners WHERE owner IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1""")
def owner_roles(spark, sf_dir):
    """The roles that shown people hold anywhere."""
    shown = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("owner"))
    return relational.restrict(_owners(spark, sf_dir), shown, ["owner"]).groupBy("owner").agg(F.count("*").alias("roles"), F.count_if("control").alias("controlled"), F.max("code").alias("strongest"))


@query(f"""WITH {OFFICES}, n AS (SELECT person, office, count(*) AS n, office = person % 7 + 1 AS at_home FROM offices GROUP BY 1, 2)
  SELECT person, office, n, at_home, row_number() OVER (PARTITION BY person ORDER BY at_home DESC, n DESC, office) AS place FROM n""")
def places_of_people(spark, sf_dir):
    """Every place of a person with its evidence, the home place and the commonest first."""
    n = offices(spark, sf_dir).groupBy("person", "office").agg(F.count("*").alias("n")).withColumn("at_home", F.col("office") == F.col("person") % 7 + 1)
    w = Window.partitionBy("person").orderBy(F.desc("at_home"), F.desc("n"), "office")
    return n.withColumn("place", F.row_number().over(w))


@query(f"""WITH {PEOPLE} SELECT round_even(lat::DECIMAL(28,8), 5)::VARCHAR || ',' || round_even(lon::DECIMAL(28,8), 5)::VARCHAR || '#' || regexp_extract(person % 90 || ' Oak St', '^([0-9]+)', 1) AS building, count(*) AS people FROM people GROUP BY 1""")
def building_keys(spark, sf_dir):
    """People by building: the place to five decimals and the house number."""
    five = lambda c: F.bround(F.col(c).cast("decimal(28,8)"), 5).cast("string")
    number = F.regexp_extract(F.concat((F.col("person") % 90).cast("string"), F.lit(" Oak St")), "^([0-9]+)", 1)
    return people(spark, sf_dir).groupBy(F.concat(five("lat"), F.lit(","), five("lon"), F.lit("#"), number).alias("building")).agg(F.count("*").alias("people"))


METROS = [("north", 44.0, -95.0), ("south", 29.0, -95.0), ("east", 38.0, -78.0), ("west", 38.0, -115.0)]
FLAT = "pow(b_lat - lat, 2) + pow((b_lon - lon) * cos(radians(lat)), 2)"


@query(f"""WITH {PEOPLE}, b(base, b_lat, b_lon) AS (VALUES {", ".join(f"('{n}', {y}::DOUBLE, {x}::DOUBLE)" for n, y, x in METROS)}) SELECT person, arg_min(base, {FLAT}) AS base FROM people, b GROUP BY 1""")
def nearest_metro(spark, sf_dir):
    bases = spark.createDataFrame(METROS, "base string, b_lat double, b_lon double")
    return rosters.nearest_of(people(spark, sf_dir).select("person", "lat", "lon"), bases, "person", "lat", "lon")


@query(f"""WITH {PEOPLE}, {OFFICES}, e AS (SELECT person, firm, min(office) AS office FROM offices GROUP BY 1, 2)
  SELECT person, firm, office, replace(name, '#', ' ') AS shown, replace(s_name, '#', ' no. ') AS firm_shown, n_name AS state FROM e JOIN people USING (person) LEFT JOIN supplier ON s_suppkey = firm LEFT JOIN nation ON n_nationkey = people.state""")
def individuals_export(spark, sf_dir):
    """A row for each person and firm with the first office and both names."""
    e = offices(spark, sf_dir).groupBy("person", "firm").agg(F.min("office").alias("office"))
    p = people(spark, sf_dir).select("person", F.regexp_replace("name", "#", " ").alias("shown"), F.col("state").alias("n_nationkey"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("firm"), F.regexp_replace("s_name", "#", " no. ").alias("firm_shown"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("state"))
    return e.join(p, "person").join(s, "firm", "left").join(n, "n_nationkey", "left").select("person", "firm", "office", "shown", "firm_shown", "state")


@query(f"""WITH {FIRMS}, {OWNERS}, w AS (SELECT firm, count(*) FILTER (control) AS control_persons, arg_max(owner, (code, control, -owner)) AS lead FROM owners GROUP BY 1)
  SELECT crd, name, assets::DOUBLE AS assets, people, coalesce(control_persons, 0) AS control_persons, lead::VARCHAR AS lead FROM firms LEFT JOIN w ON firm = crd""")
def firm_export(spark, sf_dir):
    """Firms with their lead owner and how many control persons they have."""
    w = _owners(spark, sf_dir).groupBy(F.col("firm").alias("crd")).agg(F.count_if("control").alias("control_persons"), F.max_by("owner", F.struct("code", "control", -F.col("owner"))).alias("lead"))
    f = firms(spark, sf_dir).join(w, "crd", "left")
    return f.select("crd", "name", F.col("assets").cast("double").alias("assets"), "people", F.coalesce("control_persons", F.lit(0)).alias("control_persons"), F.col("lead").cast("string").alias("lead"))


@query("""SELECT o_custkey AS person, count(*) AS rows, count(*) FILTER (o_orderpriority <> c_mktsegment) AS moved FROM (SELECT o_custkey, CASE WHEN o_orderkey % 9 = 0 THEN o_orderpriority ELSE c_mktsegment END AS o_orderpriority, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey) GROUP BY 1""")
def move_signals(spark, sf_dir):
    """Contact rows whose firm is not the filed one."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person"), F.col("c_mktsegment").alias("filed"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person"), "o_orderkey", "o_orderpriority").join(c, "person")
    said = F.when(F.col("o_orderkey") % 9 == 0, F.col("o_orderpriority")).otherwise(F.col("filed"))
    return o.groupBy("person").agg(F.count("*").alias("rows"), F.count_if(said != F.col("filed")).alias("moved"))


@query("""SELECT l_suppkey AS firm, family, sum(amount)::DOUBLE AS amount FROM (SELECT l_suppkey, 'flag_' || lower(l_returnflag) AS family, l_extendedprice::DECIMAL(18,2) AS amount FROM lineitem UNION ALL SELECT l_suppkey, 'line_' || l_linenumber, l_quantity::DECIMAL(18,2) FROM lineitem) GROUP BY 1, 2""")
def column_families(spark, sf_dir):
    """Families of columns (by flag, by line) in long form, one row for each firm and member."""
    l = table(spark, sf_dir, "lineitem")
    cell = lambda name, v: F.struct(name.alias("family"), v.cast("decimal(18,2)").alias("amount"))
    long = l.select(F.col("l_suppkey").alias("firm"), F.explode(F.array(cell(F.concat(F.lit("flag_"), F.lower("l_returnflag")), F.col("l_extendedprice")), cell(F.concat(F.lit("line_"), F.col("l_linenumber").cast("string")), F.col("l_quantity")))).alias("x"))
    return long.groupBy("firm", "x.family").agg(F.sum("x.amount").cast("double").alias("amount"))


@query("""WITH p AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g') AS body FROM pages)
  SELECT page_id, len(list_distinct(regexp_extract_all(html, 'href="([^"#?]+)"', 1))) AS links, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(html, 'mailto:([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,})', 1), lambda e: lower(e)), lambda e: NOT regexp_matches(e, 'example\\.com|wordpress\\.com')))), '|') AS emails,
  array_to_string(list_sort(list_distinct(list_transform(list_filter(list_transform(list_concat(regexp_extract_all(html, 'href="tel:([^"]+)"', 1), regexp_extract_all(body, '\\(?\\b\\d{3}\\)?[.\\-\\s]\\d{3}[.\\-\\s]\\d{4}\\b')), lambda t: regexp_replace(regexp_replace(t, '\\D', '', 'g'), '^1', '')), lambda t: regexp_matches(t, '^[2-9]\\d{9}$')), lambda t: t[1:3] || '.' || t[4:6] || '.' || t[7:10]))), '|') AS phones FROM p""")
def page_harvest(spark, sf_dir):
    """Links, addresses and numbers of every page; the pages give linked addresses alone."""
    p = html.harvest(table(spark, sf_dir, "pages"), "url", "html")
    return p.select("page_id", F.size("links").cast("long").alias("links"), F.array_join("emails", "|").alias("emails"), F.array_join("phones", "|").alias("phones"))


@query("""SELECT 'nobody counts twice' AS name, (SELECT count(*) FROM customer WHERE c_acctbal > 9000 AND c_custkey % 2 = 0) AS failures
  UNION ALL SELECT 'the book is shared', (SELECT (p <= u * 1.05)::BIGINT + (u > s + 1)::BIGINT FROM (SELECT (SELECT sum(o_totalprice::DECIMAL(18,2)) FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey) AS p,
    (SELECT sum(o_totalprice::DECIMAL(18,2)) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS u, (SELECT sum(o_totalprice::DECIMAL(18,2)) FROM orders) AS s))""")
def audit_books(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    team = F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") - 9000)
    a, h = accounts(spark, sf_dir), holdings(spark, sf_dir)
    total = lambda df: df.agg(F.sum("value").alias("total"))
    return audit.failures([
        audit.no_double_count("nobody counts twice", c, F.col("c_acctbal"), team),
        audit.shared_book("the book is shared", total(h.join(a, "account")), total(relational.restrict(a, h, ["account"])), total(a)),
    ])


@query("SELECT 'the crosswalk is sound' AS name, 0::BIGINT AS failures")
def audit_crosswalk(spark, sf_dir):
    """Every contact once, no high row below the threshold, and an id exactly where a tier says so."""
    found = matching.match_contacts(*match_queries._people(spark, sf_dir))
    return audit.sound_crosswalk("the crosswalk is sound", found, "contact", "id", matching.CONTACT.accept)
