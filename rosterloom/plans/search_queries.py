"""Searches for places and people, capped lists, mailbox pages, and values as they are shown."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import activity, relational, search
from .base import FIRMS, LOG, firms, log, query, table


@query("""WITH q AS (SELECT c_custkey AS q, upper(CASE c_custkey // 20 % 3 WHEN 0 THEN n_name[1:3] WHEN 1 THEN c_mktsegment[1:2] ELSE (c_custkey // 20 % 90)::VARCHAR END) AS t FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 20 = 0),
  s AS (SELECT 'N' || n_nationkey AS code, n_name AS name FROM nation), z AS (SELECT (10000 + s_suppkey * 997 % 90000)::VARCHAR AS zip, 'N' || s_nationkey AS state FROM supplier),
  c AS (SELECT c_mktsegment AS city, 'N' || c_nationkey AS state, count(*) AS n FROM customer GROUP BY ALL),
  f AS (SELECT q, 1 AS o, 'state' AS kind, name AS label, code AS state, 0 AS n FROM q JOIN s ON code = t OR starts_with(upper(name), t)
    UNION ALL SELECT q, 2, 'zip', zip, state, 0 FROM q JOIN z ON starts_with(zip, t) WHERE regexp_full_match(t, '[0-9]+')
    UNION ALL SELECT q, 2, 'city', city, state, n FROM q JOIN c ON starts_with(upper(city), t) WHERE length(t) >= 2 AND NOT regexp_full_match(t, '[0-9]+'))
  SELECT q, kind, label, state, n::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY o, n DESC, label, state) AS rn FROM f) WHERE rn <= 10""")
def place_suggestions(spark, sf_dir):
    """The ten first places for every twentieth person's term: part of a state's name, of a city's, or digits."""
    n = table(spark, sf_dir, "nation")
    code = lambda c: F.concat(F.lit("N"), F.col(c).cast("string"))
    c = table(spark, sf_dir, "customer")
    turn = F.floor(F.col("c_custkey") / 20)
    term = F.when(turn % 3 == 0, F.substring("n_name", 1, 3)).when(turn % 3 == 1, F.substring("c_mktsegment", 1, 2)).otherwise((turn % 90).cast("string"))
    terms = c.filter("c_custkey % 20 = 0").join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("q"), term.alias("term"))
    states = n.select(code("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    zips = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 997 % 90000 + 10000).cast("string").alias("zip"), code("s_nationkey").alias("state"))
    cities = c.groupBy(F.col("c_mktsegment").alias("city"), code("c_nationkey").alias("state")).agg(F.count("*").alias("n"))
    return search.places(terms, states, zips, cities)


@query("""WITH i AS (SELECT p_partkey AS id, lower(p_name) AS name, [lower(replace(p_brand, '#', ''))] AS alts, lower(p_name || ' ' || p_brand || ' ' || p_type) AS text, p_size < 5 AS at_hand FROM part),
  q AS (SELECT p_partkey AS q, CASE WHEN p_partkey % 40 = 0 THEN [lower(p_name[1:3]), lower(replace(p_brand, '#', ''))] ELSE [lower(p_brand), lower(string_split(p_name, ' ')[2])] END AS words FROM part WHERE p_partkey % 20 = 0),
  n AS (SELECT q, id FROM q JOIN i ON at_hand AND contains(text, words[1]) AND contains(text, words[2])),
  x AS (SELECT q, id FROM q JOIN i ON list_contains(list_transform(list_concat(string_split(name, ' '), alts), lambda w: w[1:2]), words[1][1:2])
    AND (contains(name, words[1]) OR starts_with(alts[1], words[1])) AND (contains(name, words[2]) OR starts_with(alts[1], words[2])))
  SELECT q, id, 'near' AS source FROM n UNION ALL SELECT q, id, 'index' FROM x ANTI JOIN n USING (q, id)""")
def field_search(spark, sf_dir):
    """Every twentieth name with a firm, among the people at hand by any field and among all by name and alternates."""
    p = table(spark, sf_dir, "part")
    plain = F.replace("p_brand", F.lit("#"), F.lit(""))
    term = F.when(F.col("p_partkey") % 40 == 0, F.concat_ws(" ", F.substring("p_name", 1, 3), plain)).otherwise(F.concat_ws(" ", "p_brand", F.element_at(F.split("p_name", " "), 2)))
    index = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.array(F.lower(plain)).alias("alternates"))
    near = p.filter("p_size < 5").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))
    return search.field(p.filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("q"), term.alias("term")), index, near)


@query(f"""WITH {FIRMS}, m AS (SELECT 'relevant' AS mode, crd, row_number() OVER (ORDER BY coalesce(assets, -1) DESC, coalesce(people, 0) DESC, name, crd) AS place FROM firms
    UNION ALL SELECT 'advisors', crd, row_number() OVER (ORDER BY coalesce(people, 0) DESC, coalesce(assets, -1) DESC, name, crd) FROM firms)
  SELECT mode, crd, least(n, 25) AS shown, n AS total, greatest(n - 25, 0) AS more FROM m, (SELECT count(*) AS n FROM firms) WHERE place <= 25""")
def firm_list(spark, sf_dir):
    """The first 25 firms of a list in its two orders, with how many more there are."""
    f = firms(spark, sf_dir)
    assets, heads = F.coalesce("assets", F.lit(-1)).desc(), F.coalesce("people", F.lit(0)).desc()
    parts = []
    for mode, order in (("relevant", (assets, heads)), ("advisors", (heads, assets))):
        rows, counts = relational.capped(f, 25, *order, F.asc("name"), F.asc("crd"))
        parts.append(rows.select(F.lit(mode).alias("mode"), "crd").join(F.broadcast(counts)))  # one row of counts
    return relational.union_all(*parts)


@query(f"""WITH {LOG}, r AS (SELECT rep, event_id, row_number() OVER (PARTITION BY rep ORDER BY occurred_at, event_id) AS nth, count(*) OVER (PARTITION BY rep) AS n FROM log WHERE occurred_at >= TIMESTAMP '2024-01-03')
  SELECT rep, event_id, ((nth - 1) // 20 + 1)::INT AS page, n > 60 AS truncated FROM r WHERE nth <= 60""")
def mailbox_pages(spark, sf_dir):
    since = F.lit("2024-01-03").cast(log(spark, sf_dir).schema["occurred_at"].dataType)
    return activity.oldest_pages(log(spark, sf_dir), "rep", "occurred_at", "event_id", since, size=20, pages=3).select("rep", "event_id", "page", "truncated")


@query("""WITH o AS (SELECT o_orderkey AS id, (o_totalprice::DECIMAL(18,2) * power(10, o_orderkey % 9)::BIGINT)::DECIMAL(30,6) AS d, greatest(floor(date_diff('day', o_orderdate::DATE, DATE '1998-12-31') / 30.4375 + 0.5), 0)::BIGINT AS m FROM orders)
  SELECT id, CASE WHEN d >= 1000000000000 THEN '$' || CASE WHEN d < 10000000000000 THEN round((d / 100000000000)::DECIMAL(38,6), 0)::BIGINT // 10 || '.' || round((d / 100000000000)::DECIMAL(38,6), 0)::BIGINT % 10 ELSE round((d / 1000000000000)::DECIMAL(38,6), 0)::BIGINT::VARCHAR END || 'T'
    WHEN d >= 1000000000 THEN '$' || CASE WHEN d < 10000000000 THEN round((d / 100000000)::DECIMAL(38,6), 0)::BIGINT // 10 || '.' || round((d / 100000000)::DECIMAL(38,6), 0)::BIGINT % 10 ELSE round((d / 1000000000)::DECIMAL(38,6), 0)::BIGINT::VARCHAR END || 'B'
    WHEN d >= 1000000 THEN '$' || floor(d / 1000000 + 0.5)::BIGINT || 'M' WHEN d >= 1000 THEN '$' || floor(d / 1000 + 0.5)::BIGINT || 'K' ELSE '$' || floor(d + 0.5)::BIGINT END AS amount,
    CASE WHEN m < 12 THEN m || ' month' || CASE WHEN m = 1 THEN '' ELSE 's' END WHEN m % 12 > 0 THEN m // 12 || ' yr ' || m % 12 || ' mo' ELSE m // 12 || ' year' || CASE WHEN m = 12 THEN '' ELSE 's' END END AS tenure FROM o""")
def shown_values(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    d = F.col("o_totalprice").cast("decimal(18,2)") * F.pow(F.lit(10), F.col("o_orderkey") % 9).cast("long")
    return o.select(F.col("o_orderkey").alias("id"), text.short_money(d).alias("amount"), text.tenure(F.col("o_orderdate").cast("date"), F.lit("1998-12-31").cast("date")).alias("tenure"))
