"""Review sheets, published names, base cities, rosters' label columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.review import NOISE
from ..operators import bases, review, rosters
from .base import people, query, table

_CODE = "chr((97 + {} % 26)::INT)"
REVIEW = f"""r AS (SELECT p_partkey AS id, p_brand || ' Wealth LLC' AS our_firm, CASE p_partkey % 3 WHEN 0 THEN p_brand || ' Inc' WHEN 1 THEN p_type || ' ' || p_brand ELSE 'Other Group' END AS filed_firm,
    CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name[1] || ' ' || string_split(p_name, ' ')[2] WHEN 2 THEN 'Bob ' || string_split(p_name, ' ')[2] ELSE 'Casey ' || p_name END AS our_name,
    CASE WHEN p_partkey % 4 = 2 THEN 'ROBERT ' || upper(p_name) ELSE upper(p_name) END AS filed_name, upper(p_name) AS legal_name,
    lpad((p_partkey * 7 % 100)::VARCHAR, 5, '0') || '-1234' AS our_postal, CASE WHEN p_partkey % 9 > 0 THEN 'City ' || {_CODE.format("p_partkey")} END AS our_city,
    'HEAD' AS city0, '00000' AS postal0 FROM part),
  b AS (SELECT l_partkey AS id, l_orderkey * 10 + l_linenumber AS ord, 'CITY' || upper({_CODE.format("l_suppkey")}) || CASE WHEN l_linenumber = 1 THEN 'VILLE' ELSE '' END AS city, lpad((l_orderkey % 100)::VARCHAR, 5, '0') AS postal FROM lineitem),
  f AS (SELECT r.id, b.city, b.postal, row_number() OVER (PARTITION BY r.id ORDER BY CASE WHEN b.postal = our_postal[1:5] THEN 1 WHEN starts_with(lower(b.city), lower(replace(our_city, ' ', ''))) THEN 2 ELSE 3 END, ord) AS rn, count(*) OVER (PARTITION BY r.id) AS n,
    b.postal = our_postal[1:5] OR coalesce(starts_with(lower(b.city), lower(replace(our_city, ' ', ''))), false) AS fits FROM r JOIN b USING (id)),
  c AS (SELECT r.*, CASE WHEN fits THEN f.city ELSE city0 END AS city, CASE WHEN fits THEN f.postal ELSE postal0 END AS postal, coalesce(n, 0) AS branch_count FROM r LEFT JOIN f ON r.id = f.id AND rn = 1),
  w AS (SELECT *, {", ".join(f"list_distinct(list_filter(regexp_split_to_array(lower({s}_firm), '[^a-z0-9]+'), lambda x: length(x) > 1 AND NOT list_contains({NOISE!r}, x))) AS {s}_words" for s in ("our", "filed"))},
    CASE WHEN id % 4 = 2 THEN 'robert' ELSE lower(string_split(our_name, ' ')[1]) END AS first1, lower(string_split(filed_name, ' ')[1]) AS k1, lower(string_split(legal_name, ' ')[1]) AS k2 FROM c),
  e AS (SELECT *, CASE WHEN len(our_words) = 0 OR len(filed_words) = 0 THEN 'unknown' WHEN len(list_intersect(our_words, filed_words)) = least(len(our_words), len(filed_words)) THEN 'yes' WHEN len(list_intersect(our_words, filed_words)) > 0 THEN 'partial' ELSE 'no' END AS firms_agree,
    CASE WHEN first1 IN (k1, k2) THEN 'yes' WHEN length(first1) = 1 AND (k1[1] = first1 OR k2[1] = first1) THEN 'initial' ELSE 'no' END AS first_names_agree,
    CASE WHEN our_postal[1:5] = postal THEN 'yes' ELSE 'no' END AS postals_agree, CASE WHEN our_city IS NULL THEN 'unknown' WHEN starts_with(lower(city), lower(replace(our_city, ' ', ''))) THEN 'yes' ELSE 'no' END AS cities_agree FROM w)"""


@query(f"""WITH {REVIEW} SELECT id, city, postal, branch_count, firms_agree, first_names_agree, postals_agree, cities_agree,
  CASE WHEN first_names_agree = 'no' AND postals_agree <> 'yes' THEN 'REJECT' WHEN first_names_agree IN ('yes', 'initial') AND 'yes' IN (postals_agree, firms_agree, cities_agree) THEN 'ACCEPT' ELSE 'CHECK' END AS suggestion FROM e""")
def review_sheet(spark, sf_dir):
    k, name = F.col("p_partkey"), F.col("p_name")
    last = F.element_at(F.split(name, " "), 2)
    letter = lambda c: F.char(F.lit(97) + F.col(c) % 26)
    two = lambda c: F.lpad(c.cast("string"), 5, "0")
    rows = table(spark, sf_dir, "part").select(
        k.alias("id"), F.concat("p_brand", F.lit(" Wealth LLC")).alias("our_firm"),
        F.when(k % 3 == 0, F.concat("p_brand", F.lit(" Inc"))).when(k % 3 == 1, F.concat("p_type", F.lit(" "), "p_brand")).otherwise("Other Group").alias("filed_firm"),
        F.when(k % 4 == 0, name).when(k % 4 == 1, F.concat(F.substring(name, 1, 1), F.lit(" "), last)).when(k % 4 == 2, F.concat(F.lit("Bob "), last)).otherwise(F.concat(F.lit("Casey "), name)).alias("our_name"),
        F.when(k % 4 == 2, F.concat(F.lit("ROBERT "), F.upper(name))).otherwise(F.upper(name)).alias("filed_name"), F.upper(name).alias("legal_name"),
        F.concat(two(k * 7 % 100), F.lit("-1234")).alias("our_postal"), F.when(k % 9 > 0, F.concat(F.lit("City "), letter("p_partkey"))).alias("our_city"),
        F.lit("").alias("street"), F.lit("HEAD").alias("city"), F.lit("").alias("state"), F.lit("00000").alias("postal"),
    )
    city = F.concat(F.lit("CITY"), F.upper(letter("l_suppkey")), F.when(F.col("l_linenumber") == 1, "VILLE").otherwise(""))
    branches = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.lit("").alias("street"), city.alias("city"), F.lit("").alias("state"), two(F.col("l_orderkey") % 100).alias("postal"))
    placed = review.best_branch(rows.withColumn("row", F.col("id")), branches, "row", "id", "ord")
    return review.sheet(placed).select("id", "city", "postal", "branch_count", "firms_agree", "first_names_agree", "postals_agree", "cities_agree", "suggestion")


PUBLISHED = """p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 13 = 0 THEN '' ELSE 'Jo' END AS first, 'Lee' AS middle, CASE c_custkey % 4 WHEN 0 THEN 'Josesph' WHEN 1 THEN 'Jo' WHEN 2 THEN 'Katheryn' ELSE 'Wanda' END AS used, c_mktsegment AS last FROM customer),
  c AS (SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN 'review' WHEN 1 THEN 'confirmed' ELSE 'high' END AS tier,
    CASE c_custkey % 6 WHEN 0 THEN 'Joe ' || c_mktsegment WHEN 1 THEN 'Jo ' || c_mktsegment WHEN 2 THEN 'B ' || c_mktsegment WHEN 3 THEN 'Katie ' || c_mktsegment WHEN 4 THEN 'Lee Q ' || c_mktsegment ELSE 'Joe Other' END AS name,
    CASE c_custkey % 5 WHEN 0 THEN 'joe.x@a.com' WHEN 1 THEN 'Lee@a.com' WHEN 2 THEN 'joel@a.com' END AS email, CASE WHEN c_custkey % 3 < 2 THEN 'https://a.com/team/joe-x' ELSE 'https://a.com/jo' END AS url FROM customer WHERE c_custkey % 11 <> 0)"""


@query(f"""WITH {PUBLISHED}, j AS (SELECT id, tier, first, middle, used, last, lower(string_split(name, ' ')[1]) AS given, lower(string_split(name, ' ')[-1]) AS surname, regexp_split_to_array(lower(coalesce(email, '')), '[^a-z]+') AS e, regexp_split_to_array(lower(url), '[^a-z]+') AS u FROM p JOIN c USING (id) WHERE first <> '' AND length(used) > length(first)),
  r AS (SELECT *, given IN (lower(first), lower(middle)) AS filed, CASE WHEN tier = 'review' THEN 'tier' WHEN surname <> lower(last) THEN 'surname' WHEN length(given) < 2 THEN 'initial'
    WHEN given IN (lower(first), lower(middle)) THEN CASE WHEN list_contains(e, given) OR list_contains(u, given) THEN 'shown' ELSE 'no_corroboration' END
    WHEN length(given) >= length(used) OR given[1:2] <> lower(used)[1:2] THEN 'not_in_filing' WHEN list_contains(e, given) AND list_contains(u, given) THEN 'shown' ELSE 'no_corroboration' END AS reason FROM j),
  t AS (SELECT *, upper(last[1]) || lower(last[2:]) AS shown_last FROM r)
  SELECT id, reason, CASE WHEN reason = 'shown' THEN CASE WHEN filed THEN first ELSE upper(given[1]) || given[2:] END || ' ' || shown_last END AS preferred, CASE WHEN reason = 'shown' THEN used || ' ' || shown_last END AS replaced FROM t""")
def published_names(spark, sf_dir):
    k, last = F.col("c_custkey"), F.col("c_mktsegment")
    c = table(spark, sf_dir, "customer")
    said = c.select(k.alias("id"), F.when(k % 13 == 0, "").otherwise("Jo").alias("first"), F.lit("Lee").alias("middle"), F.when(k % 4 == 0, "Josesph").when(k % 4 == 1, "Jo").when(k % 4 == 2, "Katheryn").otherwise("Wanda").alias("used"), last.alias("last"))
    with_last = lambda given: F.concat(F.lit(given), last)
    held = c.filter(k % 11 != 0).select(
        k.alias("id"), F.when(k % 7 == 0, "review").when(k % 7 == 1, "confirmed").otherwise("high").alias("tier"),
        F.when(k % 6 == 0, with_last("Joe ")).when(k % 6 == 1, with_last("Jo ")).when(k % 6 == 2, with_last("B ")).when(k % 6 == 3, with_last("Katie ")).when(k % 6 == 4, with_last("Lee Q ")).otherwise("Joe Other").alias("name"),
        F.when(k % 5 == 0, "joe.x@a.com").when(k % 5 == 1, "Lee@a.com").when(k % 5 == 2, "joel@a.com").alias("email"), F.when(k % 3 < 2, "https://a.com/team/joe-x").otherwise("https://a.com/jo").alias("url"),
    )
    return review.published_names(said, held, "id")


@query(None)
def territory_bases(spark, sf_dir):
    """States by their people's balances, one candidate city a state, neighbours by number."""
    p = people(spark, sf_dir).withColumn("w", F.greatest(F.col("balance"), F.lit(1.0)).cast("decimal(18,2)"))
    mean = lambda c: F.bround(F.avg(F.col(c).cast("decimal(18,4)")), 4).cast("double").alias(c)
    states = p.groupBy("state").agg(mean("lat"), mean("lon"), F.sum("w").cast("double").alias("weight"))
    cities = p.filter("person % 3 = 0").groupBy(F.col("state").alias("city")).agg(mean("lat"), mean("lon"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"))
    borders = n.select("a", F.explode(F.array(F.col("a") + 1, F.col("a") + 5)).alias("b"))
    return bases.choose(states, cities, borders, k=4, starts=3).select("state", "base")


@query("""WITH r AS (SELECT p_partkey AS id, p_brand AS roster, p_type AS city, CASE right(p_brand, 1) WHEN '1' THEN p_type WHEN '2' THEN 'dept ' || p_partkey % 3 WHEN '3' THEN '' ELSE p_name || ' ' || p_partkey END AS team FROM part),
  s AS (SELECT roster, count(*) AS n, count(DISTINCT team) AS v, count(*) FILTER (team = city) AS e FROM r WHERE team <> '' GROUP BY 1)
  SELECT id, CASE WHEN n >= 50 AND (v < n * 0.15 OR e > n * 0.5) THEN '' ELSE team END AS team FROM r LEFT JOIN s USING (roster)""")
def roster_labels(spark, sf_dir):
    brand = F.right("p_brand", F.lit(1))
    team = F.when(brand == "1", F.col("p_type")).when(brand == "2", F.concat(F.lit("dept "), (F.col("p_partkey") % 3).cast("string"))).when(brand == "3", "").otherwise(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")))
    r = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("roster"), F.col("p_type").alias("city"), team.alias("team"))
    return rosters.drop_label_columns(r, "roster", "team", "city").select("id", "team")
