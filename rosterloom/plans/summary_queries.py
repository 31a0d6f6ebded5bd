"""Summaries: practices, blocks, destinations, coverage, name shards, filed numbers, vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, text
from ..operators import relational, search
from .base import OFFICES, offices, query, table
from .place_queries import PLACED, _placed

TEAMS = """rows AS (SELECT p_partkey AS person, p_brand AS firm, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS team, CASE WHEN p_partkey % 3 = 0 THEN 'https://' || p_partkey || '.example.com' END AS url FROM part),
practices AS (SELECT firm, team, count(*) AS members, arg_min(url, person) FILTER (url IS NOT NULL) AS url FROM rows GROUP BY 1, 2 HAVING count(*) >= 2)"""


def _teams(spark, sf_dir):
    key = F.col("p_partkey")
    url = F.when(key % 3 == 0, F.concat(F.lit("https://"), key.cast("string"), F.lit(".example.com")))
    return table(spark, sf_dir, "part").select(key.alias("person"), F.col("p_brand").alias("firm"), text.loose(F.col("p_type")).alias("team"), url.alias("url"))


def _practices(rows):
    first = F.min_by("url", F.when(F.col("url").isNotNull(), F.col("person")))
    return rows.groupBy("firm", "team").agg(F.count("*").alias("members"), first.alias("url")).filter("members >= 2")


@query(f"WITH {TEAMS} SELECT * FROM practices")
def practices(spark, sf_dir):
    """Teams of a firm with two members or more, and the first page that a member gives."""
    return _practices(_teams(spark, sf_dir))


@query(f"WITH {TEAMS} SELECT person, firm, team, members FROM rows JOIN practices USING (firm, team)")
def practice_membership(spark, sf_dir):
    """Who belongs to which practice, as rows: a practice of any size makes no long value."""
    rows = _teams(spark, sf_dir)
    return rows.select("person", "firm", "team").join(_practices(rows).select("firm", "team", "members"), ["firm", "team"])


@query("""SELECT c_custkey AS id, min(c_custkey) OVER w AS block, count(*) OVER w AS members FROM customer
  WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment, floor(c_acctbal / 10)) QUALIFY count(*) OVER w >= 2""")
def block_members(spark, sf_dir):
    """Blocks of candidates by their least id: members and sizes instead of pairs."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 10).alias("step"))
    on = ["c_nationkey", "c_mktsegment", "step"]
    sizes = c.groupBy(*on).agg(F.min("id").alias("block"), F.count("*").alias("members")).filter("members >= 2")
    return c.join(sizes, on).select("id", "block", "members")


@query("""WITH t AS (SELECT c_custkey AS person, c_mktsegment || floor(c_acctbal / 1000)::BIGINT AS team, c_nationkey AS state FROM customer),
  b AS (SELECT DISTINCT o_custkey AS person FROM orders WHERE o_orderpriority LIKE '1%' AND o_totalprice > 300000)
  SELECT a.person, count(m.person) AS mates FROM t a LEFT JOIN (SELECT * FROM t ANTI JOIN b USING (person)) m ON a.team = m.team AND a.state = m.state AND a.person <> m.person GROUP BY 1""")
def teammate_counts(spark, sf_dir):
    """How many open members of the team and state each person has beside it, from one count a team."""
    team = F.concat("c_mktsegment", F.floor(F.col("c_acctbal") / 1000).cast("string"))
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person"), team.alias("team"), F.col("c_nationkey").alias("state"))
    blocked = table(spark, sf_dir, "orders").filter("o_orderpriority like '1%' and o_totalprice > 300000").select(F.col("o_custkey").alias("person"))
    marked = relational.corroborate(t, blocked, ["person"], "blocked")
    open_ = marked.groupBy("team", "state").agg(F.count_if(~F.col("blocked")).alias("open"))
    return marked.join(open_, ["team", "state"]).select("person", (F.col("open") - F.when(F.col("blocked"), 0).otherwise(1)).alias("mates"))


@query(f"""WITH {OFFICES}, o AS (SELECT firm, office, c_nationkey AS state, count(DISTINCT person) AS heads FROM offices JOIN customer ON c_custkey = person GROUP BY 1, 2, 3),
  t AS (SELECT o.*, n_name AS state_name, CASE WHEN state % 7 <> 0 THEN r_name END AS territory FROM o JOIN nation ON n_nationkey = state JOIN region ON r_regionkey = n_regionkey)
  SELECT firm, CASE WHEN territory IS NULL THEN state_name ELSE 'T:' || territory END AS scope, coalesce(territory, state_name) AS label, sum(heads)::BIGINT AS placements, count(*) AS offices,
    string_agg(DISTINCT state_name, '|' ORDER BY state_name) AS states FROM t GROUP BY 1, 2, 3""")
def firm_destinations(spark, sf_dir):
    """Where a firm's people sit, by territory, or by state where none owns it."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.select(F.col("n_nationkey").alias("state"), F.col("n_name").alias("state_name"), F.when(F.col("n_nationkey") % 7 != 0, F.col("r_name")).alias("territory"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person"), F.col("c_nationkey").alias("state"))
    o = offices(spark, sf_dir).join(c, "person").groupBy("firm", "office", "state").agg(F.count_distinct("person").alias("heads")).join(n, "state")
    scope = F.when(F.col("territory").isNull(), F.col("state_name")).otherwise(F.concat(F.lit("T:"), "territory"))
    rolled = o.groupBy("firm", scope.alias("scope"), F.coalesce("territory", "state_name").alias("label"))
    # states are a fixed vocabulary
    return rolled.agg(F.sum("heads").alias("placements"), F.count("*").alias("offices"), F.array_join(F.array_sort(F.collect_set("state_name")), "|").alias("states"))


@query(f"""WITH {PLACED} SELECT count(*) AS pairs, count(*) FILTER (location_type <> 'uncertain') AS placed, count(*) FILTER (location_type = 'uncertain') AS unplaced,
  round_even((100 * count(*) FILTER (location_type <> 'uncertain') / greatest(count(*), 1)::DOUBLE)::DECIMAL(28,8), 3)::DOUBLE AS coverage_pct,
  count(*) FILTER (location_type = 'office') AS in_office, count(*) FILTER (location_type = 'remote') AS remote, count(DISTINCT person) AS people, count(DISTINCT firm) AS firms, count(DISTINCT office) AS offices FROM placed""")
def placement_metrics(spark, sf_dir):
    """One row on the placed table: coverage, how places are known, and what is distinct."""
    p = _placed(spark, sf_dir)
    at = F.col("location_type")
    counts = p.agg(
        F.count("*").alias("pairs"), F.count_if(at != "uncertain").alias("placed"), F.count_if(at == "uncertain").alias("unplaced"),
        F.count_if(at == "office").alias("in_office"), F.count_if(at == "remote").alias("remote"),
    )
    # distinct counts apart, so that rows are not repeated for each of them
    for name, key in (("people", "person"), ("firms", "firm"), ("offices", "office")):
        counts = counts.join(F.broadcast(p.select(key).distinct().agg(F.count("*").alias(name))))  # one row
    share = F.lit(100.0) * F.col("placed") / F.greatest("pairs", F.lit(1))
    return counts.withColumn("coverage_pct", F.bround(share.cast("decimal(28,8)"), 3).cast("double"))


GIVEN = ["William", "Bob", "Jane", "Kathy", "Al"]
NICK_SQL = ", ".join(f"('{a}', '{b}')" for a, others in names.nickname_table().items() for b in others)


@query(f"""WITH people AS (SELECT p_partkey AS id, list_value({", ".join(f"'{g}'" for g in GIVEN)})[p_partkey % 5 + 1] || ' ' || upper(substr(p_name, 1, 1)) || '. ' || string_split(p_name, ' ')[2] || CASE WHEN p_partkey % 4 = 0 THEN ' Jr' ELSE '' END AS name FROM part),
  nick(word, other) AS (VALUES {NICK_SQL}), raw AS (SELECT DISTINCT id, name, regexp_replace(unnest(string_split(lower(name), ' ')), '[^a-z]', '', 'g') AS word FROM people),
  w AS (SELECT * FROM raw WHERE length(word) >= 2 AND word NOT IN ({", ".join(f"'{w}'" for w in search.NOT_NAMES)})),
  t AS (SELECT id, name, word AS token FROM w UNION SELECT id, name, other FROM w JOIN nick USING (word) WHERE length(other) >= 2),
  alt AS (SELECT id, coalesce(string_agg(token, ' ' ORDER BY token) FILTER (NOT contains(lower(name), token)), '') AS alt FROM t GROUP BY 1),
  heavy AS (SELECT substr(token, 1, 2) AS two FROM t GROUP BY 1 HAVING count(DISTINCT id) > 60)
  SELECT DISTINCT CASE WHEN h.two IS NULL THEN substr(token, 1, 2) ELSE substr(token, 1, 3) END AS prefix, id, name, alt
  FROM t JOIN alt USING (id) LEFT JOIN heavy h ON h.two = substr(token, 1, 2) WHERE h.two IS NULL OR length(token) >= 3""")
def name_shards(spark, sf_dir):
    """The name index by prefix: words and nicknames, heavy prefixes split by a third letter."""
    p = F.col("p_partkey")
    first = F.element_at(F.array(*map(F.lit, GIVEN)), (p % 5 + 1).cast("int"))
    name = F.concat(first, F.lit(" "), F.upper(F.substring("p_name", 1, 1)), F.lit(". "), F.split("p_name", " ")[1], F.when(p % 4 == 0, " Jr").otherwise(""))
    return search.name_shards(table(spark, sf_dir, "part").select(p.alias("id"), name.alias("name")), "id", "name", 60)


SPELLED = ", ".join(f"'{w}'" for w in text.NUMBER_WORDS)


@query(f"""WITH l AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN p_size || ' ' || p_name WHEN 1 THEN list_value({SPELLED})[p_size % 10 + 1] || ' ' || p_name WHEN 2 THEN 'N' || p_size || ' w' || p_partkey || ', ' || p_name
    WHEN 3 THEN 'n' || p_size || 'E' || p_partkey || ' ' || p_name WHEN 4 THEN 'S' || p_size || ', ' || p_name ELSE p_name END AS line FROM part),
  w AS (SELECT id, upper(rtrim(split_part(line, ' ', 1), ',')) AS a, upper(rtrim(split_part(line, ' ', 2), ',')) AS b FROM l)
  SELECT id, CASE WHEN regexp_full_match(a, '[0-9]+') THEN a WHEN list_position([{SPELLED}], a) > 0 THEN list_position([{SPELLED}], a)::VARCHAR
    WHEN regexp_full_match(a, '[NSEW][0-9]+') THEN a || CASE WHEN regexp_full_match(b, '[NSEW][0-9]+') THEN b ELSE '' END WHEN regexp_full_match(a, '[NSEW][0-9]+[NSEW][0-9]+') THEN a END AS number FROM w""")
def filed_numbers(spark, sf_dir):
    """House numbers in digits, in words and in grid forms."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    word = F.element_at(F.array(*map(F.lit, text.NUMBER_WORDS)), F.col("p_size") % 10 + 1)
    shape = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts], "p_name")
    line = (
        F.when(key % 6 == 0, shape(size, " ")).when(key % 6 == 1, shape(word, " ")).when(key % 6 == 2, shape("N", size, " w", key.cast("string"), ", "))
        .when(key % 6 == 3, shape("n", size, "E", key.cast("string"), " ")).when(key % 6 == 4, shape("S", size, ", ")).otherwise(F.col("p_name"))
    )
    return table(spark, sf_dir, "part").select(key.alias("id"), text.filed_number(line).alias("number"))


@query("""WITH c AS (SELECT 'segment' AS field, c_mktsegment AS value, true AS counts FROM customer UNION ALL SELECT 'negative', (c_acctbal < 0)::VARCHAR, c_acctbal < 0 FROM customer UNION ALL SELECT 'name', nullif(substr(c_name, 1, 40), ''), true FROM customer WHERE c_custkey % 2 = 0),
  v AS (SELECT field, value, count(*) AS n, count(*) FILTER (counts) AS filled FROM c WHERE value IS NOT NULL GROUP BY 1, 2),
  f AS (SELECT field, sum(filled)::BIGINT AS filled, count(*) > 20 AS capped FROM v GROUP BY 1)
  SELECT field, value, n, f.filled, capped FROM v JOIN f USING (field) QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, value) <= 20""")
def field_vocabulary(spark, sf_dir):
    """The twenty commonest values of each field, and whether it has more; flags are filled where they are true."""
    c = table(spark, sf_dir, "customer")
    wide = c.select(F.col("c_mktsegment").alias("segment"), (F.col("c_acctbal") < 0).cast("string").alias("negative"), F.when(F.col("c_custkey") % 2 == 0, F.nullif(F.substring("c_name", 1, 40), F.lit(""))).alias("name"))
    long = wide.unpivot([], ["segment", "negative", "name"], "field", "value").filter(F.col("value").isNotNull())
    values = long.groupBy("field", "value").agg(F.count("*").alias("n"))
    counted = F.when((F.col("field") != "negative") | (F.col("value") == "true"), F.col("n")).otherwise(0)
    fields = values.groupBy("field").agg(F.sum(counted).alias("filled"), (F.count("*") > 20).alias("capped"))
    return relational.top_n(values, ["field"], 20, F.desc("n"), F.asc("value")).join(F.broadcast(fields), "field")  # one row a field
