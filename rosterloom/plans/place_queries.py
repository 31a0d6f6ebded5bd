"""Places: placement, geography, grids, views, search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, numeric, text
from ..functions.rules import FilterSpec
from ..operators import allocation, quadtree, relational
from .base import FIRMS, OFFICES, PEOPLE, firms, offices, people, query, table


def _dec(c, places=4):
    return F.bround(c.cast("decimal(28,8)"), places).cast("double")


PLACED = f"""{OFFICES}, rows AS (SELECT *, (person + office) % 25 AS city, office % 5 AS state, office % 2 = 0 AS has_street FROM offices),
ev AS (SELECT DISTINCT c_custkey AS person, c_nationkey AS city FROM customer),
es AS (SELECT DISTINCT c_custkey AS person, c_nationkey % 5 AS state FROM customer),
head AS (SELECT s_suppkey AS firm, s_nationkey AS city FROM supplier),
crowds AS (SELECT office, count(DISTINCT person) AS crowd FROM offices GROUP BY 1),
pts AS (SELECT r.*, crowd, greatest(CASE WHEN ev.person IS NOT NULL THEN 3 WHEN es.person IS NOT NULL THEN 2 ELSE 0 END - CASE WHEN head.firm IS NOT NULL THEN 2 ELSE 0 END, 0) AS score
  FROM rows r JOIN crowds USING (office) LEFT JOIN ev ON ev.person = r.person AND ev.city = r.city LEFT JOIN es ON es.person = r.person AND es.state = r.state
  LEFT JOIN head ON head.firm = r.firm AND head.city = r.city),
placed AS (SELECT person, firm, office, score, CASE WHEN score = 0 THEN 'uncertain' WHEN has_street THEN 'office' ELSE 'remote' END AS location_type
  FROM pts QUALIFY row_number() OVER (PARTITION BY person, firm ORDER BY score DESC, has_street DESC, crowd, office) = 1)"""


def _placed(spark, sf_dir):
    rows = offices(spark, sf_dir).withColumn("city", (F.col("person") + F.col("office")) % 25).withColumn("state", F.col("office") % 5).withColumn("has_street", F.col("office") % 2 == 0)
    c = table(spark, sf_dir, "customer")
    ev = c.select(F.col("c_custkey").alias("person"), F.col("c_nationkey").alias("city"))
    es = c.select(F.col("c_custkey").alias("person"), (F.col("c_nationkey") % 5).alias("state"))
    head = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("firm"), F.col("s_nationkey").alias("city"))
    return allocation.place(rows, ev, es, head, "person", "firm")


@query(f"WITH {PLACED} SELECT * FROM placed")
def placement_best_branch(spark, sf_dir):
    return _placed(spark, sf_dir).select("person", "firm", "office", "score", "location_type")


@query(f"WITH {PLACED} SELECT firm, office, count(DISTINCT person) AS people, count(*) FILTER (location_type = 'uncertain') AS uncertain FROM placed GROUP BY 1, 2")
def building_roster(spark, sf_dir):
    return _placed(spark, sf_dir).groupBy("firm", "office").agg(F.count_distinct("person").alias("people"), F.count_if(F.col("location_type") == "uncertain").alias("uncertain"))


@query(f"""WITH {OFFICES}, c AS (SELECT office, firm, count(DISTINCT person) AS headcount FROM offices GROUP BY 1, 2)
  SELECT office, firm, headcount, count(*) OVER (PARTITION BY office) AS firms_here FROM c""")
def building_firm_cube(spark, sf_dir):
    c = offices(spark, sf_dir).groupBy("office", "firm").agg(F.count_distinct("person").alias("headcount"))
    here = c.groupBy("office").agg(F.count("*").alias("firms_here"))
    return c.join(here, "office")


@query(f"WITH {PEOPLE} SELECT state, segment, round_even((sum(lat::DECIMAL(18,4))::DOUBLE / count(*))::DECIMAL(28,8), 4)::DOUBLE AS lat, count(*) AS n, mode(segment ORDER BY segment) AS top FROM people GROUP BY 1, 2")
def geo_index(spark, sf_dir):
    p = people(spark, sf_dir)
    mean = F.sum(F.col("lat").cast("decimal(18,4)")).cast("double") / F.count("*")
    return p.groupBy("state", "segment").agg(_dec(mean).alias("lat"), F.count("*").alias("n"), F.expr("mode() WITHIN GROUP (ORDER BY segment)").alias("top"))


@query(f"WITH {PEOPLE} SELECT round_even(lat / 0.25, 0)::INT AS cell_i, round_even(lon / 0.25, 0)::INT AS cell_j, count(*) AS n FROM people GROUP BY 1, 2")
def grid_counts(spark, sf_dir):
    return people(spark, sf_dir).groupBy(geo.cell(F.col("lat")).alias("cell_i"), geo.cell(F.col("lon")).alias("cell_j")).agg(F.count("*").alias("n"))


VIEW = "lat BETWEEN 30 AND 42 AND lon BETWEEN -110 AND -80"


def _view(spark, sf_dir):
    return people(spark, sf_dir).filter(geo.in_box(F.col("lat"), F.col("lon"), 30, -110, 42, -80))


@query(f"""WITH {PEOPLE}, {OFFICES}, v AS (SELECT o.* , p.state FROM offices o JOIN people p USING (person) WHERE {VIEW})
  SELECT firm, count(DISTINCT person) AS people, count(*) AS offices, count(DISTINCT state) AS states, list_sort(list(office))[len(list(office)) // 2 + 1] AS median_office FROM v GROUP BY 1""")
def viewport_firm_rollup(spark, sf_dir):
    v = offices(spark, sf_dir).join(_view(spark, sf_dir).select("person", "state"), "person")
    rolled = v.groupBy("firm").agg(F.count_distinct("person").alias("people"), F.count("*").alias("offices"), F.count_distinct("state").alias("states"))
    medians = relational.at_places(v, ["firm"], "office", {"median_office": F.floor(F.col("n") / 2)}).drop("n")
    return rolled.join(medians, "firm")


@query(f"""WITH {PEOPLE}, {OFFICES}, {FIRMS}, v AS (SELECT firm, count(DISTINCT person) AS seen FROM offices JOIN people USING (person) WHERE {VIEW} GROUP BY 1),
  a AS (SELECT firm, count(DISTINCT person) AS everyone FROM offices GROUP BY 1)
  SELECT count(*) AS firms, count(assets) AS covered, round_even(sum(round_even((least(1.0::DOUBLE, seen / nullif(everyone, 0)::DOUBLE) * assets::DOUBLE)::DECIMAL(28,8), 2))::DECIMAL(28,8), 2)::DOUBLE AS pool
  FROM v JOIN a USING (firm) LEFT JOIN firms f ON f.crd = firm""")
def viewport_allocation(spark, sf_dir):
    o = offices(spark, sf_dir)
    by_person = relational.dealt(o, relational.task_count(table(spark, sf_dir, "lineitem")), "person")
    seen = by_person.join(_view(spark, sf_dir).select("person"), "person").groupBy("firm").agg(F.count_distinct("person").alias("seen"))
    everyone = o.groupBy("firm").agg(F.count_distinct("person").alias("everyone"))
    f = firms(spark, sf_dir).select(F.col("crd").alias("firm"), "assets")
    part = F.least(F.lit(1.0), numeric.ratio(F.col("seen").cast("double"), F.col("everyone").cast("double"))) * F.col("assets").cast("double")
    rows = seen.join(everyone, "firm").join(f, "firm", "left").withColumn("part", F.bround(part.cast("decimal(28,8)"), 2))
    return rows.agg(F.count("*").alias("firms"), F.count("assets").alias("covered"), F.sum("part").cast("double").alias("pool"))


RING = [(28.0, -112.0), (44.0, -100.0), (40.0, -82.0), (30.0, -78.0), (33.0, -95.0)]


def _ring_sql():
    parts = []
    for (y1, x1), (y2, x2) in zip(RING, [*RING[1:], RING[0]]):
        parts.append(f"CASE WHEN (({y1} > lat) <> ({y2} > lat)) AND lon < ({x2 - x1!r})::DOUBLE * (lat - {y1}) / ({y2 - y1!r})::DOUBLE + ({x1})::DOUBLE THEN 1 ELSE 0 END")
    return " + ".join(parts)


@query(f"WITH {PEOPLE} SELECT person, state FROM people WHERE ({_ring_sql()}) % 2 = 1")
def polygon_filter(spark, sf_dir):
    return people(spark, sf_dir).filter(geo.in_polygon(F.col("lat"), F.col("lon"), RING)).select("person", "state")


MILES = "2 * 3958.8 * asin(least(sqrt(pow(sin(radians(o_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(o_lat)) * pow(sin(radians(o_lon - lon) / 2), 2)), 1))"


@query(f"""WITH {PEOPLE}, o AS (SELECT person AS o_id, lat AS o_lat, lon AS o_lon FROM people WHERE person % 20 = 0)
  SELECT person, o_id, round_even({MILES}::DECIMAL(28,8), 1)::DOUBLE AS miles FROM people, o WHERE {MILES} <= 100""")
def near_me_radius(spark, sf_dir):
    p = people(spark, sf_dir)
    o = p.filter(F.col("person") % 20 == 0).select(F.col("person").alias("o_id"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"))
    return relational.within_miles(p, o, 100.0, shown=_dec(F.col("miles"), 1)).select("person", "o_id", "miles")


@query(f"""WITH {PEOPLE}, o AS (SELECT person AS o_id, lat AS o_lat, lon AS o_lon FROM people), d AS (SELECT o_id, {MILES} AS m FROM people, o)
  SELECT o_id, CASE WHEN count(*) FILTER (m <= 25) >= 5 THEN 25 WHEN count(*) FILTER (m <= 50) >= 5 THEN 50 ELSE 100 END AS radius,
    CASE WHEN count(*) FILTER (m <= 25) >= 5 THEN count(*) FILTER (m <= 25) WHEN count(*) FILTER (m <= 50) >= 5 THEN count(*) FILTER (m <= 50) ELSE count(*) FILTER (m <= 100) END AS found
  FROM d GROUP BY 1""")
def near_me_widening(spark, sf_dir):
    """Around every person, the least of three radii that holds five people (itself one of them), and how many it holds."""
    p = people(spark, sf_dir)
    o = p.select(F.col("person").alias("o_id"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"))
    c = relational.count_within(p, o, (25, 50, 100))
    radius = F.when(F.col("n25") >= 5, 25).when(F.col("n50") >= 5, 50).otherwise(100)
    found = F.when(F.col("n25") >= 5, F.col("n25")).when(F.col("n50") >= 5, F.col("n50")).otherwise(F.col("n100"))
    return c.select("o_id", radius.alias("radius"), found.alias("found"))


@query(f"""WITH {PEOPLE}, o AS (SELECT person AS o_id, lat AS o_lat, lon AS o_lon FROM people WHERE person % 20 = 0)
  SELECT o_id, person, row_number() OVER (PARTITION BY o_id ORDER BY round({MILES}, 6), person) AS place FROM people, o QUALIFY place <= 8""")
def nearest_people(spark, sf_dir):
    """The eight people nearest to every twentieth one, through a quadtree of all people."""
    p = people(spark, sf_dir)
    o = p.filter(F.col("person") % 20 == 0).select(F.col("person").alias("q"), F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon"))
    found = quadtree.nearest(o, quadtree.build(p, "lat", "lon", most=64), "person", "lat", "lon", k=8)
    return found.select(F.col("q").alias("o_id"), F.col("id").alias("person"), F.col("place").cast("bigint").alias("place"))


_CORNERS = ((0, 0), (3, 1), (5, 6), (1, 4))


@query(f"""WITH {PEOPLE}, c AS (SELECT n_nationkey AS area, k, 26 + n_nationkey % 5 * 4 + [0, 3, 5, 1][k + 1]::DOUBLE AS y, -118 + n_nationkey * 1.75 + [0, 1, 6, 4][k + 1]::DOUBLE AS x FROM nation, range(4) t(k)),
  e AS (SELECT a.area, a.y AS y1, a.x AS x1, b.y AS y2, b.x AS x2 FROM c a JOIN c b ON a.area = b.area AND b.k = (a.k + 1) % 4)
  SELECT area, person FROM people, e GROUP BY 1, 2 HAVING count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1""")
def people_in_areas(spark, sf_dir):
    """Who lives in each of many four-cornered areas, by inner and border cells."""
    n = F.col("n_nationkey")
    south, west = 26 + n % 5 * 4, F.lit(-118) + n * 1.75
    areas = table(spark, sf_dir, "nation").select(n.alias("pid"), F.array(*[(south + y).cast("double") for y, _ in _CORNERS]).alias("lats"), F.array(*[(west + x).cast("double") for _, x in _CORNERS]).alias("lons"))
    return quadtree.in_polygons(people(spark, sf_dir), areas, "person", "lat", "lon").select(F.col("pid").alias("area"), F.col("id").alias("person"))


@query(f"""WITH {PEOPLE}, b AS (SELECT floor(lat / 2)::INT AS i, floor(lon / 2)::INT AS j, count(*) AS n FROM people GROUP BY 1, 2),
  q AS (SELECT list_sort(list(n)) AS s FROM b), e AS (SELECT s[floor((len(s) - 1) * 0.12)::INT + 1] AS lo, s[floor((len(s) - 1) * 0.97)::INT + 1] AS hi FROM q)
  SELECT i, j, n, round_even(pow(least(greatest((ln(1 + n) - ln(1 + lo)) / nullif(ln(1 + hi) - ln(1 + lo), 0), 0), 1), 0.8)::DECIMAL(28,8), 4)::DOUBLE AS heat FROM b, e""")
def heat_bins(spark, sf_dir):
    p = people(spark, sf_dir)
    b = p.groupBy(F.floor(F.col("lat") / 2).cast("int").alias("i"), F.floor(F.col("lon") / 2).cast("int").alias("j")).agg(F.count("*").alias("n"))
    # the cells of a fixed grid: at most 90 by 180 of them
    ends = b.agg(F.collect_list("n").alias("s")).select(numeric.floor_quantile(F.col("s"), 0.12).alias("lo"), numeric.floor_quantile(F.col("s"), 0.97).alias("hi"))
    scaled = numeric.clip(numeric.ratio(F.log1p("n") - F.log1p("lo"), F.log1p("hi") - F.log1p("lo")))
    return b.crossJoin(F.broadcast(ends)).select("i", "j", "n", _dec(F.pow(scaled, F.lit(0.8))).alias("heat"))


@query(f"""WITH {PEOPLE} SELECT person FROM people WHERE segment IN ('BUILDING', 'MACHINERY') AND state NOT IN (3, 4) AND (balance < 0 OR (balance >= 5000 AND balance < 8000)) AND {VIEW}""")
def facet_filter(spark, sf_dir):
    spec = FilterSpec(members={"segment": ["BUILDING", "MACHINERY"], "name": []}, excluded={"state": [3, 4]}, bands={"balance": [(None, 0), (5000, 8000)]})
    return _view(spark, sf_dir).filter(spec.predicate()).select("person")


@query(f"""WITH {PEOPLE} SELECT NOT bool_or(segment IN ('BUILDING')) AS segment, NOT bool_or(state NOT IN (3, 4)) AS not_state, NOT bool_or(balance < 0) AS band_balance FROM people WHERE person = 7""")
def facets_hiding_target(spark, sf_dir):
    spec = FilterSpec(members={"segment": ["BUILDING"]}, excluded={"state": [3, 4]}, bands={"balance": [(None, 0)]})
    return spec.hiding(people(spark, sf_dir), F.col("person") == 7)


@query("""WITH n AS (SELECT p_partkey AS id, p_name AS name, ' ' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) || ' ' AS flat FROM part),
  w AS (SELECT DISTINCT id AS query, unnest(string_split(trim(flat), ' ')) AS term FROM n WHERE id % 20 = 0), k AS (SELECT query, count(*) AS terms FROM w GROUP BY 1),
  h AS (SELECT query, id, name FROM w JOIN n ON contains(flat, ' ' || term || ' ') GROUP BY 1, 2, 3 HAVING count(*) = (SELECT terms FROM k WHERE k.query = w.query)),
  r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY name, id) AS place, count(*) OVER (PARTITION BY query) AS found FROM h)
  SELECT query, id, place, found - least(found, 60) AS more FROM r WHERE place <= 60""")
def search_names(spark, sf_dir):
    """Every twentieth name as a query: the names with all its words, sixty of them and how many more there are."""
    words = F.array_distinct(F.split(text.loose(F.col("name")), " "))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")).withColumn("words", words)
    # names of equal words are one entry of the index, whatever their number
    index = p.groupBy(F.array_sort("words").alias("entry")).agg(F.count("*").alias("held"))
    queries = p.filter("id % 20 = 0").groupBy(F.array_sort("words").alias("asked")).agg(F.count("*").alias("askers"))
    terms = queries.select("asked", F.explode("asked").alias("word"))
    hits = terms.join(index.select("entry", "held", F.explode("entry").alias("word")), "word").groupBy("asked", "entry", "held").agg(F.count("*").alias("n")).filter(F.col("n") == F.size("asked"))
    first = relational.top_n(p.select(F.array_sort("words").alias("entry"), "id", "name"), ["entry"], 60, F.asc("name"), F.asc("id"))
    found = hits.groupBy("asked").agg(F.sum("held").alias("found"))
    best = relational.top_n(hits.select("asked", "entry").join(first, "entry"), ["asked"], 60, F.asc("name"), F.asc("id"))
    place = F.row_number().over(Window.partitionBy("asked").orderBy("name", "id"))
    best = best.withColumn("place", place).join(found, "asked").withColumn("more", F.col("found") - F.least("found", F.lit(60)))
    asked = p.filter("id % 20 = 0").select(F.col("id").alias("query"), F.array_sort("words").alias("asked"))
    return asked.join(best, "asked").select("query", "id", "place", "more")


TOKENS = """t AS (SELECT DISTINCT p_partkey AS id, unnest(string_split(trim(regexp_replace(lower(p_name), '[^a-z]+', ' ', 'g')), ' ')) AS token FROM part),
c AS (SELECT substr(token, 1, 2) AS two, count(*) AS n FROM t GROUP BY 1),
k AS (SELECT id, token, CASE WHEN n > 150 THEN substr(token, 1, 3) ELSE two END AS prefix FROM t JOIN c ON two = substr(token, 1, 2))"""


@query(f"WITH {TOKENS} SELECT prefix, count(*) AS entries, count(DISTINCT id) AS ids FROM k GROUP BY 1")
def name_tokens_prefix(spark, sf_dir):
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(F.split(F.trim(F.regexp_replace(F.lower("p_name"), "[^a-z]+", " ")), " ")).alias("token")).distinct()
    t = t.withColumn("two", F.substring("token", 1, 2))
    big = t.groupBy("two").agg(F.count("*").alias("n"))
    k = t.join(big, "two").withColumn("prefix", F.when(F.col("n") > 150, F.substring("token", 1, 3)).otherwise(F.col("two")))
    return k.groupBy("prefix").agg(F.count("*").alias("entries"), F.count_distinct("id").alias("ids"))


@query(f"""WITH {OFFICES}, r AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY firm, office) AS n FROM offices WHERE office <> 1) SELECT person, firm, office FROM r WHERE n <= 6""")
def other_offices(spark, sf_dir):
    return relational.top_n(offices(spark, sf_dir).filter("office <> 1"), ["person"], 6, F.asc("firm"), F.asc("office"))


@query(f"""WITH {OFFICES}, c AS (SELECT firm, office, count(DISTINCT person) AS n FROM offices GROUP BY 1, 2) SELECT person, firm, office, n - 1 AS colleagues FROM offices JOIN c USING (firm, office)""")
def same_building_colleagues(spark, sf_dir):
    """How many others share each of a person's offices; counted once an office, no pairs."""
    o = offices(spark, sf_dir)
    counts = o.groupBy("firm", "office").agg(F.count_distinct("person").alias("n"))
    return o.join(counts, ["firm", "office"]).select("person", "firm", "office", (F.col("n") - 1).alias("colleagues"))


@query(f"""WITH {PEOPLE}, {OFFICES}, {FIRMS} SELECT o.person, o.firm, min(o.office) AS office, any_value(p.name) AS person_name, any_value(f.name) AS firm_name, any_value(n_name) AS state_name
  FROM offices o JOIN people p USING (person) LEFT JOIN firms f ON f.crd = o.firm LEFT JOIN nation ON n_nationkey = p.state WHERE {VIEW} GROUP BY 1, 2""")
def advisor_export_view(spark, sf_dir):
    pairs = offices(spark, sf_dir).groupBy("person", "firm").agg(F.min("office").alias("office"))
    v = pairs.join(_view(spark, sf_dir).select("person", F.col("name").alias("person_name"), "state"), "person")
    f = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("firm"), F.col("s_name").alias("firm_name"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("state"), F.col("n_name").alias("state_name"))
    return v.join(f, "firm", "left").join(n, "state", "left").select("person", "firm", "office", "person_name", "firm_name", "state_name")


@query("""WITH t AS (SELECT c_nationkey AS state, count(*) AS targets FROM customer GROUP BY 1) SELECT state, targets, targets > 60 AS large FROM t WHERE state NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)""")
def pending_targets(spark, sf_dir):
    t = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("state")).agg(F.count("*").alias("targets"))
    done = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("state"))
    return relational.missing_only(t, done, ["state"]).withColumn("large", F.col("targets") > 60)


@query("""SELECT o_custkey AS person, count(*) AS accounts, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS held FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') GROUP BY 1 ORDER BY held DESC, person LIMIT 25""")
def unmatched_by_value(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"), "o_orderpriority")
    matched = o.filter(F.col("o_orderpriority").startswith("1"))
    left = relational.missing_only(o, matched, ["person"])
    return left.groupBy("person").agg(F.count("*").alias("accounts"), F.sum("v").cast("double").alias("held")).orderBy(F.desc("held"), "person").limit(25)
