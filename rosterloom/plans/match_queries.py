"""People and names: matching, calibration, donation, learned maps, ownership, groups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names, text
from ..operators import evidence, graph, matching, relational
from .base import query, table


def _parts(spark, sf_dir):
    """Two-word names as people: the first word the given name, the second the surname."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_brand", "p_size", "p_type")
    ending = F.when(F.col("id") % 11 == 1, "jr").when(F.col("id") % 11 == 2, "sr")
    return p.withColumn("first", F.split("name", " ")[0]).withColumn("last_key", F.split("name", " ")[1]).withColumn("ending", ending)


NAMED = """parts AS (SELECT p_partkey AS id, p_brand, p_size % 7 AS p_city, p_size % 3 AS p_state, string_split(p_name, ' ')[1] AS first, string_split(p_name, ' ')[2] AS last_key, CASE p_partkey % 11 WHEN 1 THEN 'jr' WHEN 2 THEN 'sr' END AS ending FROM part),
published AS (SELECT id AS pub, CASE id % 3 WHEN 0 THEN first WHEN 1 THEN substr(first, 1, 1) ELSE substr(first, 2) END AS said, last_key, CASE WHEN id % 5 <> 0 THEN p_brand END AS firm, p_city AS city, p_state AS state, CASE id % 7 WHEN 1 THEN 'jr' END AS suffix FROM parts),
pairs AS (SELECT pub, id, said, first, CASE WHEN said = first THEN 1.0::DOUBLE WHEN length(said) > 1 AND length(first) > 1 AND levenshtein(said, first) <= 1 THEN 0.8::DOUBLE
   WHEN (length(said) = 1 OR length(first) = 1) AND substr(said, 1, 1) = substr(first, 1, 1) THEN 0.45::DOUBLE ELSE 0.0::DOUBLE END AS name_score,
   CASE WHEN firm = p_brand THEN 1.0::DOUBLE WHEN firm IS NOT NULL THEN 0.0::DOUBLE END AS f, (city = p_city)::INT::DOUBLE AS c, (state = p_state)::INT::DOUBLE AS s,
   CASE WHEN suffix IS NULL OR ending IS NULL THEN 0.0::DOUBLE WHEN suffix = ending THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS g FROM published JOIN parts USING (last_key)),
scored AS (SELECT pub, id, said, first, name_score, name_score > 0 AS able, CASE WHEN name_score > 0 THEN round_even((CASE WHEN f IS NULL THEN (name_score * 0.42 + c * 0.13 + s * 0.15)::DOUBLE / 0.7::DOUBLE ELSE (name_score * 0.42 + c * 0.13 + s * 0.15 + f * 0.3)::DOUBLE END + g * 0.18::DOUBLE)::DECIMAL(28,8), 4)::DOUBLE END AS score FROM pairs),
best AS (SELECT *, count(*) FILTER (name_score >= 0.8) OVER (PARTITION BY pub) AS namesakes, score - coalesce(lead(score) OVER w, 0) AS gap, row_number() OVER w AS rn
   FROM scored WINDOW w AS (PARTITION BY pub ORDER BY able DESC, score DESC NULLS LAST, id)),
decided AS (SELECT pub, CASE WHEN able THEN id END AS id, said, first, namesakes, coalesce(score, 0) AS score, coalesce(round_even(gap::DECIMAL(28,8), 4)::DOUBLE, 0) AS gap,
   CASE WHEN NOT able THEN 'none' WHEN score >= 0.72 AND round_even(gap::DECIMAL(28,8), 4) >= 0.12 AND namesakes <= 3 THEN 'high' ELSE 'review' END AS tier FROM best WHERE rn = 1)"""


def _letters(number):
    return F.translate(number.cast("string"), "0123456789", "abcdefghij")


def _published(spark, sf_dir):
    """Published rows and the people they may be; a brand is a firm of one word."""
    p = _parts(spark, sf_dir).withColumns({"city": (F.col("p_size") % 7).cast("string"), "state": (F.col("p_size") % 3).cast("string"), "house": F.concat(F.lit("house"), _letters(F.split("p_brand", "#")[1]))})
    k = F.col("id")
    said = F.when(k % 3 == 0, F.col("first")).when(k % 3 == 1, F.substring("first", 1, 1)).otherwise(F.expr("substring(first, 2)"))
    published = p.select(k.alias("pub"), "last_key", F.array(said).alias("said"), F.when(k % 5 != 0, F.col("house")).alias("firm"), "city", "state", F.when(k % 7 == 1, "jr").alias("suffix"), "p_type")
    index = p.select("id", "last_key", F.array("first").alias("forms"), F.array("house").alias("firms"), F.array("city").alias("cities"), F.array("state").alias("states"), F.col("ending").alias("suffix"), "p_type")
    return published, index


def _decided(spark, sf_dir):
    """Every published name, with what it says and the form that was found."""
    published, index = _published(spark, sf_dir)
    found = evidence.match_published(published, index, "pub").join(published.select("pub", F.col("said")[0].alias("said")), "pub")
    return found.join(index.select("id", F.col("forms")[0].alias("first")), "id", "left")


@query(f"WITH {NAMED} SELECT pub, id, namesakes, score, gap, tier FROM decided")
def entity_match_tiers(spark, sf_dir):
    return _decided(spark, sf_dir).select("pub", "id", "namesakes", "score", "gap", "tier")


@query(f"""WITH {NAMED} SELECT pub, id, tier = 'high' AND NOT (said = first OR (length(said) > 1 AND length(first) > 1 AND levenshtein(said, first) <= 1)
  OR ((length(said) = 1 OR length(first) = 1) AND substr(said, 1, 1) = substr(first, 1, 1))) AS demoted FROM decided""")
def match_demotion(spark, sf_dir):
    return matching.demote(_decided(spark, sf_dir), F.array("said"), F.array("first")).select("pub", "id", "demoted")


@query(f"""WITH {NAMED}, t AS (SELECT unnest([0.3, 0.5, 0.7, 0.9])::DOUBLE AS threshold)
  SELECT threshold, count(*) FILTER (score >= threshold) AS accepted, count(*) FILTER (score >= threshold AND pub = id) AS correct, count(*) FILTER (pub = id) AS positives FROM decided, t GROUP BY 1""")
def match_calibration(spark, sf_dir):
    return matching.calibrate(_decided(spark, sf_dir), F.col("score"), F.col("pub") == F.col("id"), [0.3, 0.5, 0.7, 0.9])


_SHARE = "list_max(flatten(list_transform(parts, lambda p: list_transform(words, lambda q: len(list_intersect(p, q))::DOUBLE / least(len(p), len(q))))))"
FIRMED = f"""parts AS (SELECT p_partkey AS id, p_size % 7 AS city, p_size % 3 AS state, lower(p_type) AS kind, 'house' || translate(string_split(p_brand, '#')[2], '0123456789', 'abcdefghij') AS house,
  string_split(p_name, ' ')[1] AS first, string_split(p_name, ' ')[2] AS last_key, CASE p_partkey % 11 WHEN 1 THEN 'jr' WHEN 2 THEN 'sr' END AS ending FROM part),
published AS (SELECT id AS pub, CASE id % 3 WHEN 0 THEN first WHEN 1 THEN substr(first, 1, 1) ELSE substr(first, 2) END AS said, last_key, CASE WHEN id % 5 > 1 THEN [list_distinct([kind, last_key]), [house]] END AS parts, city, state, CASE id % 7 WHEN 1 THEN 'jr' END AS suffix FROM parts),
known AS (SELECT id, first, last_key, CASE WHEN id % 9 = 0 THEN [] ELSE [[house], list_distinct([first, kind])] END AS words, [city, (city + id) % 7] AS cities, state, ending FROM parts),
pairs AS (SELECT pub, id, CASE WHEN said = first THEN 1.0::DOUBLE WHEN length(said) > 1 AND length(first) > 1 AND levenshtein(said, first) <= 1 THEN 0.8::DOUBLE
   WHEN (length(said) = 1 OR length(first) = 1) AND substr(said, 1, 1) = substr(first, 1, 1) THEN 0.45::DOUBLE ELSE 0.0::DOUBLE END AS name_score, parts, words,
   list_contains(k.cities, p.city)::INT::DOUBLE AS c, (p.state = k.state)::INT::DOUBLE AS s, CASE WHEN suffix IS NULL OR ending IS NULL THEN 0.0::DOUBLE WHEN suffix = ending THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS g FROM published p JOIN known k USING (last_key)),
able AS (SELECT *, CASE WHEN parts IS NULL THEN NULL WHEN len(words) = 0 THEN 0.3::DOUBLE ELSE {_SHARE} END AS f FROM pairs WHERE name_score > 0),
scored AS (SELECT pub, id, name_score, round_even((CASE WHEN f IS NULL THEN (name_score * 0.42 + c * 0.13 + s * 0.15)::DOUBLE / 0.7::DOUBLE ELSE (name_score * 0.42 + c * 0.13 + s * 0.15 + f * 0.3)::DOUBLE END + g * 0.18::DOUBLE)::DECIMAL(28,8), 4)::DOUBLE AS score FROM able),
best AS (SELECT *, count(*) FILTER (name_score >= 0.8) OVER (PARTITION BY pub) AS namesakes, round_even((score - coalesce(lead(score) OVER w, 0))::DECIMAL(28,8), 4)::DOUBLE AS gap, row_number() OVER w AS rn
   FROM scored WINDOW w AS (PARTITION BY pub ORDER BY score DESC, id)),
inferred AS (SELECT p.pub, id, coalesce(namesakes, 0) AS namesakes, coalesce(score, 0) AS score, coalesce(gap, 0) AS gap,
   CASE WHEN id IS NULL THEN 'none' WHEN score >= 0.72 AND gap >= 0.12 AND namesakes <= 3 THEN 'high' ELSE 'review' END AS tier FROM published p LEFT JOIN (SELECT * FROM best WHERE rn = 1) b USING (pub)),
decided AS (SELECT pub, CASE WHEN pub % 10 = 3 THEN pub ELSE id END AS id, namesakes, CASE WHEN pub % 10 = 3 THEN 1.0 ELSE score END::DOUBLE AS score, gap, CASE WHEN pub % 10 = 3 THEN 'confirmed' ELSE tier END AS tier,
   id AS inferred, score AS inferred_score FROM inferred)"""


def _firm_words_sides(spark, sf_dir):
    """Published rows with firms as they are written ("Team | House"), and people with several firms and cities."""
    published, index = _published(spark, sf_dir)
    k, kind = F.col("pub"), F.lower("p_type")
    told = F.concat(kind, F.lit(" "), "last_key", F.lit(" Wealth Management | The "), "firm", F.lit(", LLC"))
    published = published.withColumn("firm", F.when(k % 5 == 1, "Capital Advisors Group").otherwise(told)).drop("p_type")
    number = F.col("id")
    town = F.array(F.col("cities")[0], ((F.col("cities")[0].cast("int") + number) % 7).cast("string"))
    firms = F.when(number % 9 == 0, F.array(F.lit("Financial Services"))).otherwise(F.array(F.concat(F.col("firms")[0], F.lit(" Advisors Inc")), F.concat(F.col("forms")[0], F.lit(" "), F.lower("p_type"), F.lit(" Partners LP"))))
    return published, index.withColumns({"firms": firms, "cities": town}).drop("p_type")


def _by_firm_words(spark, sf_dir):
    """Matches by firm words, with known ids for a tenth of the published rows."""
    published, index = _firm_words_sides(spark, sf_dir)
    truth = published.filter(F.col("pub") % 10 == 3).select("pub", F.col("pub").alias("id"))
    return matching.confirm(evidence.match_published(published, index, "pub"), truth, "pub", "id")


@query(f"WITH {FIRMED} SELECT pub, id, namesakes, score, gap, tier, inferred, inferred_score FROM decided")
def entity_match_tiers_all(spark, sf_dir):
    """By firm words, several firms and cities a person, with tier confirmed where the id is known."""
    return _by_firm_words(spark, sf_dir).select("pub", "id", "namesakes", "score", "gap", "tier", "inferred", "inferred_score")


@query(f"WITH {FIRMED} SELECT tier, count(*) AS rows, count(*) FILTER (inferred = pub) AS found, count(*) FILTER (inferred IS NOT NULL) AS answered FROM decided GROUP BY 1")
def match_tier_summary(spark, sf_dir):
    """What each tier holds, and how often the matcher by itself was right there."""
    found = F.coalesce(F.col("inferred") == F.col("pub"), F.lit(False))
    return _by_firm_words(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("rows"), F.count_if(found).alias("found"), F.count("inferred").alias("answered"))


@query(f"""WITH {FIRMED}, t AS (SELECT unnest([0.60, 0.66, 0.72, 0.78, 0.84, 0.90])::DOUBLE AS threshold), k AS (SELECT *, gap >= 0.12 AND namesakes <= 3 AS clear FROM decided WHERE tier = 'confirmed')
  SELECT threshold, count(*) FILTER (clear AND inferred_score >= threshold) AS accepted, count(*) FILTER (clear AND inferred_score >= threshold AND inferred = pub) AS correct, count(*) AS known FROM k, t GROUP BY 1""")
def match_known_calibration(spark, sf_dir):
    """The matcher by itself against the known ids, at six thresholds."""
    known = _by_firm_words(spark, sf_dir).filter("tier = 'confirmed'")
    clear = (F.col("gap") >= 0.12) & (F.col("namesakes") <= 3)
    rated = known.withColumn("rated", F.when(clear, F.col("inferred_score")).otherwise(-1.0))
    out = matching.calibrate(rated, F.col("rated"), F.coalesce(F.col("inferred") == F.col("pub"), F.lit(False)), [0.60, 0.66, 0.72, 0.78, 0.84, 0.90])
    return out.crossJoin(F.broadcast(known.agg(F.count("*").alias("known")))).select("threshold", "accepted", "correct", "known")


@query(f"""WITH {FIRMED}, d AS (SELECT i.pub, i.id, i.tier, p.said, CASE WHEN k.id % 6 = 0 THEN k.last_key ELSE k.first END AS shown FROM inferred i JOIN published p USING (pub) LEFT JOIN known k ON k.id = i.id)
  SELECT pub, id, coalesce(tier = 'high' AND NOT (said = shown OR (length(said) > 1 AND length(shown) > 1 AND levenshtein(said, shown) <= 1) OR ((length(said) = 1 OR length(shown) = 1) AND substr(said, 1, 1) = substr(shown, 1, 1))), false) AS demoted FROM d""")
def match_demotion_all(spark, sf_dir):
    """High matches fall to review where the name that is shown for the person disagrees, whatever form was matched."""
    published, index = _firm_words_sides(spark, sf_dir)
    shown = index.select("id", F.when(F.col("id") % 6 == 0, F.col("last_key")).otherwise(F.col("forms")[0]).alias("shown"))
    decided = evidence.match_published(published, index, "pub").join(published.select("pub", "said"), "pub").join(shown, "id", "left")
    return matching.demote(decided, F.col("said"), F.array_compact(F.array("shown"))).select("pub", "id", "demoted")


@query(f"""WITH {FIRMED}, t AS (SELECT unnest([0.3, 0.5, 0.7, 0.9])::DOUBLE AS threshold)
  SELECT threshold, count(*) FILTER (score >= threshold) AS accepted, count(*) FILTER (score >= threshold AND pub = id) AS correct, count(*) FILTER (pub = id) AS positives FROM inferred, t GROUP BY 1""")
def match_calibration_all(spark, sf_dir):
    """The matcher by firm words over every published row, at four thresholds."""
    found = evidence.match_published(*_firm_words_sides(spark, sf_dir), "pub")
    return matching.calibrate(found, F.col("score"), F.coalesce(F.col("pub") == F.col("id"), F.lit(False)), [0.3, 0.5, 0.7, 0.9])


def _people(spark, sf_dir):
    """Contact rows and the index they are matched to, from parts: three surnames an initial, odd rows of every kind."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ")[0].alias("first"), F.split("p_name", " ")[1].alias("word"), F.col("p_brand").alias("firm"), (F.col("p_size") % 9).cast("string").alias("city"), (F.col("p_size") % 3).cast("string").alias("state"))
    k = F.col("id")
    last = F.concat("word", F.translate(F.lpad((k % 997).cast("string"), 3, "0"), "0123456789", "abcdefghij"))
    p = p.withColumn("last", last).withColumn("town", F.translate("city", "0123456789", "abcdefghij"))
    index = p.select("id", F.col("last").alias("last_key"), names.with_nicknames(F.array("first")).alias("forms"), F.array("firm").alias("firms"), F.array("town").alias("cities"), F.array("state").alias("states"), F.when(k % 11 == 1, "jr").when(k % 11 == 2, "sr").alias("suffix"))
    given = F.when(k % 4 == 0, F.substring("first", 1, 1)).when(k % 4 == 1, "zz").otherwise(F.col("first"))
    said = F.concat(given, F.lit(" "), "last", F.when(k % 5 == 0, ", CFP").when(k % 5 == 1, ", Unheard").when(k % 11 == 1, " Jr.").otherwise(""))
    people = p.select(
        k.alias("contact"), said.alias("name"), F.when(k % 3 == 0, F.concat(F.lit("someone."), "last", F.lit("@example.com"))).alias("email"),
        F.when(k % 6 != 5, F.col("firm")).alias("firm"), F.col("town").alias("city"), F.when(k % 2 == 0, F.col("state")).alias("state"), F.when(k % 13 == 0, k + 7).alias("given_id"),
    )
    return people, index


@query(None)
def contact_match(spark, sf_dir):
    """Every contact row with the person behind it; held to a plain loop on small tables in the tests."""
    return matching.match_contacts(*_people(spark, sf_dir))


@query(None)
def safe_contacts(spark, sf_dir):
    """High matches that no second row claims and no name or address speaks against."""
    people, index = _people(spark, sf_dir)
    filed = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("filed_name"), F.when(F.col("p_partkey") % 2 == 0, "other.person@example.com").alias("filed_email"))
    found = matching.match_contacts(people, index).join(people.select("contact", "name", "email"), "contact")
    return matching.safe_lookup(found, filed, "contact", "id")


BOOK = """rows AS (SELECT c_custkey AS person, 'p' || c_custkey // 2 * 2 % 400 || '@d' || c_custkey % 50 || '.example.com' AS address, CASE WHEN c_custkey % 50 < 30 THEN 'f' || c_custkey % 10 ELSE 'f' || c_nationkey END AS firm FROM customer WHERE c_custkey % 50 <> 7),
book AS (SELECT address, CASE WHEN count(DISTINCT person) = 1 THEN min(person) END AS person FROM rows GROUP BY 1),
doms AS (SELECT string_split(address, '@')[2] AS domain, min(firm) AS firm FROM rows GROUP BY 1 HAVING count(DISTINCT firm) = 1 AND count(*) >= 2),
said AS (SELECT event_id, 'p' || user_id * 2 % 500 || '@d' || event_id % 60 || '.example.com' AS address FROM events)"""


@query(f"""WITH {BOOK} SELECT event_id, CASE WHEN said.address LIKE '%@d7.example.com' THEN 'internal' WHEN person IS NOT NULL THEN 'advisor' WHEN book.address IS NOT NULL THEN 'ambiguous' WHEN doms.firm IS NOT NULL THEN 'firm' ELSE 'unknown' END AS kind,
  CASE WHEN said.address NOT LIKE '%@d7.example.com' THEN person END::VARCHAR AS person, CASE WHEN book.address IS NULL AND said.address NOT LIKE '%@d7.example.com' THEN doms.firm END AS firm
  FROM said LEFT JOIN book USING (address) LEFT JOIN doms ON domain = string_split(said.address, '@')[2]""")
def address_routes(spark, sf_dir):
    """Whose message it is: our own, a person's, one of several persons', a firm's, or nobody's."""
    k = F.col("c_custkey")
    firm = F.concat(F.lit("f"), F.when(k % 50 < 30, k % 10).otherwise(F.col("c_nationkey")).cast("string"))
    address = F.concat(F.lit("p"), (F.floor(k / 2) * 2 % 400).cast("string"), F.lit("@d"), (k % 50).cast("string"), F.lit(".example.com"))
    book, domains = matching.address_book(table(spark, sf_dir, "customer").select(k.alias("person"), address.alias("address"), firm.alias("firm")), "person", "address", "firm", ["d7.example.com"])
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("P"), (F.col("user_id") * 2 % 500).cast("string"), F.lit("@d"), (F.col("event_id") % 60).cast("string"), F.lit(".example.com ")).alias("address"))
    out = matching.classify_addresses(e, book, domains, "address", "person", "firm", ["d7.example.com"])
    return out.select("event_id", "kind", F.col("person").cast("string").alias("person"), "firm")


@query("""WITH d AS (SELECT d.doc_id, n_chars, quality FROM documents d JOIN labels l USING (doc_id)), t AS (SELECT unnest([500, 1000, 2000, 4000])::DOUBLE AS threshold)
  SELECT threshold, count(*) FILTER (n_chars >= threshold) AS accepted, count(*) FILTER (n_chars >= threshold AND quality = 1) AS correct, count(*) FILTER (quality = 1) AS positives FROM d, t GROUP BY 1""")
def threshold_grid(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return matching.calibrate(d, F.col("n_chars").cast("double"), F.col("quality") == 1, [500.0, 1000.0, 2000.0, 4000.0])


@query("""WITH r AS (SELECT o_custkey AS id, o_orderkey AS pos, o_totalprice AS score, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS phone, nullif(o_orderstatus, 'P') AS email FROM orders),
  n AS (SELECT *, max(score) OVER (PARTITION BY id) AS top FROM r), b AS (SELECT * FROM n WHERE score >= top - 20000 QUALIFY row_number() OVER (PARTITION BY id ORDER BY (phone <> '') DESC, score DESC, pos) = 1)
  SELECT b.id, b.pos, coalesce(nullif(b.phone, ''), (SELECT arg_max(phone, (score, pos)) FROM r WHERE r.id = b.id AND phone <> '')) AS phone,
    coalesce(b.email, (SELECT arg_max(email, (score, pos)) FROM r WHERE r.id = b.id AND email IS NOT NULL)) AS email FROM b""")
def best_record_donation(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    r = o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("score"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("phone"), F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("email"))
    winner = matching.best_record(r, "id", "score", 20000, F.desc(F.col("phone") != ""), F.desc("score"), F.asc("pos")).select("id", "pos")
    filled = matching.donate(r, "id", ["phone", "email"], F.desc("score"), F.desc("pos"))
    return filled.join(winner, ["id", "pos"]).select("id", "pos", "phone", "email")


@query("""WITH d AS (SELECT p_brand AS brand, p_size AS number, count(DISTINCT p_partkey) AS people FROM part GROUP BY 1, 2)
  SELECT brand, number, people, CASE WHEN people <= 1 THEN 'direct' WHEN people <= 4 THEN 'team' ELSE 'office' END AS kind FROM d""")
def phone_kind_sharing(spark, sf_dir):
    from ..operators.allocation import sharing_kind

    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("number"), "p_partkey")
    return sharing_kind(p, ["brand"], "number", "p_partkey")


@query("""WITH c AS (SELECT o_custkey AS domain, o_orderstatus AS firm, count(*) AS n FROM orders GROUP BY 1, 2)
  SELECT domain, arg_max(firm, (n, firm)) AS firm, sum(n)::BIGINT AS rows FROM c GROUP BY 1 HAVING sum(n) >= 2 AND count(*) = 1""")
def domain_to_firm(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("domain"), F.col("o_orderstatus").alias("firm"))
    return relational.learned_map(o, "domain", "firm", 2)


@query("""WITH c AS (SELECT l_suppkey AS area, l_linestatus AS state, count(*) AS n FROM lineitem GROUP BY 1, 2)
  SELECT area, arg_max(state, (n, state)) AS state, sum(n)::BIGINT AS rows FROM c GROUP BY 1 HAVING sum(n) >= 20 AND max(n) >= sum(n) * 0.51""")
def area_code_dominance(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("area"), F.col("l_linestatus").alias("state"))
    return relational.learned_map(l, "area", "state", 20, 0.51)


@query("""SELECT p_name AS email, CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) END AS owner, CASE WHEN count(DISTINCT p_brand) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM part GROUP BY 1""")
def email_resolution(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("email"), F.col("p_brand").alias("owner"))
    return matching.split_by_owners(p, "email", "owner")


@query("""SELECT p_brand AS company, p_size AS city, p_type AS amount, count(*) AS members FROM part GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def team_amount_once(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("company"), F.col("p_size").alias("city"), F.col("p_type").alias("amount")).agg(F.count("*").alias("members")).filter("members >= 2")


@query("""SELECT p_brand AS firm, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS team, count(*) AS members, string_agg(p_partkey::VARCHAR, '|' ORDER BY p_partkey::VARCHAR) AS ids FROM part GROUP BY 1, 2 HAVING count(*) >= 2""")
def practice_members(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("firm"), text.loose(F.col("p_type")).alias("team"), F.col("p_partkey").cast("string").alias("id"))
    return p.groupBy("firm", "team").agg(F.count("*").alias("members"), F.array_join(F.sort_array(F.collect_list("id")), "|").alias("ids")).filter("members >= 2")


@query("""WITH p AS (SELECT DISTINCT c_custkey AS l, s_suppkey AS r FROM customer JOIN supplier ON c_nationkey = s_nationkey AND floor(c_acctbal / 500) = floor(s_acctbal / 500)),
  q AS (SELECT *, count(*) OVER (PARTITION BY l) AS x, count(*) OVER (PARTITION BY r) AS y FROM p) SELECT l, r FROM q WHERE x = 1 AND y = 1""")
def truth_bridge(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("l"), F.col("c_nationkey").alias("state"), F.floor(F.col("c_acctbal") / 500).alias("step"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("r"), F.col("s_nationkey").alias("state"), F.floor(F.col("s_acctbal") / 500).alias("step"))
    return relational.bridge(c, s, ["state", "step"], "l", "r")


EDGES = """edges AS (SELECT p_partkey AS child, p_partkey // 2 AS parent, p_size AS weight FROM part WHERE p_partkey > 1 UNION ALL SELECT p_partkey, p_partkey // 3, p_size + 1 FROM part WHERE p_partkey > 2 AND p_partkey % 2 = 0),
up AS (SELECT child, parent FROM edges QUALIFY row_number() OVER (PARTITION BY child ORDER BY weight DESC, parent) = 1)"""


def _edges(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    a = p.filter("p_partkey > 1").select(k.alias("child"), F.floor(k / 2).alias("parent"), F.col("p_size").alias("weight"))
    b = p.filter("p_partkey > 2 and p_partkey % 2 = 0").select(k.alias("child"), F.floor(k / 3).alias("parent"), (F.col("p_size") + 1).alias("weight"))
    return a.unionAll(b)


WALK = f"""RECURSIVE {EDGES}, walk AS (SELECT p_partkey AS node, [p_partkey] AS chain FROM part
  UNION ALL SELECT node, list_append(chain, parent) FROM walk JOIN up ON child = chain[len(chain)] WHERE NOT list_contains(chain, parent) AND len(chain) <= 12),
  done AS (SELECT node, arg_max(chain, len(chain)) AS chain FROM walk GROUP BY 1)"""


def _chains(spark, sf_dir):
    starts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    return graph.chains(_edges(spark, sf_dir), starts)


@query(f"WITH {WALK} SELECT node, array_to_string(chain, '>') AS chain, len(chain) AS hops FROM done")
def owner_chain(spark, sf_dir):
    return _chains(spark, sf_dir).select("node", F.array_join(F.col("chain").cast("array<string>"), ">").alias("chain"), F.size("chain").cast("long").alias("hops"))


@query(f"WITH {WALK}, x AS (SELECT node, unnest(chain[2:]) AS parent FROM done) SELECT parent, count(DISTINCT node) AS members FROM x GROUP BY 1 HAVING count(DISTINCT node) > 1")
def parent_groups(spark, sf_dir):
    return graph.parent_groups(_chains(spark, sf_dir))


@query(None)
def connected_branches(spark, sf_dir):
    """Branches that share an (order, line) key, directly or through others; SQL has no bounded form of it."""
    lines = table(spark, sf_dir, "lineitem")
    # part keys take a span of their own for each supplier, however many there are
    low, high = lines.agg(F.min("l_partkey"), F.max("l_partkey")).first()
    span = max(100000, (high or 0) - (low or 0) + 1)
    l = lines.select("l_orderkey", "l_linenumber", (F.col("l_suppkey").cast("long") * F.lit(span).cast("long") + F.col("l_partkey")).alias("k")).distinct()
    # a star around the least member of each shared key instead of all its pairs
    hub = l.groupBy("l_orderkey", "l_linenumber").agg(F.min("k").alias("a"))
    return graph.components(l.join(hub, ["l_orderkey", "l_linenumber"]).select("a", F.col("k").alias("b")))


@query("""SELECT DISTINCT c.c_custkey AS id, f.c_custkey AS twin FROM customer c JOIN customer f ON f.c_nationkey = c.c_nationkey AND f.c_mktsegment = c.c_mktsegment AND floor(f.c_acctbal / 10) = floor(c.c_acctbal / 10) AND f.c_custkey > c.c_custkey""")
def candidate_blocks(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 10).alias("step"))
    other = c.withColumnRenamed("c_custkey", "twin")
    return c.join(other, ["c_nationkey", "c_mktsegment", "step"]).filter("twin > c_custkey").select(F.col("c_custkey").alias("id"), "twin")


@query("""SELECT s_suppkey AS id, s_name AS raw, upper(replace(replace(s_name, '#', ' '), '-', ' ')) || CASE s_suppkey % 3 WHEN 0 THEN ' AND SONS' WHEN 1 THEN ' HILL' ELSE '' END AS firm_key FROM supplier""")
def firm_name_keys(spark, sf_dir):
    """Ampersands, punctuation, and legal forms at the end, inside and spelled with points."""
    k = F.col("s_suppkey") % 3
    said = F.concat("s_name", F.when(k == 0, " & Sons, Inc.").when(k == 1, " Trust-Hill L.L.C.").otherwise(" Group, N.A."))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("raw"), F.trim(text.firm_key(said)).alias("firm_key"))
