"""Contact rows: addresses, credentials, ranks, replies, donations, snapshots, causes of loss."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contacts
from ..operators import relational
from .base import query, table


def _part(spark, sf_dir):
    return table(spark, sf_dir, "part")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 <> 2 THEN lower(replace(p_name, ' ', '.')) || p_partkey || '@' || lower(replace(p_brand, '#', '')) || '.example.com' END AS email FROM part""")
def email_repair(spark, sf_dir):
    """Addresses with invisible characters and entities, and some that are none."""
    p = _part(spark, sf_dir)
    good = F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.col("p_partkey").cast("string"))
    host = F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(".example.com"))
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, F.concat(F.lit(" "), good, F.lit("​@"), host)).when(k == 1, F.concat(good, F.lit("&#64;"), host, F.lit(" "))).otherwise(good)
    return p.select(F.col("p_partkey").alias("id"), contacts.email(raw).alias("email"))


@query("""WITH w AS (SELECT p_partkey AS id, lower(string_split(p_name, ' ')[1]) AS a, lower(string_split(p_name, ' ')[2]) AS b FROM part)
  SELECT id, CASE id % 3 WHEN 0 THEN a || '.' || b || '@example.com' WHEN 1 THEN substr(a, 1, 1) || '.' || b || '@example.com' END AS email FROM w""")
def own_email_choice(spark, sf_dir):
    """Of two addresses on a page the person's own: by name, by initial, or none."""
    p = _part(spark, sf_dir)
    a, b = F.lower(F.split("p_name", " ")[0]), F.lower(F.split("p_name", " ")[1])
    at = lambda c: F.concat(c, F.lit("@example.com"))
    k = F.col("p_partkey") % 3
    other = at(F.lit("someone.else"))
    mine = F.when(k == 0, at(F.concat(a, F.lit("."), b))).when(k == 1, at(F.concat(F.substring(a, 1, 1), F.lit("."), b))).otherwise(at(F.lit("front.desk")))
    return p.select(F.col("p_partkey").alias("id"), contacts.own_email(F.col("p_name"), F.array(other, mine)).alias("email"))


@query("""SELECT p_partkey AS id, p_name || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ', Jr' ELSE '' END AS name FROM part""")
def credential_strip(spark, sf_dir):
    p = _part(spark, sf_dir)
    k = F.col("p_partkey") % 3
    said = F.concat("p_name", F.when(k == 0, ", CFA, AWMATM").when(k == 1, ", Jr, C.F.P.").otherwise(""))
    return p.select(F.col("p_partkey").alias("id"), contacts.without_credentials(said).alias("name"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN string_split(p_name, ' ')[1] END AS city, CASE WHEN p_size % 2 = 0 THEN 'TX' END AS state FROM part""")
def address_tail(spark, sf_dir):
    p = _part(spark, sf_dir)
    word = F.split("p_name", " ")[0]
    line = F.concat(F.lit("880 S Oak Rd, "), word, F.when(F.col("p_size") % 2 == 0, ", TX 75078").otherwise(" Tower"))
    found = contacts.city_state(line)
    return p.select(F.col("p_partkey").alias("id"), found["city"].alias("city"), found["state"].alias("state"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://a.example.com/p/' || page_id WHEN 1 THEN 'https://b.example.com/' || page_id WHEN 2 THEN url END AS link FROM pages""")
def absolute_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    n, k = F.col("page_id").cast("string"), F.col("page_id") % 4
    raw = F.when(k == 0, F.concat(F.lit("/p/"), n)).when(k == 1, F.concat(F.lit("//b.example.com/"), n)).when(k == 2, F.col("url")).otherwise("none")
    return p.select("page_id", contacts.absolute_url(raw, F.lit("https://a.example.com/")).alias("link"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def iso_days(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    raw = F.when(F.col("o_orderkey") % 5 == 0, "NaT").otherwise(F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")))
    return o.select(F.col("o_orderkey").alias("id"), contacts.iso_day(raw).alias("day"))


@query("""SELECT c_custkey AS id, n_name AS state, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS market, CASE WHEN c_custkey % 3 = 0 THEN 'High' END AS segment,
  CASE WHEN c_custkey % 10 = 9 THEN 'RANKED' WHEN c_custkey % 2 = 0 THEN '#' || (c_custkey % 10) || ' ' || upper(c_mktsegment) ELSE '#' || (c_custkey % 10) || ' IN ' || upper(n_name) END AS label
  FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def rank_labels(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = table(spark, sf_dir, "customer").join(n, "c_nationkey")
    k = F.col("c_custkey")
    said = F.concat("n_name", F.lit(" - "), F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise("State"), F.when(k % 3 == 0, " (High)").otherwise(""))
    rank = F.when(k % 10 != 9, k % 10)
    parts = contacts.category(said)
    return c.select(k.alias("id"), parts["state"].alias("state"), parts["market"].alias("market"), parts["segment"].alias("segment"), contacts.rank_label(rank, parts).alias("label"))


@query("""WITH c AS (SELECT p_partkey AS id, substr(upper(p_name), 1, 4) AS code FROM part)
  SELECT id, code, CASE WHEN substr(code, 1, 3) = 'RED' THEN 'red house' WHEN substr(code, 1, 2) = 'BL' THEN 'bl house' WHEN substr(code, 1, 2) = 'RE' THEN 're house' ELSE substr(code, 1, 2) END AS platform FROM c""")
def account_platform(spark, sf_dir):
    code = F.substring(F.upper("p_name"), 1, 4)
    known = {"RED": "red house", "BL": "bl house", "RE": "re house"}
    return _part(spark, sf_dir).select(F.col("p_partkey").alias("id"), code.alias("code"), contacts.platform(code, known).alias("platform"))


@query("""SELECT event_id, CASE WHEN event_type = 'signup' OR event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 17 = 0 THEN 'auto_reply' ELSE 'reply' END AS kind FROM events""")
def reply_kinds(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    header = lambda test, name, value: F.when(test, F.struct(F.lit(name).alias("n"), F.lit(value).alias("v")))
    signup = F.col("event_type") == "signup"
    told = [header(signup, "auto-submitted", "auto-replied"), header(~signup & (k % 2 == 0), "auto-submitted", "no"), header(k % 7 == 0, "precedence", " Bulk "), header(k % 13 == 0, "x-auto-response-suppress", "All"), header(k % 17 == 0, "x-autorespond", "yes")]
    subject = F.when(k % 11 == 0, "Out of Office: back soon").otherwise(F.concat(F.lit("Re: "), "event_type"))
    return e.select("event_id", contacts.reply_kind(F.map_from_entries(F.array_compact(F.array(*told))), subject).alias("kind"))


@query("""SELECT user_id, count(*) AS n, CASE WHEN count(*) > 90 THEN 'drafts' WHEN count(*) > 70 THEN 'elevated' WHEN count(*) > 50 THEN 'large' ELSE 'normal' END AS level FROM events GROUP BY 1""")
def guard_levels(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return e.withColumn("level", contacts.guard_level(F.col("n"), (50, "large"), (70, "elevated"), (90, "drafts")))


@query("""WITH r AS (SELECT o_custkey AS email, o_orderkey AS pos, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 4 ELSE 5 END AS rank, o_clerk AS phone FROM (SELECT *, 'n' || o_orderkey AS o_clerk FROM orders)),
  b AS (SELECT email, min(rank) AS best, arg_min(phone, (rank, pos)) AS better, arg_min(pos, (rank, pos)) AS donor FROM r GROUP BY 1)
  SELECT pos, CASE WHEN best < rank THEN better ELSE phone END AS phone, CASE WHEN best < rank THEN donor END::VARCHAR AS phone_from FROM r JOIN b USING (email)""")
def phone_donation(spark, sf_dir):
    """The number that reaches a person best goes to all rows of the same address, with its source."""
    o = table(spark, sf_dir, "orders")
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 4).otherwise(5)
    r = o.select(F.col("o_custkey").alias("email"), F.col("o_orderkey").alias("pos"), rank.alias("rank"), F.concat(F.lit("n"), F.col("o_orderkey").cast("string")).alias("phone"))
    best = r.groupBy("email").agg(F.min(F.struct("rank", "pos", "phone")).alias("b"))
    better = F.col("b.rank") < F.col("rank")
    return r.join(best, "email").select("pos", F.when(better, F.col("b.phone")).otherwise(F.col("phone")).alias("phone"), F.when(better, F.col("b.pos").cast("string")).alias("phone_from"))


@query("""WITH c AS (SELECT p_name AS address, count(DISTINCT p_brand) AS claimants FROM part GROUP BY 1)
  SELECT p_partkey AS id, CASE WHEN claimants = 1 THEN p_name END AS address FROM part JOIN c ON address = p_name""")
def address_ownership(spark, sf_dir):
    """An address that two claim belongs to neither."""
    p = _part(spark, sf_dir)
    claims = p.groupBy(F.col("p_name").alias("said")).agg((F.min("p_brand") == F.max("p_brand")).alias("alone"))
    return p.join(claims, F.col("p_name") == F.col("said")).select(F.col("p_partkey").alias("id"), F.when(F.col("alone"), F.col("p_name")).alias("address"))


@query("""SELECT count(*) AS both, count(*) FILTER (a.top IS DISTINCT FROM b.top) AS moved FROM (SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS top FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) a
  JOIN (SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS top FROM orders GROUP BY 1) b USING (o_custkey)""")
def snapshot_moves(spark, sf_dir):
    """Ids in two snapshots, and how many of them point elsewhere in the second."""
    o = table(spark, sf_dir, "orders")
    top = lambda df, name: df.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias(name))
    joined = top(o.filter("o_orderstatus <> 'P'"), "old").join(top(o, "new"), "o_custkey")
    return joined.agg(F.count("*").alias("both"), F.count_if(~F.col("old").eqNullSafe(F.col("new"))).alias("moved"))


@query("""WITH k AS (SELECT DISTINCT s_nationkey FROM supplier), w AS (SELECT c_mktsegment AS source, CASE WHEN c_acctbal < 0 THEN 'no_surname' WHEN c_nationkey NOT IN (SELECT s_nationkey FROM k) THEN 'surname_unknown'
    WHEN c_custkey NOT IN (SELECT o_custkey FROM orders) THEN 'no_given_match' WHEN c_acctbal < 3000 THEN 'scored_low' END AS why FROM customer)
  SELECT source, why, count(*) AS n, round_even((count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY source))::DECIMAL(28,8), 4)::DOUBLE AS share FROM w GROUP BY 1, 2""")
def loss_causes(spark, sf_dir):
    """Why rows did not match, by source, the first cause that holds; matched rows have none."""
    c = table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey"))
    buyers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    c = relational.corroborate(relational.corroborate(c, nations, ["c_nationkey"], "known"), buyers, ["c_custkey"], "given")
    why = F.when(F.col("c_acctbal") < 0, "no_surname").when(~F.col("known"), "surname_unknown").when(~F.col("given"), "no_given_match").when(F.col("c_acctbal") < 3000, "scored_low")
    counts = c.groupBy(F.col("c_mktsegment").alias("source"), why.alias("why")).agg(F.count("*").alias("n"))
    total = counts.groupBy("source").agg(F.sum("n").alias("all"))
    share = F.bround((F.col("n") / F.col("all")).cast("decimal(28,8)"), 4).cast("double")
    return counts.join(total, "source").select("source", "why", "n", share.alias("share"))


@query("""SELECT user_id % 7 AS rep, count(*) FILTER (event_type = 'view') AS sent, count(*) FILTER (event_type = 'error') AS bounced,
  count(*) FILTER (event_type = 'view') >= 25 AND count(*) FILTER (event_type = 'error') * 100 > count(*) FILTER (event_type = 'view') * 3 AS pause FROM events GROUP BY 1""")
def campaign_pause(spark, sf_dir):
    """A campaign pauses at 25 sent or more with over 3 in 100 bounced."""
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 7).alias("rep")).agg(F.count_if(F.col("event_type") == "view").alias("sent"), F.count_if(F.col("event_type") == "error").alias("bounced"))
    return e.withColumn("pause", (F.col("sent") >= 25) & (F.col("bounced") * 100 > F.col("sent") * 3))


@query("""WITH f AS (SELECT o_orderkey AS id, o_custkey AS person, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS state FROM orders),
  k AS (SELECT person, arg_min(state, id) FILTER (state IS NOT NULL) AS known FROM f GROUP BY 1)
  SELECT id, coalesce(state, known) AS state, state IS NULL AND known IS NOT NULL AS inherited FROM f JOIN k USING (person)""")
def inherited_state(spark, sf_dir):
    """A missing state is taken from the same person's first row that has one."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("person"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("state"))
    known = o.filter("state is not null").groupBy("person").agg(F.min_by("state", "id").alias("known"))
    return o.join(known, "person", "left").select("id", F.coalesce("state", "known").alias("state"), (F.col("state").isNull() & F.col("known").isNotNull()).alias("inherited"))
