"""Text: quotes, pages, templates, addresses, phones, money; dictionaries and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup, text
from ..operators import audit
from .base import query, table


@query("""SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(trim(regexp_replace(lower(d.text), '\\s+', ' ', 'g')), trim(regexp_replace(lower(b.text), '\\s+', ' ', 'g')))""")
def quote_containment(spark, sf_dir):
    """Which quotes stand in which text.

    The longest word inside a quote (neither its first nor its last) must be a word of any text that
    holds it, so texts and quotes meet on that word and only then is the quote looked for. Quotes of
    one or two words have none and are looked for in every text.
    """
    quotes = table(spark, sf_dir, "benchmark").select("item_id", text.fold_quote(F.col("text")).alias("q"))
    inner = F.transform(F.slice(F.split("q", " "), 2, F.greatest(F.size(F.split("q", " ")) - 2, F.lit(0))), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    quotes = quotes.withColumn("word", F.array_max(inner)["w"])
    folded = table(spark, sf_dir, "documents").select("doc_id", text.fold_quote(F.col("text")).alias("body"))
    words = folded.select("doc_id", F.explode(F.array_distinct(F.split("body", " "))).alias("word"))
    met = words.join(quotes.filter("word is not null"), "word").select("doc_id", "item_id", "q")
    found = folded.join(met, "doc_id").filter(F.contains("body", F.col("q"))).select("doc_id", "item_id")
    short = quotes.filter("word is null")
    return found.unionAll(folded.join(short, F.contains("body", F.col("q"))).select("doc_id", "item_id"))


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS links,
  regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages""")
def html_contacts(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    links = F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).cast("long")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), links.alias("links"), F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"))


SITE = "regexp_extract(url, '^https?://([^/?#]+)', 1)"


@query(f"""WITH p AS (SELECT page_id, url, {SITE} AS firm, regexp_matches(url, '(forum|social|blog)') AS is_social FROM pages)
  SELECT firm, arg_min(url, (is_social, page_id)) AS website, count(*) AS n_sites, count(*) FILTER (is_social) AS n_social FROM p GROUP BY 1""")
def website_primary(spark, sf_dir):
    """One site for each firm, one that is no social page if there is any."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("firm"), F.col("url").rlike("(forum|social|blog)").alias("is_social"))
    return p.groupBy("firm").agg(F.min_by("url", F.struct("is_social", "page_id")).alias("website"), F.count("*").alias("n_sites"), F.count_if("is_social").alias("n_social"))


@query(None)
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", markup.page_text(F.col("html")).alias("text"))


@query("""SELECT c_custkey AS id, replace(replace('Dear {{name}}, {{segment}} {{other}}', '{{name}}', c_name), '{{segment}}', c_mktsegment) AS body,
  len(regexp_extract_all(replace(replace('Dear {{name}}, {{segment}} {{other}}', '{{name}}', c_name), '{{segment}}', c_mktsegment), '\\{\\{[a-z]+\\}\\}')) AS unresolved FROM customer""")
def template_render(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    body = text.render(F.lit("Dear {{name}}, {{segment}} {{other}}"), {"name": F.col("c_name"), "segment": F.col("c_mktsegment")})
    return c.select(F.col("c_custkey").alias("id"), body.alias("body")).withColumn("unresolved", F.size(F.regexp_extract_all("body", F.lit(r"\{\{[a-z]+\}\}"), F.lit(0))).cast("long"))


@query("""WITH a AS (SELECT p_partkey AS id, p_size::VARCHAR AS n, upper(string_split(p_name, ' ')[1]) AS w FROM part)
  SELECT id, CASE id % 4 WHEN 0 THEN n || ' N ' || w || ' ST' WHEN 1 THEN n || ' ' || w || ' TRL NE' WHEN 2 THEN n || ' ' || w || ' PKWY' END AS street, CASE WHEN id % 4 < 2 THEN n END AS house FROM a""")
def street_lines(spark, sf_dir):
    """Units, glued building names, two-word directions, rear notes and lines without a number."""
    n, w = F.col("p_size").cast("string"), F.split("p_name", " ")[0]
    k = F.col("p_partkey") % 4
    line = (
        F.when(k == 0, F.concat(n, F.lit(" North "), w, F.lit(" Street, Suite "), n)).when(k == 1, F.concat(n, F.lit(" "), w, F.lit(" Trail North East bldg 3")))
        .when(k == 2, F.concat(F.lit("Oak Tower-"), n, F.lit(" "), w, F.lit(" Parkway, rear"))).otherwise(F.concat(F.lit("PO Box "), n))
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.street(line).alias("street"), text.house_number(line).alias("house"))


@query("""SELECT c_custkey AS id, lpad((c_custkey * 7919 % 10000000000)::VARCHAR, 10, '2') AS phone,
  '(' || substr(lpad((c_custkey * 7919 % 10000000000)::VARCHAR, 10, '2'), 1, 3) || ') ' || substr(lpad((c_custkey * 7919 % 10000000000)::VARCHAR, 10, '2'), 4, 3) || '-' || substr(lpad((c_custkey * 7919 % 10000000000)::VARCHAR, 10, '2'), 7, 4) AS pretty FROM customer""")
def phone_forms(spark, sf_dir):
    raw = F.lpad((F.col("c_custkey") * 7919 % 10_000_000_000).cast("string"), 10, "2")
    said = F.concat(F.lit("+1 ("), F.substring(raw, 1, 3), F.lit(") "), F.substring(raw, 4, 3), F.lit("."), F.substring(raw, 7, 4))
    digits = text.phone_digits(said)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), digits.alias("phone"), text.pretty_phone(digits).alias("pretty"))


@query("""SELECT p_partkey AS id, p_size * CASE p_partkey % 4 WHEN 0 THEN 1e9 WHEN 1 THEN 1e6 WHEN 2 THEN 1000 END::DOUBLE AS amount FROM part""")
def money_text(spark, sf_dir):
    k, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    said = F.when(k == 0, F.concat(F.lit("over $"), n, F.lit("B"))).when(k == 1, F.concat(n, F.lit(" m and more"))).when(k == 2, F.concat(n, F.lit(",000"))).otherwise("undisclosed")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.money(said).alias("amount"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN '''=' || p_name ELSE p_name END AS cell FROM part""")
def csv_cells(spark, sf_dir):
    raw = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("="), "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.csv_guard(raw).alias("cell"))


@query("""WITH c AS (SELECT 'segment' AS field, c_mktsegment AS value FROM customer UNION ALL SELECT 'negative', CASE WHEN c_acctbal < 0 THEN 'true' END FROM customer UNION ALL SELECT 'name', c_name FROM customer WHERE c_custkey % 2 = 0)
  SELECT field, count(value) AS filled, count(DISTINCT value) AS vocabulary FROM c GROUP BY 1""")
def field_census(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    wide = c.select(F.col("c_mktsegment").alias("segment"), F.when(F.col("c_acctbal") < 0, "true").alias("negative"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("name"))
    long = wide.unpivot([], ["segment", "negative", "name"], "field", "value")
    return long.groupBy("field").agg(F.count("value").alias("filled"), F.count_distinct("value").alias("vocabulary"))


@query("""SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, arg_max(role, turn) AS last_role FROM conversations GROUP BY 1""")
def conversation_threads(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.max_by("role", "turn").alias("last_role"))


@query("""SELECT l_returnflag AS source, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY 1""")
def pivot_source_tier(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("source")).pivot("l_linestatus", ["F", "O"]).count().na.fill(0)


@query("""SELECT 'lines have orders' AS name, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS failures UNION ALL
  SELECT 'orders are unique', (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) UNION ALL
  SELECT 'flags are known', (SELECT count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')) UNION ALL
  SELECT 'nations partition customers', (SELECT abs((SELECT count(*) FROM customer) - (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey)))""")
def audit_counts(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return audit.failures([
        audit.referenced("lines have orders", t("lineitem"), "l_orderkey", t("orders"), "o_orderkey"),
        audit.unique("orders are unique", t("orders"), ["o_orderkey"]),
        audit.vocabulary("flags are known", t("lineitem"), "l_returnflag", ["A", "N"]),
        audit.same_count("nations partition customers", t("customer"), t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))),
    ])


@query(None)
def field_dictionary(spark, sf_dir):
    from ..sources.catalogs import dictionary

    return dictionary(spark, {n: table(spark, sf_dir, n) for n in ("supplier", "customer", "orders", "lineitem", "events")})
