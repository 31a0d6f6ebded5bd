"""The registry of queries, and the analog tables they share.

The driver's tables stand in for the domain: a supplier is a firm, a customer a person, an order an
account that its suppliers hold together, a nation a state, a region a territory, a line number an
office, an event an activity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import dealt, task_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that must give the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """crd, name, state, balance and roll-ups of the firm's lines: assets, accounts, people, retail."""
    tasks = task_count(table(spark, sf_dir, "lineitem"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("crd"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    # counts of distinct accounts and people by folding them first: no row is copied for either
    joined = dealt(lines, tasks, "l_orderkey").join(dealt(orders, tasks, "o_orderkey"), lines.l_orderkey == orders.o_orderkey)
    sums = [F.sum("price").alias("price"), F.count("*").alias("rows"), F.count_if(F.col("l_returnflag") == "N").alias("retail_rows")]
    again = [F.sum(c).alias(c) for c in ("price", "rows", "retail_rows")]
    by_account = joined.groupBy("crd", "o_custkey", "l_orderkey").agg(*sums)
    held = dealt(by_account, tasks, "crd", "o_custkey").groupBy("crd", "o_custkey").agg(F.count("*").alias("accounts"), *again)
    rolled = held.groupBy("crd").agg(F.sum("price").alias("assets"), F.sum("accounts").alias("accounts"), F.count("o_custkey").alias("people"), F.sum("rows").alias("rows"), F.sum("retail_rows").alias("retail_rows"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("crd"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("state"), F.col("s_acctbal").alias("balance"))
    return s.join(rolled, "crd", "left")


#: The same in SQL.
FIRMS = """firms AS (
  SELECT s_suppkey AS crd, s_name AS name, s_nationkey AS state, s_acctbal AS balance, r.* EXCLUDE (k)
  FROM supplier LEFT JOIN (
    SELECT l_suppkey AS k, sum(l_extendedprice::DECIMAL(18,2)) AS assets, count(DISTINCT l_orderkey) AS accounts,
           count(DISTINCT o_custkey) AS people, count(*) AS rows, count(*) FILTER (l_returnflag = 'N') AS retail_rows
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) r ON r.k = s_suppkey)"""


def offices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (person, firm, office)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    tasks = task_count(table(spark, sf_dir, "lineitem"))
    joined = dealt(lines, tasks, "l_orderkey").join(dealt(orders, tasks, "o_orderkey"), lines.l_orderkey == orders.o_orderkey)
    rows = joined.select(F.col("o_custkey").alias("person"), F.col("l_suppkey").alias("firm"), F.col("l_linenumber").alias("office"))
    return dealt(rows, tasks, "firm", "person").distinct()


OFFICES = """offices AS (
  SELECT DISTINCT o_custkey AS person, l_suppkey AS firm, l_linenumber AS office FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (account, holder)."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("account"), F.col("l_suppkey").alias("holder")).distinct()


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("account"), F.col("o_custkey").alias("person"), F.col("o_totalprice").cast("decimal(18,2)").alias("value"), F.col("o_orderdate").alias("stamp"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as activity: rep, advisor, direction, classification, occurred_at."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        "event_id", (F.col("user_id") % 7).alias("rep"), (F.col("user_id") % 40).alias("advisor"), F.col("ts").alias("occurred_at"), "value", "props", kind.alias("event_type"),
        F.when(kind == "view", "outbound").when(kind.isin("click", "signup", "error"), "inbound").alias("direction"),
        F.when(kind == "view", "sent").when(kind == "click", "reply").when(kind == "signup", "auto_reply").when(kind == "error", "bounce").alias("classification"),
    )


LOG = """log AS (
  SELECT event_id, user_id % 7 AS rep, user_id % 40 AS advisor, ts AS occurred_at, value, props, event_type,
    CASE event_type WHEN 'view' THEN 'outbound' WHEN 'click' THEN 'inbound' WHEN 'signup' THEN 'inbound' WHEN 'error' THEN 'inbound' END AS direction,
    CASE event_type WHEN 'view' THEN 'sent' WHEN 'click' THEN 'reply' WHEN 'signup' THEN 'auto_reply' WHEN 'error' THEN 'bounce' END AS classification
  FROM events)"""

#: A person's place, derived from the key so that both engines agree.
PEOPLE = """people AS (
  SELECT c_custkey AS person, c_name AS name, c_nationkey AS state, 25 + (c_custkey * 37 % 2400) / 100.0::DOUBLE AS lat,
         -(70 + (c_custkey * 91 % 5000) / 100.0::DOUBLE) AS lon, c_acctbal AS balance, c_mktsegment AS segment FROM customer)"""


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    lat = F.lit(25) + (key * 37 % 2400) / F.lit(100.0)
    lon = -(F.lit(70) + (key * 91 % 5000) / F.lit(100.0))
    return table(spark, sf_dir, "customer").select(key.alias("person"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("state"), lat.alias("lat"), lon.alias("lon"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
