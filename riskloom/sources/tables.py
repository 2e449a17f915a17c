"""The driver tables as inputs of the operators: the same expressions feed Spark and the comparison SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A binary scored table; the key's share in the score makes the order total.
SCORED = """SELECT o_orderkey AS id, o_orderpriority AS seg, CAST(year(o_orderdate) AS INT) AS period,
 CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INT) AS target,
 o_totalprice + CAST(o_orderkey AS DOUBLE) / CAST(1000000 AS DOUBLE) AS score,
 CAST(0 AS DOUBLE) - o_totalprice + CAST(o_orderkey AS DOUBLE) / CAST(1000000 AS DOUBLE) AS reverse FROM orders"""
#: One observation a customer and day; and the questions: each customer at three dates.
HISTORY = """SELECT o_custkey AS id, CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) AS total,
 CAST(count(*) AS DOUBLE) AS n, CASE WHEN o_custkey % 3 = 0 THEN CAST(NULL AS DOUBLE) ELSE max(o_totalprice) END AS most
 FROM orders GROUP BY o_custkey, CAST(o_orderdate AS DATE)"""
SPINE = """SELECT c_custkey AS id, c_mktsegment AS segment, r FROM customer CROSS JOIN
 (SELECT CAST('1997-06-30' AS DATE) AS r UNION ALL SELECT CAST('1999-01-31' AS DATE) UNION ALL SELECT CAST('2001-06-30' AS DATE)) dates"""
#: Daily values of users, for day and week units.
DAILY = "SELECT user_id AS id, CAST(ts AS DATE) AS d, sum(value) AS total FROM events GROUP BY user_id, CAST(ts AS DATE)"
DAILY_SPINE = "SELECT DISTINCT user_id AS id, CAST('2024-01-20' AS DATE) AS r FROM events"
#: What was sent to a provider and what came back, with gaps, repeats and values out of range.
SENT = "SELECT CASE WHEN o_orderkey % 97 = 0 THEN CAST(NULL AS BIGINT) WHEN o_orderkey % 5 = 0 THEN -o_orderkey ELSE o_orderkey END AS id, CAST(o_orderdate AS DATE) AS dt FROM orders"
RECEIVED = """SELECT CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey + 1000000000 ELSE o_orderkey - o_orderkey % 2 END AS id, CASE WHEN o_orderkey % 89 = 0 THEN CAST(NULL AS DATE) ELSE CAST(o_orderdate AS DATE) END AS dt,
 CASE WHEN o_orderkey % 53 = 0 THEN CAST(NULL AS DOUBLE) WHEN o_orderkey % 101 = 0 THEN CAST(-5 AS DOUBLE) WHEN o_orderkey % 103 = 0 THEN CAST(1200 AS DOUBLE)
 ELSE o_totalprice / CAST(500 AS DOUBLE) END AS score FROM orders"""
#: Features and a target for selection.
SELECTION = """SELECT CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INT) AS target, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
 CAST(l_linenumber AS INT) AS code, CASE WHEN l_orderkey % 10 = 0 THEN CAST(NULL AS DOUBLE) ELSE l_quantity END AS sparse, CAST(7 AS INT) AS flat, l_linestatus AS status,
 CASE WHEN l_orderkey % 11 = 0 THEN CAST(NULL AS VARCHAR(3)) ELSE l_returnflag END AS flag FROM lineitem"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The result of one of the expressions above over the tables of a folder."""
    names = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "events", "lineitem") if f" {t}" in sql}
    for t, df in names.items():
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **names)
