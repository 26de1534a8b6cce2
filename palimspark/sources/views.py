"""Views that give the test tables the shapes of the domain, for Spark and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Orders as versions of titled documents; valid in both engines.
VERSIONS_SQL = """
SELECT CAST(o_orderkey AS STRING) AS bbbs, concat('T', CAST(o_custkey AS STRING)) AS title,
  CASE o_custkey % 3 WHEN 0 THEN 'law' WHEN 1 THEN 'regulation' ELSE 'interpretation' END AS category,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN rn = 1 AND o_orderkey % 10 = 1 THEN 4 WHEN rn = 1 THEN 3
       WHEN o_orderkey % 4 = 0 THEN 1 ELSE 2 END AS status_code,
  CAST(o_orderdate AS DATE) AS effective_date
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) t"""

#: Customers as chunks with access attributes; valid in both engines.
ACL_SQL = """
SELECT c_custkey AS node_id,
  CASE c_nationkey % 3 WHEN 0 THEN 'corp-default' WHEN 1 THEN 'tenant-1' ELSE NULL END AS tenant_id,
  CASE c_custkey % 6 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'confidential'
    WHEN 3 THEN 'restricted' WHEN 4 THEN 'odd' ELSE NULL END AS security_level,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'all' WHEN 'AUTOMOBILE' THEN 'support_agent,team_lead'
    WHEN 'MACHINERY' THEN 'qa' ELSE '' END AS audience
FROM customer"""

#: Events as retrieval trace rows; valid in both engines.
TRACE_SQL = "SELECT concat('q-', CAST(user_id AS STRING)) AS query_id, ts, event_type AS stage, event_id, value AS elapsed_ms FROM events"

#: Line items as texts that cite an article by a Chinese numeral; valid in both engines.
CITATIONS_SQL = """
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS article, l_partkey,
  concat(CASE WHEN CAST(l_quantity AS INT) >= 20 THEN concat(substr('一二三四五六七八九', CAST(floor(CAST(l_quantity AS INT) / 10) AS INT), 1), '十')
              WHEN CAST(l_quantity AS INT) >= 10 THEN '十' ELSE '' END,
         CASE WHEN CAST(l_quantity AS INT) % 10 > 0 THEN substr('一二三四五六七八九', CAST(l_quantity AS INT) % 10, 1) ELSE '' END) AS numeral
FROM lineitem"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A view of one table, by its SQL. The table's name in the SQL is replaced by its path."""
    for name in TABLES:
        if f"FROM {name}" in sql:
            escaped = sql.replace("{", "{{").replace("}", "}}")
            return spark.sql(escaped.replace(f"FROM {name}", "FROM {source}"), source=table(spark, sf_dir, name))
    raise ValueError("the view names none of the tables")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, VERSIONS_SQL)


def acl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, ACL_SQL)


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, TRACE_SQL).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, CITATIONS_SQL)
