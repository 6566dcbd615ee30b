"""The graph that the relational tables imply, and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..tables import table


def key_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers live in nations, nations are part of regions; (seq, subject, predicate, object, page_num)."""
    t = lambda n: table(spark, sf_dir, n)
    nation = t("nation")
    row = lambda df, seq, s, p, o, page: df.select((F.lit(seq[0]) + F.col(seq[1]).cast("long")).alias("seq"), F.col(s).alias("subject"), F.lit(p).alias("predicate"), F.col(o).alias("object"), page.cast("int").alias("page_num"))
    c = row(t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")), (0, "c_custkey"), "c_name", "LIVES_IN", "n_name", F.col("c_nationkey") % 5 + 1)
    n = row(nation.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")), (10**12, "n_nationkey"), "n_name", "PART_OF", "r_name", F.col("n_regionkey") + 1)
    s = row(t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")), (2 * 10**12, "s_suppkey"), "s_name", "LIVES_IN", "n_name", F.col("s_nationkey") % 7 + 1)
    return c.unionByName(n).unionByName(s)


def key_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.upsert(key_triples(spark, sf_dir))


def order_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and the parts they ship, the return flag as predicate: pairs come again and again."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.concat(F.lit("S"), "l_suppkey").alias("subject"), F.col("l_returnflag").alias("predicate"), F.concat(F.lit("P"), "l_partkey").alias("object"), F.col("l_linenumber").cast("int").alias("page_num"))


TRIPLES_SQL = """
t AS (
  SELECT c_custkey::BIGINT AS seq, c_name AS subject, 'LIVES_IN' AS predicate, n_name AS object, (c_nationkey % 5 + 1)::INT AS page_num FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 1000000000000 + n_nationkey, n_name, 'PART_OF', r_name, (n_regionkey + 1)::INT FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 2000000000000 + s_suppkey, s_name, 'LIVES_IN', n_name, (s_nationkey % 7 + 1)::INT FROM supplier JOIN nation ON s_nationkey = n_nationkey
)"""
EDGES_SQL = (
    TRIPLES_SQL
    + """, e AS (
  SELECT subject AS src, object AS dst, max_by(predicate, seq) AS relation, max_by(page_num, seq) AS page_num, min(seq) AS first_seq, max(seq) AS last_seq FROM t GROUP BY subject, object
), u AS (SELECT src AS node, dst AS other FROM e UNION SELECT dst, src FROM e), n AS (SELECT DISTINCT node AS entity FROM u)"""
)
