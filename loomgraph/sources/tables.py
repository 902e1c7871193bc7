"""Graphs and vectors made from the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: which customer bought which part.  Customers have even ids, parts odd ones."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    both = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return both.select((F.col("o_custkey") * 2).cast("long").alias("src"), (F.col("l_partkey") * 2 + 1).cast("long").alias("dst"))


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: which part comes from which supplier; suppliers are hubs.  Parts have even ids, suppliers odd ones."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 2).cast("long").alias("src"), (F.col("l_suppkey") * 2 + 1).cast("long").alias("dst"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: users of consecutive events of one type on one day."""
    w = Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("src"), F.lead("user_id").over(w).cast("long").alias("dst"))
    return e.where("dst is not null")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src (child), dst (parent): orders, customers, nations and regions; the id's remainder by four names the level."""
    part = lambda name, child, parent, level: table(spark, sf_dir, name).select((F.col(child).cast("long") * 4 + level).alias("src"), (F.col(parent).cast("long") * 4 + level + 1).alias("dst"))
    return part("orders", "o_orderkey", "o_custkey", 0).union(part("customer", "c_custkey", "c_nationkey", 1)).union(part("nation", "n_nationkey", "n_regionkey", 2))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, vec, label."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("long").alias("label"))


#: DuckDB's forms.
SQL = {
    "basket": "SELECT DISTINCT o_custkey * 2 AS src, l_partkey * 2 + 1 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "supply": "SELECT DISTINCT l_partkey * 2 AS src, l_suppkey * 2 + 1 AS dst FROM lineitem",
    "users": "SELECT DISTINCT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL AND src <> dst",
    "tree": "SELECT o_orderkey::BIGINT * 4 AS src, o_custkey::BIGINT * 4 + 1 AS dst FROM orders UNION ALL SELECT c_custkey::BIGINT * 4 + 1, c_nationkey::BIGINT * 4 + 2 FROM customer UNION ALL SELECT n_nationkey::BIGINT * 4 + 2, n_regionkey::BIGINT * 4 + 3 FROM nation",
}


def edges_sql(name: str) -> str:
    """CTEs g (one direction, distinct) and e (both directions, no loops)."""
    return f"g AS MATERIALIZED ({SQL[name]}), e AS MATERIALIZED (SELECT src, dst FROM g WHERE src <> dst UNION SELECT dst, src FROM g WHERE src <> dst)"
