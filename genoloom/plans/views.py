"""Interval views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CALLS = """
SELECT o_orderkey AS id, o_orderpriority AS t, o_orderstatus AS side, o_custkey % 25 AS k, CAST(floor(o_totalprice / 10) AS BIGINT) AS s,
  CAST(floor(o_totalprice / 10) AS BIGINT) + 50 + o_orderkey % 400 AS e
  FROM orders
"""
DENSE = "SELECT l_suppkey AS k, l_returnflag AS t, l_partkey AS s, l_partkey + CAST(l_quantity AS BIGINT) AS e FROM lineitem"
GENE = "SELECT p_name AS symbol, p_brand AS chrom, p_partkey AS s, p_partkey + 5 AS e FROM part"
TREE = "SELECT (n_nationkey - 1) // 2 AS parent, n_nationkey AS child FROM nation WHERE n_nationkey > 0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.floor(F.col("o_totalprice") / 10).cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("t"), F.col("o_orderstatus").alias("side"), (F.col("o_custkey") % 25).alias("k"), s.alias("s"), (s + 50 + F.col("o_orderkey") % 400).alias("e"))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("t"), F.col("l_partkey").alias("s"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("e"))


def gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("symbol"), F.col("p_brand").alias("chrom"), F.col("p_partkey").alias("s"), (F.col("p_partkey") + 5).alias("e"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").filter("n_nationkey > 0").select(F.floor((F.col("n_nationkey") - 1) / 2).cast("int").alias("parent"), F.col("n_nationkey").alias("child"))
