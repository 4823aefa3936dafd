"""The driver's tables in the roles of filings, grants and names; the same roles in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def returns(spark: SparkSession, d: str) -> DataFrame:
    """Filing headers: one row per order."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("filing_id"), F.col("o_custkey").alias("ein"), F.year("o_orderdate").cast("long").alias("tax_year"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("return_ts"), F.col("o_orderstatus").alias("return_type"),
        F.when(F.col("o_orderpriority").startswith("1"), "1").alias("amended"), F.col("o_orderpriority").alias("org_name"), F.col("o_totalprice").alias("total"),
    )


def grants(spark: SparkSession, d: str) -> DataFrame:
    """Child rows: one row per line item."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("filing_id"), F.col("l_suppkey").alias("recipient"), F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("cash"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("noncash"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
    )


def grant_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Grants of a filing to a recipient, summed: this pair is a key."""
    return grants(spark, d).groupBy("filing_id", "recipient").agg(F.round(F.sum("cash"), 2).alias("amount"))


def flows(spark: SparkSession, d: str) -> DataFrame:
    """Money from filer to recipient by year."""
    joined = grants(spark, d).join(returns(spark, d).select("filing_id", "ein", "tax_year"), "filing_id")
    return joined.groupBy("ein", "recipient", "tax_year").agg(F.round(F.sum("cash"), 2).alias("amount"))


RETURNS = """returns AS (
  SELECT o_orderkey AS filing_id, o_custkey AS ein, CAST(year(o_orderdate) AS BIGINT) AS tax_year, strftime(o_orderdate, '%Y-%m-%d') AS return_ts,
         o_orderstatus AS return_type, CASE WHEN o_orderpriority LIKE '1%' THEN '1' END AS amended, o_orderpriority AS org_name, o_totalprice AS total
  FROM orders)"""
GRANTS = """grants AS (
  SELECT l_orderkey AS filing_id, l_suppkey AS recipient, l_partkey AS part, l_extendedprice AS cash, l_extendedprice * l_tax AS noncash,
         l_returnflag AS flag, l_linestatus AS status
  FROM lineitem)"""
PAIRS = "pairs AS (SELECT filing_id, recipient, round(sum(cash), 2) AS amount FROM grants GROUP BY filing_id, recipient)"
FLOWS = "flows AS (SELECT ein, recipient, tax_year, round(sum(cash), 2) AS amount FROM grants JOIN returns USING (filing_id) GROUP BY ein, recipient, tax_year)"
CANONICAL = """canonical AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY ein, tax_year ORDER BY (return_ts IS NOT NULL) DESC, return_ts DESC NULLS LAST, coalesce(amended, '0') DESC, filing_id DESC) AS rn
    FROM returns WHERE return_type IN ('F', 'O')) WHERE rn = 1)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
