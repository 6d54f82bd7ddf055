"""Candidate feeds derived from keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEX_DIGITS = "0123456789abcdef"


def dna_from_key(key: Column, length: int) -> Column:
    """A deterministic sequence of up to 32 bases for a key: its MD5 digits modulo four."""
    digest = F.translate(F.md5(key.cast("string").cast("binary")), HEX_DIGITS, "ACGT" * 4)
    return F.substring(digest, 1, length)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_candidates(spark: SparkSession, sf_dir: str, length: int = 20) -> DataFrame:
    """One candidate per order, attempt = order key: no duplicates."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("attempt_id"), dna_from_key(F.col("o_orderkey"), length).alias("sequence")
    )


def line_candidates(spark: SparkSession, sf_dir: str, length: int = 20) -> DataFrame:
    """One candidate per line item, sequence from its part and supplier: many duplicates.

    Line numbers repeat within an order, so the attempt number is not unique."""
    lines = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    return lines.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("attempt_id"),
        dna_from_key(key, length).alias("sequence"),
    )


def customer_candidates(spark: SparkSession, sf_dir: str, length: int = 20) -> DataFrame:
    """One candidate per order, sequence from its customer: every customer orders repeatedly."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("attempt_id"), dna_from_key(F.col("o_custkey"), length).alias("sequence")
    )
