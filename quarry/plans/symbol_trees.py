"""Trees of symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.hierarchy import descendants, resolve


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/symbols.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return resolve(_symbols(spark, d), F.col("id"), F.col("parent_symbol_id"), [F.col("created_at")])


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    return resolve(_symbols(spark, d), F.col("id"), F.col("parent_symbol_id"), [F.col("created_at")], name=F.col("name"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(_symbols(spark, d), F.col("id"), F.col("parent_symbol_id"), [F.col("created_at")])


def p2_all_descendants(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of ``p2_descendants`` and those on and below cycles."""
    return descendants(_symbols(spark, d), F.col("id"), F.col("parent_symbol_id"), [F.col("created_at")], cyclic=True)
