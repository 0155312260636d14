"""The stored tables and the views that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import clean_path
from quarry.scratch import Scratch


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def all_files(spark: SparkSession, d: str) -> DataFrame:
    """Every row of repository_files, with clean paths; repeated and superseded ones too."""
    return table(spark, d, "repository_files").select("id", "analysis_id", clean_path(F.col("path")).alias("path"), "size_bytes", "content", "created_at")


def latest_files(rows: DataFrame) -> DataFrame:
    """One row per run and path: of several the latest, then the greatest id. For rows that no longer hold contents."""
    rest = [c for c in rows.columns if c not in ("analysis_id", "path", "created_at")]
    return rows.groupBy("analysis_id", "path").agg(F.max_by(F.struct(*rest), F.struct("created_at", "id")).alias("v")).select("analysis_id", "path", "v.*")


#: Superseded rows (a long each) up to which they are broadcast, after a count.
BROADCAST_ROWS = 1_000_000


def without_superseded(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` (a stored table with a unique ``rid``) of ``latest_files``; only ids of superseded rows travel, no values.

    Rows are told apart by short hashes of run and path first: what is alone under its hash is not superseded. The ids are stored, as every reader of ``rows`` asks for them.
    """
    w = Window.partitionBy("analysis_id", "path").orderBy(F.desc("created_at"), F.desc("id"), "rid")
    keyed = rows.select("analysis_id", "path", "created_at", "id", "rid", F.xxhash64("analysis_id", "path").alias("k"))
    several = scratch.write(keyed.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k"))
    few = F.broadcast(several) if several.count() <= BROADCAST_ROWS else several
    old = scratch.write(keyed.join(few, "k", "left_semi").withColumn("n", F.row_number().over(w)).filter("n > 1").select("rid"))
    return rows.join(F.broadcast(old) if old.count() <= BROADCAST_ROWS else old, "rid", "left_anti")


def scored_files(spark: SparkSession, d: str) -> DataFrame:
    """file_metrics, one row per run and path."""
    cols = ["sloc", "max_cyclomatic_complexity", "max_nesting_depth", "fan_in", "fan_out", "issues_count", "blocker_count", "critical_count", "major_count", "minor_count"]
    t = table(spark, d, "file_metrics").filter("analysis_id is not null").select("id", "analysis_id", clean_path(F.col("file_path")).alias("file_path"), "created_at", *cols)
    return t.groupBy("analysis_id", "file_path").agg(F.max_by(F.struct(*cols), F.struct("created_at", "id")).alias("v")).select("analysis_id", "file_path", "v.*")


def clone_edges(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "code_duplicates")
    return t.select("analysis_id", clean_path(F.col("source_file_path")).alias("src"), clean_path(F.col("target_file_path")).alias("dst"), F.col("source_start_line").alias("line_number")).filter("src is not null and dst is not null")


def numstat(spark: SparkSession, d: str) -> DataFrame:
    """A change history: orders are commits of their customers, line items the changed files."""
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(F.col("l_orderkey").alias("commit"), F.col("o_custkey").alias("author"), F.concat(F.lit("src/part_"), F.col("l_partkey").cast("string"), F.lit(".py")).alias("path"), F.col("l_quantity").cast("int").alias("added"), F.col("l_linenumber").alias("deleted"))
