"""Issue changes between consecutive completed runs of a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.jsonvalue import json_value_hash
from quarry.functions.text import blank_to_null, clean_path, strip
from quarry.operators.snapshot_diff import diff_snapshots, snapshot_positions


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """One row per job id: the state with the latest updated_at, ties by the remaining values."""
    order = [F.col("updated_at").desc_nulls_last(), F.col("completed_at").desc_nulls_last(), F.col("status").desc_nulls_last(), F.col("repository_id").desc_nulls_last()]
    w = Window.partitionBy("id").orderBy(*order)
    return jobs.select("id", "repository_id", "status", "completed_at", "updated_at").withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def issue_changes(issues: DataFrame, jobs: DataFrame) -> DataFrame:
    """analysis_id, rule_id, file_path, issue_scope, change_kind; see ``snapshot_diff`` for the defined cases.

    A null rule_id or file_path stays null in the key. A target_identifier that is no string counts by its JSON text.
    """
    done = latest_jobs(jobs).filter(F.col("status") == "completed")
    positions = snapshot_positions(done, F.col("id"), F.col("repository_id"), [F.col("completed_at")])
    target = blank_to_null(F.get_json_object("metadata_json", "$.target_identifier"))
    scope = F.coalesce(blank_to_null(strip(F.col("symbol_name"))), target, F.lit("file"))
    out = diff_snapshots(
        issues.select("id", "analysis_id", "rule_id", "file_path", "symbol_name", "severity", "metadata_json", "created_at"),
        positions,
        snapshot=F.col("analysis_id"),
        key={"rule_id": strip(F.col("rule_id")), "file_path": clean_path(F.col("file_path")), "issue_scope": scope},
        fingerprint={"severity": F.col("severity"), "metadata": json_value_hash(F.col("metadata_json"))},
        order=[F.col("created_at"), F.col("id")],
    )
    return out.withColumnRenamed("snapshot", "analysis_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return issue_changes(spark.read.parquet(f"{d}/analysis_issues.parquet"), spark.read.parquet(f"{d}/analysis_jobs.parquet"))
