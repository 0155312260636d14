"""Queries of the subpackage and, where SQL can say it, the same results in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import clean_path
from quarry.llm import bpe, broken, groups, handwritten, mix, pii, sql, topn


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/code_duplicates.parquet")
    return groups.group_matches(
        t, F.col("analysis_id"), clean_path(F.col("source_file_path")), clean_path(F.col("target_file_path")), F.col("fragment_hash")
    ).withColumnRenamed("scope", "analysis_id")


HOTSPOT_SCORES = ("hotspot_score", "architectural_centrality", "complexity_risk", "issue_severity_burden")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/file_metrics.parquet").select("id", "analysis_id", clean_path(F.col("file_path")).alias("path"), "created_at", *HOTSPOT_SCORES)
    latest = (
        t.filter("analysis_id is not null and path is not null").groupBy("analysis_id", "path")
        .agg(F.max_by(F.struct(*HOTSPOT_SCORES), F.struct("created_at", "id")).alias("m")).select("analysis_id", "path", "m.*")
    )
    return topn.top_n(latest, F.col("analysis_id"), [F.col(c) for c in HOTSPOT_SCORES], F.col("path"), 10, ("analysis_id", "hotspot_rank", "file_path"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/repository_files.parquet").filter("id is not null")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return broken.broken_files(_files(spark, d), "id", "path", "content").select(F.col("id").alias("file_id")).distinct()


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates per repository (of the run's job) and language."""
    jobs = spark.read.parquet(f"{d}/analysis_jobs.parquet").groupBy("id").agg(F.max_by("repository_id", "updated_at").alias("repository_id"))
    checked = broken.check_files(_files(spark, d), "id", "analysis_id", "path", "content").join(jobs.withColumnRenamed("id", "analysis_id"), "analysis_id", "left")
    return broken.rates(checked, "id", "repository_id")


def _p5(spark: SparkSession, d: str) -> DataFrame:
    """Repositories of one owner are related; a run without a known repository stands for itself."""
    jobs = spark.read.parquet(f"{d}/analysis_jobs.parquet").groupBy("id").agg(F.max_by("repository_id", "updated_at").alias("repository_id"))
    repositories = spark.read.parquet(f"{d}/repositories.parquet").groupBy("id").agg(F.max("owner").alias("owner")).withColumnRenamed("id", "repository_id")
    owners = jobs.join(repositories, "repository_id", "left").select(F.col("id").alias("analysis_id"), F.coalesce("owner", "repository_id").alias("owner"))
    files = spark.read.parquet(f"{d}/repository_files.parquet").filter("id is not null")
    return handwritten.not_handwritten(files, "id", "analysis_id", "path", "content", owners)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d).select(F.col("id").alias("file_id")).distinct()


def p5_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d).select(F.col("id").alias("file_id"), "kind").distinct()


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_column(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), "text")


def _p8(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mix.draw_mix(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/source_targets.parquet"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix and how often each occurs."""
    return _p8(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _p8(spark, d)[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text")


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.scan(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text").select("doc_id", "redacted")


QUERIES = {"p3_found": p3_found, "p4_found": p4_found, "p4_rates": p4_rates, "p5_found": p5_found, "p5_kinds": p5_kinds, "p6_found": p6_found, "p7_ids": p7_ids, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_redacted": p9_redacted}
ORACLES = {"p3_found": sql.P3, "p6_found": sql.P6}
