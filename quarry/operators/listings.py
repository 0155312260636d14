"""Filtered, sorted and paged reads of the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.scores import severity_rank

MAX_PAGE = 200


def contains_text(term: str, *columns: str) -> Column:
    """Whether any column holds ``term``, whatever the letter case; wildcards in it are plain characters."""
    pattern = "%" + term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
    return out


def page(rows: DataFrame, order: list[Column], skip: int = 0, limit: int = 50) -> DataFrame:
    """``order`` must end in a unique column, so that pages neither repeat nor lose rows."""
    if skip < 0 or not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"skip is 0 or more, limit 1 to {MAX_PAGE}")
    return rows.orderBy(*order).offset(skip).limit(limit)


def sorted_by(allowed: dict[str, str], key: str, direction: str) -> Column:
    if key not in allowed or direction not in ("asc", "desc"):
        raise ValueError(f"sort by one of {sorted(allowed)}, asc or desc")
    return F.col(allowed[key]).desc_nulls_last() if direction == "desc" else F.col(allowed[key]).asc_nulls_first()


def symbols(symbols: DataFrame, files: DataFrame, symbol_type: str | None = None, search: str | None = None) -> DataFrame:
    """Symbols with their file's path."""
    rows = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    if symbol_type:
        rows = rows.filter(F.col("symbol_type") == symbol_type)
    return rows.filter(contains_text(search, "name", "qualified_name")) if search else rows


def issues(rows: DataFrame, category: str | None = None, severity: str | None = None, rule_id: str | None = None, search: str | None = None) -> DataFrame:
    for c, v in (("category", category), ("severity", severity), ("rule_id", rule_id)):
        if v:
            rows = rows.filter(F.lower(c) == v.lower() if c != "rule_id" else F.col(c) == v)
    if search:
        rows = rows.filter(contains_text(search, "title", "description", "file_path", "symbol_name"))
    return rows.withColumn("severity_rank", severity_rank(F.col("severity")))


ISSUE_ORDER = ["severity_rank", "rule_id", "created_at", "id"]


def issue_summary(rows: DataFrame, group: str) -> DataFrame:
    """Counts and minutes by severity, by category and overall, in one pass (grouping sets)."""
    g, sev, cat = F.col(group), F.col("severity"), F.col("category")
    level = (F.grouping("severity").cast("int") * 2 + F.grouping("category").cast("int")).alias("level")
    return rows.groupingSets([[g, sev], [g, cat], [g]], g, sev, cat).agg(F.count("*").alias("issues"), F.coalesce(F.sum("remediation_effort_minutes"), F.lit(0)).cast("long").alias("minutes"), level)


def top_rules(rows: DataFrame, group: str, k: int = 10) -> DataFrame:
    from pyspark.sql import Window

    per = rows.groupBy(group, "rule_id").agg(F.count("*").alias("issues"))
    return per.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("issues"), "rule_id"))).filter(F.col("position") <= k)


def dependencies(edges: DataFrame, files: DataFrame, status: str | None = None, kind: str | None = None, search: str | None = None) -> DataFrame:
    """Imports with the paths of both ends; the far end may be outside."""
    f = files.select("id", "path")
    rows = edges.join(f.select(F.col("id").alias("source_file_id"), F.col("path").alias("source_path")), "source_file_id").join(f.select(F.col("id").alias("target_file_id"), F.col("path").alias("target_path")), "target_file_id", "left")
    if status:
        rows = rows.filter(F.col("resolution_status") == status)
    if kind:
        rows = rows.filter(F.col("dependency_type") == kind)
    return rows.filter(contains_text(search, "source_path", "target_path", "target_module")) if search else rows


def duplicates(rows: DataFrame, repositories: DataFrame | None = None, clone_type: str | None = None) -> DataFrame:
    """Clone pairs with links to the lines, longest first."""
    if clone_type:
        rows = rows.filter(F.col("clone_type") == clone_type)
    if repositories is not None:
        link = lambda s: F.format_string("%s/blob/%s/%s#L%d-L%d", F.regexp_replace("url", "/+$", ""), "commit_hash", f"{s}_file_path", f"{s}_start_line", f"{s}_end_line")
        rows = rows.join(repositories, "analysis_id", "left").withColumns({"source_url": link("source"), "target_url": link("target")})
    return rows


DUPLICATE_ORDER = [("line_count", False), ("source_file_path", True), ("source_start_line", True), ("target_file_path", True), ("target_start_line", True), ("id", True)]


def active_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter(~F.col("status").isin("completed", "failed", "cancelled"))


def stale_jobs(jobs: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Unfinished jobs without an update for ``minutes`` (or ever)."""
    old = F.col("updated_at").isNull() | (F.col("updated_at") <= now - F.expr(f"interval {int(minutes)} minutes"))
    return active_jobs(jobs).filter(old)


def recovered(jobs: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """All jobs, the stale ones failed."""
    old = F.col("updated_at").isNull() | (F.col("updated_at") <= now - F.expr(f"interval {int(minutes)} minutes"))
    stale = old & ~F.col("status").isin("completed", "failed", "cancelled")
    return jobs.withColumns({"status": F.when(stale, "failed").otherwise(F.col("status")), "error_message": F.when(stale, "no progress for too long").otherwise(F.col("error_message"))})


def cancelled(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Jobs after cancel requests (id): finished ones refuse, waiting ones are cancelled now, running ones are asked to stop."""
    asked = jobs.join(requests.select("id").distinct().withColumn("asked", F.lit(True)), "id", "left")
    s = F.col("status")
    outcome = F.when(F.col("asked").isNull(), None).when(s.isin("completed", "failed"), "conflict").when(s == "cancelled", "already cancelled").when(s == "queued", "cancelled").otherwise("requested")
    new = F.when(F.col("asked").isNotNull() & (s == "queued"), "cancelled").when(F.col("asked").isNotNull() & ~s.isin("completed", "failed", "cancelled"), "cancellation_requested").otherwise(s)
    return asked.withColumns({"outcome": outcome, "new_status": new}).drop("asked")


def upsert_repositories(existing: DataFrame, submitted: DataFrame) -> DataFrame:
    """Known repositories and, of the submitted ones, those with a new url; one row per url."""
    fresh = submitted.dropDuplicates(["url"]).join(existing.select("url"), "url", "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def admits(jobs: DataFrame, limit: int = 2) -> bool:
    """Whether another job may start."""
    return active_jobs(jobs).limit(limit).count() < limit
