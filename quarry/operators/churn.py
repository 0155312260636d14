"""Change history per file, from rows of (commit, author, path, added, deleted) or from raw log text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.scores import churn_score


def parse_numstat(logs: DataFrame, group: str, log: str) -> DataFrame:
    """Rows of a log written with NUL separators: markers ``COMMIT``, hash, author; then added, deleted and path by tabs.

    Binary files (``-``) count 0 lines. A rename has an empty path followed by the old and the new one; the new counts.
    Inside Catalyst: pieces are numbered, and each line's commit is the last marker before it.
    """
    w = Window.partitionBy(group).orderBy("i")
    piece = logs.select(group, F.posexplode(F.split(F.col(log), "\u0000")).alias("i", "piece"))
    mark = F.trim(F.col("piece")) == "COMMIT"
    one = piece.withColumns({"p1": F.lag("piece", 1).over(w), "p2": F.lag("piece", 2).over(w), "n1": F.lead("piece", 1).over(w), "n2": F.lead("piece", 2).over(w)})
    line = F.ltrim(F.col("piece"), F.lit("\n"))
    stat = F.regexp_extract(line, r"^(\d+|-)\t(\d+|-)\t", 0)
    tagged = one.withColumns(
        {
            "commit": F.last(F.when(mark, F.col("n1")), ignorenulls=True).over(w),
            "author": F.last(F.when(mark, F.col("n2")), ignorenulls=True).over(w),
            "parts": F.split(line, "\t", 3),
            "is_stat": (stat != "") & (F.trim(F.coalesce("p1", F.lit(""))) != "COMMIT") & (F.trim(F.coalesce("p2", F.lit(""))) != "COMMIT"),
        }
    ).filter("is_stat")
    path = F.when(F.get("parts", F.lit(2)) == "", F.col("n2")).otherwise(F.get("parts", F.lit(2)))
    number = lambda i: F.coalesce(F.expr(f"try_cast(parts[{i}] as int)"), F.lit(0))
    return tagged.select(group, "commit", "author", log_path(path).alias("path"), number(0).alias("added"), number(1).alias("deleted")).filter("path <> ''")


def log_path(path: Column) -> Column:
    """Slashes, and no dots or slashes in front: the log's spelling of a path."""
    return F.ltrim(F.translate(path, "\\", "/"), F.lit("./"))


def churn_summary(by_file: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """Files with changes, max_churn and has_git_history of every group in ``groups``; without changes 0, 0.0 and false."""
    per = by_file.groupBy(group).agg(F.count("*").alias("files"), F.max("churn_score").alias("max_churn"))
    out = groups.select(group).distinct().join(per, group, "left")
    return out.select(group, F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("max_churn", F.lit(0.0)).alias("max_churn"), F.col("files").isNotNull().alias("has_git_history"))


def with_history(rows: DataFrame, by_file: DataFrame, group: str) -> DataFrame:
    """``rows`` with has_git_history of their group."""
    return rows.join(churn_summary(by_file, rows, group).select(group, "has_git_history"), group)


def churn_by_file(rows: DataFrame, group: str | None = None) -> DataFrame:
    """Commits, authors, lines and churn score per path (and group)."""
    keys = [*([group] if group else []), "path"]
    out = rows.groupBy(*keys).agg(
        F.count_distinct("commit").alias("commit_count"), F.greatest(F.lit(1), F.count_distinct("author")).alias("author_count"), F.sum("added").cast("long").alias("insertions"), F.sum("deleted").cast("long").alias("deletions")
    )
    return out.withColumn("churn_score", churn_score(F.col("commit_count"), F.col("insertions") + F.col("deletions"), F.col("author_count")))
