"""Quality gate, comparison of two runs and its verdict, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import blank_to_null, strip

#: Threshold and whether a miss fails the gate or warns.
CONDITIONS = {
    "overall_score": (80.0, "fail"), "blocker_issues": (0.0, "fail"), "circular_dependencies": (0.0, "fail"),
    "critical_issues": (2.0, "warn"), "average_maintainability": (55.0, "warn"), "critical_functions": (3.0, "warn"),
}
AT_LEAST = ("overall_score", "average_maintainability")


def quality_gate(figures: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """``figures`` (one row per run, a column per condition) with conditions (array of structs), status and passed."""
    unknown = set(thresholds or {}) - set(CONDITIONS)
    if unknown:
        raise ValueError(f"unknown conditions: {sorted(unknown)}")
    rows = []
    for name, (default, level) in CONDITIONS.items():
        limit = float((thresholds or {}).get(name, default))
        value = F.coalesce(F.col(name).cast("double"), F.lit(100.0 if name in AT_LEAST else 0.0))
        ok = value >= limit if name in AT_LEAST else value <= limit
        rows.append(F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(limit).alias("threshold"), F.lit(level).alias("level"), ok.alias("ok")))
    out = figures.withColumn("conditions", F.array(*rows))
    failed = F.exists("conditions", lambda c: ~c["ok"] & (c["level"] == "fail"))
    warned = F.exists("conditions", lambda c: ~c["ok"] & (c["level"] == "warn"))
    return out.withColumn("status", F.when(failed, "FAILED").when(warned, "WARNING").otherwise("PASSED")).withColumn("passed", F.col("status") != "FAILED")


def fingerprint(rule: Column, path: Column, symbol: Column, metadata: Column) -> Column:
    """SHA-256 over rule, path and scope; null parts are empty.

    The scope is the symbol, or the target named in the metadata, or the place of the other copy named there, or ``file``.
    """
    said = lambda k: F.get_json_object(metadata, f"$.{k}")
    copy = F.concat_ws("_", F.lit("dup"), said("target_file_path"), *[F.coalesce(said(k), F.lit("None")) for k in ("target_start_line", "target_end_line")])
    scope = F.coalesce(blank_to_null(strip(symbol)), F.when(said("target_identifier") != "", strip(said("target_identifier"))), F.when(said("target_file_path") != "", copy), F.lit("file"))
    place = strip(F.regexp_replace(F.translate(F.coalesce(path, F.lit("")), "\\", "/"), r"^[./]+", ""))
    return F.sha2(F.concat(strip(F.coalesce(rule, F.lit(""))), F.lit(":"), place, F.lit(":"), scope), 256)


def issue_lifecycle(base: DataFrame, head: DataFrame, key: str = "fingerprint") -> DataFrame:
    """key and lifecycle: new, fixed or persistent; each key once."""
    b, h = base.select(key).distinct().withColumn("in_base", F.lit(True)), head.select(key).distinct().withColumn("in_head", F.lit(True))
    state = F.when(F.col("in_base").isNull(), "new").when(F.col("in_head").isNull(), "fixed").otherwise("persistent")
    return b.join(h, key, "full").select(key, state.alias("lifecycle"))


def canonical_cycle(nodes: Column) -> Column:
    """A closed walk without its repeated end, rotated so that its least node comes first."""
    open_ = F.when((F.size(nodes) > 1) & (F.get(nodes, F.lit(0)) == F.element_at(nodes, -1)), F.slice(nodes, F.lit(1), F.size(nodes) - 1)).otherwise(nodes)
    at = F.array_position(open_, F.array_min(open_)).cast("int")
    return F.when(F.size(open_) > 0, F.concat(F.slice(open_, at, F.size(open_)), F.slice(open_, F.lit(1), at - 1))).otherwise(open_)


def cycle_lifecycle(base: DataFrame, head: DataFrame, nodes: str = "nodes") -> DataFrame:
    one = lambda d: d.select(canonical_cycle(F.col(nodes)).alias("cycle"))
    return issue_lifecycle(one(base), one(head), "cycle")


def lifecycle_of_pairs(pairs: DataFrame, rows: DataFrame, group: str, key: str) -> DataFrame:
    """head_id, ``key``, lifecycle for all pairs of runs (head_id, base_id) in one full join."""
    r = rows.select(group, key).distinct()
    head = r.join(pairs, F.col(group) == F.col("head_id")).select("head_id", key, F.lit(True).alias("in_head"))
    base = r.join(pairs, F.col(group) == F.col("base_id")).select("head_id", key, F.lit(True).alias("in_base"))
    state = F.when(F.col("in_base").isNull(), "new").when(F.col("in_head").isNull(), "fixed").otherwise("persistent")
    return base.join(head, ["head_id", key], "full").select("head_id", key, state.alias("lifecycle"))


def score_deltas(pairs: DataFrame, scores: DataFrame, columns: dict[str, str]) -> DataFrame:
    """head_id, base_id and, per name in ``columns``, head minus base rounded to one decimal; a run without scores counts
    100 of a score and 0 of minutes."""
    missing = lambda c: F.lit(0 if c.endswith("minutes") else 100.0)
    side = lambda s: scores.select(F.col("analysis_id").alias(f"{s}_id"), *[F.col(c).alias(f"{s}_{c}") for c in columns.values()])
    both = pairs.select("head_id", "base_id").join(side("head"), "head_id", "left").join(side("base"), "base_id", "left")
    delta = lambda c: F.coalesce(f"head_{c}", missing(c)) - F.coalesce(f"base_{c}", missing(c))
    return both.select("head_id", "base_id", *[(delta(c) if c.endswith("minutes") else F.round(delta(c), 1)).alias(n) for n, c in columns.items()])


def comparable(pairs: DataFrame, jobs: DataFrame) -> DataFrame:
    """``pairs`` (head_id, base_id) with error: why the two are not compared, null where they are."""
    side = lambda s: jobs.select(F.col("id").alias(f"{s}_id"), F.col("repository_id").alias(f"{s}_repository"), F.col("status").alias(f"{s}_status"))
    both = pairs.join(side("head"), "head_id", "left").join(side("base"), "base_id", "left")
    error = (
        F.when(F.col("head_id") == F.col("base_id"), "same run").when(F.col("base_status").isNull(), "no base run").when(F.col("head_status").isNull(), "no head run")
        .when(F.col("base_status") != "completed", "base run not completed").when(F.col("head_status") != "completed", "head run not completed").when(F.col("head_repository") != F.col("base_repository"), "other repository")
    )
    return both.withColumn("error", error)


def merge_verdict(rows: DataFrame) -> DataFrame:
    """Needs score_delta, new_blockers, new_criticals, new_cycles: adds status and reasons."""
    d = F.col("score_delta")
    failures = F.filter(F.array(F.when(F.col("new_blockers") > 0, "new blocker issues"), F.when(F.col("new_cycles") > 0, "new circular dependencies"), F.when(d < -2.0, "score fell by more than 2")), lambda x: x.isNotNull())
    warnings = F.filter(F.array(F.when(F.col("new_criticals") > 0, "new critical issues"), F.when((d >= -2.0) & (d < 0), "score fell")), lambda x: x.isNotNull())
    out = rows.withColumn("reasons", F.concat(failures, warnings))
    return out.withColumn("status", F.when(F.size(failures) > 0, "FAILED").when(F.size(warnings) > 0, "WARNING").otherwise("PASSED"))


def check_comparable(jobs: DataFrame, base_id: str, head_id: str) -> None:
    """Raise unless both are different, known, completed runs of one repository."""
    if base_id == head_id:
        raise ValueError("a run is not compared with itself")
    rows = {r["id"]: r for r in jobs.filter(F.col("id").isin(base_id, head_id)).select("id", "repository_id", "status").limit(3).collect()}
    for i in (base_id, head_id):
        if i not in rows:
            raise LookupError(f"no run {i}")
        if rows[i]["status"] != "completed":
            raise ValueError(f"run {i} is not completed")
    if rows[base_id]["repository_id"] != rows[head_id]["repository_id"]:
        raise ValueError("runs of different repositories")


def timeline(jobs: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Completed runs of each repository in order of commit date (unknown last), then creation; position and score deltas."""
    done = jobs.filter(F.col("status") == "completed")
    if scores is not None:
        done = done.join(scores.select(F.col("analysis_id").alias("id"), "overall_score"), "id", "left")
        done = done.withColumn("overall_score", F.coalesce("overall_score", F.lit(100.0)))
    w = Window.partitionBy("repository_id").orderBy(F.col("commit_date").asc_nulls_last(), F.col("created_at").asc_nulls_last(), F.col("id"))
    out = done.withColumn("position", F.row_number().over(w))
    if scores is not None:
        out = out.withColumns({"delta": F.round(F.col("overall_score") - F.lag("overall_score").over(w), 1), "since_first": F.round(F.col("overall_score") - F.first("overall_score").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), 1)})
    return out
