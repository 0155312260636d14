"""Reports: SARIF, Markdown and JSON, one row per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.rules import RULES
from quarry.operators.scores import repeats


def report_path(path: Column) -> Column:
    """A path relative to the repository: no scheme, drive, temporary folder or slash in front."""
    p = F.regexp_replace(path, r"^file:/+", "/")
    p = F.translate(p, "\\", "/")
    p = F.regexp_replace(p, r"^[A-Za-z]:/", "/")
    p = F.regexp_replace(p, r"^/(?:tmp|var/tmp|private/tmp)/[^/]+/", "")
    return F.regexp_replace(p, r"^/+", "")


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("blocker", "critical"), "error").when(severity == "major", "warning").otherwise("note")


def sarif(issues: DataFrame, group: str) -> DataFrame:
    """group, sarif: a SARIF 2.1.0 document. Results are ordered by path, line and rule; every known rule is declared.

    A document holds all issues of its run, so its size is that of one run's issues.
    """
    path = report_path(F.coalesce("file_path", F.lit("")))
    region = F.when(F.col("line_number") >= 1, F.struct(F.col("line_number").alias("startLine"), F.when(F.col("end_line_number") >= F.col("line_number"), F.col("end_line_number")).alias("endLine")))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.struct(F.col("title").alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(path.alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))).alias("locations"),
    )
    keyed = issues.select(group, "rule_id", F.struct(path.alias("p"), F.coalesce("line_number", F.lit(0)).alias("l"), F.col("rule_id").alias("r"), result.alias("result")).alias("k"))
    per = keyed.groupBy(group).agg(F.transform(F.array_sort(F.collect_list("k")), lambda x: x["result"]).alias("results"), F.collect_set("rule_id").alias("seen"))
    rules = F.transform(F.array_sort(F.array_distinct(F.concat(F.array(*[F.lit(r) for r in RULES]), "seen"))), lambda r: F.struct(r.alias("id")))
    driver = F.struct(F.struct(F.lit("quarry").alias("name"), rules.alias("rules")).alias("driver"))
    return per.select(group, F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct(driver.alias("tool"), F.col("results"))).alias("runs"))).alias("sarif"))


def sarif_rows(issues: DataFrame, group: str) -> DataFrame:
    """The results of the documents as rows; line 0 where a result names none."""
    return issues.select(group, "id", F.col("rule_id").alias("rule"), sarif_level(F.col("severity")).alias("level"), report_path(F.coalesce("file_path", F.lit(""))).alias("uri"), F.when(F.col("line_number") >= 1, F.col("line_number")).otherwise(0).alias("start_line"))


def _table(head: str, lines: Column) -> Column:
    n = head.count("|") - 1
    return F.concat(F.lit(head + "\n|" + "---|" * n + "\n"), F.array_join(lines, "\n"), F.lit("\n"))


def markdown(scored: DataFrame, hotspots: DataFrame, issues: DataFrame, recommended: DataFrame, gates: DataFrame, group: str) -> DataFrame:
    """group, report: score, gate, pillars, issue counts, highest hotspots, recommendations."""
    top = hotspots.filter("rank <= 5").groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.format_string("| %d | %s | %.1f |", "rank", "file_path", "hotspot_score").alias("s")))), lambda x: x["s"]).alias("hot"))
    advice = recommended.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.format_string("| %d | %s | %s | %d |", F.col("rank"), F.col("target"), F.coalesce(F.col("gain").cast("string"), F.lit("-")), F.col("effort")).alias("s")))), lambda x: x["s"]).alias("advice"))
    counts = issues.groupBy(group, "severity").agg(F.sum(repeats(issues)).alias("count")).groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("severity", "count"))), lambda x: F.concat(F.lit("| "), x["severity"], F.lit(" | "), x["count"].cast("string"), F.lit(" |"))).alias("counts"))
    rows = scored.join(gates.select(group, "status"), group, "left").join(top, group, "left").join(advice, group, "left").join(counts, group, "left")
    pillar = F.array(*[F.format_string(f"| {n} | %.1f | {w.replace("%", "%%")} |", f"{n}_score") for n, w in (("maintainability", "22 %"), ("complexity", "22 %"), ("architecture", "22 %"), ("hygiene", "22 %"), ("duplication", "12 %"))])
    empty = F.array().cast("array<string>")
    z = lambda c: F.coalesce(F.col(c), empty)
    report = F.concat_ws(
        "\n", F.concat(F.lit("# Code health of "), F.col(group)), F.format_string("Score %.1f (%s), gate %s\n", F.col("overall_score"), F.col("grade"), F.coalesce("status", F.lit("-"))),
        F.lit("## Pillars"), _table("| pillar | score | weight |", pillar), F.lit("## Issues"), _table("| severity | count |", z("counts")), F.lit("## Hotspots"), _table("| rank | file | score |", z("hot")),
        F.lit("## Recommendations"), _table("| rank | target | gain | minutes |", z("advice")),
    )
    return rows.select(group, report.alias("report"))


def json_payload(scored: DataFrame, hotspots: DataFrame, recommended: DataFrame, gates: DataFrame, issues: DataFrame, group: str) -> DataFrame:
    """group, payload: everything about a run in one JSON document."""
    pick = lambda d, cols, name: d.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    hot = pick(hotspots, ["rank", "file_path", "hotspot_score"], "hotspots")
    advice = pick(recommended, ["rank", "target", "gain", "effort"], "recommendations")
    by = issues.groupBy(group).agg(F.sum(repeats(issues)).alias("total"), F.sum(F.col("remediation_effort_minutes") * repeats(issues)).alias("minutes"))
    rows = scored.join(gates.select(group, "status", "conditions"), group, "left").join(hot, group, "left").join(advice, group, "left").join(by, group, "left")
    health = F.struct("overall_score", "grade", "maintainability_score", "complexity_score", "architecture_score", "hygiene_score", "duplication_score", "debt_ratio")
    body = F.struct(F.lit("1.0").alias("schema_version"), F.col(group), health.alias("health"), F.struct("status", "conditions").alias("quality_gate"), "hotspots", "recommendations", F.struct("total", "minutes").alias("issues"))
    return rows.select(group, F.to_json(body).alias("payload"))


#: What a log line must not show.
SENSITIVE = (
    (r"(?i)(https?://)[^/\s:@]+:[^/\s@]+@", "$1***:***@"), (r"(?i)\b(token|password|secret|api[_-]?key|authorization)(\s*[=:]\s*)(?:bearer\s+)?[^\s,;\"']+", "$1$2***"), (r"\b(?:ghp|gho|ghs)_[A-Za-z0-9]{20,}\b|\bgithub_pat_[A-Za-z0-9_]{20,}\b", "***"),
)


def redact(text: Column) -> Column:
    for pattern, replacement in SENSITIVE:
        text = F.regexp_replace(text, pattern, replacement)
    return text
