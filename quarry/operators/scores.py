"""Score formulas: hotspots, churn, defects, maintainability and health. All are expressions inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def complexity_risk(sloc: Column, max_cc: Column, max_nesting: Column) -> Column:
    return F.round(clamp(sloc / 1000.0 * 40.0 + max_cc / 20.0 * 40.0 + max_nesting / 5.0 * 20.0), 1)


def centrality(fan_in: Column, fan_out: Column) -> Column:
    return F.round(clamp(fan_in / 10.0 * 60.0 + fan_out / 10.0 * 40.0), 1)


def severity_burden(blocker: Column, critical: Column, major: Column, minor: Column) -> Column:
    return F.round(clamp(blocker * 40.0 + critical * 25.0 + major * 10.0 + minor * 2.0), 1)


def hotspot_score(risk: Column, central: Column, burden: Column) -> Column:
    return F.round(risk * 0.40 + central * 0.35 + burden * 0.25, 1)


def churn_score(commits: Column, lines: Column, authors: Column) -> Column:
    return F.round(clamp(commits / 20.0 * 50.0 + lines / 1000.0 * 30.0 + authors / 5.0 * 20.0), 1)


def defect_score(hotspot: Column, churn: Column, has_history: Column) -> Column:
    """A file without history of its own counts churn 0 where the analysis has any history."""
    return F.when(has_history, F.round(hotspot * 0.6 + F.coalesce(churn, F.lit(0.0)) * 0.4, 1)).otherwise(hotspot)


def maintainability_index(mean_loc: Column, mean_cc: Column, lines: Column, comments: Column) -> Column:
    n = F.greatest(F.lit(1), lines)
    raw = F.lit(171.0) - F.lit(5.2) * F.ln(F.greatest(F.lit(1.0), mean_loc)) - mean_cc * 0.23 - F.lit(16.2) * F.ln(n) + comments / n * 50.0
    return F.round(clamp(raw * 100.0 / 171.0), 2)


def grade(score: Column) -> Column:
    out = F.when(score >= 95, "A+")
    for least, letter in ((90, "A"), (80, "B"), (70, "C"), (60, "D")):
        out = out.when(score >= least, letter)
    return out.otherwise("F")


def rank_hotspots(files: DataFrame, group: str, limit: int = 10) -> DataFrame:
    """Scores and rank of the files with the highest ones, per group. Needs sloc, max_cyclomatic_complexity,
    max_nesting_depth, fan_in, fan_out and the four severity counts; missing figures count 0."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    scored = files.withColumns(
        {
            "complexity_risk": complexity_risk(z("sloc"), z("max_cyclomatic_complexity"), z("max_nesting_depth")),
            "architectural_centrality": centrality(z("fan_in"), z("fan_out")),
            "issue_severity_burden": severity_burden(z("blocker_count"), z("critical_count"), z("major_count"), z("minor_count")),
        }
    ).withColumn("hotspot_score", hotspot_score(F.col("complexity_risk"), F.col("architectural_centrality"), F.col("issue_severity_burden")))
    order = [F.desc("hotspot_score"), F.desc("architectural_centrality"), F.desc("complexity_risk"), F.desc("issue_severity_burden"), F.asc("file_path")]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= limit)


SEVERITIES = ("blocker", "critical", "major", "minor", "info")


def repeats(issues: DataFrame) -> Column:
    """How many issues a row stands for."""
    return F.col("repeats") if "repeats" in issues.columns else F.lit(1)


def severity_rank(c: Column) -> Column:
    out = F.when(c == SEVERITIES[0], 0)
    for i, s in enumerate(SEVERITIES[1:], 1):
        out = out.when(c == s, i)
    return out.otherwise(len(SEVERITIES))


def maintainability_score(mean_mi: Column, documented: Column, public: Column, poor_files: Column, files: Column) -> Column:
    doc = F.when(public > 0, documented / public).otherwise(1.0)
    return F.when(files > 0, F.round(clamp(mean_mi * 0.70 + doc * 100.0 * 0.30 - poor_files / files * 25.0), 1)).otherwise(100.0)


def complexity_score(functions: Column, mild: Column, high: Column, critical: Column, max_cc: Column, max_nesting: Column) -> Column:
    share = (mild * 10.0 + high * 35.0 + critical * 60.0) / functions
    extra = F.least(F.lit(15.0), F.greatest(F.lit(0.0), max_cc - 15) * 0.5) + F.least(F.lit(10.0), F.greatest(F.lit(0.0), max_nesting - 4) * 2.0)
    return F.when(functions > 0, F.round(clamp(F.lit(100.0) - share - extra), 1)).otherwise(100.0)


def architecture_score(files: Column, cycles: Column, cyclic_files: Column, god_modules: Column, hubs: Column, unstable: Column) -> Column:
    loss = F.least(F.lit(45.0), cycles * 12.0 + cyclic_files / files * 25.0) + F.least(F.lit(30.0), god_modules * 6.0 + hubs * 8.0) + F.least(F.lit(15.0), unstable * 3.0)
    return F.when(files > 1, F.round(clamp(F.lit(100.0) - loss), 1)).otherwise(100.0)


def hygiene_score(blocker: Column, critical: Column, major: Column, minor: Column, sloc: Column) -> Column:
    weight = blocker * 25.0 + critical * 12.0 + major * 5.0 + minor * 1.5
    return F.round(clamp(F.lit(100.0) - F.least(F.lit(100.0), weight / F.greatest(F.lit(1.0), F.sqrt(sloc / 1000.0)))), 1)


def duplication_score(ratio: Column, blocks: Column) -> Column:
    return F.round(clamp(F.lit(100.0) - ratio * 1.5 - F.least(F.lit(10.0), blocks * 0.5)), 1)


def overall_score(maintainability: Column, complexity: Column, architecture: Column, hygiene: Column, duplication: Column) -> Column:
    return F.round(clamp((maintainability + complexity + architecture + hygiene) * 0.22 + duplication * 0.12), 1)


def debt_ratio(minutes: Column, sloc: Column) -> Column:
    return F.round(minutes / 60.0 / F.greatest(F.lit(0.1), sloc / 1000.0), 1)
