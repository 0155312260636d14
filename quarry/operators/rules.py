"""Diagnostic rules. Each is a filter or join that yields issue rows; ``run_rules`` unites and orders them."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.gates import fingerprint
from quarry.operators.scores import severity_rank
from quarry.parse.files import SECRETS, SINKS


log = logging.getLogger(__name__)


@dataclass
class Inputs:
    """What rules read; any may be missing, then the rules that need it yield nothing. ``group`` names the run's column."""

    group: str
    metrics: DataFrame | None = None  # path, sloc, maintainability_score, ...
    functions: DataFrame | None = None  # path, name, start_line, end_line and figures
    symbols: DataFrame | None = None
    degrees: DataFrame | None = None  # node, fan_in, fan_out, instability
    edges: DataFrame | None = None  # src, dst, line_number
    cycles: DataFrame | None = None  # cycle_id, length, nodes
    clones: DataFrame | None = None
    handlers: DataFrame | None = None
    hits: DataFrame | None = None  # path, name of the pattern, line_number


COLUMNS = ("file_path", "rule_id", "category", "severity", "line_number", "end_line_number", "symbol_name", "title", "remediation_effort_minutes", "target_type", "target_identifier")


def _issues(df: DataFrame, group: str, rule: str, category: str, severity: str | Column, minutes: int | Column, title: Column, path: Column, target: Column | None = None, kind: str = "file", line: Column | None = None, end: Column | None = None, symbol: Column | None = None, more: tuple = ()) -> DataFrame:
    nothing = F.lit(None)
    values = {
        "file_path": path, "rule_id": F.lit(rule), "category": F.lit(category), "severity": F.lit(severity) if isinstance(severity, str) else severity, "line_number": (nothing if line is None else line).cast("int"),
        "end_line_number": (nothing if end is None else end).cast("int"), "symbol_name": (nothing if symbol is None else symbol).cast("string"), "title": title, "remediation_effort_minutes": (F.lit(minutes) if isinstance(minutes, int) else minutes).cast("int"),
        "target_type": F.lit(kind), "target_identifier": path if target is None else target,
    }
    return df.select(group, *[values[c].alias(c) for c in COLUMNS], *more)


def _function_rule(rule: str, severity: str, minutes: int, label: str, test: Callable[[], Column], figure: str) -> Callable[[Inputs], DataFrame]:
    def run(x: Inputs) -> DataFrame:
        c = F.col
        return _issues(x.functions.filter(test()), x.group, rule, "complexity", severity, minutes, F.format_string(f"{label}: %s (%d)", c("name"), c(figure)), c("path"), F.concat_ws("::", "path", "name"), "symbol", c("start_line"), c("end_line"), c("name"))

    return run


def _file_rule(rule: str, category: str, severity: str, minutes: int, label: str, test: Callable[[], Column]) -> Callable[[Inputs], DataFrame]:
    return lambda x: _issues(x.metrics.filter(test()), x.group, rule, category, severity, minutes, F.concat(F.lit(f"{label}: "), "path"), F.col("path"))


def arch_cycle(x: Inputs) -> DataFrame:
    first = F.get("nodes", F.lit(0))
    walk = F.array_join(F.concat("nodes", F.array(first)), " -> ")
    return _cycle_issues(x.cycles, x.group, F.concat(F.lit("Import cycle: "), walk), first)


def _cycle_issues(cycles: DataFrame, group: str, title: Column, first: Column, kind: str = "cycle", more: tuple = ()) -> DataFrame:
    return _issues(cycles, group, "ARCH-001", "architecture", "critical", 120, title, first, F.concat(F.lit("cycle::"), F.col("cycle_id").cast("string")), kind, more=more)


def counted_cycles(counts: DataFrame, group: str) -> DataFrame:
    """ARCH-001 from ``cycle_counts``, with ``repeats``: a row per cycle with an id, and one of type ``cycles`` per file for all others that begin there."""
    rows = lambda test, kind: _cycle_issues(counts.filter(test), group, F.lit("Import cycle"), F.col("node"), kind, (F.col("cycles").alias("repeats"),))
    return rows("cycle_id is not null", "cycle").unionByName(rows("cycle_id is null", "cycles"))


def arch_god_module(x: Inputs) -> DataFrame:
    both = x.metrics.join(x.degrees.withColumnRenamed("node", "path"), [x.group, "path"]).filter("fan_out >= 12 and sloc >= 500")
    return _issues(both, x.group, "ARCH-002", "architecture", "major", 90, F.format_string("Module does too much: %s (fan-out %d, %d lines)", "path", "fan_out", "sloc"), F.col("path"))


def arch_hub(x: Inputs) -> DataFrame:
    return _issues(x.degrees.filter("fan_in >= 8 and fan_out >= 8"), x.group, "ARCH-003", "architecture", "major", 90, F.format_string("Hub: %s (in %d, out %d)", "node", "fan_in", "fan_out"), F.col("node"))


def arch_unstable(x: Inputs) -> DataFrame:
    src = x.degrees.filter("instability < 0.25 and fan_in >= 5").select(x.group, F.col("node").alias("src"))
    dst = x.degrees.filter("instability > 0.75").select(x.group, F.col("node").alias("dst"))
    hit = x.edges.groupBy(x.group, "src", "dst").agg(F.min("line_number").alias("line_number")).join(src, [x.group, "src"], "left_semi").join(dst, [x.group, "dst"], "left_semi")
    return _issues(hit, x.group, "ARCH-004", "architecture", "minor", 45, F.concat_ws(" -> ", F.concat(F.lit("Stable file relies on a volatile one: "), "src"), "dst"), F.col("src"), line=F.col("line_number"))


def undocumented(x: Inputs) -> DataFrame:
    c = F.col
    hit = x.symbols.filter(c("symbol_type").isin("function", "class") & ~c("name").startswith("_") & ~F.coalesce("has_docstring", F.lit(False)))
    return _issues(hit, x.group, "MAINT-003", "maintainability", "minor", 15, F.format_string("No documentation: %s %s", "symbol_type", "name"), c("path"), F.concat_ws("::", "path", "name"), "symbol", c("start_line"), c("end_line"), c("name"))


def duplicate_block(x: Inputs) -> DataFrame:
    c, n = F.col, F.col("line_count")
    severity = F.when(n >= 50, "critical").when(n >= 15, "major").otherwise("minor")
    target = F.format_string("%s:%d-%d", c("source_file_path"), c("source_start_line"), c("source_end_line"))
    return _issues(x.clones.filter(n >= 10), x.group, "DUP-001", "maintainability", severity, n * 2, F.format_string("%d lines repeated in %s", n, c("target_file_path")), c("source_file_path"), target, "code_block", c("source_start_line"), c("source_end_line"))


def empty_handler(x: Inputs) -> DataFrame:
    return _issues(x.handlers, x.group, "HYGIENE-001", "hygiene", "major", 30, F.concat(F.lit("Error swallowed: "), "exception_type"), F.col("path"), line=F.col("line_number"))


def unused_private(x: Inputs) -> DataFrame:
    c = F.col
    rows = x.symbols.filter("mentions <= 1").join(x.metrics.filter("sloc >= 50").select(x.group, "path"), [x.group, "path"], "left_semi")
    return _issues(rows, x.group, "HYGIENE-002", "hygiene", "minor", 20, F.concat(F.lit("Private and never used: "), "name"), c("path"), F.concat_ws("::", "path", "name"), "symbol", c("start_line"), c("end_line"), c("name"))


def _found(x: Inputs, rule: str, names: tuple[str, ...], label: str) -> DataFrame:
    rows = x.hits.filter(F.col("name").isin(*names))
    return _issues(rows, x.group, rule, "security", "blocker", 60, F.concat(F.lit(label), "name"), F.col("path"), line=F.col("line_number"))


def secrets(x: Inputs) -> DataFrame:
    return _found(x, "SEC-001", tuple(SECRETS), "Credential in the source: ")


def code_sinks(x: Inputs) -> DataFrame:
    return _found(x, "SEC-002", tuple(SINKS), "Text run as code: ")


#: rule -> (function, inputs it needs)
RULES: dict[str, tuple[Callable[[Inputs], DataFrame], tuple[str, ...]]] = {
    "ARCH-001": (arch_cycle, ("cycles",)), "ARCH-002": (arch_god_module, ("metrics", "degrees")), "ARCH-003": (arch_hub, ("degrees",)), "ARCH-004": (arch_unstable, ("degrees", "edges")),
    "COMPLEX-001": (_function_rule("COMPLEX-001", "critical", 90, "Critical complexity", lambda: F.col("cyclomatic_complexity") >= 20, "cyclomatic_complexity"), ("functions",)),
    "COMPLEX-002": (_function_rule("COMPLEX-002", "major", 45, "High complexity", lambda: F.col("cyclomatic_complexity").between(11, 19), "cyclomatic_complexity"), ("functions",)),
    "COMPLEX-003": (_function_rule("COMPLEX-003", "major", 45, "Deep nesting", lambda: F.col("nesting_depth") >= 5, "nesting_depth"), ("functions",)),
    "COMPLEX-004": (_file_rule("COMPLEX-004", "complexity", "major", 60, "Giant file", lambda: F.col("sloc") >= 800), ("metrics",)),
    "COMPLEX-005": (_function_rule("COMPLEX-005", "minor", 30, "Many parameters", lambda: F.col("parameter_count") >= 6, "parameter_count"), ("functions",)),
    "MAINT-001": (_file_rule("MAINT-001", "maintainability", "critical", 90, "Very hard to maintain", lambda: F.col("maintainability_score") < 40), ("metrics",)),
    "MAINT-002": (_file_rule("MAINT-002", "maintainability", "major", 45, "Hard to maintain", lambda: (F.col("maintainability_score") >= 40) & (F.col("maintainability_score") < 55)), ("metrics",)),
    "MAINT-003": (undocumented, ("symbols",)), "DUP-001": (duplicate_block, ("clones",)), "HYGIENE-001": (empty_handler, ("handlers",)), "HYGIENE-002": (unused_private, ("symbols", "metrics")),
    "SEC-001": (secrets, ("hits",)), "SEC-002": (code_sinks, ("hits",)),
}


def run_rules(x: Inputs, rules: dict | None = None, on_error: Callable[[str, Exception], None] | None = None) -> DataFrame | None:
    """All rules whose inputs are given, with severity rank and fingerprint.

    A rule whose plan cannot be built is left out; it is logged with its error, and given to ``on_error``.
    """
    parts = []
    for name, (rule, needs) in (rules or RULES).items():
        if all(getattr(x, n) is not None for n in needs):
            try:
                parts.append(rule(x))
            except Exception as e:  # noqa: BLE001 - one faulty rule must not stop the others
                log.error("rule %s is left out: %s", name, e)
                if on_error:
                    on_error(name, e)
    if not parts:
        return None
    out = reduce(DataFrame.unionByName, parts)
    target = F.to_json(F.struct("target_identifier"))
    return out.withColumns({"severity_rank": severity_rank(F.col("severity")), "fingerprint": fingerprint(F.col("rule_id"), F.col("file_path"), F.coalesce("symbol_name", F.lit("")), target)})


def ordered(issues: DataFrame) -> DataFrame:
    return issues.orderBy("severity_rank", F.coalesce("file_path", F.lit("")), F.coalesce("line_number", F.lit(0)), "rule_id")
