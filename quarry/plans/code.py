"""Queries over the contents of source files: parsed once per query, everything else follows from that."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import clones, cycle_counts, dependencies, exports, gates, graph, health, metrics, rules
from quarry.operators import scores as S
from quarry.parse.files import explode_parts, parse_files
from quarry.plans.tables import all_files, without_superseded
from quarry.scratch import Scratch

G = "analysis_id"


def stored_tokens(spark: SparkSession, d: str, scratch: Scratch) -> DataFrame:
    rows = clones.token_table(all_files(spark, d), G, "path", "content", ["id", "created_at"])
    return scratch.write(rows.withColumn("rid", F.monotonically_increasing_id()))


class Code:
    """Parsed files of all runs, written once; its parts as rows."""

    def __init__(self, spark: SparkSession, d: str) -> None:
        self.spark, self.d = spark, d
        self.scratch = Scratch(spark, "code", tidy=True)
        # every stored row is parsed where it is read; contents are not shuffled, superseded rows are left out afterwards
        self.parsed = without_superseded(self.scratch.write(parse_files(all_files(spark, d), [G, "id", "created_at"]).withColumn("rid", F.monotonically_increasing_id())), self.scratch)
        self.files = self.parsed.select(G, "path", "id")

    def clones(self, *columns: str) -> DataFrame:
        """``columns`` of all clones, stored; the tokens go afterwards."""
        tokens = stored_tokens(self.spark, self.d, self.scratch)
        blocks = clones.store_clones(without_superseded(tokens, self.scratch), G, self.scratch, columns)
        self.scratch.drop(tokens)
        return blocks

    def part(self, name: str) -> DataFrame:
        return explode_parts(self.parsed, [G], name)

    @property
    def metrics(self) -> DataFrame:
        return metrics.file_metrics(self.parsed, [G])

    def resolved(self) -> DataFrame:
        return dependencies.first_per_line(dependencies.resolve_imports(self.part("imports"), self.files.select(G, "path"), G), G)

    def edges(self) -> DataFrame:
        return dependencies.import_edges(self.resolved(), G)


def parsed_files(spark: SparkSession, d: str) -> DataFrame:
    return Code(spark, d).parsed.select(G, "path", "language", "status", F.coalesce("error", F.lit("")).alias("error"), F.size("symbols").alias("symbols"), F.size("functions").alias("functions"), F.size("imports").alias("imports"))


def code_symbols(spark: SparkSession, d: str) -> DataFrame:
    c = Code(spark, d)
    return metrics.link_parents(c.part("symbols"), [G]).select(G, "path", "ordinal", "name", "symbol_type", "qualified_name", "parent_name", "parent_ordinal", "start_line", "end_line", "signature")


def symbol_kinds(spark: SparkSession, d: str) -> DataFrame:
    return metrics.symbol_distribution(Code(spark, d).part("symbols"), G)


def function_figures(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.function_flags(Code(spark, d).part("functions"))
    return out.withColumn("quality_flags", F.array_join(F.transform("quality_flags", lambda q: q["flag"]), ","))


def function_matches(spark: SparkSession, d: str) -> DataFrame:
    c = Code(spark, d)
    return metrics.match_functions(c.part("functions"), c.part("symbols"), [G])


def file_figures(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.file_flags(Code(spark, d).metrics)
    return out.withColumn("quality_flags", F.array_join(F.transform("quality_flags", lambda q: q["flag"]), ",")).drop("functions")


def top_flags(spark: SparkSession, d: str) -> DataFrame:
    return metrics.top_flags(metrics.file_flags(Code(spark, d).metrics), G)


def repository_figures(spark: SparkSession, d: str) -> DataFrame:
    return metrics.repository_summary(Code(spark, d).metrics, G)


def resolved_imports(spark: SparkSession, d: str) -> DataFrame:
    return Code(spark, d).resolved().select(G, "path", "target_module", "line_number", "dependency_type", "resolution_status", F.coalesce("target_path", F.lit("")).alias("target_path"), "resolution_note")


def dependency_listing(spark: SparkSession, d: str) -> DataFrame:
    """Imports that stay within their repository, with both files, by a search over their paths and modules."""
    from quarry.operators import listings

    c = Code(spark, d)
    f = c.files.select(G, "id", "path")
    r = c.resolved().join(f.withColumnRenamed("id", "source_file_id"), [G, "path"]).join(f.select(G, F.col("id").alias("target_file_id"), F.col("path").alias("target_path")), [G, "target_path"], "left")
    rows = listings.dependencies(r.drop("path", "target_path"), f, search="s")
    return rows.select(G, "source_path", "target_path", "target_module", "line_number", "resolution_status", "dependency_type")


def import_degrees(spark: SparkSession, d: str) -> DataFrame:
    c = Code(spark, d)
    return graph.degrees(c.files.select(G, F.col("path").alias("node")), c.edges(), G)


def import_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.import_counters(Code(spark, d).resolved(), G)


def import_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.strong_components(Code(spark, d).edges(), G)


def import_cycles(spark: SparkSession, d: str) -> DataFrame:
    return graph.elementary_cycles(Code(spark, d).edges(), G)


def code_clones(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "tokens")
    return clones.find_clones(without_superseded(stored_tokens(spark, d, scratch), scratch), G)


#: Columns of clones that rules and figures read.
BLOCK = ("source_file_path", "source_start_line", "source_end_line", "target_file_path", "target_start_line", "target_end_line", "line_count")


def _inputs(c: Code, cycles: Callable[[DataFrame], DataFrame] | None = None) -> rules.Inputs:
    edges = c.scratch.write(c.edges())
    nodes = c.files.select(G, F.col("path").alias("node"))
    blocks = c.clones(G, *BLOCK)
    return rules.Inputs(
        group=G, metrics=c.metrics, functions=c.part("functions"), symbols=c.part("symbols"), degrees=graph.degrees(nodes, edges, G), edges=edges,
        cycles=c.scratch.write(cycles(edges)) if cycles else None, clones=blocks, handlers=c.part("handlers"), hits=c.part("hits"),
    )


def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return rules.run_rules(_inputs(Code(spark, d), lambda edges: graph.elementary_cycles(edges, G)))


#: Columns of issues that the assessment reads.
ISSUE = ("file_path", "rule_id", "category", "severity", "symbol_name", "target_type", "target_identifier", "remediation_effort_minutes")


class Assessment:
    """Issues, figures, scores, gate, hotspots and recommendations of all runs, for the reports."""

    def __init__(self, spark: SparkSession, d: str) -> None:
        c = Code(spark, d)
        x = _inputs(c)
        # all cycles, of any number and length: counted, and only those that may be advised have a row of their own
        cycles = c.scratch.write(cycle_counts.cycle_counts(x.edges, G, health.CANDIDATES))
        # what figures, advice and reports read; titles and fingerprints are many and long, and made for ``diagnostics`` only
        others = rules.run_rules(x).select(G, *ISSUE, F.lit(1).cast("decimal(38,0)").alias("repeats"))
        self.issues = c.scratch.write(others.unionByName(rules.counted_cycles(cycles, G).select(G, *ISSUE, "repeats")))
        m = c.scratch.write(c.metrics.drop("functions"))
        covered = clones.covered_lines(x.clones, G)
        blocks = x.clones.groupBy(G).agg(F.count("*").alias("blocks"))
        duplication = clones.duplication_ratio(covered, m, G).join(blocks, G, "left").withColumn("blocks", F.coalesce("blocks", F.lit(0)))
        self.scored = c.scratch.write(health.health_scores(health.figures(G, m, self.issues, x.symbols, x.functions, cycles, duplication)))
        counts = self.issues.groupBy(G, F.col("file_path")).agg(*[F.sum(F.when(F.col("severity") == s, F.col("repeats")).otherwise(0)).alias(f"{s}_count") for s in S.SEVERITIES[:4]])
        per_file = m.withColumnRenamed("path", "file_path").join(x.degrees.withColumnRenamed("node", "file_path"), [G, "file_path"], "left").join(counts, [G, "file_path"], "left")
        self.hotspots = S.rank_hotspots(per_file, G)
        self._advice = lambda: c.scratch.write(health.recommendations(self.issues, self.scored, G, x.functions, cycles, store=c.scratch.write))
        self.gates = gates.quality_gate(
            self.scored.select(G, "overall_score", F.col("blocker").alias("blocker_issues"), F.col("cycles").alias("circular_dependencies"), F.col("critical").alias("critical_issues"), F.when(F.col("files") > 0, F.col("mi_sum") / F.col("files")).alias("average_maintainability"), F.col("critical_cc").alias("critical_functions"))
        )

    @functools.cached_property
    def advice(self) -> DataFrame:
        """Worked out only where it is asked for; neither scores nor gates read it."""
        return self._advice()


def health_scores(spark: SparkSession, d: str) -> DataFrame:
    s = Assessment(spark, d).scored
    return s.select(G, "maintainability_score", "complexity_score", "architecture_score", "hygiene_score", "duplication_score", "overall_score", "grade", "debt_minutes", "debt_ratio")


def recommendations(spark: SparkSession, d: str) -> DataFrame:
    return Assessment(spark, d).advice.withColumn("rules", F.array_join("rules", ","))


def code_gate(spark: SparkSession, d: str) -> DataFrame:
    return Assessment(spark, d).gates.select(G, "overall_score", "status", "passed")


def markdown_reports(spark: SparkSession, d: str) -> DataFrame:
    a = Assessment(spark, d)
    return exports.markdown(a.scored, a.hotspots, a.issues, a.advice, a.gates, G)


def json_reports(spark: SparkSession, d: str) -> DataFrame:
    a = Assessment(spark, d)
    return exports.json_payload(a.scored, a.hotspots, a.advice, a.gates, a.issues, G)


CODE = {
    f.__name__: f
    for f in (
        parsed_files, code_symbols, symbol_kinds, function_figures, function_matches, file_figures, top_flags, repository_figures, resolved_imports, dependency_listing, import_degrees, import_counts, import_components, import_cycles, code_clones, diagnostics, health_scores, recommendations, code_gate,
        markdown_reports, json_reports,
    )
}
