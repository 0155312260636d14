"""Queries over the stored tables. Each takes (session, folder)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import clean_path
from quarry.operators import churn, clones, exports, gates, graph, health, listings, treemap
from quarry.operators import scores as S
from quarry.plans.issue_changes import latest_jobs
from quarry.plans.tables import all_files, clone_edges, latest_files, numstat, scored_files, table
from quarry.sources import discovery

G = "analysis_id"
HOSTS = ("code.example", "scm.test", "git.example")
NOW = "2025-01-01 00:00:00"


def url_validation(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "repositories").select("id", F.explode(F.array("url", F.concat("url", F.lit("/x")), F.regexp_replace("url", "^https", "http"), F.concat("url", F.lit(".git")))).alias("raw"))
    return discovery.validate_urls(t, "raw", HOSTS).select("id", "raw", "error", F.col("owner").alias("valid_owner"), F.col("name").alias("valid_name"))


def _discovered(spark: SparkSession, d: str) -> DataFrame:
    """Lines are counted where the contents are read; only narrow columns are shuffled."""
    return latest_files(discovery.discover(all_files(spark, d)).drop("content"))


def discovered_files(spark: SparkSession, d: str) -> DataFrame:
    return _discovered(spark, d).select(G, "id", "path", "filename", "extension", "language", "is_analyzable", F.coalesce(F.col("line_count").cast("long"), F.lit(-1)).alias("line_count"))


def language_shares(spark: SparkSession, d: str) -> DataFrame:
    return discovery.language_shares(_discovered(spark, d), G)


def job_status(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "repositories").select(F.col("id").alias("repository_id"), "url", "name")
    return latest_jobs(table(spark, d, "analysis_jobs")).join(r, "repository_id").select("id", "repository_id", "url", "name", "status")


def stale_jobs(spark: SparkSession, d: str) -> DataFrame:
    return listings.stale_jobs(latest_jobs(table(spark, d, "analysis_jobs")), F.lit(NOW).cast("timestamp_ntz")).select("id", "status", "updated_at")


def cancel_outcomes(spark: SparkSession, d: str) -> DataFrame:
    jobs = latest_jobs(table(spark, d, "analysis_jobs"))
    return listings.cancelled(jobs, jobs.filter(F.col("completed_at").isNull()).select("id")).filter("outcome is not null").select("id", "status", "outcome", "new_status")


def symbol_search(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "repository_files").select("id", clean_path(F.col("path")).alias("path")).distinct()
    return listings.symbols(table(spark, d, "symbols"), f, symbol_type="method", search="ledger").select("id", "file_id", "path", "name", "qualified_name", "start_line", "start_column")


def symbol_page(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col(c).asc_nulls_first() for c in ("path", "start_line", "start_column", "id", "name", "created_at")]
    f = table(spark, d, "repository_files").select("id", clean_path(F.col("path")).alias("path")).distinct()
    rows = listings.symbols(table(spark, d, "symbols"), f)
    return listings.page(rows, order, skip=100, limit=50).select("id", "path", "name", "start_line", "start_column")


def issue_search(spark: SparkSession, d: str) -> DataFrame:
    return listings.issues(table(spark, d, "analysis_issues"), severity="major", search="ledger").select("id", G, "rule_id", "severity", "severity_rank", "title")


def issue_page(spark: SparkSession, d: str) -> DataFrame:
    rows = listings.issues(table(spark, d, "analysis_issues"))
    return listings.page(rows, [F.col(c).asc_nulls_first() for c in ("severity_rank", "rule_id", "created_at", "id", "file_path", "line_number", "title")], 0, 100).select("id", "rule_id", "severity", "severity_rank")


def issue_summary(spark: SparkSession, d: str) -> DataFrame:
    return listings.issue_summary(table(spark, d, "analysis_issues"), G)


def top_rules(spark: SparkSession, d: str) -> DataFrame:
    return listings.top_rules(table(spark, d, "analysis_issues"), G)


def _fingerprinted(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "analysis_issues")
    return t.withColumn("fingerprint", gates.fingerprint(F.col("rule_id"), F.col("file_path"), F.col("symbol_name"), F.col("metadata_json")))


def issue_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return _fingerprinted(spark, d).groupBy(G, "fingerprint").agg(F.count("*").alias("rows"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "analysis_jobs").groupBy("id").agg(F.max_by("base_analysis_id", "updated_at").alias("base_id"))
    return j.filter("base_id is not null").select(F.col("id").alias("head_id"), "base_id")


def _lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of each run against its base run: one full join for all pairs of runs."""
    latest = F.struct(F.col("created_at").isNotNull(), "created_at", "id", "severity")  # of one run's equal fingerprints the last row counts
    i = _fingerprinted(spark, d).groupBy(G, "fingerprint").agg(F.max_by("severity", latest).alias("severity"))
    p = _pairs(spark, d)
    head = i.join(p, F.col(G) == F.col("head_id")).select("head_id", "fingerprint", F.col("severity").alias("head_severity"))
    base = i.join(p, F.col(G) == F.col("base_id")).select("head_id", "fingerprint", F.col("severity").alias("base_severity"))
    state = F.when(F.col("base_severity").isNull(), "new").when(F.col("head_severity").isNull(), "fixed").otherwise("persistent")
    return base.join(head, ["head_id", "fingerprint"], "full").withColumn("lifecycle", state)


def issue_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    return _lifecycle(spark, d).select("head_id", "fingerprint", "lifecycle")


def merge_verdicts(spark: SparkSession, d: str) -> DataFrame:
    new = F.col("lifecycle") == "new"
    per = _lifecycle(spark, d).groupBy("head_id").agg(F.count_if(new & (F.col("head_severity") == "blocker")).alias("new_blockers"), F.count_if(new & (F.col("head_severity") == "critical")).alias("new_criticals"))
    all_pairs = _pairs(spark, d).select("head_id").join(per, "head_id", "left").na.fill(0, ["new_blockers", "new_criticals"])
    deltas = score_deltas(spark, d).select("head_id", F.col("overall").alias("score_delta"))
    cycles = pair_lifecycle(spark, d).groupBy("head_id").agg(F.count_if(F.col("lifecycle") == "new").alias("new_cycles"))
    out = gates.merge_verdict(all_pairs.join(deltas, "head_id", "left").join(cycles, "head_id", "left").na.fill(0, ["new_cycles"]))
    return out.select("head_id", "new_blockers", "new_criticals", "score_delta", "new_cycles", "status", F.array_join("reasons", "; ").alias("reasons"))


def _stored_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores that the stored tables give for a run; pillars without stored figures keep 100."""
    s = issue_debt(spark, d).select(G, "hygiene_score", "debt_minutes").join(duplication_scores(spark, d).select(G, "duplication_score"), G, "full")
    s = s.withColumns({"hygiene_score": F.coalesce("hygiene_score", F.lit(100.0)), "duplication_score": F.coalesce("duplication_score", F.lit(100.0)), "debt_minutes": F.coalesce("debt_minutes", F.lit(0))})
    full = F.lit(100.0)
    return s.withColumn("overall_score", S.overall_score(full, full, full, F.col("hygiene_score"), F.col("duplication_score")))


def score_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Change of scores and debt of each run against its base run."""
    columns = {"overall": "overall_score", "hygiene": "hygiene_score", "duplication": "duplication_score", "debt_minutes": "debt_minutes"}
    return gates.score_deltas(_pairs(spark, d), _stored_scores(spark, d), columns)


def pair_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """The shortest cycles of each run's clone graph, two files that point at each other, against those of its base run."""
    e = clone_edges(spark, d).filter("src <> dst").select(G, "src", "dst").distinct()
    back = e.select(G, F.col("src").alias("dst"), F.col("dst").alias("src"))
    cycles = e.join(back, [G, "src", "dst"]).select(G, gates.canonical_cycle(F.array("src", "dst", "src")).alias("cycle")).distinct()
    return gates.lifecycle_of_pairs(_pairs(spark, d), cycles, G, "cycle").select("head_id", F.array_join("cycle", ">").alias("cycle"), "lifecycle")


def comparisons(spark: SparkSession, d: str) -> DataFrame:
    """Which runs may be compared with their base run, and why not."""
    return gates.comparable(_pairs(spark, d), latest_jobs(table(spark, d, "analysis_jobs"))).select("head_id", "base_id", "error")


def timeline(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("id").orderBy(F.col("updated_at").desc_nulls_last(), F.col("completed_at").desc_nulls_last(), F.col("status").desc_nulls_last(), F.col("repository_id").desc_nulls_last())
    jobs = table(spark, d, "analysis_jobs").withColumn("n", F.row_number().over(w)).filter("n = 1")
    return gates.timeline(jobs).select("repository_id", "id", "position", "commit_date")


def hotspot_ranking(spark: SparkSession, d: str) -> DataFrame:
    return S.rank_hotspots(scored_files(spark, d), G).select(G, "rank", "file_path", "complexity_risk", "architectural_centrality", "issue_severity_burden", "hotspot_score")


FILE_SORTS = {"score": "hotspot_score", "sloc": "sloc", "complexity": "max_cyclomatic_complexity", "fan_in": "fan_in", "path": "file_path"}


def file_metric_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of complex files, by complexity."""
    rows = scored_files(spark, d).filter((F.col("max_cyclomatic_complexity") >= 10) & (F.col("issues_count") > 0))
    order = [listings.sorted_by(FILE_SORTS, "complexity", "desc"), F.col("sloc").desc_nulls_last(), F.col(G), F.col("file_path")]
    return listings.page(rows, order, 50, 50).select(G, "file_path", "sloc", "max_cyclomatic_complexity")


def churn_page(spark: SparkSession, d: str) -> DataFrame:
    rows = churn.churn_by_file(numstat(spark, d))
    return listings.page(rows, [F.desc("churn_score"), F.desc("commit_count"), F.asc("path")], 0, 100).select("path", "churn_score", "commit_count")


def score_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Runs in order with the change of their hygiene score since the run before and since the first."""
    w = Window.partitionBy("id").orderBy(F.col("updated_at").desc_nulls_last(), F.col("completed_at").desc_nulls_last(), F.col("status").desc_nulls_last(), F.col("repository_id").desc_nulls_last())
    jobs = table(spark, d, "analysis_jobs").withColumn("n", F.row_number().over(w)).filter("n = 1")
    scores = issue_debt(spark, d).select(G, F.col("hygiene_score").alias("overall_score"))
    return gates.timeline(jobs, scores).select("repository_id", "id", "position", "overall_score", F.coalesce("delta", F.lit(0.0)).alias("delta"), "since_first")


def repository_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Known repositories and submitted ones: every second owner's again, and a fork of each."""
    known = table(spark, d, "repositories").select("url", "owner", "name")
    sent = known.unionByName(known.withColumns({"url": F.concat("url", F.lit("-fork")), "name": F.concat("name", F.lit("-fork"))}))
    return listings.upsert_repositories(known, sent)


def event_messages(spark: SparkSession, d: str) -> DataFrame:
    from quarry.streaming.progress import events_json

    return events_json(table(spark, d, "events").select("user_id", F.col("event_type").alias("event"), "event_id"), "user_id")


def duplicated_lines(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "code_duplicates").withColumns({c: clean_path(F.col(c)) for c in ("source_file_path", "target_file_path")})
    return clones.covered_lines(t, G)


def _duplication(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "code_duplicates").groupBy(G).agg(F.count_distinct("id").alias("blocks"))
    sloc = scored_files(spark, d).select(G, F.coalesce("sloc", F.lit(0)).alias("sloc"))
    return clones.duplication_ratio(duplicated_lines(spark, d), sloc, G).join(blocks, G, "left").withColumn("blocks", F.coalesce("blocks", F.lit(0)))


def duplication_scores(spark: SparkSession, d: str) -> DataFrame:
    return _duplication(spark, d).withColumn("duplication_score", S.duplication_score(F.col("duplication_ratio"), F.col("blocks"))).select(G, F.col("sloc").cast("long").alias("sloc"), "duplicated_lines", "duplication_ratio", "blocks", "duplication_score")


def duplicate_listing(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "analysis_jobs").groupBy("id").agg(F.max_by(F.struct("repository_id", "commit_hash"), "updated_at").alias("v")).select(F.col("id").alias(G), "v.*")
    where = j.join(table(spark, d, "repositories").select(F.col("id").alias("repository_id"), "url"), "repository_id").select(G, "commit_hash", "url")
    t = table(spark, d, "code_duplicates").withColumns({c: clean_path(F.col(c)) for c in ("source_file_path", "target_file_path")})
    return listings.duplicates(t, where, "TYPE_1").select("id", G, "line_count", "source_url", "target_url")


def clone_containment(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "code_duplicates").withColumns({c: clean_path(F.col(c)) for c in ("source_file_path", "target_file_path")})
    kept = clones.drop_contained(t.select(G, "source_file_path", "target_file_path", "source_start_line", "source_end_line", "target_start_line", "target_end_line", "line_count").distinct(), G)
    return kept.select(G, "source_file_path", "target_file_path", "source_start_line", "target_start_line", "line_count")


def issue_debt(spark: SparkSession, d: str) -> DataFrame:
    """Hygiene pillar, debt and severity counts per run."""
    f = health.issue_figures(table(spark, d, "analysis_issues"), G)
    sloc = scored_files(spark, d).groupBy(G).agg(F.sum(F.coalesce("sloc", F.lit(0))).cast("long").alias("sloc"))
    rows = f.join(sloc, G, "left").withColumn("sloc", F.coalesce("sloc", F.lit(0)))
    c = F.col
    return rows.select(
        G, "sloc", *S.SEVERITIES, "debt_minutes", S.debt_ratio(c("debt_minutes"), c("sloc")).alias("debt_ratio"), S.hygiene_score(c("h_blocker"), c("h_critical"), c("h_major"), c("h_minor"), c("sloc")).alias("hygiene_score"),
    ).withColumn("grade", S.grade(F.col("hygiene_score")))


def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    functions = scored_files(spark, d).groupBy(G).agg(F.count_if(F.col("max_cyclomatic_complexity") >= 20).alias("critical_functions"))
    rows = issue_debt(spark, d).join(functions, G, "left").select(G, F.col("hygiene_score").alias("overall_score"), F.col("blocker").alias("blocker_issues"), F.lit(0).alias("circular_dependencies"), F.col("critical").alias("critical_issues"), F.lit(None).cast("double").alias("average_maintainability"), "critical_functions")
    out = gates.quality_gate(rows)
    return out.select(G, "status", "passed", F.array_join(F.transform(F.filter("conditions", lambda x: ~x["ok"]), lambda x: x["name"]), ",").alias("missed"))


def churn_by_file(spark: SparkSession, d: str) -> DataFrame:
    return churn.churn_by_file(numstat(spark, d))


def defect_scores(spark: SparkSession, d: str) -> DataFrame:
    c = churn.churn_by_file(numstat(spark, d)).select("path", "churn_score")
    parts = table(spark, d, "part").select(F.concat(F.lit("src/part_"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), S.complexity_risk(F.col("p_size") * 10, F.col("p_size") % 20, F.col("p_size") % 5).alias("static_score"))
    known = churn.with_history(parts.withColumn("grp", F.when(F.col("path") < "src/part_2", "with").otherwise("without")), c.withColumn("grp", F.lit("with")), "grp")
    return known.join(c, "path", "left").select("path", "has_git_history", "static_score", "churn_score", S.defect_score(F.col("static_score"), F.col("churn_score"), F.col("has_git_history")).alias("defect_score"))


def churn_summary(spark: SparkSession, d: str) -> DataFrame:
    """Files, highest churn and whether there is any history, per customer segment."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("author"), F.col("c_mktsegment").alias("grp"))
    rows = numstat(spark, d).join(c, "author")
    return churn.churn_summary(churn.churn_by_file(rows, "grp"), c.select("grp").unionByName(spark.range(1).select(F.lit("none").alias("grp"))), "grp")


def numstat_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Each commit's rows written as log text, and parsed again."""
    n = numstat(spark, d)
    line = F.concat_ws("\t", F.col("added").cast("string"), F.col("deleted").cast("string"), "path")
    logs = n.groupBy("commit", "author").agg(F.sort_array(F.collect_list(line)).alias("lines")).select(
        F.col("commit").alias("grp"), F.concat_ws("\u0000", F.lit("COMMIT"), F.col("commit").cast("string"), F.col("author").cast("string"), F.concat(F.lit("\n"), F.array_join("lines", "\u0000")), F.lit("")).alias("log")
    )
    return churn.parse_numstat(logs, "grp", "log").select(F.col("commit").cast("long").alias("commit"), F.col("author").cast("long").alias("author"), "path", "added", "deleted")


def fan_in_out(spark: SparkSession, d: str) -> DataFrame:
    e = clone_edges(spark, d)
    nodes = e.select(G, F.explode(F.array("src", "dst")).alias("node"))
    return graph.degrees(nodes, e, G)


def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_summary(fan_in_out(spark, d), G)


def top_fan_in(spark: SparkSession, d: str) -> DataFrame:
    return graph.top_degree(fan_in_out(spark, d), G, "fan_in").select(G, "position", "node", "fan_in")


def graph_view(spark: SparkSession, d: str) -> DataFrame:
    """Edges between the 60 nodes of highest degree of every run."""
    return graph.graph_view(fan_in_out(spark, d), clone_edges(spark, d), G)[1]


def elementary_cycles(spark: SparkSession, d: str) -> DataFrame:
    c = graph.elementary_cycles(clone_edges(spark, d), G)
    return c.select(G, "cap_reached", "cycle_id", "length", F.array_join("nodes", ">").alias("nodes"))


def cycle_membership(spark: SparkSession, d: str) -> DataFrame:
    return graph.cycle_membership(graph.elementary_cycles(clone_edges(spark, d), G), G).select(G, "node", "cycle_count")


def cycle_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.cycle_edges(graph.elementary_cycles(clone_edges(spark, d), G), G).select(G, "cycle_id", "position", "src", "dst")


def clone_components(spark: SparkSession, d: str) -> DataFrame:
    """Strongly connected components of the whole clone graphs."""
    return graph.strong_components(clone_edges(spark, d), G)


def _impact(spark: SparkSession, d: str, direction: str) -> DataFrame:
    e = clone_edges(spark, d)
    rows = graph.impact(e, e.select(G, F.explode(F.array("src", "dst")).alias("target")).distinct(), G, direction, 5)
    return rows.select(G, "target", "node", "depth", F.array_join("path", ">").alias("path"), "relation")


def impact_dependents(spark: SparkSession, d: str) -> DataFrame:
    return _impact(spark, d, "dependents")


def impact_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return _impact(spark, d, "dependencies")


def _tree_files(spark: SparkSession, d: str) -> DataFrame:
    f = scored_files(spark, d)
    top = F.when(F.col("blocker_count") > 0, "blocker").when(F.col("critical_count") > 0, "critical").when(F.col("major_count") > 0, "major").when(F.col("minor_count") > 0, "minor")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return f.select(G, F.col("file_path").alias("path"), z("sloc").alias("sloc"), z("sloc").alias("total_lines"), z("max_cyclomatic_complexity").alias("total_cc"), z("max_cyclomatic_complexity").alias("max_cc"), z("issues_count").alias("issues"), top.alias("top_severity"))


def folder_rollup(spark: SparkSession, d: str) -> DataFrame:
    r = treemap.folder_rollup(_tree_files(spark, d), G)
    return r.select(G, "path", "parent", F.col("depth").cast("int").alias("depth"), "is_file", "file_count", "sloc", "total_cc", "max_cc", "issues", "dominant_severity", "position")


def treemap_layout(spark: SparkSession, d: str) -> DataFrame:
    return treemap.layout(treemap.folder_rollup(_tree_files(spark, d), G), G)


def treemap_means(spark: SparkSession, d: str) -> DataFrame:
    t = _tree_files(spark, d)
    scores = t.select(G, "path", F.greatest(F.lit(0.0), F.lit(100.0) - F.col("max_cc") * 2).alias("score"))
    return treemap.nested_means(treemap.folder_rollup(t, G), scores, G).select(G, "path", F.col("depth").cast("int").alias("depth"), "maintainability")


def sarif_rows(spark: SparkSession, d: str) -> DataFrame:
    return exports.sarif_rows(table(spark, d, "analysis_issues"), G)


def sarif_documents(spark: SparkSession, d: str) -> DataFrame:
    return exports.sarif(table(spark, d, "analysis_issues"), G)


def version_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Line of every version number in the documents."""
    t = table(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "s"))
    n = F.regexp_count("s", F.lit(r"v[0-9]+[.][0-9]+[.][0-9]+"))
    return t.withColumn("n", n).filter("n > 0").select("doc_id", (F.col("at") + 1).alias("line"), F.explode(F.sequence(F.lit(1), "n"))).select("doc_id", "line")


def redacted_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages of all jobs, and the addresses of their repositories with a login and a token put in, without credentials."""
    j = table(spark, d, "analysis_jobs")
    said = j.select("id", F.explode(F.array("message", "error_message")).alias("line")).filter("line is not null")
    r = table(spark, d, "repositories").select("id", F.concat(F.lit("fetch "), F.regexp_replace("url", "^https://", "https://bot:pw@"), F.lit(" with Token: "), F.col("name")).alias("line"))
    return said.unionByName(r).distinct().select("id", exports.redact(F.col("line")).alias("line"))


CORE = {
    f.__name__: f
    for f in (
        url_validation, discovered_files, language_shares, job_status, stale_jobs, cancel_outcomes, symbol_search, symbol_page, issue_search, issue_page, issue_summary, top_rules, issue_fingerprints, issue_lifecycle, merge_verdicts, score_deltas, pair_lifecycle, comparisons, timeline,
        hotspot_ranking, file_metric_page, churn_page, score_timeline, repository_upsert, event_messages, duplicated_lines, duplication_scores, duplicate_listing, clone_containment, issue_debt, quality_gate, churn_by_file, defect_scores, numstat_parsed, churn_summary, clone_components, fan_in_out, graph_summary, top_fan_in, graph_view, elementary_cycles, cycle_membership,
        cycle_edges, impact_dependents, impact_dependencies, folder_rollup, treemap_layout, treemap_means, sarif_rows, sarif_documents, version_mentions, redacted_messages,
    )
}
