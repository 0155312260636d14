"""Health of a run: five pillars from additive figures, the overall score, and what fixing a target would regain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import scores as S

ZERO = (
    "files mi_sum poor_files documented public functions mild high critical_cc max_cc max_nesting cycles cyclic_files god_modules hubs unstable h_blocker h_critical h_major h_minor sloc ratio blocks debt_minutes "
    "blocker critical major minor info"
).split()

#: Targets of a run that recommendations weigh.
CANDIDATES = 25


def figures(group: str, metrics: DataFrame, issues: DataFrame | None = None, symbols: DataFrame | None = None, functions: DataFrame | None = None, cycles: DataFrame | None = None, duplication: DataFrame | None = None) -> DataFrame:
    """One row per run with every figure the pillars need; what is missing counts 0. All of them add up, apart from two maxima.

    ``cycles``: ``elementary_cycles`` or ``cycle_counts``.
    """
    seen = (F.col("total_lines") > 0) | (F.col("sloc") > 0)
    mi = F.col("maintainability_score")
    out = metrics.groupBy(group).agg(F.count_if(seen).alias("files"), F.sum(F.when(seen, mi).otherwise(0.0)).alias("mi_sum"), F.count_if(seen & (mi < 40)).alias("poor_files"), F.sum("sloc").alias("sloc"))
    if symbols is not None:
        public = F.col("symbol_type").isin("function", "class") & ~F.col("name").startswith("_")
        out = out.join(symbols.groupBy(group).agg(F.count_if(public & F.coalesce("has_docstring", F.lit(False))).alias("documented"), F.count_if(public).alias("public")), group, "left")
    if functions is not None:
        cc = F.col("cyclomatic_complexity")
        out = out.join(functions.groupBy(group).agg(F.count("*").alias("functions"), F.count_if(cc.between(6, 10)).alias("mild"), F.count_if(cc.between(11, 19)).alias("high"), F.count_if(cc >= 20).alias("critical_cc"), F.max(cc).alias("max_cc"), F.max("nesting_depth").alias("max_nesting")), group, "left")
    if cycles is not None and "cyclic_files" in cycles.columns:
        out = out.join(cycles.groupBy(group).agg(F.sum("cycles").alias("cycles"), F.max("cyclic_files").alias("cyclic_files")), group, "left")
    elif cycles is not None:
        per = cycles.select(group, "cycle_id", F.explode("nodes").alias("n")).groupBy(group).agg(F.count_distinct("cycle_id").alias("cycles"), F.count_distinct("n").alias("cyclic_files"))
        out = out.join(per, group, "left")
    if issues is not None:
        out = out.join(issue_figures(issues, group), group, "left")
    if duplication is not None:
        out = out.join(duplication.select(group, F.col("duplication_ratio").alias("ratio"), "blocks"), group, "left")
    return out.select(group, *[F.coalesce(F.col(c), F.lit(0)).alias(c) if c in out.columns else F.lit(0).alias(c) for c in ZERO])


def issue_figures(issues: DataFrame, group: str) -> DataFrame:
    """Counts by severity, by rule where a pillar asks for it, and the debt. Only ARCH-001 has rows that repeat."""
    sev, rule = F.col("severity"), F.col("rule_id")
    dirty = F.col("category").isin("hygiene", "security")
    n = S.repeats(issues)
    return issues.groupBy(group).agg(
        *[F.sum(F.when(sev == s, n).otherwise(0)).alias(s) for s in S.SEVERITIES], *[F.count_if(dirty & (sev == s)).alias(f"h_{s}") for s in S.SEVERITIES[:4]],
        F.count_if(rule == "ARCH-002").alias("god_modules"), F.count_if(rule == "ARCH-003").alias("hubs"), F.count_if(rule == "ARCH-004").alias("unstable"), F.sum(F.col("remediation_effort_minutes") * n).alias("debt_minutes"),
    )


def pillars(c) -> dict[str, Column]:
    """The five pillar scores; ``c`` maps a figure's name to its column."""
    return {
        "maintainability": S.maintainability_score(c("mi_sum") / c("files"), c("documented"), c("public"), c("poor_files"), c("files")),
        "complexity": S.complexity_score(c("functions"), c("mild"), c("high"), c("critical_cc"), c("max_cc"), c("max_nesting")),
        "architecture": S.architecture_score(c("files"), c("cycles"), c("cyclic_files"), c("god_modules"), c("hubs"), c("unstable")),
        "hygiene": S.hygiene_score(c("h_blocker"), c("h_critical"), c("h_major"), c("h_minor"), c("sloc")),
        "duplication": S.duplication_score(c("ratio"), c("blocks")),
    }


def health_scores(figs: DataFrame) -> DataFrame:
    """``figs`` with the pillars, overall_score, grade, debt_hours_per_ksloc and category_scores."""
    out = figs.withColumns({f"{n}_score": e for n, e in pillars(F.col).items()})
    names = ("maintainability", "complexity", "architecture", "hygiene", "duplication")
    out = out.withColumn("overall_score", S.overall_score(*[F.col(f"{n}_score") for n in names]))
    weights = dict.fromkeys(names[:4], 0.22) | {"duplication": 0.12}
    return out.withColumns(
        {
            "grade": S.grade(F.col("overall_score")), "debt_ratio": S.debt_ratio(F.col("debt_minutes").cast("double"), F.col("sloc")),
            "category_scores": F.create_map(*[x for n in names for x in (F.lit(n), F.struct(F.col(f"{n}_score").alias("score"), F.lit(weights[n]).alias("weight")))]),
        }
    )


def recommendations(issues: DataFrame, scored: DataFrame, group: str, functions: DataFrame | None = None, cycles: DataFrame | None = None, candidates: int = CANDIDATES, limit: int = 5, store: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The targets whose repair regains most: rank, target, gain (null where the model has none), effort, rules.

    Every pillar is a function of additive figures and two maxima. A target's repair is a change of these figures, so
    all of a run's candidates are scored in one pass over (candidate, run) rows. ``scored``: ``health_scores``.
    ``cycles``: ``elementary_cycles``, or ``cycle_counts`` that names as many as ``candidates``. Of one weight, targets come in order of their texts, so no cycle
    without an id is a candidate. ``store`` may write what is read on, so that the shuffles before it can go.
    """
    issues = issues.filter(~F.col("target_type").eqNullSafe("cycles"))
    target = F.coalesce("target_identifier", "file_path", F.lit("repository"))
    sev, rule = F.col("severity"), F.col("rule_id")
    dirty = F.col("category").isin("hygiene", "security")
    per = store(issues.withColumn("target", target).groupBy(group, "target").agg(
        *[F.count_if(sev == s).alias(f"n_{s}") for s in S.SEVERITIES], *[F.count_if(dirty & (sev == s)).alias(f"d_{s}") for s in S.SEVERITIES[:4]],
        F.sum("remediation_effort_minutes").cast("long").alias("effort"), F.count("*").alias("issues"), F.array_sort(F.collect_set("rule_id")).alias("rules"), F.min("file_path").alias("file_path"), F.min("symbol_name").alias("symbol_name"), F.min("target_type").alias("target_type"),
        *[F.count_if(rule == r).alias(n) for r, n in (("ARCH-002", "d_god"), ("ARCH-003", "d_hub"), ("ARCH-004", "d_unstable"), ("DUP-001", "d_dup"), ("MAINT-003", "d_doc"))],
        F.max(F.when(rule == "ARCH-001", F.regexp_extract("target_identifier", r"(\d+)$", 1))).alias("cycle"),
    ))
    weight = [F.desc(f"n_{s}") for s in S.SEVERITIES[:4]]
    top = store(per.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(*weight, F.desc("effort"), "target"))).filter(F.col("k") <= candidates).drop("k"))
    none = F.lit(0)
    if functions is not None:
        # what the target's own functions are, and the maxima over all other functions (from the two highest per run)
        cc, nest = F.col("cyclomatic_complexity"), F.col("nesting_depth")
        own = store(functions.withColumn("target", F.concat_ws("::", "path", "name")).groupBy(group, "target").agg(
            F.count_if(cc.between(11, 19)).alias("o_high"), F.count_if(cc >= 20).alias("o_critical"), F.max(cc).alias("o_cc"), F.max(nest).alias("o_nest")
        ))
        ranks = {c: Window.partitionBy(group).orderBy(F.desc(c), "target") for c in ("o_cc", "o_nest")}
        best = {}
        for c, w in ranks.items():
            best[c] = own.withColumn("k", F.row_number().over(w)).filter("k <= 2").groupBy(group).agg(F.max(F.when(F.col("k") == 1, F.col("target"))).alias(f"{c}_holder"), F.max(F.when(F.col("k") == 2, F.col(c))).alias(f"{c}_second"))
        top = top.join(own, [group, "target"], "left").join(best["o_cc"], group, "left").join(best["o_nest"], group, "left")
    else:
        top = top.withColumns({"o_high": none, "o_critical": none, "o_cc": F.lit(None).cast("int"), "o_nest": F.lit(None).cast("int"), "o_cc_holder": F.lit(None).cast("string"), "o_nest_holder": F.lit(None).cast("string"), "o_cc_second": F.lit(None).cast("int"), "o_nest_second": F.lit(None).cast("int")})
    if cycles is not None and "lone_files" in cycles.columns:
        # unknown where a run has more cycles than candidates: with five or more the architecture's loss stays at its bound, whichever is broken
        top = top.join(cycles.filter("lone_files is not null").select(group, F.col("cycle_id").cast("string").alias("cycle"), "lone_files"), [group, "cycle"], "left")
    elif cycles is not None:
        # files that lie on this cycle only
        on = cycles.select(group, "cycle_id", F.explode("nodes").alias("n"))
        alone = on.groupBy(group, "n").agg(F.count_distinct("cycle_id").alias("c"), F.min("cycle_id").alias("cycle_id")).filter("c = 1").groupBy(group, F.col("cycle_id").cast("string").alias("cycle")).agg(F.count("*").alias("lone_files"))
        top = top.join(alone, [group, "cycle"], "left")
    else:
        top = top.withColumn("lone_files", none)
    both = top.join(scored.select(group, *ZERO, "overall_score"), group)
    z = lambda c: F.coalesce(F.col(c), none)
    complex_ = F.exists("rules", lambda r: r.startswith("COMPLEX-")) & F.col("symbol_name").isNotNull() & F.col("o_cc").isNotNull()
    broken = F.array_contains("rules", "ARCH-001")
    lowered = lambda c, to: F.when(complex_ & (F.col(f"{c}_holder") == F.col("target")), F.greatest(z(f"{c}_second"), F.least(F.col(c), F.lit(to))))
    new = {
        "documented": F.when(F.col("d_doc") > 0, F.least(F.col("public"), F.col("documented") + 1)),
        "mild": F.when(complex_, F.col("mild") + z("o_high") + z("o_critical")), "high": F.when(complex_, F.col("high") - z("o_high")), "critical_cc": F.when(complex_, F.col("critical_cc") - z("o_critical")),
        "max_cc": lowered("o_cc", 10), "max_nesting": lowered("o_nest", 3), "cycles": F.when(broken, F.col("cycles") - 1), "cyclic_files": F.when(broken, F.col("cyclic_files") - z("lone_files")),
        "god_modules": F.col("god_modules") - F.col("d_god"), "hubs": F.col("hubs") - F.col("d_hub"), "unstable": F.col("unstable") - F.col("d_unstable"), **{f"h_{s}": F.col(f"h_{s}") - F.col(f"d_{s}") for s in S.SEVERITIES[:4]},
        "blocks": F.greatest(none, F.col("blocks") - F.col("d_dup")),
    }
    after = pillars(lambda c: F.coalesce(new[c], F.col(c)) if c in new else F.col(c))
    modelled = complex_ | broken | (F.col("d_doc") > 0) | F.exists("rules", lambda r: r.startswith("SEC-") | r.startswith("HYGIENE-") | r.isin("ARCH-002", "ARCH-003", "DUP-001"))
    gain = F.when(modelled, F.round(F.greatest(F.lit(0.0), S.overall_score(*after.values()) - F.col("overall_score")), 1))
    w = Window.partitionBy(group).orderBy(F.col("gain").desc_nulls_last(), *weight, F.desc("effort"), "target")
    return (
        both.withColumn("gain", gain).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
        .select(group, "rank", "target", "target_type", "file_path", "gain", "effort", "issues", "rules")
    )
