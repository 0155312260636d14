"""File and repository figures from parsed files (``parse.files``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.scores import maintainability_index
from quarry.parse.files import sloc


def file_metrics(parsed: DataFrame, keys: list[str], line_count: str | None = None) -> DataFrame:
    """One row per file, from arrays of the same row: no shuffle. Files that were not parsed count their lines as source
    lines, keep maintainability 100 and a status that says so."""
    f = F.col("functions")
    n = F.size(f)
    done = F.col("status") == "parsed"
    total = lambda c: F.aggregate(f, F.lit(0), lambda a, x: a + x[c])
    most = lambda c, z: F.coalesce(F.array_max(F.transform(f, lambda x: x[c])), F.lit(z))
    mean = lambda c, z: F.when(n > 0, F.round(total(c) / n, 2)).otherwise(F.lit(z))
    kind = lambda k: F.size(F.filter("symbols", lambda s: s["symbol_type"] == k))
    lines = F.coalesce("total_lines", F.col(line_count) if line_count else F.lit(0), F.lit(0))
    source = F.when(done, sloc()).otherwise(lines)
    mean_loc = F.when(n > 0, total("lines_of_code") / n).otherwise(F.greatest(F.lit(1), source).cast("double"))
    mi = maintainability_index(mean_loc, F.when(n > 0, F.round(total("cyclomatic_complexity") / n, 2)).otherwise(1.0), lines, F.col("comment_lines"))
    return parsed.select(
        *keys, "path", "language", lines.alias("total_lines"), source.alias("sloc"), "blank_lines", "comment_lines", n.alias("function_count"), kind("class").alias("class_count"), kind("method").alias("method_count"), kind("import").alias("import_count"),
        "statement_count", total("cyclomatic_complexity").alias("total_cyclomatic_complexity"), mean("cyclomatic_complexity", 1.0).alias("average_cyclomatic_complexity"), most("cyclomatic_complexity", 1).alias("max_cyclomatic_complexity"),
        most("nesting_depth", 0).alias("max_nesting_depth"), mean("nesting_depth", 0.0).alias("average_nesting_depth"), F.when(done, mi).otherwise(100.0).alias("maintainability_score"),
        F.when(done, "calculated").otherwise(F.col("status")).alias("metric_status"), F.col("error").alias("metric_error"), "functions",
    )


# Limits of the quality flags: (flag, figure, above, severity); the first that applies of a figure counts.
FUNCTION_FLAGS = (
    ("VERY_HIGH_COMPLEXITY", "cyclomatic_complexity", 20, "CRITICAL"), ("HIGH_COMPLEXITY", "cyclomatic_complexity", 10, "HIGH"), ("VERY_LARGE_FUNCTION", "lines_of_code", 100, "HIGH"), ("LARGE_FUNCTION", "lines_of_code", 50, "MEDIUM"),
    ("DEEP_NESTING", "nesting_depth", 4, "HIGH"), ("HIGH_PARAMETER_COUNT", "parameter_count", 5, "MEDIUM"), ("HIGH_BRANCH_COUNT", "branch_count", 8, "MEDIUM"),
)
FILE_FLAGS = (("VERY_LARGE_FILE", "sloc", 1000, "HIGH"), ("LARGE_FILE", "sloc", 500, "MEDIUM"))
POOR_MI = 50.0


def _flag(name: str, value: Column, limit: float, severity: str, location: Column) -> Column:
    return F.struct(F.lit(name).alias("flag"), value.cast("double").alias("metric_value"), F.lit(float(limit)).alias("threshold"), F.lit(severity).alias("severity"), location.alias("location"))


def _flags(rules: tuple, get, location: Column) -> list[Column]:
    out, before = [], {}
    for name, figure, limit, severity in rules:
        hit = get(figure) > limit
        if figure in before:
            hit = hit & (get(figure) <= before[figure])
        before[figure] = limit
        out.append(F.when(hit, _flag(name, get(figure), limit, severity, location)))
    return out


def function_flags(functions: DataFrame) -> DataFrame:
    """``functions`` (rows) with quality_flags."""
    place = F.concat_ws(":", "path", "name", "start_line")
    return functions.withColumn("quality_flags", F.filter(F.array(*_flags(FUNCTION_FLAGS, F.col, place)), lambda x: x.isNotNull()))


def file_flags(metrics: DataFrame) -> DataFrame:
    """``metrics`` with quality_flags: the file's own and those of its functions."""
    own = [*_flags(FILE_FLAGS, F.col, F.col("path")), F.when(F.col("maintainability_score") < POOR_MI, _flag("POOR_MAINTAINABILITY", F.col("maintainability_score"), POOR_MI, "HIGH", F.col("path")))]
    inner = F.flatten(F.transform("functions", lambda f: F.filter(F.array(*_flags(FUNCTION_FLAGS, lambda c: f[c], F.concat_ws(":", F.col("path"), f["name"], f["start_line"]))), lambda x: x.isNotNull())))
    return metrics.withColumn("quality_flags", F.concat(F.filter(F.array(*own), lambda x: x.isNotNull()), inner))


def repository_summary(metrics: DataFrame, group: str) -> DataFrame:
    """One row per group: totals, means, maxima, complexity classes, mean maintainability and its rating."""
    calculated = F.col("metric_status") == "calculated"
    per = metrics.select(group, "path", "total_lines", "sloc", "metric_status", "maintainability_score", "max_nesting_depth", "max_cyclomatic_complexity", "function_count", "total_cyclomatic_complexity", F.expr("aggregate(functions, 0, (a, x) -> a + x.lines_of_code)").alias("loc"), F.expr("aggregate(functions, 0, (a, x) -> a + x.nesting_depth)").alias("nest"), *[F.expr(f"size(filter(functions, x -> {rule}))").alias(name) for name, rule in CC_CLASSES.items()])
    n = F.sum("function_count")
    mi = F.coalesce(F.round(F.avg(F.when(calculated, F.col("maintainability_score"))), 2), F.lit(100.0))
    out = per.groupBy(group).agg(
        F.count("*").alias("files"), F.sum("total_lines").cast("long").alias("total_lines"), F.sum("sloc").cast("long").alias("sloc"), n.cast("long").alias("functions"), F.when(n > 0, F.round(F.sum("total_cyclomatic_complexity") / n, 2)).otherwise(0.0).alias("average_cc"),
        F.when(n > 0, F.round(F.sum("loc") / n, 1)).otherwise(0.0).alias("average_function_lines"), F.when(n > 0, F.round(F.sum("nest") / n, 2)).otherwise(0.0).alias("average_nesting"), F.max("max_cyclomatic_complexity").alias("max_cc"), F.max("max_nesting_depth").alias("max_nesting"),
        *[F.sum(c).cast("long").alias(c) for c in CC_CLASSES], mi.alias("mean_maintainability"),
    )
    return out.withColumn("rating", F.when(F.col("mean_maintainability") >= 70, "good").when(F.col("mean_maintainability") >= 50, "moderate").otherwise("poor"))


CC_CLASSES = {"cc_low": "x.cyclomatic_complexity <= 5", "cc_moderate": "x.cyclomatic_complexity between 6 and 10", "cc_high": "x.cyclomatic_complexity between 11 and 20", "cc_very_high": "x.cyclomatic_complexity > 20"}


def top_flags(flagged: DataFrame, group: str, k: int = 15) -> DataFrame:
    """The gravest flags per group: by severity, then by value."""
    rows = flagged.select(group, "path", F.explode("quality_flags").alias("q")).select(group, "path", "q.*")
    rank = F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "HIGH", 1).when(F.col("severity") == "MEDIUM", 2).otherwise(3)
    w = Window.partitionBy(group).orderBy(rank, F.desc("metric_value"), "location", "flag")
    return rows.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def symbol_distribution(symbols: DataFrame, group: str) -> DataFrame:
    return symbols.groupBy(group, "symbol_type").agg(F.count("*").alias("symbols"))


def link_parents(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """``symbols`` with parent_ordinal: the last class, function or interface of the parent's name in the file."""
    owners = symbols.filter(F.col("symbol_type").isin("class", "function", "interface")).groupBy(*keys, "path", F.col("name").alias("parent_name")).agg(F.max("ordinal").alias("parent_ordinal"))
    return symbols.join(owners, [*keys, "path", "parent_name"], "left")


def match_functions(functions: DataFrame, symbols: DataFrame, keys: list[str], reach: int = 5) -> DataFrame:
    """Each function's symbol of the same name: on the same line, else the nearest within ``reach`` lines; one to one."""
    f = functions.select(*keys, "path", "name", F.col("ordinal").alias("function_ordinal"), F.col("start_line").alias("at"))
    s = symbols.filter(F.col("symbol_type").isin("function", "method")).select(*keys, "path", "name", F.col("ordinal").alias("symbol_ordinal"), "start_line")
    near = f.join(s, [*keys, "path", "name"]).withColumn("gap", F.abs(F.col("at") - F.col("start_line"))).filter(F.col("gap") <= reach)
    mine = Window.partitionBy(*keys, "path", "function_ordinal").orderBy("gap", "symbol_ordinal")
    theirs = Window.partitionBy(*keys, "path", "symbol_ordinal").orderBy("gap", "function_ordinal")
    one = near.withColumn("a", F.row_number().over(mine)).filter("a = 1").withColumn("b", F.row_number().over(theirs)).filter("b = 1")
    return one.select(*keys, "path", "function_ordinal", "symbol_ordinal", "gap")
