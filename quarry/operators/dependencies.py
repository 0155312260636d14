"""Resolving imports to files: candidates in order of preference, joined with the files of the group."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Modules that come with the JavaScript runtime.
NODE_MODULES = (
    "assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events fs fs/promises http http2 https inspector module net os path path/posix path/win32 perf_hooks "
    "process punycode querystring readline readline/promises repl stream stream/consumers stream/promises stream/web string_decoder sys timers timers/promises tls trace_events tty url util util/types v8 vm wasi worker_threads zlib"
).split()
SCRIPT_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".json")
#: Folders below which a package root may lie one level deeper.
ROOT_PARENTS = ("src", "lib", "backend", "app")


def normal_path(path: Column) -> Column:
    """Resolve ``.`` and ``..``; a path that leaves the root keeps only what is inside."""
    return F.array_join(
        F.aggregate(
            F.split(path, "/"), F.array().cast("array<string>"),
            lambda a, x: F.when(x.isin("", "."), a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))),
        ),
        "/",
    )


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def source_roots(files: DataFrame, group: str) -> DataFrame:
    """Folders of a group that imports may start from: the top, its folders, and one level below the usual parents.

    A row per group and ``head``, the first name of a module that has anything below these ``roots``.
    """
    parts = F.split("path", "/")
    place = lambda root, k: F.struct(root.alias("root"), F.regexp_replace(F.get(parts, F.lit(k)), r"\.pyi?$", "").alias("head"))
    first = F.when(F.size(parts) > 1, place(F.get(parts, F.lit(0)), 1))
    second = F.when((F.size(parts) > 2) & F.get(parts, F.lit(0)).isin(*ROOT_PARENTS), place(F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))), 2))
    roots = files.select(group, F.explode(F.array(place(F.lit(""), 0), first, second)).alias("r")).filter("r is not null").select(group, "r.*").distinct()
    return roots.groupBy(group, "head").agg(F.sort_array(F.collect_set(F.struct((-F.length("root")).alias("k"), "root"))).alias("r")).select(group, "head", F.col("r.root").alias("roots"))


def _python_probes(base: Column) -> Column:
    return F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")), F.concat(base, F.lit(".pyi")), F.when(base.endswith(".py") | base.endswith(".pyi"), base))


def _script_probes(base: Column) -> Column:
    return F.array(base, *[F.concat(base, F.lit(s)) for s in SCRIPT_SUFFIXES], *[F.concat(base, F.lit("/index" + s)) for s in SCRIPT_SUFFIXES])


def _join(a: Column, b: Column) -> Column:
    return F.when(a == "", b).when(b == "", a).otherwise(F.concat_ws("/", a, b))


def resolve_imports(imports: DataFrame, files: DataFrame, group: str) -> DataFrame:
    """``imports`` (group, path, language, ordinal, target_module, imported_symbols, level, ...) with resolution_status
    (internal, external, unresolved), target_path and resolution_note.

    The candidates of an import are exploded with their rank and joined with the files on (group, path); the best
    match counts. A group's roots are few (its top folders), and only those that have the module's first name are tried.
    """
    i = imports.withColumn("imp", F.monotonically_increasing_id()) if "imp" not in imports.columns else imports
    module = F.translate("target_module", ".", "/")
    i = i.withColumn("head", F.split_part(module, F.lit("/"), F.lit(1))).join(source_roots(files, group), [group, "head"], "left").withColumn("roots", F.coalesce("roots", F.array().cast("array<string>")))
    here = folder_of(F.col("path"))
    up = F.concat(here, F.repeat(F.lit("/.."), F.greatest(F.col("level") - 1, F.lit(0))))
    base = normal_path(F.concat_ws("/", up, module))
    start = normal_path(up)
    note = lambda n, ps: F.transform(ps, lambda p: F.struct(p.alias("p"), F.lit(n).alias("note")))
    symbols = F.col("imported_symbols")
    relative_py = F.concat(note("relative import", _python_probes(base)), F.flatten(F.transform(symbols, lambda s: note("relative symbol", _python_probes(normal_path(_join(start, s)))))))
    absolute_py = F.concat(
        F.flatten(F.transform("roots", lambda r: note("import under a root", _python_probes(_join(r, module))))),
        F.flatten(F.transform(symbols, lambda s: F.flatten(F.transform("roots", lambda r: note("symbol module", _python_probes(_join(r, F.concat_ws("/", module, s)))))))),
    )
    target = F.trim("target_module")
    dotted = target.rlike(r"^\.\.?(/|$)")
    script = (
        F.when(dotted, note("relative import", _script_probes(normal_path(F.concat_ws("/", here, target)))))
        .when(target.startswith("/"), F.concat(note("absolute import", _script_probes(normal_path(target))), note("path alias", _script_probes(F.ltrim(target, F.lit("/"))))))
        .otherwise(F.concat(note("path alias", _script_probes(target)), note("path alias", _script_probes(F.concat(F.lit("src/"), target)))))
    )
    python = F.col("language") == "Python"
    builtin = F.when(python, F.split(F.col("target_module"), r"\.")[0].isin(sorted(sys.stdlib_module_names))).otherwise(F.regexp_replace(target, "^node:", "").isin(NODE_MODULES))
    is_relative = F.when(python, F.col("level") > 0).otherwise(dotted)
    nothing = F.array().cast("array<struct<p:string,note:string>>")
    candidates = F.when(python & (F.col("level") > 0), relative_py).when(python, F.when(F.col("target_module") == "", nothing).otherwise(absolute_py)).when(builtin, nothing).otherwise(script)
    tried = i.select("imp", group, F.posexplode(candidates).alias("rank", "c")).select("imp", group, "rank", F.col("c.p").alias("target_path"), "c.note").filter("target_path is not null")
    known = files.select(group, F.col("path").alias("target_path")).distinct()
    best = tried.join(known, [group, "target_path"]).groupBy("imp").agg(F.min_by(F.struct("target_path", "note"), "rank").alias("m")).select("imp", "m.*")
    missing = F.when(is_relative, "target not found").when(python & (F.col("target_module") == ""), "no target").when(builtin, F.when(python, "standard library").otherwise("runtime module")).otherwise("external package")
    return i.join(best, "imp", "left").select(
        *[c for c in i.columns if c not in ("imp", "head", "roots")], "target_path",
        F.when(F.col("target_path").isNotNull(), "internal").when(is_relative | (python & (F.col("target_module") == "")), "unresolved").otherwise("external").alias("resolution_status"), F.coalesce("note", missing).alias("resolution_note"),
    )


def first_per_line(resolved: DataFrame, group: str) -> DataFrame:
    """One row per (file, module, line): the first that the file names."""
    keys = [group, "path", "target_module", "line_number"]
    value = F.struct(*[c for c in resolved.columns if c not in keys])
    return resolved.groupBy(*keys).agg(F.min_by(value, "ordinal").alias("v")).select(*keys, "v.*")


def import_edges(resolved: DataFrame, group: str) -> DataFrame:
    """group, src, dst, line_number of internal imports; the first line of a pair."""
    return resolved.filter("resolution_status = 'internal'").groupBy(group, F.col("path").alias("src"), F.col("target_path").alias("dst")).agg(F.min("line_number").alias("line_number"))
