"""Parsing, figures, imports, clones, rules, churn and treemaps on small sources."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quarry.operators import churn, clones, dependencies, metrics, rules, treemap
from quarry.operators.health import figures, health_scores, recommendations
from quarry.parse import ecma_source, python_source
from quarry.parse.files import explode_parts, parse_files, parse_one
from quarry.scratch import Scratch
from quarry.sources import discovery

PY = '''import os, sys as s
from .a import b

class A(Base):
    """doc"""

    def m(self, x: int = 1, *args, **kw) -> int:
        if x and s or b:
            return 1
        elif x:
            return 2
        return 3

def outer(a):
    def inner(b):
        if b:
            return 1
    for i in a:
        while i:
            try:
                pass
            except ValueError:
                pass
            except KeyError:
                print(1)
'''


def test_python_symbols_and_figures():
    r = python_source.parse("src/happy.py", PY)
    kinds = {(s["name"], s["symbol_type"], s["parent_name"]) for s in r["symbols"]}
    assert {("os", "import", None), ("s", "import", None), ("b", "import", None), ("A", "class", None), ("m", "method", "A"), ("outer", "function", None), ("inner", "method", "outer")} == kinds
    f = {x["name"]: x for x in r["functions"]}
    assert (f["m"]["cyclomatic_complexity"], f["m"]["branch_count"], f["m"]["boolean_condition_count"], f["m"]["return_count"], f["m"]["parameter_count"]) == (5, 2, 2, 3, 4)
    assert (f["outer"]["cyclomatic_complexity"], f["outer"]["loop_count"], f["outer"]["exception_handler_count"]) == (5, 2, 2)
    assert f["inner"]["cyclomatic_complexity"] == 2
    assert r["handlers"] == [{"line_number": 22, "exception_type": "ValueError"}]
    assert [s["qualified_name"] for s in r["symbols"] if s["name"] == "A"] == ["src.ha.A"]


def test_python_failures_never_raise():
    assert python_source.parse("a.py", "def f(:\n")["status"] == "failed"
    assert python_source.parse("a.py", "x = '\x00'")["status"] == "failed"
    assert python_source.parse("a.py", "  \n")["status"] == "parsed"
    assert parse_one("Go", "a.go", "package a")["status"] == "unsupported"
    assert parse_one("Python", "a.py", None)["status"] == "unsupported"


def test_line_classes():
    assert python_source.line_classes('"""a\nb\n"""\n\n# c\nx = 1\n') == (6, 1, 4)
    assert ecma_source.line_classes("/* a\n b */\n// c\n\nx();\n") == (5, 1, 3)
    assert python_source.line_classes("") == (0, 0, 0)


def test_script_figures():
    r = ecma_source.parse(
        "a.js",
        """function calc(a, b) {
  switch (a) { case 1: return 1; case 2: return 2; default: break; }
  for (let i = 0; i < 3; i++) { b += i; }
  return a > b ? a : b;
}
const arrow = (x) => x + 1;
""",
    )
    f = {x["name"]: x for x in r["functions"]}
    assert (f["calc"]["cyclomatic_complexity"], f["calc"]["branch_count"], f["calc"]["loop_count"], f["calc"]["parameter_count"]) == (5, 3, 1, 2)
    assert f["arrow"]["cyclomatic_complexity"] == 1


def test_typescript_and_imports():
    r = ecma_source.parse(
        "a.ts",
        """import type { A } from './a';
import D, { x } from "lib";
export * from './b';
export interface User { id: string }
export class S<T> { run(a: string, b?: number): boolean { return a.length > 1 && b !== undefined; } }
const fs = require('fs');
""",
    )
    assert [(i["target_module"], i["dependency_type"], i["is_type_only"]) for i in r["imports"]] == [("./a", "import", True), ("lib", "import", False), ("./b", "re_export", False), ("fs", "require", False)]
    assert {("User", "interface"), ("S", "class"), ("run", "method")} <= {(s["name"], s["symbol_type"]) for s in r["symbols"]}
    assert r["functions"][0]["cyclomatic_complexity"] == 2


@pytest.mark.parametrize("text", ["x => )", "(((", "}}}", "`${", "class", "export", "function", "import {", "a = /x", "'", "\\", "=>", "const f = async", "if (a", "=> => =>"])
def test_script_scan_survives_anything(text):
    assert ecma_source.parse("a.ts", text)["status"] in ("parsed", "failed")


FILES = [
    ("g", "src/app/main.py", "import os\nfrom .util import helper\nfrom src.app import models\nimport requests\nfrom .gone import x\n"), ("g", "src/app/util.py", "def helper():\n    return 1\n"), ("g", "src/app/models/__init__.py", "from ..app import main\n"),
    ("g", "web/index.ts", "import { a } from './lib/a';\nimport fs from 'node:fs';\nimport r from 'react';\nimport z from './none';\n"), ("g", "web/lib/a.js", "export const a = 1;\n"),
]


def parsed(spark, rows=FILES):
    return parse_files(spark.createDataFrame(rows, "grp string, path string, content string"), ["grp"])


def test_import_resolution(spark):
    p = parsed(spark)
    i = explode_parts(p, ["grp"], "imports")
    files = spark.createDataFrame(FILES, "grp string, path string, content string").select("grp", "path")
    got = {(r["path"], r["target_module"]): (r["resolution_status"], r["target_path"]) for r in dependencies.resolve_imports(i, files, "grp").collect()}
    assert got["src/app/main.py", "os"] == ("external", None)
    assert got["src/app/main.py", "util"] == ("internal", "src/app/util.py")
    assert got["src/app/main.py", "src.app"] == ("internal", "src/app/models/__init__.py")
    assert got["src/app/main.py", "requests"] == ("external", None)
    assert got["src/app/main.py", "gone"] == ("unresolved", None)
    assert got["web/index.ts", "./lib/a"] == ("internal", "web/lib/a.js")
    assert got["web/index.ts", "node:fs"][0] == "external" and got["web/index.ts", "react"][0] == "external"
    assert got["web/index.ts", "./none"] == ("unresolved", None)


def test_file_metrics(spark):
    m = {r["path"]: r for r in metrics.file_metrics(parsed(spark, [("g", "a.py", PY), ("g", "b.go", "package a\n"), ("g", "c.py", "def (\n"), ("g", "d.py", None)]), ["grp"]).collect()}
    assert m["a.py"]["function_count"] == 3 and m["a.py"]["max_cyclomatic_complexity"] == 5 and 0 < m["a.py"]["maintainability_score"] <= 100
    assert m["b.go"]["metric_status"] == "unsupported" and m["b.go"]["maintainability_score"] == 100.0
    assert m["c.py"]["metric_status"] == "failed"


def test_rules(spark):
    secret = "AKIA" + "A" * 16
    rows = [("g", "a.py", f"\nkey = '{secret}'\neval('1')\nexec('2')\n"), ("g", "b.ts", "try { a() } catch (e) { }\nnew Function('x')\nexec('no')\n"), ("g", "c.py", "def long(a, b, c, d, e, f):\n    pass\n")]
    df = spark.createDataFrame(rows, "grp string, path string, content string")
    p = parse_files(df, ["grp"])
    x = rules.Inputs("grp", metrics=metrics.file_metrics(p, ["grp"]), functions=explode_parts(p, ["grp"], "functions"), symbols=explode_parts(p, ["grp"], "symbols"), handlers=explode_parts(p, ["grp"], "handlers"), hits=explode_parts(p, ["grp"], "hits"))
    got = sorted((r["file_path"], r["rule_id"], r["line_number"]) for r in rules.run_rules(x).collect())
    assert ("a.py", "SEC-001", 2) in got and ("a.py", "SEC-002", 3) in got and ("a.py", "SEC-002", 4) in got
    assert ("b.ts", "HYGIENE-001", 1) in got and ("b.ts", "SEC-002", 2) in got and ("b.ts", "SEC-002", 3) not in got
    assert ("c.py", "COMPLEX-005", 1) in got and ("c.py", "MAINT-003", 1) in got

    def faulty(_):
        raise RuntimeError("no")

    failed = []
    assert rules.run_rules(x, {"BAD": (faulty, ()), "SEC-001": rules.RULES["SEC-001"]}, lambda n, e: failed.append(n)).count() == 1 and failed == ["BAD"]


def test_health_and_recommendations(spark):
    m = spark.createDataFrame([("g", "a.py", 100, 90, 70.0), ("g", "b.py", 100, 90, 30.0)], "grp string, path string, total_lines int, sloc int, maintainability_score double")
    issues = spark.createDataFrame(
        [("g", "SEC-001", "security", "blocker", 60, "a.py", None, "file", "a.py"), ("g", "COMPLEX-001", "complexity", "critical", 90, "a.py", "f", "symbol", "a.py::f"), ("g", "MAINT-001", "maintainability", "critical", 90, "b.py", None, "file", "b.py")],
        "grp string, rule_id string, category string, severity string, remediation_effort_minutes int, file_path string, symbol_name string, target_type string, target_identifier string",
    )
    fn = spark.createDataFrame([("g", "a.py", "f", 25, 6), ("g", "b.py", "h", 3, 1)], "grp string, path string, name string, cyclomatic_complexity int, nesting_depth int")
    s = health_scores(figures("grp", m, issues, functions=fn))
    r = s.first()
    assert r["maintainability_score"] == round(0.7 * 50 + 30 - 12.5, 1) and r["complexity_score"] == 100 - 30 - 5 - 4
    top = recommendations(issues, s, "grp", fn).orderBy("rank").collect()
    assert [t["target"] for t in top] == ["a.py::f", "a.py", "b.py"] and top[-1]["gain"] is None
    # with f at 10 and depth 3: one mild function of two, no extra
    assert top[0]["gain"] == pytest.approx(0.22 * (95 - 61), abs=0.1)


def test_interval_union_random(spark):
    rnd = random.Random(1)
    rows = [("g", rnd.choice("ab"), s, s + rnd.randint(0, 9), rnd.choice("ab"), t, t + rnd.randint(0, 9)) for s, t in ((rnd.randint(1, 90), rnd.randint(1, 90)) for _ in range(60))]
    df = spark.createDataFrame(rows, "grp string, source_file_path string, source_start_line int, source_end_line int, target_file_path string, target_start_line int, target_end_line int")
    want = {}
    for _, a, s, e, b, t, u in rows:
        want.setdefault(a, set()).update(range(s, e + 1))
        want.setdefault(b, set()).update(range(t, u + 1))
    assert {r["file_path"]: r["duplicated_lines"] for r in clones.covered_lines(df, "grp").collect()} == {k: len(v) for k, v in want.items()}


BODY = "".join(f"    value_{i} = compute(value, {i})\n" for i in range(14))


def test_clones(spark):
    rows = [("g", "a.py", f"def f(value):\n{BODY}"), ("g", "b.py", f"x = 1\ndef f(value):\n{BODY}"), ("g", "c.py", ("def g(other):\n" + BODY).replace("value", "other")), ("g", "d.py", "x = 1\n"), ("h", "a.py", f"def f(value):\n{BODY}")]
    got = clones.find_clones(clones.token_table(spark.createDataFrame(rows, "grp string, path string, content string"), "grp", "path", "content"), "grp").collect()
    pairs = {(r["source_file_path"], r["target_file_path"]): r for r in got if r["source_file_path"] != r["target_file_path"]}
    assert pairs["a.py", "b.py"]["clone_type"] == 1 and pairs["a.py", "c.py"]["clone_type"] == 2
    assert pairs["a.py", "b.py"]["line_count"] >= 15 and pairs["a.py", "b.py"]["target_start_line"] == 2
    assert all(r["grp"] == "g" for r in got) and not any("d.py" in (r["source_file_path"], r["target_file_path"]) for r in got)


def test_clones_of_a_window_with_many_occurrences(spark):
    rows = [("g", f"f{i:03}.py", f"x_{i} = 1\ndef f(value):\n{BODY}") for i in range(150)]
    got = clones.find_clones(clones.token_table(spark.createDataFrame(rows, "grp string, path string, content string"), "grp", "path", "content"), "grp")
    assert got.count() == 150 * 149 // 2
    assert clones.covered_lines(got, "grp").count() == 150


def maximal_blocks(files):
    """(source, source lines, target, target lines, tokens, type) by comparing all pairs of tokens; of equal begins the longest, without contained ones."""
    tokens = {p: clones.tokens_of(p, t) for p, t in files}
    out = []
    for p in sorted(tokens):
        for q in sorted(x for x in tokens if x >= p):
            x, y, best = tokens[p], tokens[q], {}
            for a in range(len(x)):
                for b in range(a + 1 if p == q else 0, len(y)):
                    n = 0
                    if a and b and x[a - 1].normal == y[b - 1].normal:
                        continue
                    while a + n < len(x) and b + n < len(y) and x[a + n].normal == y[b + n].normal:
                        n += 1
                    if n < clones.WINDOW or p == q and b - a < n:
                        continue
                    s, e, s2, e2 = x[a].line, x[a + n - 1].line, y[b].line, y[b + n - 1].line
                    kind = 1 if [t.text for t in x[a : a + n]] == [t.text for t in y[b : b + n]] else 2
                    if max(e - s, e2 - s2) + 1 >= clones.LINES and (p != q or s2 > e):
                        best[s, s2] = min(best.get((s, s2), (0,)), (-n, -max(e - s, e2 - s2), kind, e, e2))
            for (s, s2), (n, _, kind, e, e2) in best.items():
                if not any(o != (s, s2) and o[0] <= s and o[1] <= s2 and v[3] >= e and v[4] >= e2 for o, v in best.items()):
                    out.append((p, s, e, q, s2, e2, -n, kind))
    return sorted(out)


def shuffled_bytes(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_clones_are_the_maximal_runs(spark):
    pick = random.Random(5)
    lines = ["a = b", "f(x, y)", "if a:", "return (1)", "x = [1, 2]", "import k", "b = a + 1", "g()", "for i in a: pass", "y.z = 0"]
    base = [pick.choice(lines) for _ in range(60)]
    files = []
    for i in range(9):
        text, at = [], pick.randrange(20)
        while len(text) < 50:
            n = pick.choice([9, 10, 12, 17, 25])
            text += [pick.choice(lines) for _ in range(pick.randrange(3))] + base[at : at + n]
            at = pick.randrange(40)
        files.append((f"f{i}.js", "\n".join(text).replace("; ", "\n") + "\n"))
    files.append(("table.json", "[\n" + "".join(f'"k{i}": {i},\n' for i in range(40)) + "]\n"))
    files.append(("odd.js", "\u0001\n" + "\n".join(base[5:40]) + "\n\u0001"))
    rows = spark.createDataFrame([("g", *x) for x in files], "grp string, path string, content string")
    got = clones.find_clones(clones.token_table(rows, "grp", "path", "content"), "grp").collect()
    sides = [f"{s}_{c}" for s in ("source", "target") for c in ("file_path", "start_line", "end_line")]
    want = maximal_blocks(files)
    assert len(want) > 50 and sorted((*[r[c] for c in sides], r["token_count"], r["clone_type"]) for r in got) == want


def test_clones_shuffle_little(spark):
    pick = random.Random(7)
    files = [("g", f"f{i}.js", "".join(f"{pick.choice('abc')}{i} {pick.choice('+-*/')} f{k}({pick.choice('xyz')}, {k}) {pick.choice('&|^')} {pick.choice('!~')}w\n" for k in range(300))) for i in range(60)]
    tokens = clones.token_table(spark.createDataFrame(files, "grp string, path string, content string"), "grp", "path", "content").cache()
    tokens.count()
    before, usual = shuffled_bytes(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert clones.find_clones(tokens, "grp").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    written, size = shuffled_bytes(spark) - before, sum(len(t) for _, _, t in files)
    assert written < 6 * size, (written, size)


def without_broadcasts(spark, run):
    """What ``run`` gives, and the bytes that it shuffles."""
    before, usual = shuffled_bytes(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = run()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    return out, shuffled_bytes(spark) - before


def test_clones_of_many_copies_shuffle_little(spark):
    pick = random.Random(3)
    text = [f"{pick.choice('abc')}{k} {pick.choice('+-*/')} f{k}({pick.choice('xyz')}, {k}) {pick.choice('&|^')} {pick.choice('!~')}w" for k in range(60)]
    files = [("g", f"{pick.randrange(1 << 60):x}/f{i}.js", "\n".join([f"if {i};", *text[pick.randrange(20) : pick.randrange(40, 60)]])) for i in range(250)]
    tokens = clones.token_table(spark.createDataFrame(files, "grp string, path string, content string"), "grp", "path", "content").cache()
    tokens.count()
    pairs, written = without_broadcasts(spark, lambda: clones.find_clones(tokens, "grp").count())
    assert pairs == 250 * 249 // 2 and written < 90 * pairs, written / pairs



def test_stored_clones_come_in_slices(spark, monkeypatch):
    sizes = {"g": 24, "h": 12, "i": 3, "j": 3}
    files = [(g, f"f{i:02}.py", f"x_{i} = 1\ndef f(value):\n{BODY}" + (f"y = {i}\n" + BODY if i % 3 else "")) for g, n in sizes.items() for i in range(n)]
    tokens = clones.token_table(spark.createDataFrame(files, "grp string, path string, content string"), "grp", "path", "content").cache()
    all_ = clones.find_clones(tokens, "grp")
    want = sorted(map(tuple, all_.collect()))
    for name, value in (("SLICES", 2), ("SLICE_BYTES", 1000), ("LARGE_FILES", 10), ("SLICE_PAIRS", 250)):
        monkeypatch.setattr(clones, name, value)
    scratch, written = Scratch(spark, "slices"), []
    gather = scratch.gather
    monkeypatch.setattr(scratch, "gather", lambda parts, by=(): gather((written.append(x) or x for x in parts), by))
    got = clones.store_clones(tokens, "grp", scratch, all_.columns)
    assert len(written) >= 4 and len(want) > 24 * 23 // 2 and sorted(map(tuple, got.collect())) == want


def test_scores_work_out_no_advice(spark, small, monkeypatch):
    from quarry.plans import code

    monkeypatch.setattr(code.health, "recommendations", lambda *x, **y: 1 / 0)
    a = code.Assessment(spark, small)
    assert a.scored.count() == a.gates.count() > 0
    with pytest.raises(ZeroDivisionError):
        a.advice  # noqa: B018


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def test_tidy_tables_leave_no_shuffle_files(spark):
    kept = shuffle_files(spark)
    table = Scratch(spark, "tidy", tidy=True).write(spark.range(1000).repartition(7))
    for _ in range(50):  # they go in the background
        if not (more := shuffle_files(spark) - kept):
            break
        time.sleep(0.1)
    assert not more and table.count() == 1000


def test_imports_shuffle_little_whatever_the_folders(spark):
    files = spark.createDataFrame([("g", f"d{i}/m{i}.py") for i in range(200)], "grp string, path string").cache()
    imports = spark.createDataFrame([("g", f"d{i}/m{i}.py", "Python", 0, f"m{i + 1}", [], i, 0) for i in range(200)], "grp string, path string, language string, ordinal int, target_module string, imported_symbols array<string>, line_number int, level int").cache()
    files.count(), imports.count()
    got, written = without_broadcasts(spark, lambda: dependencies.resolve_imports(imports, files, "grp").collect())
    assert sorted(r["target_path"] for r in got if r["target_path"]) == sorted(f"d{i}/m{i}.py" for i in range(1, 200))
    assert written < 500 * len(got), written / len(got)


def test_assessment_keeps_short_issues(spark, small):
    from quarry.plans.code import Assessment

    found = Assessment(spark, small).issues
    assert not {"title", "fingerprint"} & set(found.columns) and found.count() > 0


def test_numstat(spark):
    z = "\0"
    log = f"COMMIT{z}h1{z}Alice{z}\n10{'\t'}2{'\t'}main.py{z}5{'\t'}1{'\t'}utils.py{z}COMMIT{z}h2{z}Bob{z}\n5{'\t'}4{'\t'}main.py{z}-{'\t'}-{'\t'}./logo.png{z}3{'\t'}0{'\t'}{z}old.py{z}new.py{z}"
    rows = churn.parse_numstat(spark.createDataFrame([("g", log)], "grp string, log string"), "grp", "log")
    got = sorted((r["commit"], r["author"], r["path"], r["added"], r["deleted"]) for r in rows.collect())
    assert got == [("h1", "Alice", "main.py", 10, 2), ("h1", "Alice", "utils.py", 5, 1), ("h2", "Bob", "logo.png", 0, 0), ("h2", "Bob", "main.py", 5, 4), ("h2", "Bob", "new.py", 3, 0)]
    by = {r["path"]: r for r in churn.churn_by_file(rows, "grp").collect()}
    assert by["main.py"]["commit_count"] == 2 and by["main.py"]["churn_score"] == 13.6


def test_treemap(spark):
    rows = [("g", "a/x.py", 30, 30, 1, 1, 0, None), ("g", "a/y.py", 10, 10, 2, 2, 1, "major"), ("g", "b.py", 60, 60, 3, 3, 2, "blocker")]
    t = treemap.folder_rollup(spark.createDataFrame(rows, "grp string, path string, sloc int, total_lines int, total_cc int, max_cc int, issues int, top_severity string"), "grp")
    by = {r["path"]: r for r in t.collect()}
    assert by[""]["sloc"] == 100 and by[""]["dominant_severity"] == "blocker" and by["a"]["file_count"] == 2 and by["a"]["position"] == 2 and by["b.py"]["is_file"]
    boxes = {r["path"]: r for r in treemap.layout(t, "grp").collect()}
    assert abs(boxes["b.py"]["w"] * boxes["b.py"]["h"] - 600_000) < 1 and abs(boxes["a/y.py"]["w"] * boxes["a/y.py"]["h"] - 100_000) < 1
    means = {r["path"]: r["maintainability"] for r in treemap.nested_means(t, spark.createDataFrame([("g", "a/x.py", 50.0), ("g", "a/y.py", 75.25), ("g", "b.py", 10.0)], "grp string, path string, score double"), "grp").collect()}
    assert means["a"] == 62.6 and means[""] == round((62.6 * 2 + 10) / 3, 1)


def test_urls(spark):
    bad = ["http://github.com/a/b", "https://u:p@github.com/a/b", "https://github.com:8443/a/b", "https://127.0.0.1/a/b", "https://localhost/a/b", "https://[::1]/a/b", "https://github.com/a", "https://github.com/a/b/c", "https://github.com/../b", "https://github.com/-a/b", "https://github.com/a/b;ls", "https://evil.test/a/b", "", None]
    good = ["https://github.com/a/b.git", "https://www.gitlab.com/own-er/re.po"]
    rows = discovery.validate_urls(spark.createDataFrame([(u,) for u in bad + good], "u string"), "u").collect()
    assert [r["error"] is None for r in rows] == [False] * len(bad) + [True] * 2
    assert rows[-2]["normalized_url"] == "https://github.com/a/b" and rows[-1]["host"] == "gitlab.com"


def test_discovery(spark):
    paths = ["src/main.py", ".\\src\\app.TS", "README.md", "node_modules/x.js", "a/Build/y.py", ".github/z.yml", "logo.png", "Dockerfile", ".gitignore"]
    got = {r["path"]: (r["language"], r["is_analyzable"], r["line_count"]) for r in discovery.discover(spark.createDataFrame([(p, "a\nb", 3) for p in paths], "path string, content string, size_bytes long")).collect()}
    assert got["src/main.py"] == ("Python", True, 1) and got["src/app.TS"][0] == "TypeScript" and got["README.md"] == ("Markdown", False, 1)
    assert set(got) == {"src/main.py", "src/app.TS", "README.md", "Dockerfile", ".gitignore"} and got["Dockerfile"][0] == "Dockerfile"
