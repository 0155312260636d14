"""Differences between snapshots: brute force on random data, and the defined cases."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quarry.functions.jsonvalue import canonical
from quarry.operators.snapshot_diff import diff_snapshots, snapshot_positions
from quarry.plans.issue_changes import issue_changes

T0 = datetime(2024, 1, 1)
ROWS = "snap string, k1 string, k2 string, v string, at timestamp, id string, key string"


def run(spark, rows, snaps):
    r = spark.createDataFrame(rows, ROWS)
    s = spark.createDataFrame(snaps, "id string, series string, at timestamp")
    p = snapshot_positions(s, F.col("id"), F.col("series"), [F.col("at")])
    out = diff_snapshots(r, p, F.col("snap"), {"k1": F.col("k1"), "k2": F.col("k2")}, {"v": F.col("v")}, [F.col("at"), F.col("id")])
    return sorted(map(tuple, out.collect()), key=str)


def brute(rows, snaps):
    out = []
    series = {}
    for i, s, at in snaps:
        series.setdefault(s, []).append((at, i))
    content = {}
    for snap, k1, k2, v, at, i, _ in rows:
        cur = content.setdefault(snap, {})
        if (k1, k2) not in cur or (at, i) > cur[k1, k2][0]:
            cur[k1, k2] = ((at, i), v)
    for runs in series.values():
        runs.sort()
        for (_, a), (_, b) in zip(runs, runs[1:]):
            x, y = content.get(a, {}), content.get(b, {})
            for k in x.keys() | y.keys():
                if k not in x:
                    out.append((b, *k, "added"))
                elif k not in y:
                    out.append((b, *k, "removed"))
                elif x[k][1] != y[k][1]:
                    out.append((b, *k, "changed"))
    return sorted(out, key=str)


def test_random_against_brute_force(spark):
    rnd = random.Random(5)
    snaps = [(f"s{s}_{i}", f"r{s}", T0 + timedelta(hours=i)) for s in range(3) for i in range(5)]
    rows = []
    for s, _, at in snaps:
        if rnd.random() < 0.15:
            continue  # a snapshot without rows
        for _ in range(40):
            rows.append((s, rnd.choice("abc"), rnd.choice(["x", "y", None, "z"]), rnd.choice(["1", "2", None]), at + timedelta(seconds=rnd.randint(0, 3)), f"{rnd.random()}", "clash"))
    rows += rows[:60]
    assert run(spark, rows, snaps) == brute(rows, snaps)


def test_empty_snapshot_removes_everything_and_unknown_ones_are_ignored(spark):
    snaps = [("a", "r", T0), ("b", "r", T0 + timedelta(days=1)), ("c", "r", T0 + timedelta(days=2))]
    rows = [("a", "k", "1", "v", T0, "1", ""), ("c", "k", "1", "v", T0, "2", ""), ("zz", "k", "9", "v", T0, "3", "")]
    assert run(spark, rows, snaps) == [("b", "k", "1", "removed"), ("c", "k", "1", "added")]
    assert run(spark, [], snaps) == [] and run(spark, rows, []) == []


def test_ties_take_the_greatest_id(spark):
    snaps = [("a", "r", T0), ("b", "r", T0 + timedelta(days=1))]
    rows = [("a", "k", "1", "old", T0, "1", ""), ("a", "k", "1", "new", T0, "2", ""), ("b", "k", "1", "new", T0, "9", "")]
    assert run(spark, rows, snaps) == []


def test_json_values():
    same = ['{"a": 5, "b": [1, 2]}', '{"b":[1.0,2e0],"a":5.00}', '{ "\\u0061" : 50e-1 , "b" : [1,2]}']
    assert len({canonical(x) for x in same}) == 1
    assert canonical(None) == canonical("{}") == canonical("  ")
    assert len({canonical(x) for x in ('{"a": "5"}', '{"a": 5}', '{"a": null}', "[]", '{"a": ",}"}', '{"a": "}"}', "no json", "0.1", "0.10000000000000001")}) == 9


def test_issue_changes_end_to_end(spark):
    jobs = spark.createDataFrame(
        [("j1", "r", "completed", T0, T0), ("j2", "r", "running", None, T0), ("j2", "r", "completed", T0 + timedelta(days=1), T0 + timedelta(days=1)), ("j3", "r", "failed", T0 + timedelta(days=2), T0)],
        "id string, repository_id string, status string, completed_at timestamp, updated_at timestamp",
    )
    cols = "id string, analysis_id string, rule_id string, file_path string, symbol_name string, severity string, metadata_json string, created_at timestamp"
    issues = spark.createDataFrame(
        [
            ("1", "j1", " R1 ", ".\\a\\b.py", "  ", "major", '{"target_identifier": "t", "n": 5}', T0),
            ("2", "j2", "R1", "a/b.py", None, "major", '{"n": 5.0, "target_identifier": "t"}', T0),
            ("3", "j2", "R2", "a.py", "f", "minor", None, T0),
            ("4", "j3", "R3", "a.py", "f", "minor", None, T0),
        ],
        cols,
    )
    assert [tuple(r) for r in issue_changes(issues, jobs).collect()] == [("j2", "R2", "a.py", "f", "added")]
