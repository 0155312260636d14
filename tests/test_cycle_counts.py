"""All cycles counted without a list: against lists and known numbers, and in the reports."""

import json
import random
import re
from collections import Counter
from datetime import datetime
from math import comb, factorial

import pytest

from quarry.operators import cycle_counts, graph
from quarry.plans import code

SCHEMA = "grp string, src int, dst int"


def full(n, base=0):
    return [(base + a, base + b) for a in range(n) for b in range(n) if a != b]


def cycles_of_full(n):
    return sum(comb(n, k) * factorial(k - 1) for k in range(2, n + 1))


def ahead(es):
    out = {x: set() for e in es for x in e}
    for a, b in es:
        out[a].add(b)
    return {n: sorted(ts) for n, ts in out.items()}


def test_counts_against_lists():
    for seed in range(400):
        rnd = random.Random(seed)
        n = rnd.randint(1, 7)
        g = ahead([(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randint(1, 3 * n))])
        listed, _ = graph._cycles(g, n, None)
        assert cycle_counts.counts(g) == (Counter(c[0] for c in listed), len({x for c in listed for x in c}))
        assert list(cycle_counts._listed(g)) == listed


def test_counts_of_long_and_many_cycles():
    assert cycle_counts.counts(ahead(full(30)))[0] == {a: cycles_of_full(30 - a) - cycles_of_full(29 - a) for a in range(29)}
    ring = [(i, (i + 1) % 3000) for i in range(3000)]
    assert cycle_counts.counts(ahead(ring)) == ({0: 1}, 3000)
    pairs = [e for i in range(0, 150, 3) for e in ((i, i + 1), (i, i + 2), (i + 1, (i + 3) % 150), (i + 2, (i + 3) % 150))]
    assert cycle_counts.counts(ahead(pairs)) == ({0: 2**50}, 150)


def test_ids_whose_texts_come_first():
    for most in (0, 1, 9, 10, 25, 99, 100, 409, 1234):
        assert cycle_counts.least_texts(most, 25) == sorted(range(1, most + 1), key=str)[:25]


def test_rows_of_counts(spark):
    es = [("many", *e) for e in full(6)] + [("long", i, (i + 1) % 20) for i in range(20)] + [("long", 30, 30), ("none", 1, 2)]
    rows = cycle_counts.cycle_counts(spark.createDataFrame(es, SCHEMA), "grp", 25).collect()
    many = [r for r in rows if r["grp"] == "many"]
    assert sum(r["cycles"] for r in many) == 409 and {r["cyclic_files"] for r in many} == {6} and {r["lone_files"] for r in many} == {None}
    listed, _ = graph._cycles(ahead(full(6)), 15, None)
    assert {r["cycle_id"]: r["node"] for r in many if r["cycle_id"]} == {i: listed[i - 1][0] for i in sorted(range(1, 410), key=str)[:25]}
    assert {(r["node"], r["cycle_id"], r["cycles"], r["cyclic_files"], r["lone_files"]) for r in rows if r["grp"] == "long"} == {(0, 1, 1, 21, 20), (30, 2, 1, 21, 1)}
    assert {r["grp"] for r in rows} == {"many", "long"}


def test_large_ids_and_counts_are_exact(spark):
    pairs = [e for i in range(0, 180, 3) for e in ((i, i + 1), (i, i + 2), (i + 1, (i + 3) % 180), (i + 2, (i + 3) % 180))]
    rows = cycle_counts.cycle_counts(spark.createDataFrame([("g", *e) for e in pairs], SCHEMA), "grp", 25).collect()
    assert sum(r["cycles"] for r in rows) == 2**60 and {r["cycle_id"] for r in rows if r["cycle_id"]} == set(cycle_counts.least_texts(2**60, 25))


def test_more_cycles_than_counts_hold_are_an_error(spark):
    pairs = [e for i in range(0, 360, 3) for e in ((i, i + 1), (i, i + 2), (i + 1, (i + 3) % 360), (i + 2, (i + 3) % 360))]
    assert sum(cycle_counts.counts(ahead(pairs))[0].values()) == 2**120
    with pytest.raises(Exception, match="cycles of one group are more than"):
        cycle_counts.cycle_counts(spark.createDataFrame([("g", *e) for e in pairs], SCHEMA), "grp", 25).collect()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Files of four runs: six and 20 that all import each other (409 and 349,096,664,728,623,316 cycles), a ring of 20, two that import each other."""
    runs = {"dense": full(6), "all": full(20), "ring": [(i, (i + 1) % 20) for i in range(20)], "pair": [(0, 1), (1, 0), (2, 0)]}
    rows = []
    for run, es in runs.items():
        for n, ts in ahead(es).items():
            text = "".join(f"import m{t:02}\n" for t in ts)
            rows.append((f"{run}{n}", run, f"m{n:02}.py", len(text), text, datetime(2026, 1, 1)))
    folder = tmp_path_factory.mktemp("cyclic")
    spark.createDataFrame(rows, "id string, analysis_id string, path string, size_bytes long, content string, created_at timestamp").write.parquet(f"{folder}/repository_files.parquet")
    return str(folder)


CYCLES = {"dense": 409, "all": cycles_of_full(20), "ring": 1, "pair": 1}


def test_json_reports_count_all_cycles(spark, tables):
    got = {r[0]: json.loads(r[1]) for r in code.json_reports(spark, tables).collect()}
    repeated = got["all"]["issues"]["total"] - CYCLES["all"]  # lines that its files share
    assert {run: p["issues"]["total"] for run, p in got.items()} == CYCLES | {"all": CYCLES["all"] + repeated} and 0 <= repeated < 1000
    assert all(got[run]["issues"]["minutes"] == 120 * CYCLES[run] for run in ("dense", "ring", "pair")) and got["all"]["issues"]["minutes"] >= 120 * CYCLES["all"]
    assert {run: [c["value"] for c in p["quality_gate"]["conditions"] if c["name"] == "circular_dependencies"] for run, p in got.items()} == {run: [float(n)] for run, n in CYCLES.items()}
    assert got["ring"]["health"]["architecture_score"] == 100 - 12 - 25
    assert [r["target"] for r in got["dense"]["recommendations"]] == [f"cycle::{i}" for i in (1, 10, 100, 101, 102)]


def test_markdown_reports_count_all_cycles(spark, tables):
    got = {r[0]: int(re.search(r"\| critical \| (\d+) \|", r[1]).group(1)) for r in code.markdown_reports(spark, tables).collect()}
    assert got == CYCLES
