"""Cycles and impact against brute force on random graphs; the other graph operators on small ones."""

import itertools
import random
from collections import deque

from quarry.operators import graph
from quarry.operators.gates import canonical_cycle, cycle_lifecycle


def edges(spark, rows):
    return spark.createDataFrame([("g", a, b, 1) for a, b in rows], "grp string, src int, dst int, line_number int")


def brute_cycles(es, longest):
    es = set(es)
    nodes = {x for e in es for x in e}
    out = []
    for n in range(2, longest + 1):
        for p in itertools.permutations(sorted(nodes), n):
            if p[0] == min(p) and all((a, b) in es for a, b in zip(p, (*p[1:], p[0]))):
                out.append(list(p))
    on = {x for c in out for x in c}
    return sorted([*out, *[[a] for a, b in es if a == b and a not in on]])


def test_cycles_random(spark):
    for seed in range(3):
        rnd = random.Random(seed)
        es = [(rnd.randrange(6), rnd.randrange(6)) for _ in range(12)]
        got = graph.elementary_cycles(edges(spark, es), "grp", limit=None).orderBy("cycle_id").collect()
        assert [r["nodes"] for r in got] == brute_cycles(es, 6)


def test_cycle_limit_and_membership(spark):
    full = [(a, b) for a in range(5) for b in range(5) if a != b]
    c = graph.elementary_cycles(edges(spark, full), "grp", limit=5)
    assert c.count() == 5
    loop = graph.elementary_cycles(edges(spark, [(1, 1)]), "grp")
    assert graph.cycle_membership(loop, "grp").first()["cycle_count"] == 2
    two = graph.cycle_edges(graph.elementary_cycles(edges(spark, [(1, 2), (2, 1)]), "grp"), "grp").orderBy("position").collect()
    assert [(r["src"], r["dst"]) for r in two] == [(1, 2), (2, 1)]


def test_impact_random(spark):
    for seed in range(3):
        rnd = random.Random(seed)
        es = sorted({(rnd.randrange(8), rnd.randrange(8)) for _ in range(14)})
        got = graph.impact(edges(spark, es), spark.createDataFrame([("g", 0)], "grp string, target int"), "grp", "dependencies", 5)
        want, seen, queue = {}, {0}, deque([[0]])
        while queue:
            p = queue.popleft()
            for a, b in es:
                if a == p[-1] and b not in seen and len(p) <= 5:
                    seen.add(b)
                    want[b] = [*p, b]
                    queue.append([*p, b])
        assert {r["node"]: r["path"] for r in got.collect()} == want


def test_degrees(spark):
    e = edges(spark, [(1, 2), (1, 2), (3, 2), (2, 2)])
    nodes = spark.createDataFrame([("g", n) for n in (1, 2, 3, 4)], "grp string, node int")
    got = {r["node"]: (r["fan_in"], r["fan_out"], r["instability"]) for r in graph.degrees(nodes, e, "grp").collect()}
    assert got == {1: (0, 1, 1.0), 2: (3, 1, 0.25), 3: (0, 1, 1.0), 4: (0, 0, 0.0)}


def test_cycle_comparison(spark):
    a = spark.createDataFrame([(["b", "c", "a", "b"],), (["x", "y"],)], "nodes array<string>")
    b = spark.createDataFrame([(["a", "b", "c"],), (["p", "q"],)], "nodes array<string>")
    assert a.select(canonical_cycle(a["nodes"]).alias("c")).first()["c"] == ["a", "b", "c"]
    assert sorted((r[0][0], r[1]) for r in cycle_lifecycle(a, b).collect()) == [("a", "persistent"), ("p", "new"), ("x", "fixed")]


def test_cycles_of_a_dense_graph_end_early(spark):
    full = [(a, b) for a in range(20) for b in range(20) if a != b]
    got = graph.elementary_cycles(edges(spark, full), "grp").collect()
    assert len(got) == 100 and all(r["cap_reached"] for r in got)
    assert [r["nodes"] for r in sorted(got, key=lambda r: r["cycle_id"])] == sorted(r["nodes"] for r in got)


def test_components(spark):
    chain = [(i, i + 1) for i in range(3000)]
    got = {r["node"]: (r["component"], r["members"], r["cyclic"]) for r in graph.strong_components(edges(spark, [*chain, (10, 8), (7, 7)]), "grp").collect()}
    assert got[8] == got[9] == got[10] == (8, 3, True) and got[7] == (7, 1, True) and got[2999] == (2999, 1, False) and len(got) == 3001
    for seed in range(4):
        rnd = random.Random(seed)
        es = {(rnd.randrange(9), rnd.randrange(9)) for _ in range(14)}
        reach = set(es)
        while new := {(a, d) for a, b in reach for c, d in es if b == c} - reach:
            reach |= new
        for r in graph.strong_components(edges(spark, sorted(es)), "grp").collect():
            n = r["node"]
            same = {n} | {b for a, b in reach if a == n and (b, a) in reach}
            assert (r["component"], r["members"], r["cyclic"]) == (min(same), len(same), (n, n) in reach)
    assert graph.strong_components(edges(spark, [(1, 1)]).limit(0), "grp").count() == 0
