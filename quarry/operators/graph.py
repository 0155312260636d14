"""The import graph: degrees, cycles, impact, neighbourhoods. Edges are rows (group, src, dst)."""

from __future__ import annotations

import collections
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.scratch import Scratch

#: Longest cycle listed, cycles listed per group.
MAX_CYCLE, CYCLE_LIMIT = 15, 100


def degrees(nodes: DataFrame, edges: DataFrame, group: str) -> DataFrame:
    """fan_in, fan_out (distinct neighbours, a loop counts in both) and instability of every node (group, node)."""
    distinct = edges.select(group, "src", "dst").distinct()
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    counted = distinct.select(group, ends.alias("e")).groupBy(group, F.col("e.node").alias("node")).agg(F.sum("e.o").alias("fan_out"), F.sum("e.i").alias("fan_in"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = z("fan_in") + z("fan_out")
    return nodes.select(group, "node").distinct().join(counted, [group, "node"], "left").select(
        group, "node", z("fan_in").alias("fan_in"), z("fan_out").alias("fan_out"), F.when(both > 0, F.round(z("fan_out") / both, 4)).otherwise(0.0).alias("instability")
    )


def graph_summary(degree: DataFrame, group: str) -> DataFrame:
    """One row per group: averages, maxima and counts over its nodes."""
    linked = (F.col("fan_in") + F.col("fan_out")) > 0
    return degree.groupBy(group).agg(
        F.count("*").alias("nodes"), F.round(F.avg("fan_in"), 2).alias("avg_fan_in"), F.round(F.avg("fan_out"), 2).alias("avg_fan_out"), F.max("fan_in").alias("max_fan_in"), F.max("fan_out").alias("max_fan_out"),
        F.round(F.coalesce(F.avg(F.when(linked, F.col("instability"))), F.lit(0.0)), 2).alias("avg_instability"), F.count_if(~linked).alias("isolated"),
        F.count_if((F.col("fan_in") >= 3) & (F.col("instability") <= 0.3)).alias("core_foundation"), F.count_if((F.col("fan_out") >= 5) | ((F.col("fan_in") >= 3) & (F.col("fan_out") >= 3))).alias("high_coupling"),
    )


def top_degree(degree: DataFrame, group: str, column: str, k: int = 10) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(column), F.asc("node"))
    return degree.filter(F.col(column) > 0).withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def _components(ahead: dict) -> dict:
    """node -> its strongly connected component's least node (Tarjan, without recursion)."""
    index, low, on, stack, out = {}, {}, set(), [], {}
    for root in sorted(ahead):
        if root in index:
            continue
        work = [(root, iter(ahead[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, targets = work[-1]
            for t in targets:
                if t not in index:
                    index[t] = low[t] = len(index)
                    stack.append(t)
                    on.add(t)
                    work.append((t, iter(ahead.get(t, ()))))
                    break
                if t in on:
                    low[node] = min(low[node], index[t])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while not members or members[-1] != node:
                        members.append(stack.pop())
                        on.discard(members[-1])
                    least = min(members)
                    out |= dict.fromkeys(members, least)
    return out


def _cycles(ahead: dict, max_length: int, limit: int | None) -> tuple[list[list], bool]:
    """Cycles in order of their nodes, at most ``limit``; whether there are more.

    From each node in order, paths over greater nodes of its component; a path goes on only while the way back (breadth
    first, over nodes not smaller than the first) still fits the length. The search ends with the cycle after the last.
    """
    part = _components(ahead)
    size = collections.Counter(part.values())
    found: list[list] = []
    for first in sorted(ahead):
        home = part[first]
        if size[home] == 1:
            if first in ahead[first]:
                found.append([first])
        else:
            inside = {n: [t for t in ts if part[t] == home and t >= first and t != n] for n, ts in ahead.items() if part[n] == home and n >= first}
            before: dict = {}
            for n, ts in inside.items():
                for t in ts:
                    before.setdefault(t, []).append(n)
            back, queue = {first: 0}, collections.deque([first])
            while queue:
                n = queue.popleft()
                for s in before.get(n, ()):
                    if s not in back:
                        back[s] = back[n] + 1
                        queue.append(s)
            path, seen, work = [first], {first}, [iter(inside.get(first, ()))]
            while work:
                for t in work[-1]:
                    if t == first:
                        found.append(list(path))
                        if limit is not None and len(found) > limit:
                            break
                    elif t not in seen and len(path) + back.get(t, max_length) <= max_length:
                        path.append(t)
                        seen.add(t)
                        work.append(iter(inside.get(t, ())))
                        break
                else:
                    work.pop()
                    seen.discard(path.pop())
                    continue
                if limit is not None and len(found) > limit:
                    break
        if limit is not None and len(found) > limit:
            return found[:limit], True
    return found, False


def _per_group(edges: DataFrame, group: str, schema: str, rows: Callable[[dict], list[tuple]]) -> DataFrame:
    """``rows`` of each group's graph. A group is one run's files, at most ``discovery.MAX_FILES``; edges come once."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        ahead: dict = {}
        for s, t in zip(part["src"], part["dst"]):
            ahead.setdefault(s, set()).add(t)
            ahead.setdefault(t, set())
        key = part[group].iloc[0]
        return pd.DataFrame([(key, *r) for r in rows({n: sorted(ts) for n, ts in ahead.items()})], columns=names)

    kind = edges.schema["src"].dataType.simpleString()
    full = f"{group} {edges.schema[group].dataType.simpleString()}, {schema.format(node=kind)}"
    names = [c.split()[0] for c in full.split(", ")]
    return edges.filter("src is not null and dst is not null").select(group, "src", "dst").distinct().groupBy(group).applyInPandas(run, full)


def strong_components(edges: DataFrame, group: str) -> DataFrame:
    """group, node, component (its least node), members, cyclic: strongly connected components of each group's graph.

    Linear in a group's edges, however long its chains are. ``cyclic``: the component has a cycle (two members or a loop).
    """

    def rows(ahead: dict) -> list[tuple]:
        part = _components(ahead)
        size = collections.Counter(part.values())
        return [(n, c, size[c], size[c] > 1 or n in ahead[n]) for n, c in part.items()]

    return _per_group(edges, group, "node {node}, component {node}, members int, cyclic boolean", rows)


def elementary_cycles(edges: DataFrame, group: str, max_length: int = MAX_CYCLE, limit: int | None = CYCLE_LIMIT) -> DataFrame:
    """group, cycle_id, length, nodes, cap_reached: simple directed cycles of up to ``max_length`` nodes, least node first.

    In order of their nodes, which cycle_id numbers. A loop counts (length 1) where its node is a component of its own. The search stops
    behind the first ``limit`` cycles of a group, and cap_reached tells that there are more; null lists all.
    """

    def rows(ahead: dict) -> list[tuple]:
        found, more = _cycles(ahead, max_length, limit)
        return [(i, len(c), c, more) for i, c in enumerate(found, 1)]

    return _per_group(edges, group, "cycle_id int, length int, nodes array<{node}>, cap_reached boolean", rows)


def import_counters(resolved: DataFrame, group: str) -> DataFrame:
    """Imports per file (path) and, with a null path, per group: total and by where they lead."""
    status = F.col("resolution_status")
    return resolved.groupingSets([[F.col(group), F.col("path")], [F.col(group)]], F.col(group), F.col("path")).agg(
        F.count("*").alias("total"), *[F.count_if(status == s).alias(s) for s in ("internal", "external")], F.count_if(~status.isin("internal", "external")).alias("unresolved")
    )


def cycle_membership(cycles: DataFrame, group: str) -> DataFrame:
    """cycle_count per node on a cycle; a loop of its own counts twice."""
    node = F.explode("nodes")
    return cycles.select(group, "length", node.alias("node")).groupBy(group, "node").agg(F.sum(F.when(F.col("length") == 1, 2).otherwise(1)).alias("cycle_count"))


def cycle_edges(cycles: DataFrame, group: str) -> DataFrame:
    """The consecutive pairs of each cycle, the last one leading back to the first."""
    nxt = F.concat(F.slice("nodes", F.lit(2), F.size("nodes")), F.array(F.get("nodes", F.lit(0))))
    pairs = F.zip_with("nodes", nxt, lambda a, b: F.struct(a.alias("src"), b.alias("dst")))
    return cycles.select(group, "cycle_id", F.posexplode(pairs).alias("position", "e")).select(group, "cycle_id", "position", "e.src", "e.dst")


def impact(edges: DataFrame, targets: DataFrame, group: str, direction: str = "dependents", max_depth: int = 5) -> DataFrame:
    """group, target, node, depth, path, relation: what depends on each target (or what it depends on), breadth first.

    ``targets``: (group, target). Of several shortest paths the least counts. ``max_depth`` is held to 1..10.
    """
    if direction not in ("dependents", "dependencies"):
        raise ValueError("direction is dependents or dependencies")
    scratch = Scratch(edges.sparkSession, "impact")
    a, b = ("dst", "src") if direction == "dependents" else ("src", "dst")
    step = edges.select(group, F.col(a).alias("node"), F.col(b).alias("next")).distinct()
    front = targets.select(group, "target", F.col("target").alias("node"), F.array("target").alias("path")).distinct()
    seen, out = front.select(group, "target", "node"), []
    for depth in range(1, min(10, max(1, max_depth)) + 1):
        ahead = front.join(step, [group, "node"]).select(group, "target", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"))
        fresh = ahead.join(seen, [group, "target", "node"], "left_anti").groupBy(group, "target", "node").agg(F.min("path").alias("path"))
        front = scratch.write(fresh)
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front.select(group, "target", "node"))
        out.append(front.select(group, "target", "node", F.lit(depth).alias("depth"), "path", F.lit("direct" if depth == 1 else "transitive").alias("relation")))
    if not out:
        return front.limit(0).select(group, "target", "node", F.lit(0).alias("depth"), "path", F.lit("").alias("relation"))
    return reduce(DataFrame.unionByName, out)


def graph_view(degree: DataFrame, edges: DataFrame, group: str, max_nodes: int = 60, min_degree: int = 0, focus: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes of highest degree per group (or ``focus`` and its neighbours) and the edges between them, one per pair."""
    total = F.col("fan_in") + F.col("fan_out")
    if focus is None:
        w = Window.partitionBy(group).orderBy(total.desc(), F.asc("node"))
        kept = degree.filter(total >= min_degree).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= max_nodes).select(group, "node", "fan_in", "fan_out")
    else:
        near = edges.filter((F.col("src") == focus) | (F.col("dst") == focus)).select(group, F.explode(F.array("src", "dst")).alias("node")).unionByName(degree.filter(F.col("node") == focus).select(group, "node")).distinct()
        kept = degree.join(near, [group, "node"], "left_semi").select(group, "node", "fan_in", "fan_out")
    ends = kept.select(group, "node")
    inner = edges.select(group, "src", "dst").distinct().join(ends.withColumnRenamed("node", "src"), [group, "src"], "left_semi").join(ends.withColumnRenamed("node", "dst"), [group, "dst"], "left_semi")
    return kept, inner
