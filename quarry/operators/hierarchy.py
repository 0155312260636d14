"""Parent-child rows into full hierarchies, by pointer doubling.

Every node starts with a pointer to its parent. A round joins each pending pointer with its target's state: a target
that knows its root settles the node, a pending target doubles the jump. Depth d settles in about log2(d) rounds; a
round that settles nobody proves that the rest lie on or below cycles. Path segments are concatenated along with the
jumps. See ``pointers`` for what a round reads, and ``skew`` for parents with very many children.

Nodes are 64-bit codes of their ids, so a state row is a few longs; each run checks that no two ids share a code and
takes another seed if they do. From ``pointers.NARROW_ROWS`` rows on codes have 128 bits, and none is shared.

Defined results
* Several rows of one id: the row first in ``order`` counts; ids and links compare without letter case.
* A null or empty id is no node. A parent that is null, empty or no node's id makes a root (depth 0).
* On or below a cycle: depth -1, root = the smallest id on that cycle, path null. A node that is its own parent is a cycle.
* A null name counts as an empty path segment. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.pointers import BROADCAST_ROWS_PATHS, NARROW_ROWS, code, follow
from quarry.scratch import Scratch
from quarry.skew import hot_counted, hot_keys, join_one


def _nodes(rows: DataFrame, id_: Column, parent: Column, name: Column | None, order: Sequence[Column], scratch: Scratch) -> tuple[DataFrame, int]:
    """One row per node: h, id, ph (code of the parent, null where there is none), name. And their number."""
    seed, wide = 0, rows.count() > NARROW_ROWS
    while True:
        base = rows.select(F.lower(id_).alias("id"), F.lower(parent).alias("parent"), *([name.alias("name")] if name is not None else []), *[o.alias(f"o{i}") for i, o in enumerate(order)])
        base = base.filter("id is not null and id <> ''").withColumn("parent", F.expr("nullif(parent, '')"))
        value = F.struct("id", "parent", *(["name"] if name is not None else []))
        key = F.struct(*[f"o{i}" for i in range(len(order))], "parent", *(["name"] if name is not None else []))
        best = base.groupBy(code(wide, seed, "id").alias("h")).agg(F.max_by(value, key).alias("v"), F.min(F.hash("id")).alias("c0"), F.max(F.hash("id")).alias("c1"))
        out = best.select("h", "v.*", (F.col("c0") != F.col("c1")).alias("clash")).withColumn("ph", F.when(F.col("parent").isNotNull(), code(wide, seed, "parent"))).drop("parent")
        table = scratch.write(out)
        counts = table.agg(F.count("*"), F.count_if("clash")).first()
        if not counts[1]:
            return table.drop("clash"), counts[0]
        scratch.drop(table)
        seed += 1


def resolve(
    rows: DataFrame,
    id_: Column,
    parent: Column,
    order: Sequence[Column],
    name: Column | None = None,
    separator: str = ".",
) -> DataFrame:
    """symbol_id, root_id, tree_depth and, with ``name``, path (names from the root down, joined by ``separator``)."""
    scratch = Scratch(rows.sparkSession, "hierarchy")
    nodes, count = _nodes(rows, id_, parent, name, order, scratch)
    extra = ["path"] if name is not None else []
    mine = nodes.select("h", "ph", *[F.coalesce("name", F.lit("")).alias("path") for _ in extra])
    known = nodes.select(F.col("h").alias("ph"), F.lit(True).alias("there"))
    first = join_one(mine, known, "ph", hot_keys(mine.filter("ph is not null"), "ph", count), "left")
    state = scratch.write(first.select(F.col("h").alias("v"), F.when(F.col("there"), F.col("ph")).alias("p"), *extra))
    tree, loops = follow(state.filter("p is not null"), state.filter("p is null").drop("p"), scratch, separator)
    ids = nodes.select(F.col("h").alias("v"), "id")
    named = tree.join(ids, "v")
    sizes = tree.groupBy("root").agg(F.count("*").alias("n"))
    roots = named.filter("depth = 0").select("root", F.col("id").alias("root_id"))
    out = join_one(named, roots, "root", hot_counted(sizes, "root", count)).select(F.col("id").alias("symbol_id"), "root_id", F.col("depth").alias("tree_depth"), *extra)
    if loops is not None:
        looped = _cycles(loops.select(F.col("v").alias("h")), nodes, loops.count(), scratch)
        out = out.unionByName(looped.select(F.col("id").alias("symbol_id"), "root_id", F.lit(-1).alias("tree_depth"), *[F.lit(None).cast("string").alias("path") for _ in extra]))
    return out


def _cycles(pending: DataFrame, nodes: DataFrame, count: int, scratch: Scratch) -> DataFrame:
    """id, root_id of the nodes on or below cycles. All their pointers stay within the set.

    Doubling again, with the smallest id met within the jump. The nodes that still are targets of jumps shrink to
    the cycles: once a round leaves their number as it is, they are the cycles. Once a round lowers no minimum
    among them, each minimum is that of its whole cycle.
    """
    small = count <= BROADCAST_ROWS_PATHS
    some = F.broadcast(pending) if small else pending
    state = scratch.write(nodes.join(some, "h").select("h", "id", F.col("ph").alias("ptr"), F.col("id").alias("low")))
    targets = -1
    while True:
        t = state.select(F.col("h").alias("ptr"), F.col("ptr").alias("next"), F.col("low").alias("tlow"))
        both = state.join(F.broadcast(t), "ptr") if small else join_one(state, t, "ptr", hot_keys(state, "ptr", count))
        new = scratch.write(both.select("h", "id", F.col("next").alias("ptr"), F.least("low", "tlow").alias("low"), (F.col("tlow") < F.col("low")).alias("moved")))
        on = new.select(F.col("ptr").alias("h")).distinct().withColumn("target", F.lit(True))
        seen = new.join(F.broadcast(on) if small else on, "h", "left").agg(F.count_if("target"), F.count_if(F.col("target") & F.col("moved"))).first()
        now, still = seen[0], not seen[1]
        scratch.drop(state)
        state = new
        if now == targets and still:
            break
        targets = now
    low = state.select(F.col("h").alias("ptr"), F.col("low").alias("root_id"))
    mine = state.select("id", "ptr")
    return (mine.join(F.broadcast(low), "ptr") if small else join_one(mine, low, "ptr", hot_keys(mine, "ptr", count))).select("id", "root_id")


def descendants(rows: DataFrame, id_: Column, parent: Column, order: Sequence[Column], cyclic: bool = False) -> DataFrame:
    """ancestor_id, descendant_id, distance (1 and more) for all nodes of acyclic trees and, with ``cyclic``, of all others.

    Doubling of reach: pairs up to distance 2^k, joined with jumps of exactly 2^k, give the pairs up to 2^(k+1), so
    every pair is made once. With ``cyclic`` the one link that leads out of the smallest id of each cycle is cut, which
    leaves a tree below that id; the pairs that go through the cut link are added in the end. A node of a cycle is then an
    ancestor of every other node on and below the cycle, at the least distance, and never of itself.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "descendants")
    solved = resolve(rows, id_, parent, order)
    if not cyclic:
        solved = solved.filter("tree_depth >= 0")
    tree = scratch.write(solved.select(F.col("symbol_id").alias("id"), "root_id", "tree_depth"))
    value = F.struct(F.lower(parent).alias("parent"))
    links = (
        rows.groupBy(F.lower(id_).alias("id")).agg(F.max_by(value, F.struct(*order, F.lower(parent))).alias("v"))
        .select("id", "v.parent").join(tree.filter("tree_depth <> 0"), "id")
    )
    uncut = links.filter("tree_depth > 0 or id <> root_id")
    pairs = scratch.write(uncut.select(F.col("parent").alias("ancestor_id"), F.col("id").alias("descendant_id"), F.lit(1).alias("distance")))
    parts, jump, step = [pairs], pairs.select(F.col("ancestor_id").alias("a"), F.col("descendant_id").alias("d")), 1
    while True:
        reach = parts[0]
        for p in parts[1:]:
            reach = reach.unionByName(p)
        # reach holds distances 1..step; jump holds exactly step
        far = scratch.write(
            reach.join(jump, reach["ancestor_id"] == jump["d"]).select(F.col("a").alias("ancestor_id"), "descendant_id", (F.col("distance") + F.lit(step)).cast("int").alias("distance"))
        )
        if not far.limit(1).count():
            break
        parts.append(far)
        jump = far.filter(F.col("distance") == 2 * step).select(F.col("ancestor_id").alias("a"), F.col("descendant_id").alias("d"))
        step *= 2
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if not cyclic:
        return out
    looped = tree.filter("tree_depth < 0").select("id", "root_id")
    below = looped.join(out, (looped["id"] == out["descendant_id"]) & (looped["root_id"] == out["ancestor_id"]), "left").select("id", "root_id", F.coalesce("distance", F.lit(0)).alias("depth"))
    below = scratch.write(below)
    # the cycle: from the parent of its smallest id, where the cut link ends, up to the smallest id
    ends = links.filter("tree_depth < 0 and id = root_id").select("root_id", F.col("parent").alias("end"))
    up = out.join(ends, out["descendant_id"] == ends["end"]).select("root_id", F.col("ancestor_id").alias("id")).unionByName(ends.select("root_id", F.col("end").alias("id")))
    ring = up.join(below, ["root_id", "id"]).select("root_id", F.col("id").alias("ancestor_id"), F.col("depth").alias("at"))
    ring = ring.join(ring.groupBy("root_id").agg(F.count("*").alias("length")), "root_id")
    through = below.join(ring, "root_id").filter("id <> ancestor_id").select("ancestor_id", F.col("id").alias("descendant_id"), (F.col("depth") + F.col("length") - F.col("at")).cast("int").alias("distance"))
    return out.unionByName(through.join(out.select("ancestor_id", "descendant_id"), ["ancestor_id", "descendant_id"], "left_anti"))
