"""Consolidating pairwise matches into groups: connected components by seed-tree pruning.

Each round every vertex learns the smallest vertex of its neighbourhood (itself included) and tells its neighbours
about it; a vertex that nobody names as a minimum drops out and hangs below the smallest vertex it was told of, in the
propagation forest; the others stay, linked to that smallest vertex. The graph that remains shrinks quickly until only
seeds, the minima of the components, are left. Then the seeds' identifiers flow down the forest by pointer doubling.

Vertices are 64-bit codes (a run checks that no two vertices share one, and reseeds if they do), so an edge is two longs;
from ``pointers.NARROW_ROWS`` rows on codes have 128 bits. Neighbourhood minima are plain aggregations that combine
before the shuffle: a vertex with a third of all edges costs no task more than its share. Where a vertex's minimum goes
back to its edges, where pointers of the forest lead to one hub, and where the name of a very large group goes to its
members, the few frequent keys are broadcast instead of shuffled: see ``skew``.

Defined results
* A self pair or a pair with one null end names its vertices but links nothing else; a null vertex is none.
* Mirrored and repeated pairs count once. Shared-key links (``key``) join all vertices of a scope that occur with the
  same non-empty key: each row links its vertices to an auxiliary vertex for the key, never all pairs within a key.
* Empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.pointers import NARROW_ROWS, code, follow, union_all
from quarry.scratch import Scratch
from quarry.skew import hot_counted, join_one


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` (u, v longs, any direction, repeats and loops allowed) -> (v, seed), seed = smallest vertex of the component."""
    graph = scratch.write(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    forest: list[DataFrame] = []
    everyone: DataFrame | None = None
    while True:
        size = graph.count()
        if not size:
            break
        ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        both = graph.select(F.explode(ends).alias("e")).select("e.u", "e.v")
        low = scratch.write(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        hot = hot_counted(low.select("u", "n"), "u", 2 * size)
        # told(w, m): w is told of m, the minimum of a neighbour's (or its own) neighbourhood
        told = join_one(both, low.select("u", "m"), "u", hot).select(F.col("v").alias("w"), "m").unionByName(low.select(F.col("u").alias("w"), "m")).distinct()
        told = scratch.write(told)
        best = told.groupBy("w").agg(F.min("m").alias("low"), F.max((F.col("m") == F.col("w")).cast("int")).alias("own"), F.max("m").alias("high"))
        best = scratch.write(best)
        more = best.filter("low <> high").select("w", "low")
        busy = hot.withColumnRenamed("u", "w") if hot is not None else None
        rest = join_one(told, more, "w", busy).filter("m <> low").select(F.col("low").alias("u"), F.col("m").alias("v")).distinct()
        new = scratch.write(rest)
        forest.append(scratch.write(best.filter("own = 0").select(F.col("w").alias("v"), F.col("low").alias("p"))))
        scratch.drop(graph, told, best)
        if everyone is None:
            everyone = low.select(F.col("u").alias("v"))
        else:
            scratch.drop(low)
        graph = new
    if everyone is None:
        return graph.select("v", F.col("u").alias("seed"))
    # who never dropped out is the seed of its component; the seeds' identifiers flow down the forest
    fallen = union_all(forest)
    seeds = scratch.write(everyone.join(fallen.select("v"), "v", "left_anti"))
    settled, rest = follow(fallen, seeds, scratch)
    if rest is not None:
        raise AssertionError("the forest has no cycles")
    return settled.select("v", F.col("root").alias("seed"))


def _tagged(c: Column, bit: int, wide: bool) -> Column:
    """Codes of named vertices and of shared keys never meet: the last bit, or a byte in front, tells them apart."""
    if wide:
        return F.concat(F.unhex(F.lit(f"0{bit}")), c)
    return c.bitwiseOR(F.lit(1)) if bit else c.bitwiseAND(F.lit(-2))


def group_matches(pairs: DataFrame, scope: Column, source: Column, target: Column, key: Column, name: str = "file_path") -> DataFrame:
    """scope, ``name``, group_id (the smallest name of the group within the scope) for every vertex named in ``pairs``."""
    scratch = Scratch(pairs.sparkSession, "groups", tidy=True)
    count = pairs.count()
    seed, wide = 0, count > NARROW_ROWS

    def vertex(c: str) -> Column:
        return _tagged(code(wide, seed, F.lit("v"), "s", c), 0, wide)

    def shared(k: str) -> Column:
        return _tagged(code(wide, seed, F.lit("k"), "s", k), 1, wide)

    while True:
        rows = pairs.select(scope.alias("s"), source.alias("a"), target.alias("b"), F.when(key != "", key).alias("k"))
        named = rows.select("s", F.explode(F.array("a", "b")).alias("x")).filter("x is not null")
        vertices = scratch.write(named.distinct().withColumn("v", vertex("x")))
        clash = vertices.groupBy("v").count().filter("count > 1")
        keys = rows.filter("k is not null").groupBy(shared("k").alias("h")).agg(F.min(F.hash("s", "k")).alias("c0"), F.max(F.hash("s", "k")).alias("c1"))
        if wide or (not clash.limit(1).count() and not keys.filter("c0 <> c1").limit(1).count()):
            break
        scratch.drop(vertices)
        seed += 1
    one = F.coalesce("a", "b")
    ends = F.array(
        F.struct(F.when(one.isNotNull(), vertex("one")).alias("u"), F.when(F.coalesce("b", "a").isNotNull(), vertex("two")).alias("v")),
        F.struct(F.when(one.isNotNull(), vertex("one")).alias("u"), F.when(F.col("k").isNotNull() & one.isNotNull(), shared("k")).alias("v")),
    )
    linked = rows.withColumns({"one": one, "two": F.coalesce("b", "a")}).select(F.explode(ends).alias("e")).select("e.u", "e.v").filter("u is not null and v is not null")
    comps = scratch.write(components(linked, scratch))
    member = scratch.write(vertices.join(comps, "v").select("s", "x", "seed"))
    scratch.drop(vertices, comps)
    least = scratch.write(member.groupBy("seed").agg(F.min("x").alias("group_id"), F.count("*").alias("n")))
    hot = hot_counted(least.select("seed", "n"), "seed", 2 * count)
    return join_one(member, least.drop("n"), "seed", hot).select(F.col("s").alias("scope"), F.col("x").alias(name), "group_id")
