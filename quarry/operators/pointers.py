"""Following pointers to their ends, by doubling.

Every row points at another one or is an end. A round settles the rows whose target settled in the round before, and
lets every other row jump over its target, unless the target settles in this round. So a pointer always leads to a pending row
or to one that has just settled, and a round reads only these: a settled row is read once more and never again. Rows
less than 2^r steps from their end settle by round r; a round that settles nobody proves that the rest never end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.scratch import Scratch
from quarry.skew import hot_keys, join_one

#: Rows up to which codes have 64 bits: beyond, two of some 2^28 ids could share one, and codes have 128 bits.
NARROW_ROWS = 1 << 28
#: Pending rows (a few longs each, plus a path where asked for) up to which a round broadcasts them.
BROADCAST_ROWS, BROADCAST_ROWS_PATHS = 100_000, 10_000


def code(wide: bool, seed: int, *parts: Column | str) -> Column:
    """A code of the parts: a long, or 16 bytes where ``wide``. Nulls and empty strings differ."""
    if not wide:
        return F.xxhash64(F.lit(seed), *parts)
    text = F.to_json(F.array(*[p.cast("string") if isinstance(p, Column) else F.col(p).cast("string") for p in parts]))
    return F.unhex(F.md5(F.concat(F.lit(f"{seed}:"), text)))


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def follow(links: DataFrame, ends: DataFrame, scratch: Scratch, separator: str = ".") -> tuple[DataFrame, DataFrame | None]:
    """``links``: v, p and maybe path; ``ends``: v and maybe path. -> (v, root, depth[, path]) of all that end, and the links left.

    ``path``: the row's own piece; pieces are joined by ``separator`` from the end down.
    """
    paths = ["path"] if "path" in links.columns else []
    limit = BROADCAST_ROWS_PATHS if paths else BROADCAST_ROWS
    joined = [F.concat_ws(separator, "above", "path").alias("path") for _ in paths]
    done = [ends.select("v", F.col("v").alias("root"), F.lit(0).alias("depth"), *paths)]
    pending = links.select("v", "p", F.lit(1).alias("dist"), *paths)
    left = pending.count()
    while left > limit:
        last = done[-1].select(F.col("v").alias("p"), "root", "depth", *[F.col("path").alias("above") for _ in paths])
        hot = hot_keys(pending, "p", left)
        tagged = scratch.write(join_one(pending, last, "p", hot, "left").select("v", "p", "dist", *paths, "root", F.col("depth").alias("up"), *[F.col("above") for _ in paths]))
        done.append(tagged.filter("root is not null").select("v", "root", (F.col("up") + F.col("dist")).cast("int").alias("depth"), *joined))
        rest = tagged.filter("root is null").select("v", "p", "dist", *paths)
        now = rest.count()
        if now in (0, left):
            return union_all(done), rest.select("v", "p") if now else None
        state = tagged.select(F.col("v").alias("p"), F.col("root").isNotNull().alias("stays"), F.col("p").alias("q"), F.col("dist").alias("more"), *[F.when(F.col("root").isNull(), F.col("path")).alias("above") for _ in paths])
        jump = ~F.col("stays")
        pending = scratch.write(
            join_one(rest, state, "p", hot).select(
                "v", F.when(jump, F.col("q")).otherwise(F.col("p")).alias("p"), F.when(jump, F.col("dist") + F.col("more")).otherwise(F.col("dist")).cast("int").alias("dist"),
                *[F.when(jump, F.concat_ws(separator, "above", "path")).otherwise(F.col("path")).alias("path") for _ in paths],
            )
        )
        left = now
    if not left:
        return union_all(done), None
    # few rows are left: once to where the many settled ones lie, then among themselves
    last = done[-1].select(F.col("v").alias("p"), "root", "depth", *[F.col("path").alias("above") for _ in paths])
    near = last.join(F.broadcast(pending), "p").select("v", "root", (F.col("depth") + F.col("dist")).alias("depth"), *joined)
    mine = pending.withColumnRenamed("path", "own") if paths else pending
    table = scratch.write(mine.join(F.broadcast(near), "v", "left").select("v", "p", "dist", "root", "depth", *[F.coalesce("path", "own").alias("path") for _ in paths]))
    while True:
        now = table.filter("root is null").count()
        if now in (0, left):
            rest = table.filter("root is null").select("v", "p") if now else None
            return union_all([*done, table.filter("root is not null").select("v", "root", "depth", *paths)]), rest
        t = table.select(F.col("v").alias("p"), F.col("root").alias("r"), F.col("depth").alias("up"), F.col("p").alias("q"), F.col("dist").alias("more"), *[F.col("path").alias("above") for _ in paths])
        new = table.filter("root is null").join(F.broadcast(t), "p").select(
            "v", F.col("q").alias("p"), (F.col("dist") + F.col("more")).cast("int").alias("dist"), F.col("r").alias("root"), (F.col("up") + F.col("dist")).cast("int").alias("depth"), *joined
        )
        table = scratch.write(table.filter("root is not null").unionByName(new).coalesce(4))
        left = now
