"""Top N items within every group, by simultaneous bisection of all groups.

Scores become 64-bit codes of the same order (the bits of the double, sign-adjusted, by plain arithmetic); the
identifier follows as codes of six bytes each. A round cuts every group's open interval at many midpoints at once,
counts the rows above each of them (an aggregation that combines before the shuffle, so a group of millions is
counted where its rows lie), and keeps the one bucket that the N-th row falls into: rows above it are in, rows below
it are out, and only the bucket stays open. An interval that has shrunk to one code moves on to the next code of the
chain. All groups go on until each holds exactly N rows (or all its rows); only then are these at most N rows ranked.
No task ever holds a group, and after the first round hardly any rows are left to read.

Defined results
* Rows with a null group or a null identifier are left out, and so are rows whose first score is null or NaN.
* A null or NaN in a later score orders below every number. -0.0 equals 0.0.
* Identifiers are unique within a group (``rows`` is made so by the caller), so ranks are 1..N without ties.
* A group of fewer than N rows keeps all of them. Empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.scratch import Scratch
from quarry.skew import hot_counted, join_one

#: Midpoints per round: 2^8 sections refine an interval as eight rounds of plain halving would.
SECTIONS = 256
#: Rows of the cut table (one per open group, under 150 bytes each) up to which it is broadcast, after a count.
BROADCAST_ROWS = 5_000
#: Bytes of the identifier in one code.
CHUNK = 6


def order_code(x: Column) -> Column:
    """A long with the order of the double ``x``; null and NaN become the least long. Exact for every double."""
    a = F.abs(x)
    guess = F.floor(F.log2(a))
    e = F.when(a < F.pow(F.lit(2.0), guess), guess - 1).when(a >= F.pow(F.lit(2.0), guess + 1), guess + 1).otherwise(guess)
    tiny = F.lit(2.0**-1022)
    bits = (
        F.when(a == 0, F.lit(0).cast("long"))
        .when(a == float("inf"), F.lit(0x7FF0000000000000))
        .when(a < tiny, (a * F.lit(2.0**537) * F.lit(2.0**537)).cast("long"))
        .otherwise((e.cast("long") + 1023) * F.lit(1 << 52) + ((a / F.pow(F.lit(2.0), e) - 1) * F.lit(2.0**52)).cast("long"))
    )
    return F.when(x.isNull() | F.isnan(x), F.lit(-(2**63))).otherwise(F.when(x < 0, -bits).otherwise(bits))


def _code(level: Column, scores: int) -> Column:
    """The code at ``level`` of the chain (scores first, then chunks of the identifier)."""
    out = F.when(level == 0, F.col("tn_c0"))
    for i in range(1, scores):
        out = out.when(level == i, F.col(f"tn_c{i}"))
    part = F.substring(F.encode("tn_id", "UTF-8"), ((level - scores) * CHUNK + 1).cast("int"), F.lit(CHUNK))
    value = F.conv(F.rpad(F.hex(part), 2 * CHUNK, "0"), 16, 10).cast("long")
    return out.otherwise(-(value * 8 + F.octet_length(part)))


def top_n(rows: DataFrame, group: Column, scores: Sequence[Column], identifier: Column, n: int, names: tuple[str, str, str] = ("group", "rank", "id")) -> DataFrame:
    """The ``n`` best rows of each group: group, rank, identifier (``names``). Scores descend, identifiers ascend by code point."""
    scratch = Scratch(rows.sparkSession, "topn")
    k = len(scores)
    clean = rows.select(group.alias("tn_g"), identifier.alias("tn_id"), *[s.cast("double").alias(f"tn_s{i}") for i, s in enumerate(scores)])
    clean = clean.filter("tn_g is not null and tn_id is not null and tn_s0 is not null and not isnan(tn_s0)")
    codes = [f"tn_c{i}" for i in range(k)]
    open_ = scratch.write(clean.select("tn_g", "tn_id", *[order_code(F.col(f"tn_s{i}")).alias(f"tn_c{i}") for i in range(k)]))
    ends = open_.agg(F.min("tn_c0"), F.max("tn_c0")).first()
    if ends[0] is None:
        return open_.select(F.col("tn_g").alias(names[0]), F.lit(1).alias(names[1]), F.col("tn_id").alias(names[2]))
    state = open_.withColumns({"tn_need": F.lit(n).cast("long"), "tn_level": F.lit(0), "tn_lo": F.lit(ends[0]).cast("long"), "tn_hi": F.lit(ends[1]).cast("long")})
    done: list[DataFrame] = []
    while True:
        width = F.expr(f"greatest(1L, (tn_hi div {SECTIONS}) - (tn_lo div {SECTIONS}) + 1L)")
        coded = state.withColumns({"tn_code": _code(F.col("tn_level"), k), "tn_then": _code(F.col("tn_level") + 1, k), "tn_w": width}).withColumn("tn_b", F.expr("tn_code div tn_w"))
        counted = coded.groupBy("tn_g", "tn_b").agg(
            F.count("*").alias("cnt"), F.min("tn_code").alias("lo"), F.max("tn_code").alias("hi"), F.min("tn_then").alias("lo2"), F.max("tn_then").alias("hi2"),
            F.first("tn_need").alias("need"), F.first("tn_level").alias("level"),
        )
        by = Window.partitionBy("tn_g").orderBy(F.desc("tn_b"))
        cut = (
            counted.withColumns({"cum": F.sum("cnt").over(by), "total": F.sum("cnt").over(Window.partitionBy("tn_g"))})
            .withColumn("need", F.least("need", "total"))
            .filter("cum >= need and cum - cnt < need")
            .withColumn("left", F.col("need") - (F.col("cum") - F.col("cnt")))
            .select("tn_g", F.col("total").alias("n"), F.col("tn_b").alias("cut"), "left", (F.col("left") == F.col("cnt")).alias("all_in"), "lo", "hi", "lo2", "hi2", (F.col("lo") == F.col("hi")).alias("tied"), "level")
        )
        cut = scratch.write(cut)
        groups, rows_left = cut.agg(F.count("*"), F.sum("n")).first()
        plain, ends_ = coded.drop("tn_need", "tn_level", "tn_lo", "tn_hi"), cut.drop("n")
        if groups <= BROADCAST_ROWS:
            joined = plain.join(F.broadcast(ends_), "tn_g")
        else:  # rows of huge groups stay where they are, see ``skew``
            joined = join_one(plain, ends_, "tn_g", hot_counted(cut.select("tn_g", "n"), "tn_g", rows_left))
        joined = joined.filter("tn_b >= cut")
        new = scratch.write(
            joined.select(
                "tn_g", "tn_id", *codes, (F.col("all_in") | (F.col("tn_b") > F.col("cut"))).alias("is_in"), F.col("left").alias("tn_need"),
                (F.col("level") + F.col("tied").cast("int")).alias("tn_level"), F.when(F.col("tied"), F.col("lo2")).otherwise(F.col("lo")).alias("tn_lo"), F.when(F.col("tied"), F.col("hi2")).otherwise(F.col("hi")).alias("tn_hi"),
            )
        )
        scratch.drop(open_, cut)
        done.append(new.filter("is_in").select("tn_g", "tn_id", *codes))
        open_ = None
        state = new.filter("not is_in").drop("is_in")
        if not state.limit(1).count():
            break
    kept = done[0]
    for t in done[1:]:
        kept = kept.unionByName(t)
    w = Window.partitionBy("tn_g").orderBy(*[F.desc(c) for c in codes], F.asc("tn_id"))
    return kept.select(F.col("tn_g").alias(names[0]), F.row_number().over(w).alias(names[1]), F.col("tn_id").alias(names[2]))
