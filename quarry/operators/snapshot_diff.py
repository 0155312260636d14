"""What changed between consecutive full snapshots of a table.

All snapshots of a series are laid out once, range-partitioned by (series, record key) and sorted by (series,
record key, snapshot position). One pass over each range is then a merge of every snapshot with its predecessor at
the same time: a record's neighbours in that order are its own earlier and later versions, so the pass looks one row
back and one row ahead and emits typed changes. There is one shuffle and one sort for any number of snapshots, and a
busy series is cut into ranges by record key, so no task holds a whole series.

Defined results
* A record more than once in a snapshot: the row first in ``order`` counts.
* A null in a key column is a value of its own (nulls are equal to each other).
* ``fingerprint`` columns are compared null-safely.
* The first snapshot of a series yields nothing; a snapshot without rows counts as empty, so every record of its
  predecessor is ``removed``. Rows of unknown snapshots are ignored. Empty tables give an empty result.
* Extra columns of the inputs are ignored; only the named ones are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Snapshots (three short values each) up to which their positions are broadcast, after a count.
BROADCAST_SNAPSHOTS = 50_000


def snapshot_positions(snapshots: DataFrame, snapshot: Column, series: Column, order: Sequence[Column]) -> DataFrame:
    """One row per snapshot: its series, position, whether it is the last, and the id of its successor."""
    w = Window.partitionBy("sd_series").orderBy(*[F.col(f"sd_o{i}").asc_nulls_last() for i in range(len(order))], "sd_snapshot")
    return (
        snapshots.select(snapshot.alias("sd_snapshot"), series.alias("sd_series"), *[o.alias(f"sd_o{i}") for i, o in enumerate(order)])
        .select("sd_snapshot", "sd_series", F.row_number().over(w).alias("sd_pos"), F.lead("sd_snapshot").over(w).alias("sd_next"))
    )


def diff_snapshots(
    rows: DataFrame,
    positions: DataFrame,
    snapshot: Column,
    key: dict[str, Column],
    fingerprint: dict[str, Column],
    order: Sequence[Column],
    kind: str = "change_kind",
) -> DataFrame:
    """Columns: ``snapshot`` (the later one), the key columns, and ``kind`` in added, removed, changed.

    ``positions`` comes from :func:`snapshot_positions`; ``order`` ranks repeated rows of one record, best first.
    """
    names = list(key)
    marks = [c.alias(f"sd_f_{n}") for n, c in fingerprint.items()]
    ranks = [o.alias(f"sd_r{i}") for i, o in enumerate(order)]
    given = rows.select(snapshot.alias("sd_snapshot"), *[c.alias(f"sd_k_{n}") for n, c in key.items()], *marks, *ranks)
    kept_names, rank_names = [f"sd_f_{n}" for n in fingerprint], [f"sd_r{i}" for i in range(len(order))]
    # repeated rows are folded where they lie, before anything is shuffled; equal ranks go by the compared values
    once = given.groupBy("sd_snapshot", *[f"sd_k_{n}" for n in names]).agg(F.max_by(F.struct(*kept_names), F.struct(*rank_names, *kept_names)).alias("sd_f"))
    few = positions.limit(BROADCAST_SNAPSHOTS + 1).count() <= BROADCAST_SNAPSHOTS
    tagged = once.join(F.broadcast(positions) if few else positions, "sd_snapshot").select("*", "sd_f.*").drop("sd_f")
    keys = ["sd_series", *[f"sd_k_{n}" for n in names]]
    kept = tagged.repartitionByRange(*keys)
    line = Window.partitionBy(*keys).orderBy("sd_pos")
    before = F.lag("sd_pos").over(line)
    after = F.lead("sd_pos").over(line)
    same = F.lit(True)
    for n in fingerprint:
        same = same & F.col(f"sd_f_{n}").eqNullSafe(F.lag(f"sd_f_{n}").over(line))
    arrived = (
        F.when(F.col("sd_pos") == 1, F.lit(None).cast("string"))
        .when(before.isNull() | (before != F.col("sd_pos") - 1), F.lit("added"))
        .when(~same, F.lit("changed"))
    )
    left = F.when(F.col("sd_next").isNotNull() & (after.isNull() | (after != F.col("sd_pos") + 1)), F.lit("removed"))
    events = F.filter(
        F.array(
            F.struct(F.col("sd_snapshot").alias("s"), F.col("sd_in").alias("c")),
            F.struct(F.col("sd_next").alias("s"), F.col("sd_out").alias("c")),
        ),
        lambda e: e["c"].isNotNull(),
    )
    return (
        kept.withColumns({"sd_in": arrived, "sd_out": left})
        .filter("sd_in is not null or sd_out is not null")
        .select(F.explode(events).alias("e"), *[F.col(f"sd_k_{n}").alias(n) for n in names])
        .select(F.col("e.s").alias("snapshot"), *names, F.col("e.c").alias(kind))
    )
