"""Streams of run events: latest state, silence, rate limits, per-run event feeds.

All take and give streaming DataFrames (they also run on batches, for checks). State is evicted by watermarks;
later rows are dropped, which is this engine's own policy.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TERMINAL = ("complete", "error", "cancelled")


def events_json(rows: DataFrame, key: str, event: str = "event") -> DataFrame:
    """Sink format: one key and one JSON value per event."""
    rest = [c for c in rows.columns if c not in (key, event)]
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(F.col(event).alias("event"), F.struct(*rest).alias("data"))).alias("value"))


def latest_status(rows: DataFrame, key: str, ts: str, values: list[str], delay: str | None = None) -> DataFrame:
    """The newest values per key; for streams in update or complete mode. Ties: the greatest values."""
    if delay:
        rows = rows.withWatermark(ts, delay)
    return rows.groupBy(key).agg(F.max(F.struct(ts, *values)).alias("m")).select(key, F.col(f"m.{ts}").alias(ts), *[F.col(f"m.{v}").alias(v) for v in values])


def silent_sessions(rows: DataFrame, key: str, ts: str, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Stretches of activity per key that ended in ``gap`` of silence: start, end of silence, events."""
    w = F.session_window(F.col(ts), gap)
    return rows.withWatermark(ts, delay).groupBy(key, w.alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("silent_at"), "events")


def session_limit(rows: DataFrame, key: str, ts: str, limit: int, window: str = "60 seconds", delay: str = "60 seconds") -> DataFrame:
    """The counter that each request prolongs: per stretch without ``window`` of silence, requests and how many are beyond ``limit``."""
    s = silent_sessions(rows, key, ts, window, delay)
    return s.select(key, "started", "silent_at", F.col("events").alias("requests"), F.greatest(F.lit(0), F.col("events") - limit).alias("rejected"))


def sliding_limit(rows: DataFrame, key: str, ts: str, limit: int, seconds: int = 60) -> DataFrame:
    """Each request's verdict under a sliding log: refused if ``limit`` accepted ones lie within the last ``seconds``.

    Refused requests are not recorded, so verdicts depend on earlier ones: state per key is the accepted times
    within the window, at most ``limit`` of them. Requests are taken in order of time within each batch.
    """
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, {ts} timestamp, allowed boolean"

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        times = sorted(pd.Timestamp(t).value // 1000 for p in parts for t in p[ts])
        out = []
        for t in times:
            kept = [x for x in kept if x > t - seconds * 1_000_000]
            ok = len(kept) < limit
            if ok:
                kept.append(t)
            out.append(ok)
        state.update((kept,))
        yield pd.DataFrame({key: [k[0]] * len(times), ts: pd.to_datetime(times, unit="us"), "allowed": out})

    return rows.select(key, ts).groupBy(key).applyInPandasWithState(run, schema, "kept array<bigint>", "append", GroupStateTimeout.NoTimeout)


def event_feed(rows: DataFrame, key: str, event: str, ts: str, data: str, idle: str | None = "15 seconds") -> DataFrame:
    """What a subscriber of each key sees: events in order up to the first terminal one, and a ``ping`` after ``idle``
    without events (none without ``idle``, for replays that must end).

    A key's state is its last event and whether it has ended; later events of an ended key are dropped.
    """
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, seq bigint, event string, data string"
    milliseconds = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, ended = state.get if state.exists else (0, False)
        out = []
        if state.hasTimedOut:
            out.append((k[0], seq, "ping", None))
            state.setTimeoutDuration(milliseconds)
        else:
            new = pd.concat(list(parts)).sort_values([ts, event], kind="stable")
            for e, d in zip(new[event], new[data]):
                if ended:
                    break
                seq += 1
                out.append((k[0], seq, e, d))
                ended = e in TERMINAL
            state.update((seq, ended))
            if not ended and milliseconds:
                state.setTimeoutDuration(milliseconds)
        yield pd.DataFrame(out, columns=[key, "seq", "event", "data"])

    return rows.select(key, event, ts, data).groupBy(key).applyInPandasWithState(run, schema, "seq bigint, ended boolean", "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


def cancellations(rows: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Checkpoints of runs with the verdict of a table of cancel requests (key, requested_at, valid for an hour)."""
    asked = requests.groupBy(key).agg(F.max("requested_at").alias("requested_at"))
    alive = F.col("requested_at").isNotNull() & (F.col("ts") >= F.col("requested_at")) & (F.col("ts") < F.col("requested_at") + F.expr("interval 1 hour"))
    return rows.join(asked, key, "left").withColumn("stop", alive)


def replay(rows: DataFrame, folder: str, checkpoint: str, name: str, mode: str = "append") -> DataFrame:
    """Run a streaming DataFrame over all that is there now into files, for checks and batch use.

    Outside append mode a batch gives the whole result, which takes the place of the one before; no row passes the driver.
    """
    spark, schema = rows.sparkSession, rows.schema
    if mode == "append":
        rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    else:
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(folder)  # of a stream without files no batch runs
        whole = lambda batch, _: batch.write.mode("overwrite").parquet(folder)
        rows.writeStream.foreachBatch(whole).queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(folder)
