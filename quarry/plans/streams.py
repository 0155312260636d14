"""Streaming queries: the events table read as a stream, up to what is there now."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.scratch import shared_folder
from quarry.streaming import progress


def _events(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    kind = F.col("ts").cast("timestamp")
    # a folder that holds the table is what a file stream watches; the name picks the table in it
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parque[t]")
    return rows.withColumn("ts", kind)


def _run(rows: DataFrame, label: str, mode: str) -> DataFrame:
    base = f"{shared_folder(rows.sparkSession)}/stream-{label}-{uuid.uuid4().hex}"
    return progress.replay(rows, f"{base}/out", f"{base}/checkpoint", f"quarry_{label}_{uuid.uuid4().hex}", mode)


def latest_status(spark: SparkSession, d: str) -> DataFrame:
    out = _run(progress.latest_status(_events(spark, d), "user_id", "ts", ["event_id", "event_type"]), "latest", "complete")
    return out.select("user_id", "event_id", "event_type")


def session_limits(spark: SparkSession, d: str) -> DataFrame:
    out = _run(progress.session_limit(_events(spark, d), "event_type", "ts", 5, "10 minutes"), "limit", "complete")
    return out.select("event_type", F.col("started").cast("timestamp_ntz").alias("started"), "requests", "rejected")


def silent_runs(spark: SparkSession, d: str) -> DataFrame:
    out = _run(progress.silent_sessions(_events(spark, d), "user_id", "ts", "1 hour"), "silent", "complete")
    return out.select("user_id", F.col("silent_at").cast("timestamp_ntz").alias("silent_at"), "events")


def sliding_limits(spark: SparkSession, d: str) -> DataFrame:
    rows = progress.sliding_limit(_events(spark, d), "event_type", "ts", 3, 600)
    return _run(rows, "sliding", "append").groupBy("event_type", "allowed").agg(F.count("*").alias("requests"))


def event_feeds(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("event", F.when(F.col("event_type") == "error", "error").otherwise(F.col("event_type")))
    return _run(progress.event_feed(e, "user_id", "event", "ts", "props", idle=None), "feed", "append").filter("event <> 'ping'").select("user_id", "seq", "event")


STREAMS = {f.__name__: f for f in (latest_status, session_limits, silent_runs, sliding_limits, event_feeds)}
STREAM_SQL = {
    "latest_status": "select user_id, m.event_id event_id, m.event_type event_type from (select user_id, max({'ts': ts, 'event_id': event_id, 'event_type': event_type}) m from events group by 1)",
    "session_limits": """with s as (select event_type, ts, case when lag(ts) over w is null or ts >= lag(ts) over w + interval 10 minutes then 1 else 0 end o from events window w as (partition by event_type order by ts)),
i as (select event_type, ts, sum(o) over (partition by event_type order by ts rows unbounded preceding) k from s)
select event_type, min(ts) started, count(*) requests, greatest(0, count(*) - 5) rejected from i group by event_type, k""",
    "silent_runs": """with s as (select user_id, ts, case when lag(ts) over w is null or ts >= lag(ts) over w + interval 1 hour then 1 else 0 end o from events window w as (partition by user_id order by ts)),
i as (select user_id, ts, sum(o) over (partition by user_id order by ts rows unbounded preceding) k from s)
select user_id, max(ts) + interval 1 hour silent_at, count(*) events from i group by user_id, k""",
    "event_feeds": """with n as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_type, event_id) seq from events), f as (select user_id, min(seq) s from n where event_type = 'error' group by 1)
select n.user_id, seq, event_type "event" from n left join f using (user_id) where s is null or seq <= s""",
}
