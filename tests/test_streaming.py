"""Stateful stream operators on small files."""

from pyspark.sql import functions as F

from quarry.streaming import progress


def stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("ts", F.to_timestamp("ts"))


def replay(tmp_path, df, name, mode="append"):
    return progress.replay(df, str(tmp_path / "out"), str(tmp_path / "cp"), name, mode)


def at(s):
    return f"2024-01-01 00:{s // 60:02}:{s % 60:02}"


def test_sliding_log_does_not_record_refused_requests(spark, tmp_path):
    rows = [("k", at(s)) for s in (0, 1, 2, 3, 50, 61, 62)]
    out = replay(tmp_path, progress.sliding_limit(stream(spark, tmp_path, rows, "k string, ts string"), "k", "ts", 2), "t1")
    assert [r["allowed"] for r in out.orderBy("ts").collect()] == [True, True, False, False, False, True, True]


def test_feed_stops_at_the_terminal_event(spark, tmp_path):
    rows = [("a", "stage", at(1), "1"), ("a", "complete", at(2), "2"), ("a", "stage", at(3), "3"), ("b", "stage", at(1), "4")]
    out = replay(tmp_path, progress.event_feed(stream(spark, tmp_path, rows, "k string, event string, ts string, data string"), "k", "event", "ts", "data", idle=None), "t2")
    assert sorted((r["k"], r["seq"], r["event"]) for r in out.collect()) == [("a", 1, "stage"), ("a", 2, "complete"), ("b", 1, "stage")]


def test_session_counter(spark, tmp_path):
    rows = [("k", at(s)) for s in (0, 30, 80, 200)]
    out = replay(tmp_path, progress.session_limit(stream(spark, tmp_path, rows, "k string, ts string"), "k", "ts", 2), "t3", "complete")
    assert sorted((r["requests"], r["rejected"]) for r in out.collect()) == [(1, 0), (3, 1)]


def test_cancel_requests_expire(spark):
    rows = spark.createDataFrame([("a", "2024-01-01 10:30:00"), ("a", "2024-01-01 11:30:00"), ("b", "2024-01-01 10:30:00")], "k string, ts string").withColumn("ts", F.to_timestamp("ts"))
    asked = spark.createDataFrame([("a", "2024-01-01 10:00:00")], "k string, requested_at string").withColumn("requested_at", F.to_timestamp("requested_at"))
    assert [r["stop"] for r in progress.cancellations(rows, asked, "k").orderBy("k", "ts").collect()] == [True, False, False]


def test_complete_results_lie_in_files_and_not_in_the_driver(spark, tmp_path):
    rows = [("k", at(s)) for s in (0, 30, 80, 200)]
    out = replay(tmp_path, progress.silent_sessions(stream(spark, tmp_path, rows, "k string, ts string"), "k", "ts", "60 seconds"), "t4", "complete")
    assert sorted(r["events"] for r in out.collect()) == [1, 3] and out.inputFiles()


def test_complete_result_of_no_files_is_empty(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in"))
    assert replay(tmp_path, progress.silent_sessions(rows, "k", "ts", "60 seconds"), "t5", "complete").count() == 0
