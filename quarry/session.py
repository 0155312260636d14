"""Session defaults. Only ``build`` creates a session; every operator takes the caller's."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build(app: str = "quarry", cpus: int | None = None, memory: str = "6g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster job brings its own."""
    n = cpus or os.cpu_count() or 4
    conf = DEFAULTS | {"spark.master": f"local[{n}]", "spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(n)}
    spark = SparkSession.builder.appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(df):
    """``df`` with at least as many partitions as the cluster has cores, for work that costs far more than moving its rows.

    A scan of few row groups would leave cores idle; larger inputs come in enough partitions and are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)
