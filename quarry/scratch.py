"""Tables that cut lineage between the rounds of iterative operators.

They lie in the folder all executors share (``spark.checkpoint.dir``), as compressed Parquet files:
a lost executor costs a re-read, never a recomputation of earlier rounds.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where none is set (tests, local mode)."""
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if said:
        return said.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="quarry-scratch-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return "file://" + _OWN["dir"]


class Scratch:
    """Named tables of one operator run. ``keep`` what the result still reads; ``drop`` the rest as soon as it is done with.

    ``tidy``: the shuffle files of a table go as soon as it is written, instead of when the driver happens to collect its garbage.
    """

    def __init__(self, spark: SparkSession, label: str, tidy: bool = False) -> None:
        self.spark, self.root, self.tidy = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}", tidy
        self._n = 0
        self._paths: dict[int, str] = {}

    def write(self, df: DataFrame, partition_by: Iterable[str] = ()) -> DataFrame:
        """Write once, read back with the known schema (no inference job)."""
        return self.gather([df], partition_by)

    @contextmanager
    def _cleaned(self) -> Iterator[None]:
        known = self.spark.conf.get(_CLEAN, None)
        if self.tidy:
            self.spark.conf.set(_CLEAN, "true")
        try:
            yield
        finally:
            if self.tidy:
                self.spark.conf.unset(_CLEAN) if known is None else self.spark.conf.set(_CLEAN, known)

    def gather(self, parts: Iterable[DataFrame], partition_by: Iterable[str] = ()) -> DataFrame:
        """One table of several parts of one schema, each written before the next one is asked for."""
        self._n += 1
        path, schema = f"{self.root}/t{self._n}", None
        for df in parts:
            schema = df.schema
            with self._cleaned():
                df.write.mode("append").option("compression", "zstd").partitionBy(*partition_by).parquet(path)
        back = self.spark.read.schema(schema).parquet(path)
        self._paths[id(back)] = path
        back._scratch_path = path  # type: ignore[attr-defined]
        return back

    def drop(self, *tables: DataFrame | None) -> None:
        jvm = self.spark._jvm
        for t in tables:
            path = getattr(t, "_scratch_path", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
