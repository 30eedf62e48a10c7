"""Stages of a job that run once: a written stage is read, not run again; time and failure of each run are recorded."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Stages:
    """Named tables under a folder, each made by one stage; `ledger` has a row for each run of a stage."""

    def __init__(self, spark: SparkSession, root: str, earlier: dict[str, str] | None = None):
        self.spark, self.root, self.earlier = spark, root.rstrip("/"), earlier or {}

    def path(self, name: str) -> str:
        return self.earlier.get(name, f"{self.root}/{name}")

    def _exists(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def done(self, name: str) -> bool:
        """Whether the committer has marked the stage's table as complete."""
        return self._exists(f"{self.path(name)}/_SUCCESS")

    def run(self, name: str, work: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table: read where it is complete, else made by work()."""
        if not self.done(name):
            began, status = time.time(), "failed"
            try:
                work().write.mode("overwrite").parquet(self.path(name))
                status = "done"
            finally:
                self._record(name, status, time.time() - began)
        return self.spark.read.parquet(self.path(name))

    def _record(self, name: str, status: str, seconds: float) -> None:
        self.spark.createDataFrame([(name, status, seconds, time.time())], "stage string, status string, seconds double, ended double").write.mode("append").parquet(f"{self.root}/_ledger")

    def ledger(self) -> DataFrame:
        """The last run of each stage."""
        w = Window.partitionBy("stage").orderBy(F.desc("ended"))
        return self.spark.read.parquet(f"{self.root}/_ledger").withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")

    def variant(self, root: str, shared: list[str]) -> Stages:
        """Stages under another folder that read the shared ones here and run all others anew."""
        return Stages(self.spark, root, {n: self.path(n) for n in shared})
