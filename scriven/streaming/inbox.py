"""Job inbox as a stream: new files become job rows once, with an append-only log of their states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

STEPS = {"queued": 0, "running": 1, "done": 2, "failed": 2}


#: Keeps the keys that were seen on disk and writes what a batch changed, not the whole of them.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def watch(spark: SparkSession, inbox: str, schema: str, state: str, checkpoint: str, process: Callable[[DataFrame], None]) -> StreamingQuery:
    """Runs what lies in the inbox and stops; a next call takes only what is new. process gets each batch of records.

    A record (job, id) is new if the stream's state has not met it: a batch looks up its own keys, so its cost follows its size, not what came
    before. Each job of a batch is logged as queued, running, then done or failed, under its batch id. State and files taken are committed
    after the batch, so one that failed or whose driver died comes again with the same rows under the same id; process may meet
    it twice and the log shows it.
    """

    def log(jobs: DataFrame, batch: int, status: str) -> None:
        jobs.select("job", F.lit(batch).cast("long").alias("batch"), F.lit(status).alias("status"), F.lit(STEPS[status]).alias("step"), F.current_timestamp().alias("at")).write.mode("append").parquet(state)

    def run(batch: DataFrame, number: int) -> None:
        fresh = batch.persist()
        jobs = fresh.select("job").distinct()
        try:
            log(jobs, number, "queued")
            log(jobs, number, "running")
            process(fresh)
            log(jobs, number, "done")
        except Exception:
            log(jobs, number, "failed")
            raise
        finally:
            fresh.unpersist()

    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    records = spark.readStream.schema(schema).json(inbox).dropDuplicates(["job", "id"])
    return records.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_states(spark: SparkSession, state: str) -> DataFrame:
    w = Window.partitionBy("job").orderBy(F.desc("batch"), F.desc("at"), F.desc("step"))
    return spark.read.parquet(state).withColumn("k", F.row_number().over(w)).where("k = 1").select("job", "status")
