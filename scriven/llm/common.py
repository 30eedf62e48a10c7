"""Small helpers that the corpus operators share: input columns, written tables, sharding by size."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space for lines and words in every contract: space and the five ASCII controls 0x09-0x0D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
#: Stands for a null doc_id inside an operator; null sorts first, as in Spark's own order.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_key(col: str = "doc_id") -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def doc_id_of(key: Column) -> Column:
    return F.when(key != NULL_ID, key)


#: Tables that `written` has made, in order.
_PATHS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none, a temporary one, in local mode alone (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="scriven-")
        atexit.register(shutil.rmtree, path, True)
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, so a lost executor costs one task, not the job."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scriven-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _PATHS.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, start: int, stop: int | None = None) -> None:
    """Deletes the tables that `written` made from number start up to stop: for a caller that has read or written all it wants of them."""
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in _PATHS[start:stop]:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(hadoop).delete(place, True)
    del _PATHS[start:stop]


def n_written() -> int:
    return len(_PATHS)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key that holds more than one in so many rows is heavy; there are at most so many heavy keys.
HEAVY = 1000


def keyed_join(rows: DataFrame, keyed: DataFrame, on: list[str], weight: str) -> DataFrame:
    """rows beside the one row of keyed that has their key; weight is keyed's column with the number of rows of each key.

    Keys that hold over a thousandth of the rows, a thousand at most, are broadcast, so no key makes a large task whatever its
    share; keyed's other columns must be of bounded size. rows is read twice: a written table.
    """
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) * HEAVY > total
    few = keyed.where(heavy)
    light = rows.join(F.broadcast(few.select(*on)), on, "left_anti").join(keyed.where(~heavy), on)
    return rows.join(F.broadcast(few), on).unionByName(light)
