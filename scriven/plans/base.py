"""Registration of queries with their SQL twins, and the driver tables in the roles that the operators expect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as timed segments: job, id, speaker, start, end in seconds; value counts 1,000 seconds."""
    # not timestampdiff in seconds, which rounds toward zero: before 1970 that is up
    start = F.floor(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 1_000_000)
    out = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("id"), F.col("event_type").alias("speaker"), start.alias("start"), "value")
    return out.select("job", "id", "speaker", "start", (F.col("start") + F.floor(F.col("value") * 1000)).alias("end"), "value")


SEGMENTS_SQL = """seg AS (
  SELECT user_id AS job, event_id AS id, event_type AS speaker, floor(epoch(ts))::BIGINT AS start,
         floor(epoch(ts))::BIGINT + floor(value * 1000)::BIGINT AS "end", value FROM events
)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


CLOCK_SQL = """clock AS (
  SELECT conv_id, turn, role, text, sum(dur + 8) OVER w - dur - 8 AS start_ds, sum(dur + 8) OVER w - 8 AS end_ds
  FROM (SELECT *, greatest(20, (length(coalesce(text, '')) * 20 + 13) // 26)::BIGINT AS dur FROM conversations)
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
)"""


def said(text, pairs: list[tuple[str, str]]):
    """A text with some of its words changed for what is said in meetings: the tables' own texts have none of it."""
    out = F.coalesce(text, F.lit(""))
    for word, phrase in pairs:
        out = F.replace(out, F.lit(f" {word} "), F.lit(f" {phrase} "))
    return out


def said_sql(text: str, pairs: list[tuple[str, str]]) -> str:
    out = f"coalesce({text}, '')"
    for word, phrase in pairs:
        out = f"replace({out}, ' {word} ', ' {phrase} ')"
    return out
