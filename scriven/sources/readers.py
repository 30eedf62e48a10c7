"""Sources: logs with a torn tail, label files, reference and meeting texts, envelopes of several shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriven.functions.text import clock_seconds


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, line): the lines of text files, which tasks read by byte ranges; `at` orders the lines of a file.

    A range is known by where it begins, a line in it by the order in which its task reads, which is the same each time a file
    of the same size is read.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k")).alias("at"), F.col("value").alias("line"))
    return raw.withColumn("line", F.regexp_replace("line", "^\ufeff", ""))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, line): lines with their numbers in each file, counted range by range."""
    rows = _lines(spark, path).select("file", "at.block", "at.k", "line")
    counts = rows.groupBy("file", "block").agg(F.count("*").alias("size"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("file", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("k"))
    return rows.withColumn("i", inside - 1).join(counts, ["file", "block"]).select("file", (F.col("before") + F.col("i")).cast("int").alias("n"), "line")


def _good_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, at, line, r) before the first line of each file that is no record of the schema; an empty line is none."""
    rows = _lines(spark, path).withColumn("r", F.from_json("line", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    first = rows.where(F.col("r").isNull() | F.col("r._bad").isNotNull()).groupBy("file").agg(F.min("at").alias("torn"))
    return rows.join(F.broadcast(first) if _few_files(spark, path) else first, "file", "left").where(F.col("torn").isNull() | (F.col("at") < F.col("torn"))).drop("torn")


#: Files up to this number have their first bad lines broadcast: a row each.
FEW_FILES = 100_000


def _few_files(spark: SparkSession, path: str) -> bool:
    if any(c in path for c in "*?[{,"):
        return False
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getFileCount() <= FEW_FILES


def jsonl_log(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """Records of each log file before its first bad line, the last one of each key. Files of any size are read by byte ranges."""
    good = _good_lines(spark, path, schema)
    return good.groupBy("file", F.col(f"r.{key}").alias("_key")).agg(F.max_by("r", "at").alias("r")).select("r.*").drop("_bad")


def recovered_log(spark: SparkSession, path: str, schema: str, target: str) -> DataFrame:
    """The good prefix of a log written to target as text, in order over its files, and read back as lines; the log itself stays as it is."""
    good = _good_lines(spark, path, schema).select("file", "at", "line")
    good.repartitionByRange("file", "at").sortWithinPartitions("file", "at").select("line").write.mode("errorifexists").text(target)
    return spark.read.text(target)


def json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def labels(spark: SparkSession, path: str) -> DataFrame:
    """start<TAB>end<TAB>text with decimal comma or point; blank, \\ and # lines are skipped, others must parse."""
    rows = _numbered(spark, path).where(~F.col("line").rlike("^\\s*$|^\\\\|^#"))
    parts = F.split("line", "\t", 3)
    number = lambda i: F.replace(F.get(parts, F.lit(i)), F.lit(","), F.lit(".")).try_cast("double")
    bad = number(0).isNull() | number(1).isNull()
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not a label: "), "line")).cast("double")).otherwise(number(0))
    return rows.select("file", "n", checked.alias("start"), number(1).alias("end"), F.trim(F.coalesce(F.get(parts, F.lit(2)), F.lit(""))).alias("text"))


_FRAGMENT = "^#\\s*fragment\\s+([0-9:.,]+)\\s*-\\s*([0-9:.,]+)"
_SPOKEN = "^\\[([^\\]]+)\\]\\s*([0-9:.,]+)\\s*-\\s*([0-9:.,]+)\\s*:\\s*(.*)$"


def reference(spark: SparkSession, path: str) -> DataFrame:
    """"[spk] a - b: text" lines, each with the last "# fragment a-b" above it."""
    rows = _numbered(spark, path).withColumn("line", F.trim("line"))
    mark = F.when(F.col("line").rlike(_FRAGMENT), F.struct(*[clock_seconds(F.regexp_extract("line", _FRAGMENT, g)).alias(a) for g, a in ((1, "from"), (2, "to"))]))
    above = F.last(mark, ignorenulls=True).over(Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    part = lambda g: F.regexp_extract("line", _SPOKEN, g)
    return rows.withColumn("f", above).where(F.col("line").rlike(_SPOKEN)).select("file", "n", F.regexp_replace(part(1), "\\s+", "").alias("speaker"), clock_seconds(part(2)).alias("start"), clock_seconds(part(3)).alias("end"), F.trim(part(4)).alias("text"), F.col("f.from").alias("fragment_start"), F.col("f.to").alias("fragment_end"))


_SETTING, _TURN = "^#\\s*([A-Za-z_]+)\\s*:\\s*(.*)$", "^(?:\\[(\\d+:\\d{2}(?::\\d{2})?)\\]\\s*)?(?:([A-Za-z_0-9]+):\\s+)?(.*?)\\s*(\\[\\?\\])?$"


def meeting(spark: SparkSession, path: str, pause: float = 15.0) -> DataFrame:
    """Turns "[mm:ss] SPK: text [?]" of a meeting text; a blank line before a turn is a pause."""
    rows = _numbered(spark, path).withColumn("line", F.trim("line")).where(~F.col("line").startswith("#"))
    w = Window.partitionBy("file").orderBy("n")
    rows = rows.withColumn("blank", F.col("line") == "").withColumn("after", F.coalesce(F.lag("blank").over(w), F.lit(False)))
    part = lambda g: F.regexp_extract("line", _TURN, g)
    turns = rows.where("NOT blank").select("file", "n", F.when(part(2) == "", "UNK").otherwise(part(2)).alias("speaker"), F.nullif(part(1), F.lit("")).alias("ts"), part(3).alias("text"), (part(4) != "").alias("low"), "after").where("text <> ''")
    return turns.withColumn("pause", F.when(F.col("after") & (F.row_number().over(w) > 1), pause).otherwise(0.0)).drop("after")


def settings(spark: SparkSession, path: str) -> DataFrame:
    rows = _numbered(spark, path).where(F.trim("line").rlike(_SETTING))
    return rows.select("file", F.regexp_extract(F.trim("line"), _SETTING, 1).alias("key"), F.regexp_extract(F.trim("line"), _SETTING, 2).alias("value"))


def shape_of(json: Column) -> Column:
    """envelope, turns or segments: which of three shapes a JSON text has."""
    first = F.get_json_object(json, "$[0]")
    return F.when(F.get_json_object(json, "$.turns").isNotNull(), "envelope").when(F.get_json_object(first, "$.line").isNotNull(), "turns").when(F.get_json_object(first, "$.text").isNotNull(), "segments")


def filename_fields(name: Column, keys: list[str]) -> list[Column]:
    """key-value__key-value names as columns."""
    return [F.nullif(F.regexp_extract(name, f"(?:^|__){k}-(.*?)(?:__|\\.|$)", 1), F.lit("")).alias(k) for k in keys]
