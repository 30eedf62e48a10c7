"""Interval algebra within a job: islands, unions, padding, and interval, as-of and nearest joins.

Every function takes the job's column names and works in windows over the job, or joins on it, so a plan is one
hash partitioning by job. Times are any ordered numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: list[str] | list[Column], starts: Column, name: str = "island") -> DataFrame:
    """Numbers rows from 1: a row where `starts` holds, or is unknown, begins a new island."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_new", F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0)).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def _running_end(keys: list[str], order: list[str] | list[Column], end: str) -> Column:
    return F.max(end).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def union(df: DataFrame, keys: list[str], gap: float = 0, strict: bool = False, start: str = "start", end: str = "end") -> DataFrame:
    """Intervals up to `gap` apart (less than it if strict) as one: keys, start, end, n. An unknown end comes after the known ones of its start."""
    order = [F.col(start).asc_nulls_last(), F.col(end).asc_nulls_last()]
    away = F.col(start) - _running_end(keys, order, end)
    rows = df.withColumn("_away", away)
    rows = islands(rows, keys, order, (F.col("_away") >= gap) if strict else (F.col("_away") > gap))
    return rows.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("island")


def speaker_islands(df: DataFrame, keys: list[str], gap: float, speaker: str = "speaker", tie: str = "id") -> DataFrame:
    """df with _run and _part: neighbours of one speaker less than `gap` apart share both; other speakers between them part them."""
    order = ["start", "end", tie]
    w = Window.partitionBy(*keys).orderBy(*order)
    runs = islands(df.withColumn("_same", F.lag(speaker).over(w).eqNullSafe(F.col(speaker))), keys, order, ~F.col("_same"), "_run")
    runs = runs.withColumn("_away", F.col("start") - _running_end([*keys, "_run"], order, "end"))
    return islands(runs, [*keys, "_run"], order, F.col("_away") >= gap, "_part").drop("_same", "_away")


def merge_gaps(df: DataFrame, keys: list[str], gap: float, speaker: str = "speaker", tie: str = "id") -> DataFrame:
    """Neighbours of one speaker less than `gap` apart as one."""
    out = speaker_islands(df, keys, gap, speaker, tie)
    return out.groupBy(*keys, "_run", "_part").agg(F.first(speaker).alias(speaker), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("_run", "_part")


def clusters(df: DataFrame, keys: list[str], tie: str = "id") -> DataFrame:
    """cluster: chains of intervals that start before everything earlier has ended."""
    order = ["start", "end", tie]
    return islands(df.withColumn("_end", _running_end(keys, order, "end")), keys, order, F.col("start") >= F.col("_end"), "cluster").drop("_end")


def padded(df: DataFrame, keys: list[str], by: float, low: Column, high: Column, tie: str = "id") -> DataFrame:
    """Each interval extended by `by` on both sides, up to the middle of the gap to its neighbour; renumbered from 0."""
    w = Window.partitionBy(*keys).orderBy("start", "end", tie)
    left = F.coalesce((F.lag("end").over(w) + F.col("start")) / 2, low)
    right = F.coalesce((F.col("end") + F.lead("start").over(w)) / 2, high)
    out = df.withColumn("_a", F.greatest(F.col("start") - by, left)).withColumn("_b", F.least(F.col("end") + by, right)).withColumn("seq", F.row_number().over(w) - 1)
    return out.withColumn("start", F.col("_a")).withColumn("end", F.col("_b")).drop("_a", "_b")


def hysteresis(frames: DataFrame, keys: list[str], idx: str, prob: Column, high: float, low: float | None = None) -> DataFrame:
    """Runs of consecutive frames at `low` or more that hold one at `high` or more: keys, first, last, peak."""
    low = max(0.01, high - 0.15) if low is None else low
    w = Window.partitionBy(*keys).orderBy(idx)
    rows = frames.withColumn("_p", prob).where(F.col("_p") >= low).withColumn("_gap", F.col(idx) - F.lag(idx).over(w))
    rows = islands(rows, keys, [idx], F.col("_gap") > 1)
    return rows.groupBy(*keys, "island").agg(F.min(idx).alias("first"), F.max(idx).alias("last"), F.max("_p").alias("peak")).where(F.col("peak") >= high).drop("island")


def speech_regions(regions: DataFrame, keys: list[str], shortest: float, gap: float, by: float, low: Column, high: Column) -> DataFrame:
    """Short regions dropped, near ones joined, the rest padded and joined again where they touch."""
    kept = union(regions.where(F.col("end") - F.col("start") >= shortest), keys, gap).drop("n")
    wide = kept.withColumn("start", F.greatest(F.col("start") - by, low)).withColumn("end", F.least(F.col("end") + by, high))
    return union(wide, keys, 0).drop("n")


def overlaps(a: str = "a", b: str = "b") -> Column:
    return (F.col(f"{a}.start") < F.col(f"{b}.end")) & (F.col(f"{a}.end") > F.col(f"{b}.start"))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], bucket: float | None = None) -> DataFrame:
    """Pairs (a.*, b.*) of one job whose intervals overlap, with `overlap` as how much.

    With a bucket width each side is dealt to the buckets that it touches and a pair is kept in the first bucket
    that both touch: a long job then spreads over tasks, and rows only meet near each other.
    """
    a, b = left, right
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    if bucket:
        dealt = lambda d: d.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))))
        a, b = dealt(a), dealt(b)
        same += [F.col("a._bucket") == F.col("b._bucket"), F.floor(F.greatest("a.start", "b.start") / bucket) == F.col("a._bucket")]
    cond = overlaps()
    for s in same:
        cond = cond & s
    return a.alias("a").join(b.alias("b"), cond).withColumn("overlap", F.least("a.end", "b.end") - F.greatest("a.start", "b.start"))


def best_overlap(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, bucket: float | None = None) -> DataFrame:
    """For each left interval the right one that overlaps it most, the smallest id of equals."""
    pairs = interval_join(left, right, keys, bucket)
    w = Window.partitionBy(*[F.col(f"a.{k}") for k in keys], F.col(f"a.{left_id}")).orderBy(F.desc("overlap"), F.col(f"b.{right_id}"))
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def speaker_overlaps(df: DataFrame, keys: list[str], bucket: float | None = None, speaker: str = "speaker", id_: str = "id") -> DataFrame:
    """Overlaps of different speakers: keys, a_id, b_id, start, end."""
    pairs = interval_join(df, df, keys, bucket).where((F.col(f"a.{id_}") < F.col(f"b.{id_}")) & (F.col(f"a.{speaker}") != F.col(f"b.{speaker}")))
    return pairs.select(*[F.col(f"a.{k}") for k in keys], F.col(f"a.{id_}").alias("a_id"), F.col(f"b.{id_}").alias("b_id"), F.greatest("a.start", "b.start").alias("start"), F.least("a.end", "b.end").alias("end"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, start: str, value: str, slack: float = 0, or_first: bool = False) -> DataFrame:
    """left with `value` of the last right row at or before at + slack, and `value` of the row after it as next_<value>.

    No range join: both sides are sorted together once and the last right row is carried forward. With or_first a left row
    before all right rows takes the first of them.
    """
    w = Window.partitionBy(*keys).orderBy(start, value)
    r = right.select(*keys, F.col(start).alias("_at"), F.struct(F.col(value).alias("v"), F.lead(value).over(w).alias("next"), F.col(start).alias("start")).alias("_r"))
    lcols = left.columns
    r = r.withColumn("_l", F.lit(None).cast(left.select(F.struct(*lcols).alias("s")).schema[0].dataType)).withColumn("_side", F.lit(0))
    rest = left.select(*keys, (F.col(at) + slack).alias("_at"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.struct(*lcols).alias("_l"), F.lit(1).alias("_side"))
    order = Window.partitionBy(*keys).orderBy("_at", "_side", F.col("_r.v"))
    both = r.unionByName(rest)
    found = F.last("_r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    if or_first:
        # the first of the whole job, one value a job
        found = F.coalesce(found, F.min(F.when(F.col("_side") == 0, F.struct(F.col("_at").alias("a"), F.col("_r.v").alias("v"), "_r"))).over(Window.partitionBy(*keys))["_r"])
    both = both.withColumn("_f", found).where("_side = 1")
    return both.select("_l.*", F.col("_f.v").alias(value), F.col("_f.next").alias(f"next_{value}"))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, left_id: str, start: str, right_id: str, within: float | None = None) -> DataFrame:
    """left with the id of the right row whose start is nearest, the smaller id of equals, null beyond `within`."""
    both = left.select(*keys, F.col(at).alias("_at"), F.col(left_id).alias("_id"), F.lit(1).alias("_side")).unionByName(right.groupBy(*keys, F.col(start).alias("_at")).agg(F.min(right_id).alias("_id")).withColumn("_side", F.lit(0)))
    mark = F.when(F.col("_side") == 0, F.struct("_at", "_id"))
    # both ways by a running last: a frame that reaches to the end of the job would be read anew for each row
    last = lambda *order: F.last(mark, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("_b", last("_at", "_side", "_id")).withColumn("_a", last(F.desc("_at"), F.desc("_side"), F.desc("_id"))).where("_side = 1")
    db, da = F.col("_at") - F.col("_b._at"), F.col("_a._at") - F.col("_at")
    take_before = F.col("_a").isNull() | (db < da) | ((db == da) & (F.col("_b._id") <= F.col("_a._id")))
    pick = F.when(F.coalesce(take_before & F.col("_b").isNotNull(), F.lit(False)), F.struct(F.col("_b._id").alias("id"), db.alias("far"))).otherwise(F.struct(F.col("_a._id").alias("id"), da.alias("far")))
    out = out.select(*keys, F.col("_id").alias(left_id), pick.alias("p"))
    near = F.col("p.id") if within is None else F.when(F.col("p.far") <= within, F.col("p.id"))
    return out.select(*keys, left_id, near.alias(right_id), F.col("p.far").alias("distance"))


def points_in(points: DataFrame, regions: DataFrame, keys: list[str], at: str, bucket: float) -> DataFrame:
    """Pairs (p.*, r.*) of a point and each region that holds it, both ends included; null regions for a point in none.

    A region stands in each bucket that it touches, a point in one: a long job spreads over tasks.
    """
    p = points.withColumn("_bucket", F.floor(F.col(at) / bucket)).alias("p")
    r = regions.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket)))).alias("r")
    cond = (F.col("p._bucket") == F.col("r._bucket")) & F.col(f"p.{at}").between(F.col("r.start"), F.col("r.end"))
    for k in keys:
        cond = cond & (F.col(f"p.{k}") == F.col(f"r.{k}"))
    return p.join(r, cond, "left")


def bucketed_points(points: DataFrame, regions: DataFrame, keys: list[str], at: str, region: str) -> DataFrame:
    """points with the region that starts last at or before them, if they lie before its end (half-open)."""
    r = regions.withColumn("_v", F.struct(F.col("end").alias("e"), F.col(region).alias("r")))
    out = as_of(points, r, keys, at, "start", "_v")
    return out.withColumn(region, F.when(F.col(at) < F.col("_v.e"), F.col("_v.r"))).drop("_v", "next__v")


def clip_of(points: DataFrame, clips: DataFrame, keys: list[str], at: str = "middle") -> DataFrame:
    """points(keys.., id, middle) with the clip(keys.., clip, length) that begins last at or before them; clips lie end to end from 0."""
    w = Window.partitionBy(*keys).orderBy("clip").rowsBetween(Window.unboundedPreceding, -1)
    begins = clips.withColumn("begins", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("double"))
    return as_of(points.withColumn(at, F.col(at).cast("double")), begins, keys, at, "begins", "clip").select(*keys, "id", "clip")
