"""Frame statistics: energy envelope, adaptive thresholds, blocks, gain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rms_envelope(hops: DataFrame, keys: list[str], idx: str, energy: str, width: int = 3) -> DataFrame:
    """rms of `width` hops from each hop on; the last frames are shorter."""
    w = Window.partitionBy(*keys).orderBy(idx).rowsBetween(0, width - 1)
    return hops.withColumn("rms", F.sqrt(F.avg(energy).over(w)))


def quantiles(rows: DataFrame, keys: list[str], level: str, shares: dict[str, float]) -> DataFrame:
    """keys with each named quantile of their levels, null without one; between two levels lower * (1 - part) + upper * part.

    Equal levels are counted first, so a key's windows hold its different levels. The products and their sum are rounded as
    quantile_cont of the SQL twin does it, the first product together with the sum: levels that lie on a threshold
    built from them would else fall to either side.
    """
    w = Window.partitionBy(*keys).orderBy("_level")
    counts = rows.groupBy(*keys, F.col(level).cast("double").alias("_level")).agg(F.count(level).alias("_n"))
    counts = counts.withColumn("_upto", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    at = {name: (F.col("_all") - 1) * F.lit(share) for name, share in shares.items()}
    level_at = lambda place: F.min(F.when(F.col("_upto") > place, F.col("_level")))
    ends = [x for name, p in at.items() for x in (level_at(F.floor(p)).alias(f"{name}_low"), level_at(F.ceil(p)).alias(f"{name}_high"))]

    def between(name: str):
        low, high, part = F.col(f"{name}_low"), F.col(f"{name}_high"), at[name] - F.floor(at[name])
        zero = lambda x: F.coalesce(x, F.lit(0.0))
        fused = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), zero(low), 1 - part, zero(high * part)).cast("double")
        return F.when(part == 0, low).when(low.isNotNull(), fused).alias(name)

    return counts.groupBy(*keys).agg(F.first("_all").alias("_all"), *ends).select(*keys, *map(between, shares))


def adaptive_threshold(frames: DataFrame, keys: list[str], block: Column, level: str, floor_up: float = 9, peak_down: float = 10, file_up: float = 9) -> DataFrame:
    """frames with `threshold`: min(p10 + 9, p95 - 10) of their block, at least p5 + 9 of the job; and prob, a squash of 3 dB."""
    blocks = frames.withColumn("block", block)
    per_block = quantiles(blocks, [*keys, "block"], level, {"_p10": 0.1, "_p95": 0.95})
    per_job = quantiles(frames, keys, level, {"_p5": 0.05})
    out = blocks.join(per_block, [*keys, "block"]).join(per_job, keys)
    out = out.withColumn("threshold", F.greatest(F.least(F.col("_p10") + floor_up, F.col("_p95") - peak_down), F.col("_p5") + file_up)).drop("_p10", "_p95", "_p5")
    return out.withColumn("prob", 1 / (1 + F.exp(-(F.col(level) - F.col("threshold")) / 3)))


def tumbling(jobs: DataFrame, duration: str, size: int) -> DataFrame:
    """jobs exploded to windows of `size`, the last one cut: start, end, speaker UNK."""
    out = jobs.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col(duration) - 1, F.lit(0)).cast("long"), F.lit(size).cast("long"))))
    return out.withColumn("end", F.least(F.col("start") + size, F.col(duration))).withColumn("speaker", F.lit("UNK"))


def speech_gain(regions: DataFrame, keys: list[str], order: str, energy: str, peak: str, target_db: float, regions_used: int = 200) -> DataFrame:
    """Gain in dB towards target_db from the first regions' rms, within 20 dB, less where the peak would pass 0.99."""
    w = Window.partitionBy(*keys).orderBy(order)
    used = regions.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= regions_used)
    out = used.groupBy(*keys).agg(F.sqrt(F.avg(energy)).alias("rms"), F.max(peak).alias("peak"))
    gain = F.least(F.greatest(F.lit(target_db) - 20 * F.log10("rms"), F.lit(-20.0)), F.lit(20.0))
    return out.withColumn("gain_db", F.least(gain, 20 * F.log10(F.lit(0.99) / F.col("peak"))))
