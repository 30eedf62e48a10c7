"""Ranks and quantiles of whole tables without a task that sees all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a pass over values, and of hashes that are ranked.
BUCKETS = 4096


def hashed(seed: str, *columns: str) -> Column:
    """A seeded hash as hexadecimal digits, evenly spread."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in columns]))


def _beside(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with other on keys, a null being equal to a null."""
    named = other.select(*[F.col(k).alias(f"_its_{k}") if k in keys else F.col(k) for k in other.columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_its_{k}")) for k in keys])
    return rows.join(named, same).drop(*[f"_its_{k}" for k in keys])


def hash_ranked(rows: DataFrame, keys: list[str], order: str, tie: list[str], name: str, size: Column | None = None) -> DataFrame:
    """rows with `name`: how many rows of its keys come before a row in order of a hash, then of tie; with size, the sum of their sizes.

    The first digits of the hash deal the rows over BUCKETS; a window counts inside a bucket, and what stands in the buckets before
    it is known from their counts, BUCKETS rows a key.
    """
    bucket = F.conv(F.substring(order, 1, 3), 16, 10).cast("int")
    size = F.lit(1).cast("long") if size is None else size
    dealt = rows.withColumn("_bucket", bucket).withColumn("_size", size)
    counts = dealt.groupBy(*keys, "_bucket").agg(F.sum("_size").alias("_in"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0))).drop("_in")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, -1)
    out = _beside(dealt, counts, [*keys, "_bucket"]).withColumn(name, F.col("_before") + F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    return out.drop("_bucket", "_size", "_before")


def block_shuffled(rows: DataFrame, key: str, id_: str, seed: str = "7") -> DataFrame:
    """rows(key, id, ..) with `block`, `place` and `position`: a seeded order of blocks of one to four rows of one key, as a meeting changes its language.

    The rows of a key stand in order of a hash; each ten of them are four blocks, of one to four rows in an order of their own. All
    blocks stand in order of another hash, so a key comes as often as it has rows. Nothing but counts of buckets is seen at once.
    """
    c = F.col
    ranked = hash_ranked(rows.withColumn("_h", hashed(seed, key, id_)), [key], "_h", [id_], "_rank")
    ten = F.floor(c("_rank") / 10)
    sizes = F.array_sort(F.transform(F.array(*[F.lit(n) for n in (1, 2, 3, 4)]), lambda n: F.struct(F.md5(F.concat_ws(":", F.lit(seed), c(key).cast("string"), ten.cast("string"), n.cast("string"))).alias("h"), n.alias("n"))))
    ends = F.array(*[F.aggregate(F.slice("_sizes", 1, k), F.lit(0), lambda s, x: s + x.n) for k in (1, 2, 3, 4)])
    out = ranked.withColumn("_ten", ten).withColumn("_sizes", sizes).withColumn("_ends", ends)
    k = F.size(F.filter("_ends", lambda e: e <= c("_rank") % 10))
    out = out.withColumn("_k", k).withColumn("block", c("_ten") * 4 + c("_k")).withColumn("place", (c("_rank") % 10 - F.coalesce(F.get("_ends", c("_k") - 1), F.lit(0))).cast("long"))
    blocks = out.groupBy(key, "block").agg(F.count("*").alias("_size")).withColumn("_h", hashed(seed, key, "block"))
    blocks = hash_ranked(blocks, [], "_h", [key, "block"], "_at", c("_size")).select(key, "block", "_at")
    return out.drop("_h", "_rank", "_ten", "_sizes", "_ends", "_k").transform(_beside, blocks, [key, "block"]).withColumn("position", c("_at") + c("place")).drop("_at")


def _finite(rows: DataFrame, value: str) -> DataFrame:
    v = F.col(value).cast("double")
    return rows.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def order_statistics(rows: DataFrame, value: str, ranks: list[int]) -> dict[int, float]:
    """The values of the given ranks, from 0, in ascending order of all rows: exact, by narrowing.

    Each pass counts the rows of each wanted range in BUCKETS equal parts and takes the part that holds the rank, until a part has one
    value. What reaches the driver is those counts; the ranges that are looked at shrink to nothing fast.
    """
    v = F.col(value).cast("double")
    rows = _finite(rows, value).select(v.alias("v"))
    low, high = rows.agg(F.min("v"), F.max("v")).first()
    open_ = {r: (low, high, r) for r in ranks}  # range, and the rank inside it
    found: dict[int, float] = {}
    while open_:
        for r in [r for r, (a, b, _) in open_.items() if a == b]:
            found[r] = open_.pop(r)[0]
        if not open_:
            break
        ranges = sorted({(a, b) for a, b, _ in open_.values()})
        inside = F.array_compact(F.array(*[F.when(F.col("v").between(a, b), F.struct(F.lit(i).alias("i"), F.least(F.floor((F.col("v") - a) / (b - a) * BUCKETS), F.lit(BUCKETS - 1)).alias("k"))) for i, (a, b) in enumerate(ranges)]))
        counts = rows.select("v", F.explode(inside).alias("x")).groupBy("x.i", "x.k").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()
        for r, (a, b, rank) in list(open_.items()):
            for c in sorted((c for c in counts if ranges[c.i] == (a, b)), key=lambda c: c.k):
                if rank < c.n:
                    open_[r] = (c.a, c.b, rank)
                    break
                rank -= c.n
    return found


def exact_quantiles(rows: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Quantiles of all finite values, between two of them in proportion; None of no row."""
    n = _finite(rows, value).count()
    if not n:
        return [None] * len(shares)
    at = [(n - 1) * s for s in shares]
    values = order_statistics(rows, value, sorted({k for x in at for k in (int(x), min(int(x) + 1, n - 1))}))
    return [values[int(x)] + (values[min(int(x) + 1, n - 1)] - values[int(x)]) * (x - int(x)) for x in at]
