"""Packing documents into sequences of at most WINDOW tokens by non-negative least squares.

A document's whole windows are sequences of their own; what is left of it, under WINDOW tokens, is its tail.
Tails are counted by length in bins of UNIT tokens (32 counts). Every way to fill a window with one to
MAX_PARTS bins is a column; non-negative least squares finds how often to use each so that the counts are used
up; the repeats are rounded down to what the counts hold. Tails are dealt to these combinations whole, by
their rank in their bin. The rest, laid end to end in table order, first fills the room that bins
left in the sequences, then further windows, cut where one is full. What remains is cut into powers of two, which
are not padded. The plan keeps back enough tails to fill all the room, so nothing is padded.

Ranks and positions are running totals in two steps (within a read partition, then over the partitions), so no task
sees all rows; the driver sees 32 counts and a few totals.

Defined cases: null text is empty text, whose only id is end_id; rows of one doc_id are packed one by one
and a null doc_id stays null; an empty table gives no piece; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .tokens import encoded_chunks, encoder

WINDOW, UNIT, MAX_PARTS = 4096, 128, 6
BINS = WINDOW // UNIT


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, turns: int = 300) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by an active set (Lawson and Hanson)."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(1.0, np.abs(a.T @ b).max(initial=0))
    for _ in range(turns):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= tolerance:
            break
        active[best] = True
        while True:
            z = np.zeros_like(x)
            z[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if (z[active] > 0).all():
                break
            low = active & (z <= 0)
            step = min((x[low] / np.maximum(x[low] - z[low], 1e-300)).min(), 1.0)
            x = x + step * (z - x)
            active &= x > 1e-12
            x[~active] = 0
        x = z
    return x


def fillings() -> np.ndarray:
    """Columns: how many tails of each bin (1..BINS) a combination of at most MAX_PARTS takes; each fills a window."""

    def parts(total: int, most: int, count: int) -> Iterator[tuple[int, ...]]:
        if total == 0:
            yield ()
        elif count:
            for first in range(min(total, most), 0, -1):
                for rest in parts(total - first, first, count - 1):
                    yield (first, *rest)

    return np.array([np.bincount(p, minlength=BINS + 1)[1:] for p in parts(BINS, BINS, MAX_PARTS)]).T


@dataclass(frozen=True)
class Plan:
    """repeats[k] sequences take combination k; slots: (bin, first rank, end rank, tails of the bin in one sequence, first sequence, first slot)."""

    repeats: np.ndarray
    slots: list[tuple[int, int, int, int, int, int]]

    @property
    def sequences(self) -> int:
        return int(self.repeats.sum())


def plan(counts: np.ndarray) -> Plan:
    """counts[b]: tails of (b * UNIT, (b + 1) * UNIT] tokens."""
    ways = fillings()
    shortest = np.arange(BINS) * UNIT + 1
    wanted = nonnegative_least_squares(ways.astype(float), counts.astype(float))
    room = WINDOW - shortest @ ways  # the most that a combination can leave open

    def rounded(share: float) -> np.ndarray:
        left, out = counts.copy(), np.zeros(ways.shape[1], np.int64)
        for k in np.argsort(-wanted, kind="stable"):
            if wanted[k] > 0:
                used = ways[:, k] > 0
                out[k] = max(0, min(int(wanted[k] * share + 1e-9), int((left[used] // ways[used, k]).min())))
                left = left - out[k] * ways[:, k]
        return out

    for share in np.linspace(1, 0, 201):
        repeats = rounded(share)
        if (counts - ways @ repeats) @ shortest >= room @ repeats:
            break
    slots, rank, sequence = [], np.zeros(BINS, np.int64), 0
    for k in np.flatnonzero(repeats):
        slot = 0
        for b in np.flatnonzero(ways[:, k]):
            m, n = int(ways[b, k]), int(ways[b, k] * repeats[k])
            slots.append((int(b), int(rank[b]), int(rank[b]) + n, m, sequence, slot))
            rank[b] += n
            slot += m
        sequence += int(repeats[k])
    return Plan(repeats, slots)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(part, idx, doc_id, n, bin, rank, ids), written: a row's place, its tail's bin and rank in that bin and partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, idx = encoder(tokenizer, True), TaskContext.get().partitionId(), 0
        end, width, seen = np.array([end_id], enc.dtype).tobytes(), np.dtype(enc.dtype).itemsize, np.zeros(BINS, np.int64)
        for batch in batches:
            ids = batch.column("doc_id")
            for start, encoded in encoded_chunks(enc, batch, "text"):
                n = np.array([len(x) // width + 1 for x in encoded], np.int64)
                bins = (n % WINDOW + UNIT - 1) // UNIT - 1
                rank = np.full(len(n), -1, np.int64)
                for b in np.unique(bins[bins >= 0]):
                    at = np.flatnonzero(bins == b)
                    rank[at] = seen[b] + np.arange(len(at))
                    seen[b] += len(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(idx, idx + len(n))), ids.slice(start, len(n)), pa.array(n), pa.array(bins.astype(np.int32)), pa.array(rank), pa.array([x + end for x in encoded], pa.binary())], ["part", "idx", "doc_id", "n", "bin", "rank", "ids"])
                idx += len(n)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return written(rows.mapInArrow(run, "part int, idx long, doc_id long, n long, bin int, rank long, ids binary"), "token-ids")


def _before(df: DataFrame, value: Column, keys: list[str], step: str, order: str, name: str) -> DataFrame:
    """df with `name`: the sum of value over all rows before, within keys, by (step, order); totals first by step."""
    totals = df.groupBy(*keys, step).agg(F.sum(value).alias("_all"))
    base = totals.select(*keys, step, (F.sum("_all").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(step)) - F.col("_all")).alias("_base"))
    inside = F.sum(value).over(Window.partitionBy(*keys, step).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - value
    return df.withColumn("_in", inside).join(base, [*keys, step]).withColumn(name, F.col("_base") + F.col("_in")).drop("_in", "_base")


def layout(lengths: DataFrame) -> DataFrame:
    """lengths(part, idx, n, bin, rank) to pieces (part, idx, start, length, sequence_id, offset)."""
    spark = lengths.sparkSession
    counts = np.zeros(BINS, np.int64)
    for r in lengths.where("bin >= 0").groupBy("bin").agg(F.count("*").alias("n")).collect():
        counts[r.bin] = r.n
    chosen = plan(counts)
    whole = F.floor(F.col("n") / WINDOW)
    rows = lengths.withColumn("tail", F.col("n") % WINDOW)

    # whole windows
    windows = written(_before(rows.where(f"n >= {WINDOW}").select("part", "idx", whole.alias("q")), F.col("q"), [], "part", "idx", "first"), "windows")
    n_windows = windows.agg(F.sum("q")).first()[0] or 0
    pieces = windows.select("part", "idx", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1)).alias("k"))
    pieces = pieces.select("part", "idx", (F.col("k") * WINDOW).alias("start"), F.lit(WINDOW).cast("long").alias("length"), (F.col("first") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    # tails in combinations
    tails = rows.where("tail > 0").select("part", "idx", "tail", (whole * WINDOW).alias("start"), "bin", "rank")
    per_part = tails.groupBy("bin", "part").agg(F.count("*").alias("c"))
    firsts = per_part.select("bin", "part", (F.sum("c").over(Window.partitionBy("bin").orderBy("part")) - F.col("c")).alias("before"))
    ranked = tails.join(firsts, ["bin", "part"]).withColumn("place", F.col("before") + F.col("rank")).drop("before", "rank")
    slots = spark.createDataFrame(chosen.slots, "s_bin int, low long, high long, m long, seq long, slot long")  # at most BINS rows a combination used, BINS combinations
    dealt = written(ranked.join(F.broadcast(slots), (F.col("bin") == F.col("s_bin")) & (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high")), "left"), "dealt")
    nth = F.col("place") - F.col("low")
    placed = dealt.where("low IS NOT NULL").select("part", "idx", "start", "tail", (F.col("seq") + F.floor(nth / F.col("m"))).alias("seq"), (F.col("slot") + nth % F.col("m")).alias("slot"))
    in_order = Window.partitionBy("seq").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    placed = written(placed.withColumn("offset", F.sum("tail").over(in_order) - F.col("tail")), "placed")
    pieces = pieces.unionByName(placed.select("part", "idx", "start", F.col("tail").alias("length"), (F.col("seq") + n_windows).alias("sequence_id"), "offset"))

    # the other tails, end to end, against the room left in those sequences, then against further windows
    rest = written(_before(dealt.where("low IS NULL").select("part", "idx", "start", "tail"), F.col("tail"), [], "part", "idx", "at"), "rest")
    room = placed.groupBy("seq").agg(F.sum("tail").alias("used")).where(f"used < {WINDOW}").select("seq", "used", (F.lit(WINDOW) - F.col("used")).alias("size"), F.floor(F.col("seq") / 4096).alias("chunk"))
    room = written(_before(room, F.col("size"), [], "chunk", "seq", "at").select("at", "size", (F.col("seq") + n_windows).alias("sequence_id"), F.col("used").alias("offset")), "room")
    total, open_ = rest.agg(F.sum("tail")).first()[0] or 0, room.agg(F.sum("size")).first()[0] or 0
    full = (total - open_) // WINDOW
    base, last = n_windows + chosen.sequences, open_ + full * WINDOW
    ends, at, k = [], last, base + full
    for bit in reversed(range(WINDOW.bit_length())):
        if (total - last) >> bit & 1:
            ends.append((at, 1 << bit, k, 0))
            at, k = at + (1 << bit), k + 1
    room = room.unionByName(spark.createDataFrame(ends, room.schema))
    stop = F.col("at") + F.col("tail")
    bucketed = lambda df, size: df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("at") / WINDOW), F.floor((F.col("at") + size - 1) / WINDOW))))
    a, b = bucketed(rest.where((F.col("at") < open_) | (stop > last)), F.col("tail")).alias("a"), bucketed(room, F.col("size")).alias("b")
    low, high = F.greatest("a.at", "b.at"), F.least(F.col("a.at") + F.col("a.tail"), F.col("b.at") + F.col("b.size"))
    met = a.join(b, "bucket").where((low < high) & (F.floor(low / WINDOW) == F.col("bucket")))
    pieces = pieces.unionByName(met.select("part", "idx", (F.col("a.start") + low - F.col("a.at")).alias("start"), (high - low).alias("length"), "sequence_id", (F.col("b.offset") + low - F.col("b.at")).alias("offset")))
    low, high = F.greatest(F.col("at"), F.lit(open_) + F.col("w") * WINDOW), F.least(stop, F.lit(open_) + (F.col("w") + 1) * WINDOW)
    cut = rest.where((stop > open_) & (F.col("at") < last)).withColumn("w", F.explode(F.sequence(F.floor((F.greatest("at", F.lit(open_)) - open_) / WINDOW), F.floor((F.least(stop, F.lit(last)) - 1 - open_) / WINDOW))))
    return pieces.unionByName(cut.select("part", "idx", (F.col("start") + low - F.col("at")).alias("start"), (high - low).alias("length"), (F.col("w") + base).alias("sequence_id"), (low - open_ - F.col("w") * WINDOW).alias("offset")))


def packed(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): each piece with its ids, little-endian 32-bit."""
    tokens = tokenized(docs, tokenizer, end_id)
    pieces = layout(tokens.drop("ids", "doc_id"))
    by_row = pieces.groupBy("part", "idx").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: [] for c in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
            for doc_id, n, ids, cuts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids", "pieces")), strict=True):
                ids = np.frombuffer(ids, np.uint16 if len(ids) == 2 * n else np.uint32)
                for p in cuts:
                    piece = ids[p["start"] : p["start"] + p["length"]].astype("<u4").tobytes()
                    for c, v in zip(out, (doc_id, p["start"], p["length"], piece, n, p["sequence_id"], p["offset"]), strict=True):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.binary() if c == "ids" else pa.int64()) for c, v in out.items()})

    joined = tokens.select("part", "idx", "doc_id", "n", "ids").join(by_row, ["part", "idx"]).select("doc_id", "n", "ids", "pieces")
    return joined.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def _digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(packed(table(spark, sf_dir, "documents").select("doc_id", "text"), word_vocabulary()))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the pieces of all documents that are left."""
    return _digest(packed(docs, word_vocabulary()))
