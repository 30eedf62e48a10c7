"""Speech segments: near ones of a speaker merged, short ones attached to a neighbour, long ones cut at pauses, all padded.

Merging and padding are windows over the job. Attaching goes through a job's segments in order and says which of them belong
together; the cuts of a long segment need nothing but its own pauses, so they are found segment by segment.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import intervals as I
from .folds import ordered_fold


class Span(NamedTuple):
    """A stretch of speech and the numbers of the segments in it."""

    start: float
    end: float
    speaker: str
    members: tuple[int, ...]


def _joined(short: Span, other: Span) -> Span:
    """The longer one names the speaker, the other one of equals."""
    named = short if short.end - short.start > other.end - other.start else other
    return Span(min(short.start, other.start), max(short.end, other.end), named.speaker, short.members + other.members)


def attached(segments: Iterator[Span], least: float, gap: float, most: float) -> list[Span]:
    """A span under `least` joins a neighbour at most `gap` away if both fit into `most`: one of its speaker before another,
    then the nearer, then the earlier. What they become is looked at again before the next one.
    """
    ready, ahead = [], deque(segments)
    while ahead:
        span = ahead.popleft()
        while span.end - span.start < least:
            sides = []
            for side, place in ((ready, -1), (ahead, 0)):
                if side:
                    other = side[place]
                    apart = max(other.start, span.start) - min(other.end, span.end)
                    if apart <= gap and max(other.end, span.end) - min(other.start, span.start) <= most:
                        sides.append((other.speaker != span.speaker, apart, -place, side))
            if not sides:
                break
            side = min(sides, key=lambda s: (s[0], s[1], s[2] == 0))[3]
            span = _joined(span, side.pop() if side is ready else side.popleft())
        ready.append(span)
    return ready


def pieces(parts: np.ndarray, above: float, most: float, least: float, quiet: np.ndarray) -> list[tuple[float, float]]:
    """(start, end) of what a segment is cut into; parts: its stretches of speech (start, end), in order.

    A worklist: a piece over `above` is cut at the longest pause (to 10 ms; of equals the one nearest its middle) that leaves
    `least` on both sides, and both sides go back on the list. A piece over `most` without such a pause is cut
    where its middle half is quietest; quiet: (time, level) rows of the segment, its middle where there are none.
    """
    done, todo = [], [parts]
    while todo:
        own = todo.pop()
        start, end = own[0, 0], own[:, 1].max()
        length, middle = end - start, (start + end) / 2
        if length <= above:
            done.append((start, end))
            continue
        pause = np.stack([own[:-1, 1], own[1:, 0]], 1)
        fits = np.flatnonzero((pause[:, 0] - start >= least) & (end - pause[:, 1] >= least))
        if len(fits):
            size = np.array([round(b - a, 2) for a, b in pause[fits].tolist()])
            cut = fits[np.lexsort((np.abs(pause[fits].mean(1) - middle), -size))[0]] + 1
            todo += [own[cut:], own[:cut]]
        elif length <= most:
            done.append((start, end))
        else:
            inner = quiet[(quiet[:, 0] >= start + length / 4) & (quiet[:, 0] < end - length / 4)]
            at = inner[inner[:, 1].argmin(), 0] if len(inner) else middle
            todo += [np.maximum(own[own[:, 1] > at], at), np.minimum(own[own[:, 0] < at], at)]
    return done


def _rows(values, names: tuple[str, str]) -> np.ndarray:
    found = [] if values is None else [(v[names[0]], v[names[1]]) for v in values]
    return np.array(found, float).reshape(-1, 2)


def build_segments(regions: DataFrame, least: float, gap: float, attach_gap: float, above: float, most: float, pad: float, frames: DataFrame | None = None) -> DataFrame:
    """regions(job, start, end, speaker) to padded segments (job, seq, speaker, start, end); frames(job, at, energy) tell
    where a segment without pauses is quietest."""
    longest = most - 2 * pad
    own = Window.partitionBy("job").orderBy("_run", "_part")
    rows = I.speaker_islands(regions.select("job", "start", "end", "speaker"), ["job"], gap, tie="speaker").withColumn("no", F.dense_rank().over(own))
    merged = rows.groupBy("job", "no").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("speaker").alias("speaker"))

    def fold(key: tuple, ordered: Iterator) -> Iterator[tuple]:
        for n, span in enumerate(attached((Span(r.start, r.end, r.speaker, (r.no,)) for r in ordered), least, attach_gap, longest)):
            for no in span.members:
                yield (*key, no, n, span.speaker)

    groups = ordered_fold(merged, ["job"], ["no"], fold, "job long, no long, grp long, by string")
    groups = groups.select(F.col("job").alias("_job"), F.col("no").alias("_no"), "grp", "by")
    speech = rows.join(groups, F.col("job").eqNullSafe(F.col("_job")) & (F.col("no") == F.col("_no"))).groupBy("job", "grp", "by").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("parts"))
    # levels are wanted only inside segments that are too long
    speech = speech.withColumn("start", F.element_at("parts", 1)["start"]).withColumn("end", F.array_max(F.transform("parts", lambda p: p["end"])))
    level = F.lit(None).cast("array<struct<at:double,energy:double>>")
    if frames is not None:
        # a segment meets the frames of the time buckets that it touches, not all of its job
        wide = speech.where(F.col("end") - F.col("start") > longest).select("job", "grp", "start", "end")
        inside = I.points_in(frames.select("job", "at", "energy"), wide, ["job"], "at", longest).where("r.grp IS NOT NULL AND p.at < r.end").select("r.job", "r.grp", "p.at", "p.energy")
        speech = speech.join(inside.groupBy("job", "grp").agg(F.sort_array(F.collect_list(F.struct(F.col("at").cast("double").alias("at"), F.col("energy").cast("double").alias("energy")))).alias("level")), ["job", "grp"], "left")
        level = F.col("level")

    @F.pandas_udf("array<double>")
    def cut(starts: pd.Series, ends: pd.Series, levels: pd.Series) -> pd.Series:
        """Start and end of each piece, one after another."""
        return pd.Series([np.array(pieces(np.column_stack([a, b]), above, longest, least, _rows(q, ("at", "energy")))).ravel() for a, b, q in zip(starts, ends, levels)])

    speech = speech.withColumn("level", level)
    long = F.col("end") - F.col("start") > above
    each = lambda side: F.transform("parts", lambda p: p[side])
    edges = speech.where(long).select("job", "grp", "by", cut(each("start"), each("end"), "level").alias("e"))
    cuts = F.transform(F.sequence(F.lit(0), F.floor(F.size("e") / 2).cast("int") - 1), lambda i: F.struct(F.get("e", 2 * i).alias("start"), F.get("e", 2 * i + 1).alias("end")))
    flat = edges.select("job", F.col("by").alias("speaker"), "grp", F.posexplode(cuts).alias("k", "piece")).select("job", "speaker", "piece.*", (F.col("grp") * 2**20 + F.col("k")).alias("no"))
    # what is short enough does not leave the JVM
    flat = flat.unionByName(speech.where(~long).select("job", F.col("by").alias("speaker"), "start", "end", (F.col("grp") * 2**20).alias("no")))
    # neighbours in the order of the segments, which need not be that of their ends
    w = Window.partitionBy("job").orderBy("no")
    low = F.coalesce((F.lag("end").over(w) + F.col("start")) / 2, F.lit(0.0))
    high = F.coalesce((F.col("end") + F.lead("start").over(w)) / 2, F.lit(float("inf")))
    return flat.select("job", (F.row_number().over(w) - 1).cast("long").alias("seq"), "speaker", F.round(F.greatest(F.col("start") - pad, low), 3).alias("start"), F.round(F.least(F.col("end") + pad, high), 3).alias("end"))


def cut_points(start: float, end: float, target: float, least: float, most: float, levels: np.ndarray) -> list[float]:
    """Where a region over `most` is cut: near each `target` after the last cut, at the quietest of the levels (time, level) within a second,
    but no earlier than `least` and no later than `most` after that cut."""
    out, at = [], start
    while end - at > most:
        near = levels[np.abs(levels[:, 0] - (at + target)) <= 1.0]
        best = near[near[:, 1].argmin(), 0] if len(near) else at + target
        at = min(max(best, at + max(least, 1.0)), at + most, end)
        out.append(at)
    return out


def split_regions(regions: DataFrame, frames: DataFrame | None, target: float, least: float, most: float) -> DataFrame:
    """regions(job, start, end) with those over `most` cut (cut_points); frames(job, at, energy) are the levels."""
    keyed = regions.select("job", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    short, long = keyed.where(F.col("end") - F.col("start") <= most), keyed.where(F.col("end") - F.col("start") > most)
    if frames is None:
        long = long.withColumn("level", F.lit(None).cast("array<struct<at:double,energy:double>>"))
    else:
        around = long.distinct().select("job", F.col("start").alias("_a"), F.col("end").alias("_b"), (F.col("start") - 1).alias("start"), (F.col("end") + 1).alias("end"))
        found = I.points_in(frames.select("job", F.col("at").cast("double").alias("at"), F.col("energy").cast("double").alias("energy")), around, ["job"], "at", most).where("_a IS NOT NULL")
        level = found.groupBy("r.job", F.col("_a").alias("start"), F.col("_b").alias("end")).agg(F.sort_array(F.collect_list(F.struct("at", "energy"))).alias("level"))
        long = long.join(level, ["job", "start", "end"], "left")

    @F.pandas_udf("array<double>")
    def cut(start: pd.Series, end: pd.Series, levels: pd.Series) -> pd.Series:
        return pd.Series([cut_points(a, b, target, least, most, _rows(q, ("at", "energy"))) for a, b, q in zip(start, end, levels)])

    edges = long.select("job", F.concat(F.array("start"), cut("start", "end", "level"), F.array("end")).alias("e"))
    pairs = edges.select("job", F.explode(F.arrays_zip(F.slice("e", 1, F.size("e") - 1).alias("start"), F.slice("e", 2, F.size("e")).alias("end"))).alias("p"))
    return short.unionByName(pairs.select("job", "p.start", "p.end"))
