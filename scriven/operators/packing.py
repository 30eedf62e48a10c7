"""Turns and token windows: the synthetic clock, joining turns of one speaker, greedy windows with overlap."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriven.functions.text import est_tokens, time_code

from .folds import ordered_fold


def with_clock(turns: DataFrame, job: str = "conv_id", turn: str = "turn") -> DataFrame:
    """start_ds and end_ds in tenths of a second: 13 letters a second, at least 2 s, 0.8 s between turns."""
    w = Window.partitionBy(job).orderBy(turn)
    dur = F.greatest(F.lit(20), F.floor((F.length(F.coalesce("text", F.lit(""))) * 20 + 13) / 26)).cast("long")
    out = turns.withColumn("dur_ds", dur).withColumn("start_ds", F.sum(F.col("dur_ds") + 8).over(w) - F.col("dur_ds") - 8)
    return out.withColumn("end_ds", F.col("start_ds") + F.col("dur_ds")).drop("dur_ds")


def with_given_clock(turns: DataFrame, job: str = "conv_id", turn: str = "turn", start_ms: int = 1000) -> DataFrame:
    """start_ds and end_ds in tenths of a second for turns with at_ms, pause_ms and dur_ms, each null where it is not given.

    A turn with a time begins then; another begins 0.8 s and its pause after the end of the turn before, the first one at start_ms. A turn takes its
    given length, else 13 letters a second and 2 s at least. An end closer than 0.2 s to the next start, or behind it, moves to 0.2 s
    before it, but leaves half a second. The sum restarts at each given time, so it is a window, not a fold.
    """
    c, w = F.col, Window.partitionBy(job).orderBy(turn)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    own = F.greatest(F.lit(20), F.floor((F.length(F.coalesce("text", F.lit(""))) * 20 + 13) / 26)).cast("long") * 100
    t = turns.withColumn("_took", F.coalesce(F.when(c("dur_ms") > 0, c("dur_ms")), own).cast("long"))
    t = t.withColumn("_run", F.count("at_ms").over(upto))
    inside = Window.partitionBy(job, "_run").orderBy(turn)
    before = F.coalesce(F.sum(c("_took") + 800).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pauses = F.coalesce(F.sum(F.when(c("at_ms").isNull(), c("pause_ms"))).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    base = F.coalesce(F.first("at_ms").over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.lit(start_ms))
    t = t.withColumn("_at", (base + before + pauses).cast("long"))
    tenths = lambda ms: F.floor((ms + 50) / 100)
    t = t.withColumn("start_ds", tenths(c("_at"))).withColumn("_end", tenths(c("_at") + c("_took"))).withColumn("_next", F.lead("start_ds").over(w))
    end = F.when(c("_end") > c("_next") - 2, F.greatest(c("start_ds") + 5, c("_next") - 2)).otherwise(c("_end"))
    return t.withColumn("end_ds", end).drop("_took", "_run", "_at", "_end", "_next")


def speaker_runs(turns: DataFrame, job: str = "conv_id", order: str = "turn", speaker: str = "role") -> DataFrame:
    """run: number of the run of one speaker; UNK never joins."""
    w = Window.partitionBy(job).orderBy(order)
    new = F.lag(speaker).over(w).eqNullSafe(F.col(speaker)) & (F.col(speaker) != "UNK")
    return turns.withColumn("run", F.sum(F.when(F.coalesce(new, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def joined_turns(turns: DataFrame) -> DataFrame:
    """One row a run: (conv_id, id, speaker, start_ds, end_ds, line, tokens_est), no cap on length."""
    parts = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    out = speaker_runs(turns).groupBy("conv_id", "run").agg(F.first("role").alias("speaker"), F.min("start_ds").alias("start_ds"), F.max("end_ds").alias("end_ds"), F.array_join(F.transform(parts, lambda p: p.text), " ").alias("text"))
    line = F.concat(time_code(F.floor(F.col("start_ds") / 10)), F.lit(" "), "speaker", F.lit(": "), "text")
    out = out.select("conv_id", (F.col("run") - 1).alias("id"), "speaker", "start_ds", "end_ds", line.alias("line"))
    return out.withColumn("tokens_est", est_tokens(F.col("line")) + 1)


def capped_turns(segments: DataFrame, max_tokens: int) -> DataFrame:
    """Runs of one speaker cut where the joined text would pass max_tokens: (conv_id, id, speaker, first, last, text)."""

    def fold(key: tuple, rows: Iterator) -> Iterator[tuple]:
        held, n = None, 0
        for r in rows:
            text = r.text or ""
            if held and held[0] == r.role != "UNK" and (len(f"{held[3]} {text}".encode()) + 3) // 4 <= max_tokens:
                held = (held[0], held[1], r.turn, f"{held[3]} {text}")
                continue
            if held:
                yield (*key, n, *held)
                n += 1
            held = (r.role, r.turn, r.turn, text)
        if held:
            yield (*key, n, *held)

    return ordered_fold(segments.select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn"], fold, "conv_id long, id long, speaker string, first long, last long, text string")


def token_windows(lines: DataFrame, max_tokens: int, overlap: int) -> DataFrame:
    """Greedy windows of lines(conv_id, id, line, tokens_est): (conv_id, index, first, last, overlap_turns, tokens_est, text).

    A window takes at least one line; the next starts `overlap` lines before the end, at least one further on.
    """

    def fold(key: tuple, rows: Iterator) -> Iterator[tuple]:
        held: list = []
        index = total = overlapped = 0
        for r in rows:
            while held and total + r.tokens_est > max_tokens:
                yield (*key, index, held[0].id, held[-1].id, overlapped, total, "\n".join(x.line for x in held))
                held, index = held[max(len(held) - overlap, 1) :], index + 1
                overlapped, total = len(held), sum(x.tokens_est for x in held)
                # lines taken over may pass the budget with the next line again; then they make way as a window of their own
            held.append(r)
            total += r.tokens_est
        if held:
            yield (*key, index, held[0].id, held[-1].id, overlapped, total, "\n".join(x.line for x in held))

    return ordered_fold(lines.select("conv_id", "id", "line", "tokens_est"), ["conv_id"], ["id"], fold, "conv_id long, index long, first long, last long, overlap_turns long, tokens_est long, text string")


def token_chunks(lines: DataFrame, max_tokens: int) -> DataFrame:
    """Disjoint greedy chunks: windows without overlap."""
    return token_windows(lines, max_tokens, 0)


def with_context(chunks: DataFrame, lines: DataFrame, k: int) -> DataFrame:
    """(conv_id, index, id): up to k lines before each chunk."""
    c, t = chunks.select("conv_id", "index", "first").alias("c"), lines.select("conv_id", "id").alias("t")
    return c.join(t, (F.col("c.conv_id") == F.col("t.conv_id")) & F.col("t.id").between(F.col("first") - k, F.col("first") - 1)).select("c.conv_id", "index", "id")


def packed_chunks(regions: DataFrame, target: float, least: float, most: float, max_gap: float) -> DataFrame:
    """regions(job, start, end) in order to chunks (job, index, start, end, speech): one closes at a gap over max_gap,
    where its span would pass `most`, or where it would pass `target` with `least` speech packed.

    A region without an end is a point at its start; one without a start is left out.
    """

    def fold(key: tuple, rows: Iterator) -> Iterator[tuple]:
        held, n = None, 0
        for r in rows:
            if held:
                span = r.end - held[0]
                if span > most or r.start - held[1] > max_gap or (span > target and held[2] >= least):
                    yield (*key, n, *held)
                    held, n = None, n + 1
            held = (held[0], r.end, held[2] + r.end - r.start) if held else (r.start, r.end, r.end - r.start)
        if held:
            yield (*key, n, *held)

    known = regions.where("start IS NOT NULL").select("job", "start", F.coalesce("end", "start").alias("end"))
    return ordered_fold(known, ["job"], ["start", "end"], fold, "job long, index long, start double, end double, speech double")


def merged_tiny(chunks: DataFrame, least: float, most: float) -> DataFrame:
    """A chunk shorter than `least` joins the one before it if the span stays within `most`; renumbered."""

    def fold(key: tuple, rows: Iterator) -> Iterator[tuple]:
        held, n = None, 0
        for r in rows:
            if held and r.end - r.start < least and r.end - held[0] <= most:
                held = (held[0], r.end, held[2] + r.speech)
                continue
            if held:
                yield (*key, n, *held)
                n += 1
            held = (r.start, r.end, r.speech)
        if held:
            yield (*key, n, *held)

    return ordered_fold(chunks, ["job"], ["index"], fold, "job long, index long, start double, end double, speech double")


def thinned_starts(starts: DataFrame, apart: float) -> DataFrame:
    """starts(job, at, entity): one counts only if it is `apart` after the last that counted and names another entity.

    An unknown entity is an entity of its own; a start without a time is left out.
    """

    def fold(key: tuple, rows: Iterator) -> Iterator[tuple]:
        last = None
        for r in rows:
            if last is None or (r.at - last[0] >= apart and r.entity != last[1]):
                last = (r.at, r.entity)
                yield (*key, *last)

    return ordered_fold(starts.where("at IS NOT NULL").select("job", "at", "entity"), ["job"], ["at", "entity"], fold, "job long, at double, entity string")
