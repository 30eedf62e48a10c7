"""Cleaning of recognised words, and the sheet of decisions to check."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _staying(words: list[str], word_times: int, phrase_times: int, longest: int) -> np.ndarray:
    """The places of the words that `collapse_repeats` leaves.

    Words are compared in lower case without signs; a word of signs only ends a run. Words that equal the n-th word behind them
    form stretches; one of length m says that a unit of n words stands m // n + 1 times in a row.
    """
    numbers: dict[str, int] = {"": -1}
    code = np.array([numbers.setdefault(re.sub(r"[^\w]", "", w.lower()), len(numbers)) for w in words], np.int64)
    at = np.arange(len(words))
    for n in range(1, longest + 1):
        c = code[at]
        if len(c) <= n:
            break
        same = np.concatenate([[False], (c[:-n] == c[n:]) & (c[n:] >= 0), [False]])
        starts, stops = np.flatnonzero(~same[:-1] & same[1:]), np.flatnonzero(same[:-1] & ~same[1:])
        times = (stops - starts) // n + 1
        stays = np.ones(len(c), bool)
        for start, k in zip(starts, times):
            if k >= (word_times if n == 1 else phrase_times):
                stays[start + n : start + k * n] = False
        at = at[stays]
    return at


def collapse_repeats(words: list[str], word_times: int = 4, phrase_times: int = 3, longest: int = 8) -> list[str]:
    """Units of one to eight words repeated too often in a row stand once; units shorter first."""
    return [words[i] for i in _staying(words, word_times, phrase_times, longest)]


def _shortened(rows: pa.Array) -> pa.Array:
    """Rows of words, each collapsed; one row at a time is Python strings."""
    places, ends, first = [np.array([], np.int64)], [0], 0
    for row in rows:
        words = row.as_py()
        at = _staying(words, 4, 3, 8)
        places.append(at + first)
        ends.append(ends[-1] + len(at))
        first += len(words)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows.flatten().take(pa.array(np.concatenate(places))))


def with_collapsed(df: DataFrame, words: str) -> DataFrame:
    """df with its word array collapsed and `repetition`, whether anything went."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            yield _shortened(rows)

    shorter = F.arrow_udf(run, "array<string>")(F.coalesce(F.col(words), F.array().cast("array<string>")))
    return df.withColumn("_shorter", shorter).withColumn("repetition", F.size("_shorter") < F.size(words)).withColumn(words, F.col("_shorter")).drop("_shorter")


def review_sheet(decisions: DataFrame, lines: DataFrame) -> DataFrame:
    """decisions(job, case_key, decision, turn_id) with lines(job, id, line): (job, sheet), each decision above its line."""
    found = decisions.join(lines.select("job", F.col("id").alias("turn_id"), "line"), ["job", "turn_id"], "left")
    item = F.concat(F.lit("- [ ] "), "case_key", F.lit(": "), "decision", F.lit("\n  > "), F.coalesce("line", F.lit("(not found)")))
    parts = F.array_sort(F.collect_list(F.struct(F.coalesce("turn_id", F.lit(2**62)).alias("t"), item.alias("x"))))
    return found.groupBy("job").agg(F.array_join(F.transform(parts, lambda p: p.x), "\n").alias("sheet"))
