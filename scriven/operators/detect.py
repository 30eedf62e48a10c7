"""Detection of text that a recogniser copied from its prompt."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct word trigrams of the prompts that are held in a set sent to the tasks, 8 bytes each; more go through a join.
MOST_HELD = 1_000_000


def _trigrams(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_words and _g, the 64-bit hash of each trigram by its place; the words are a column of their own first, since each trigram looks
    into them."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^\\p{L}\\p{M}\\p{N}]+"), lambda w: w != "")
    rows = texts.select(*keys, F.transform(words, lambda w: F.xxhash64(w)).alias("_w"))
    grams = F.transform(F.slice("_w", 1, F.greatest(F.size("_w") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2)))
    return rows.select(*keys, F.size("_w").cast("long").alias("n_words"), grams.alias("_g"))


def _covered(at: Column) -> Column:
    """Words that the trigrams at these places, ascending, lie on."""
    after = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return F.aggregate(after, F.lit(0), lambda s, x: s + x).cast("long")


def prompt_leak(texts: DataFrame, prompts: DataFrame, keys: list[str], share: float = 0.5) -> DataFrame:
    """texts(keys.., text) and prompts(text): keys, n_words, covered (words in a trigram of some prompt) and leak.

    Trigrams are compared by 64-bit hashes. The prompts' distinct ones are counted first: up to MOST_HELD of them are
    looked up inside each row, so no word of a text is shuffled; beyond, hashes that occur in a text are joined.
    A text under three words is no leak.
    """
    wanted = _trigrams(prompts, []).select(F.explode("_g").alias("g")).distinct()
    rows = _trigrams(texts, keys)
    held = wanted.limit(MOST_HELD + 1).toArrow()["g"].to_numpy()
    if len(held) <= MOST_HELD:
        shared = texts.sparkSession.sparkContext.broadcast(np.sort(held))

        @F.pandas_udf("array<int>")
        def found(s: pd.Series) -> pd.Series:
            known = shared.value
            lengths = np.array([len(x) for x in s])
            flat = np.concatenate([np.zeros(0, np.int64), *s])
            hit = known[np.minimum(np.searchsorted(known, flat), len(known) - 1)] == flat if len(known) else np.zeros(len(flat), bool)
            ends = np.cumsum(lengths)
            return pd.Series([np.flatnonzero(hit[a:b]).astype(np.int32) for a, b in zip(ends - lengths, ends)])

        out = rows.select(*keys, "n_words", found("_g").alias("_at"))
    else:
        flat = rows.select(*keys, F.posexplode("_g").alias("p", "g")).join(wanted, "g", "left_semi")
        hits = flat.groupBy(*keys).agg(F.sort_array(F.collect_set("p")).alias("_at"))
        out = rows.drop("_g").join(hits, keys, "left").withColumn("_at", F.coalesce("_at", F.array().cast("array<int>")))
    out = out.withColumn("covered", _covered(F.col("_at")))
    return out.select(*keys, "n_words", "covered", ((F.col("n_words") >= 3) & (F.col("covered") >= share * F.col("n_words"))).alias("leak"))
