"""Language choice from score maps, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def best_language(scores: Column) -> Column:
    """Key of the largest value, the smallest key of equals."""
    ordered = F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct((-e.value).alias("v"), e.key.alias("k"))))
    return F.get(ordered, F.lit(0)).k


def pick_language(scores: Column, preferred: str, over: str, margin: float) -> Column:
    """The best language; where `over` is best, `preferred` if within the margin and no third language beats it."""
    best, own = best_language(scores), F.try_element_at(scores, F.lit(preferred))
    thirds = F.map_filter(scores, lambda k, v: ~k.isin(preferred, over))
    ahead = F.forall(F.map_values(thirds), lambda v: own >= v)
    return F.when((best == over) & (own + margin >= F.try_element_at(scores, F.lit(over))) & ahead, F.lit(preferred)).otherwise(best)


def candidates(scores: Column, compare: list[str], losers: list[str], sure: float) -> Column:
    """Languages to try: the detected one alone where it is sure and no loser, else the compared ones and it."""
    best = best_language(scores)
    alone = (F.try_element_at(scores, best) >= sure) & ~best.isin(*losers)
    return F.when(alone, F.array(best)).otherwise(F.array_distinct(F.concat(F.array(*map(F.lit, compare)), F.array(best))))


def restricted(scores: Column, allowed: list[str]) -> Column:
    """Allowed languages only, all if none is there, best first: array of (k, v), v to 3 places."""
    kept = F.map_filter(scores, lambda k, v: k.isin(*allowed))
    used = F.when(F.size(kept) > 0, kept).otherwise(scores)
    ordered = F.array_sort(F.transform(F.map_entries(used), lambda e: F.struct((-e.value).alias("n"), e.key.alias("k"))))
    return F.transform(ordered, lambda e: F.struct(e.k.alias("k"), F.round(-e.n, 3).alias("v")))


def uncertain(scores: Column, lang_prob: Column, method: Column, margin: float = 0.1, least: float = 0.5) -> Column:
    """Two best scores closer than the margin; with fewer scores, an unforced probability under `least`."""
    values = F.sort_array(F.map_values(F.coalesce(scores, F.create_map().cast("map<string,double>"))), asc=False)
    return F.when(F.size(values) >= 2, F.get(values, F.lit(0)) - F.get(values, F.lit(1)) < margin).otherwise((F.coalesce(method, F.lit("detect")) != "forced") & (lang_prob < least))


def low_confidence(logprob: Column, least: float) -> Column:
    return F.coalesce(logprob < least, F.lit(True))
