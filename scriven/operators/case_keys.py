"""Case keys of a meeting: how sure two keys mean one case, and an index that tells which earlier keys can be that near.

The score of a pair is the first of the ranked `RULES` that says something. The index keeps the keys as rows of arrays and bounds
the score of a new key against all of them at once, from the letters of their words and from the words they share; only keys whose bound
reaches what is asked are compared, so a meeting of many cases costs array operations, not comparisons. Where few keys are asked about, all are compared
and no arrays are made.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from scriven.functions import text as T
from scriven.functions.similarity import token_set_ratio, token_sort_ratio

# fixed values: from which score two keys are one case
SAME_CASE = 90
# fixed values: words that make a case key one of a person; places in a case key
PERSON = "pacient\\w*|pat(?:ul)?|box\\w*|bocs\\w*|salon\\w*|rezerv\\w*|bolnav\\w*"
LOCATION = "(pat(?:ul)?|box[aăe]?|salon(?:ul)?|rezerva)\\s+(?:nr\\s*)?(\\d+)"


@dataclass(frozen=True)
class Key:
    """What a case key is compared by."""

    said: str
    plain: str
    places: frozenset[str]
    digits: frozenset[str]
    person: bool
    topic: str  # first letters of the words after a colon

    @property
    def is_topic(self) -> bool:
        return not self.places and not self.person


def key_features(key: Column) -> Column:
    """The fields of `Key`."""
    plain = T.norm_key(key)
    place = lambda group: F.regexp_extract_all(plain, F.lit(f"(?U)\\b{LOCATION}"), F.lit(group))
    return F.struct(
        F.coalesce(key, F.lit("")).alias("said"), plain.alias("plain"),
        F.zip_with(place(1), place(2), lambda k, n: F.concat(F.substring(k, 1, 3), F.lit(" "), n)).alias("places"),
        F.regexp_extract_all(plain, F.lit("\\d+"), F.lit(0)).alias("digits"), plain.rlike(f"(?U)\\b(?:{PERSON})\\b").alias("person"),
        T.stems5(F.regexp_replace(F.coalesce(key, F.lit("")), "(?s)^[^:]*:", "")).alias("topic"),
    )


def _alike_topics(a: Key, b: Key) -> float | None:
    score = token_set_ratio(a.topic, b.topic) if a.is_topic and b.is_topic and ":" in a.said + b.said else 0.0
    return score if score >= SAME_CASE else None


def _numbers(a: Key, b: Key) -> float | None:
    if not a.digits or not b.digits:
        return None
    return token_set_ratio(a.plain, b.plain) if a.digits == b.digits else 0.0


#: The first that gives a score decides.
RULES = (
    lambda a, b: 100.0 if a.plain == b.plain else None,
    lambda a, b: 100.0 * bool(a.places & b.places) if a.places and b.places else None,
    _alike_topics,
    _numbers,
    lambda a, b: token_sort_ratio(a.plain, b.plain),
)


@lru_cache(1 << 14)  # many meetings have the same keys
def key_score(a: Key, b: Key) -> float:
    """How sure two case keys mean one case: 0 another, 100 the same."""
    return next(score for rule in RULES if (score := rule(a, b)) is not None)


#: So many keys are compared one by one.
FEW = 16

#: Letters fall into so many classes: a bound from classes is never below the one from letters.
CLASSES = 48


class _Texts:
    """Texts of an index, each word once or as often as it stands, and an upper bound of their ratio with another text."""

    def __init__(self, once: bool):
        self.once = once
        self.letters = np.zeros((CLASSES, 64), np.int16)
        self.sizes = np.zeros(64, np.int32)
        self.words: dict[str, list[int]] = {}
        self.n = 0

    @staticmethod
    def _parts(text: str, once: bool) -> tuple[list[str], np.ndarray, int]:
        words = text.split()
        different = sorted(set(words))
        joined = " ".join(different if once else words)
        counts = np.zeros(CLASSES, np.int16)
        for c, n in Counter(joined).items():
            counts[ord(c) % CLASSES] += n
        return different, counts, len(joined)

    def add(self, text: str) -> None:
        if self.n == len(self.sizes):
            self.letters, self.sizes = (np.concatenate([a, np.zeros_like(a)], axis=-1) for a in (self.letters, self.sizes))
        words, self.letters[:, self.n], self.sizes[self.n] = self._parts(text, self.once)
        for w in words:
            self.words.setdefault(w, []).append(self.n)
        self.n += 1

    def near(self, text: str, least: float, since: int, fits: np.ndarray) -> np.ndarray:
        """Which texts from number since on, of those that fit, can have a ratio of their words in order, or if they stand once a token_set_ratio, of least with text."""
        words, letters, size = self._parts(text, self.once)
        least -= 1e-9
        sizes = self.sizes[since : self.n]
        # lengths alone rule out most texts, letters most of the rest
        out = fits & (200.0 * np.minimum(sizes, size) >= least * (sizes + size))
        if out.any():
            common = np.zeros(len(sizes), np.int32)
            for c in np.flatnonzero(letters):
                common += np.minimum(self.letters[c, since : self.n], letters[c])
            out &= 200.0 * common >= least * (sizes + size)
        shared: dict[int, int] = {}
        for w in words if self.once else ():
            for i in self.words.get(w, ()):
                if i >= since and fits[i - since]:
                    shared[i] = shared.get(i, -1) + len(w) + 1
        for i, n in shared.items():
            smaller = min(int(self.sizes[i]), size)
            out[i - since] |= n >= smaller or 200.0 * n >= least * (n + smaller)
        return out


class KeyIndex:
    """Keys by number, and those of them that a new key can score `least` or more with."""

    def __init__(self):
        self.keys: list[Key] = []
        self._plain: dict[str, list[int]] = {}
        self._places: dict[str, list[int]] = {}
        self._numbers: dict[frozenset[str], int] = {frozenset(): 0}
        self._texts: _Texts | None = None

    def add(self, k: Key) -> None:
        self.keys.append(k)

    def _put(self, k: Key, n: int) -> None:
        self._plain.setdefault(k.plain, []).append(n)
        for p in k.places:
            self._places.setdefault(p, []).append(n)
        if n == len(self._kinds):
            self._kinds = np.concatenate([self._kinds, np.zeros_like(self._kinds)])
        self._kinds[n] = bool(k.places), k.is_topic, self._numbers.setdefault(k.digits, len(self._numbers)), ":" in k.said
        self._texts.add(k.plain)
        self._sets.add(k.plain)
        self._topics.add(k.topic)

    def near(self, k: Key, least: float, since: int = 0) -> Iterator[tuple[int, float]]:
        """(number, score) of keys from number since on that score least (over 0) or more with k, in order."""
        if len(self.keys) - since <= FEW:
            for n in range(since, len(self.keys)):
                if (score := key_score(k, self.keys[n])) >= least:
                    yield n, score
            return
        if self._texts is None:
            self._kinds = np.zeros((64, 4), np.int64)  # with places, a topic, its numbers, with a colon
            self._texts, self._sets, self._topics = _Texts(False), _Texts(True), _Texts(True)
        for n in range(self._texts.n, len(self.keys)):
            self._put(self.keys[n], n)
        sure = {n for n in self._plain.get(k.plain, ()) if n >= since} | {n for p in k.places for n in self._places.get(p, ()) if n >= since}
        placed, topic, numbers, colon = self._kinds[since : len(self.keys)].T
        fits = ~(placed.astype(bool) & bool(k.places))
        if k.digits:
            fits &= (numbers == 0) | (numbers == self._numbers.get(k.digits, -1))
        # only equal numbers are compared by the words that they share
        alike = fits & (numbers == self._numbers.get(k.digits, -1)) if k.digits else np.zeros(len(fits), bool)
        may = self._texts.near(k.plain, least, since, fits) | self._sets.near(k.plain, least, since, alike)
        if k.is_topic:  # topics are compared where either key has a colon
            may |= self._topics.near(k.topic, max(least, SAME_CASE), since, topic.astype(bool) & (colon.astype(bool) | (":" in k.said)))
        for n in sorted(sure | {since + int(i) for i in np.flatnonzero(may)}):
            if (score := key_score(k, self.keys[n])) >= least:
                yield n, score
