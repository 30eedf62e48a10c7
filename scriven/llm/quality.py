"""Quality rules by weak supervision: rules vote good, bad or abstain; expectation-maximisation over the
vote patterns estimates each rule's accuracy; a document stays if its posterior of being good is 0.5 or more.

Everything here is DataFrame expressions. What reaches the driver is the fitted model, two rates
a rule; EM itself runs over one row that holds the counts of the vote patterns, at most 3^6.

Defined cases: null or empty text has no words and fails the base rules; a repeated row is judged each
time alike; an empty table returns no row; other columns of the input pass through `score` unchanged
unless they carry one of the result's names, which is then replaced, or begin with _q_, as steps in between do: such columns are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_RUN, SPACES, table, written

GOOD, BAD, ABSTAIN = 1, -1, 0
#: rule: (numerator, denominator, good at or below, bad above); between the two bounds it abstains.
RULES = {
    "symbols": ("n_symbols", "n_words", 0.02, 0.1),
    "repeat_words": ("n_repeat_words", "n_words", 0.1, 0.3),
    "dup_lines": ("n_dup_lines", "n_lines", 0.1, 0.4),
    "upper": ("n_upper", "word_chars", 0.12, 0.4),
    "digits": ("n_digits", "word_chars", 0.1, 0.3),
    "short_words": ("n_words", "word_chars", 0.4, 0.6),
}
#: What is expected before any count: how often a rule votes against a good and against a bad document, and the share of good ones.
FALSE_ALARM, HIT, GOOD_SHARE = 0.005, 0.3, 0.9
#: Weight of the first expectation, in votes for each good document; the others weigh 1 and 10 documents.
FALSE_ALARM_WEIGHT = 1.0
STEPS = 30
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits")


def _shifted(a: Column) -> Column:
    """The array without its first element; the last element then meets null in zip_with."""
    return F.slice(a, 2, F.greatest(F.size(a), F.lit(1)))


def with_features(docs: DataFrame) -> DataFrame:
    """docs with the counts in FEATURES. Arrays never leave their row: no shuffle, whatever a text's length."""
    c = F.col
    text = F.coalesce(c("text").cast("string"), F.lit(""))
    kept = [x for x in docs.columns if x not in FEATURES and not x.startswith("_q_")]
    trimmed = F.btrim(c("_q_text"), F.lit(SPACES))
    rest = lambda *more: [*kept, *more]
    out = docs.select(*kept, text.alias("_q_text"))
    out = out.select(*rest("_q_text"), F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN)).alias("_q_words"), F.filter(F.split(c("_q_text"), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("_q_lines"))
    # the hash of each 3-word window beside its place, equal windows next to each other
    windows = F.transform(c("_q_words"), lambda w, i: F.struct(F.xxhash64(w, F.get(c("_q_words"), i + 1), F.get(c("_q_words"), i + 2)).alias("h"), i.alias("i")))
    out = out.select(*rest("_q_text", "_q_words", "_q_lines"), F.sort_array(F.slice(windows, 1, F.greatest(F.size(c("_q_words")) - 2, F.lit(0)))).alias("_q_sorted"))
    out = out.select(*rest("_q_text", "_q_words", "_q_lines", "_q_sorted"), F.zip_with(c("_q_sorted"), _shifted(c("_q_sorted")), lambda a, b: F.coalesce(a.h == b.h, F.lit(False))).alias("_q_next"))
    repeated = F.zip_with(c("_q_next"), F.concat(F.array(F.lit(False)), c("_q_next")), lambda x, y: x | y)
    at = F.array_compact(F.zip_with(c("_q_sorted"), repeated, lambda a, r: F.when(r, a.i)))
    out = out.select(*rest("_q_text", "_q_words", "_q_lines"), F.sort_array(at).alias("_q_at"))
    # a repeated window covers its three words, less those that the next repeated window covers too
    covered = F.zip_with(c("_q_at"), _shifted(c("_q_at")), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    long = lambda x: F.coalesce(x.cast("long"), F.lit(0).cast("long"))
    found = lambda pattern: long(F.regexp_count("_q_text", F.lit(pattern)))
    return out.select(
        *kept,
        long(F.size("_q_words")).alias("n_words"),
        long(F.length(F.array_join("_q_words", ""))).alias("word_chars"),
        found("[#*$%&|<>]").alias("n_symbols"),
        long(F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).alias("n_dup_lines"),
        long(F.aggregate(covered, F.lit(0), lambda s, x: s + x)).alias("n_repeat_words"),
        long(F.size("_q_lines")).alias("n_lines"),
        found("\\p{Lu}").alias("n_upper"),
        found("[0-9]").alias("n_digits"),
    )


def votes() -> list[Column]:
    """One column a rule: 1 good, -1 bad, 0 abstain (also where the denominator is 0)."""
    out = []
    for name, (top, bottom, good, bad) in RULES.items():
        share = F.try_divide(F.col(top), F.col(bottom))
        out.append(F.when(share > bad, F.lit(BAD)).when(share <= good, F.lit(GOOD)).otherwise(F.lit(ABSTAIN)).cast("byte").alias(f"v_{name}"))
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class VoteModel:
    """prior: share of good documents; bad_votes[rule] = P(vote bad | good document), P(vote bad | bad document), among votes cast."""

    prior: float
    bad_votes: dict[str, tuple[float, float]]

    def log_odds(self) -> Column:
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, (in_good, in_bad) in self.bad_votes.items():
            v = F.col(f"v_{name}")
            total = total + F.when(v == BAD, F.lit(math.log(in_good / in_bad))).when(v == GOOD, F.lit(math.log((1 - in_good) / (1 - in_bad)))).otherwise(F.lit(0.0))
        return total

    def posterior(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.log_odds()))

    def accuracy(self, name: str) -> float:
        """The chance that a vote of this rule is right."""
        in_good, in_bad = self.bad_votes[name]
        return self.prior * (1 - in_good) + (1 - self.prior) * in_bad


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's variable is bound, an expression used twice is not."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(xs: Column, f) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + f(x))


def _em_step(state: Column, patterns: Column) -> Column:
    """One round of EM over patterns, an array of (v: array of votes, n: rows); state: prior, in_good, in_bad."""

    def good_mass(p: Column) -> Column:
        def odds(v: Column, i: Column) -> Column:
            g, b = F.get(state.in_good, i), F.get(state.in_bad, i)
            return F.when(v == BAD, F.log(g / b)).when(v == GOOD, F.log((1 - g) / (1 - b))).otherwise(0.0)

        return p.n / (1 + F.exp(-(F.log(state.prior / (1 - state.prior)) + _total(F.transform(p.v, odds), lambda x: x))))

    def rates(ps: Column, mass, low: float, high: float, mean: float, weight) -> Column:
        def rate(i: Column) -> Column:
            against = _total(ps, lambda x: F.when(F.get(x.v, i) == BAD, mass(x)).otherwise(0.0))
            cast = _total(ps, lambda x: F.when(F.get(x.v, i) != ABSTAIN, mass(x)).otherwise(0.0))
            return F.greatest(F.least((against + mean * weight) / (cast + weight), F.lit(high)), F.lit(low))

        return F.transform(F.sequence(F.lit(0), F.lit(len(RULES) - 1)), rate)

    def maximised(ps: Column) -> Column:
        good, bad = lambda x: x.g, lambda x: x.n - x.g
        prior = (_total(ps, good) + 10 * GOOD_SHARE) / (_total(ps, lambda x: x.n) + 10)
        in_good = rates(ps, good, 1e-4, 0.5, FALSE_ALARM, FALSE_ALARM_WEIGHT * (_total(ps, good) + 1))
        return F.struct(prior.alias("prior"), in_good.alias("in_good"), rates(ps, bad, 0.02, 0.98, HIT, F.lit(1.0)).alias("in_bad"))

    return _let(F.transform(patterns, lambda p: F.struct(p.v.alias("v"), p.n.alias("n"), good_mass(p).alias("g"))), maximised)


def fit(features: DataFrame, steps: int = STEPS) -> VoteModel:
    """EM for two hidden classes over all rows that pass the base rules.

    The rows are first counted by vote pattern; the patterns, at most 3^6, are one array in one row, and
    all EM steps are one fold over it. Two rates a rule come back, both estimated. A rule's bounds are set so that a good
    document rarely meets its bad side: FALSE_ALARM says how rarely as an expectation that weighs as much as the votes themselves.
    Without it one informative rule alone leaves the classes undetermined.
    """
    names = list(RULES)
    patterns = features.where(~base_failed()).select(F.array(*votes()).alias("v")).groupBy("v").agg(F.count("*").cast("double").alias("n"))
    rates = lambda x: F.array(*[F.lit(float(x))] * len(names))
    start = F.struct(F.lit(GOOD_SHARE).alias("prior"), rates(FALSE_ALARM).alias("in_good"), rates(HIT).alias("in_bad"))
    row = patterns.agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("patterns")).select(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda state, _: _em_step(state, F.col("patterns"))).alias("m")).first()
    return VoteModel(row.m.prior, {n: (g, b) for n, g, b in zip(names, row.m.in_good, row.m.in_bad, strict=True)})


def score(docs: DataFrame, model: VoteModel) -> DataFrame:
    """docs with FEATURES, votes, base_failed, good_probability and kept."""
    return judged(with_features(docs), model)


def judged(features: DataFrame, model: VoteModel) -> DataFrame:
    out = features.select(*(c for c in features.columns if not c.startswith("v_") and c not in ("base_failed", "good_probability", "kept")), *votes(), base_failed().alias("base_failed"))
    return out.withColumn("good_probability", model.posterior()).withColumn("kept", ~F.col("base_failed") & (F.col("good_probability") >= 0.5))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = written(with_features(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "quality")
    return judged(features, fit(features)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.floor(100 * F.col("good_probability") + 0.5).alias("good_percent"))


def oracle() -> str:
    """The query in DuckDB's SQL: counts, votes, and one pair of tables for each step of EM."""
    k, words = range(len(RULES)), "[^\\x20\\x09-\\x0d]+"
    vote = lambda top, bottom, good, bad: f"CASE WHEN {bottom} = 0 THEN 0 WHEN {top}::DOUBLE / {bottom} > {bad}::DOUBLE THEN -1 WHEN {top}::DOUBLE / {bottom} <= {good}::DOUBLE THEN 1 ELSE 0 END"
    votes_ = ", ".join(f"{vote(*rule)} AS v{i}" for i, rule in enumerate(RULES.values()))
    odds = " + ".join(["ln(prior / (1 - prior))", *(f"CASE v{i} WHEN -1 THEN ln(g{i} / b{i}) WHEN 1 THEN ln((1 - g{i}) / (1 - b{i})) ELSE 0 END" for i in k)])

    def rate(i: int, mass: str, low: float, high: float, mean: float, weight: str) -> str:
        return f"greatest(least((sum(CASE WHEN v{i} = -1 THEN {mass} ELSE 0 END) + {mean}::DOUBLE * {weight}) / (sum(CASE WHEN v{i} <> 0 THEN {mass} ELSE 0 END) + {weight}), {high}::DOUBLE), {low}::DOUBLE)"

    steps = [f"m0 AS (SELECT {GOOD_SHARE}::DOUBLE AS prior, {', '.join(f'{FALSE_ALARM}::DOUBLE AS g{i}, {HIT}::DOUBLE AS b{i}' for i in k)})"]
    for step in range(1, STEPS + 1):
        rates = ", ".join(f"{rate(i, 'g', 1e-4, 0.5, FALSE_ALARM, f'({FALSE_ALARM_WEIGHT}::DOUBLE * (sum(g) + 1))')} AS g{i}, {rate(i, '(n - g)', 0.02, 0.98, HIT, '1.0::DOUBLE')} AS b{i}" for i in k)
        steps.append(f"e{step} AS (SELECT {', '.join(f'v{i}' for i in k)}, n, n / (1 + exp(-({odds}))) AS g FROM p, m{step - 1})")
        steps.append(f"m{step} AS (SELECT (sum(g) + {10 * GOOD_SHARE}::DOUBLE) / (sum(n) + 10) AS prior, {rates} FROM e{step})")
    return f"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{words}') AS w FROM documents),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{words}')) AS lines FROM t),
x AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS times FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
r AS (SELECT rid, count(DISTINCT place) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS place FROM x WHERE times > 1) GROUP BY rid),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, len(regexp_extract_all(text, '\\p{{Lu}}')) AS n_upper, len(regexp_extract_all(text, '[0-9]')) AS n_digits FROM l LEFT JOIN r USING (rid)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {votes_} FROM f),
p AS (SELECT {', '.join(f'v{i}' for i in k)}, count(*)::DOUBLE AS n FROM j WHERE NOT base_failed GROUP BY ALL), {', '.join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 1 / (1 + exp(-({odds}))) >= 0.5 AS kept, floor(100 / (1 + exp(-({odds}))) + 0.5)::BIGINT AS good_percent FROM j, m{STEPS}"""


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that are kept, with their own columns.

    Documents and counts are written once; a filter over columns still to be computed would be pushed below them and
    their shared parts multiplied out.
    """
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), "text")
    features = written(with_features(whole).drop("text"), "quality")
    return judged(features, fit(features)).where("kept").select("_doc.*")
