"""Text rules on the tables' own texts, some of whose words are changed for days, units, places, numbers and time codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriven.functions import cleanup as C
from scriven.functions import repairs as R
from scriven.functions import text as T

from .base import query, said, said_sql, table, turns

_SAID = [
    ("the", "vineri"), ("of", "joia"), ("and", "on Friday"), ("to", "3 luni"), ("in", "luni"), ("is", "patul nou"), ("that", "două luni"), ("was", "12,5 ml"), ("for", "trei"), ("it", "Tuesday"), ("with", "[01:02–03:04]"), ("on", "[1:02:03 - 1:04:05]"),
    ("as", "zilnic"), ("die", "понедельник"), ("der", "marți"), ("und", "patului nou"), ("la", "10"), ("de", "sâmbătă"), ("que", "7.5 grade"), ("en", "zece"), ("le", "в среду"), ("el", "mâine"), ("los", "4 martie"), ("une", "каждый"), ("les", "patul nouă"),
]
_TEXT = said_sql("text", _SAID)
_W = "\\p{L}\\p{M}\\p{N}_"


def _said(spark, d):
    return turns(spark, d).select("conv_id", "turn", said(F.col("text"), _SAID).alias("t"))


def _class(pattern: str) -> str:
    return pattern.replace("\\w", f"[{_W}]")


def _has(text: str, words: str) -> str:
    """Whether one of the words stands in a text; RE2's own word edges know ASCII alone."""
    return f"regexp_matches({text}, '(?i)(?:^|[^{_W}])(?:{_class(words)})(?:[^{_W}]|$)')"


def _put(text: str, words: str, new: str) -> str:
    """The words replaced; twice, as neighbours share the letter between them."""
    once = lambda x: f"regexp_replace({x}, '(?i)(^|[^{_W}])(?:{_class(words)})([^{_W}]|$)', '\\1' || {new} || '\\2', 'g')"
    return once(once(text))


def _no_months(text: str) -> str:
    """A text whose "luni" behind a number, which means months, is hidden."""
    return f"regexp_replace(regexp_replace({text}, '(?i)([0-9]\\s*)l(uni)', '\\1§\\2', 'g'), '(?i)((?:^|[^{_W}])(?:{R.COUNTS})\\s+)l(uni)', '\\1§\\2', 'g')"


def _days(text: str) -> str:
    return f"list_filter([{', '.join(f'CASE WHEN {_has(_no_months(text), names)} THEN {k} END' for k, names in enumerate(R.DAY_NAMES))}], lambda x: x IS NOT NULL)"


_HEAD = "array_to_string(regexp_extract_all(t, '[^\\x20\\x09-\\x0d]+')[1:{}], ' ')"


@query(f"WITH s AS (SELECT conv_id, turn, {_TEXT} AS t FROM conversations) SELECT conv_id, turn, array_to_string({_days('t')}, ',') AS days FROM s")
def named_weekdays(spark, d):
    return _said(spark, d).select("conv_id", "turn", F.array_join(R.weekdays(F.col("t")).cast("array<string>"), ",").alias("days"))


def _corrected() -> str:
    out = _no_months("t")
    for k, names in enumerate(R.DAY_NAMES):
        out = f"CASE WHEN said[1] = {k} THEN {out} ELSE {_put(out, names, f'{list(R.DAYS)!r}[said[1] + 1]')} END"
    return f"CASE WHEN len(said) = 1 THEN replace({out}, '§', 'l') ELSE t END"


@query(f"WITH s AS (SELECT conv_id, turn, {_TEXT} AS t FROM conversations), q AS (SELECT *, {_days(_HEAD.format(14))} AS said FROM s) SELECT conv_id, turn, {_corrected()} AS t FROM q")
def corrected_weekdays(spark, d):
    """The days of a turn after the only one that its first words name."""
    return _said(spark, d).select("conv_id", "turn", R.fix_weekday(F.col("t"), T.head(F.col("t"), 14)).alias("t"))


@query(f"""WITH s AS (SELECT conv_id, turn, {_TEXT} AS t FROM conversations)
SELECT conv_id, turn, regexp_replace(regexp_replace(t, '(?i)(^|[^{_W}])(pat(?:ul)?|patului)\\s+nou([^{_W}]|$)', '\\1\\2 9\\3', 'g'), '(?i)(^|[^{_W}])(pat(?:ul)?|patului)\\s+nou([^{_W}]|$)', '\\1\\2 9\\3', 'g') AS t FROM s""")
def bed_numbers(spark, d):
    return _said(spark, d).select("conv_id", "turn", R.fix_bed_numbers(F.col("t")).alias("t"))


_CODE = "\\d+:\\d{2}(?::\\d{2})?"


@query(f"WITH s AS (SELECT conv_id, turn, {_TEXT} AS t FROM conversations) SELECT conv_id, turn, regexp_replace(t, '\\[({_CODE})\\s*[–—-]\\s*({_CODE})\\]', '[\\1] [\\2]', 'g') AS t FROM s")
def single_codes(spark, d):
    return _said(spark, d).select("conv_id", "turn", T.split_ranges(F.col("t")).alias("t"))


_MARKS = " \"''„”“«»"
_BARE = f"regexp_replace({{}}, '^[{_MARKS}]+|[{_MARKS}]+$', '', 'g')"


@query(f"""WITH s AS (SELECT conv_id, turn, '„[01:02] SPEAKER_01: ' || {_TEXT} || ' [?]”' AS t FROM conversations)
SELECT conv_id, turn, {_BARE.format("regexp_replace(regexp_replace(regexp_replace(" + _BARE.format("t") + f", '\\[{_CODE}\\]\\s*', '', 'g'), '^\\s*(?:SPEAKER_\\d+|UNK|SPK\\d+):\\s*', ''), '\\s*\\[\\?\\]', '', 'g')")} AS quote FROM s""")
def cleaned_quotes(spark, d):
    """Whole turns as quotes, with the marks, code, speaker and sign of doubt that models leave around them."""
    quote = F.concat(F.lit("„[01:02] SPEAKER_01: "), "t", F.lit(" [?]”"))
    return _said(spark, d).select("conv_id", "turn", T.clean_quote(quote).alias("quote"))


_NUMBER = " ".join(f"WHEN '{w}' THEN '{n}'" for w, n in T.NUMBER_WORDS.items())


@query(f"""WITH s AS (SELECT conv_id, turn, {_TEXT} AS t FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter(list_transform(regexp_extract_all(lower(t), '\\d+(?:[.,]\\d+)?|[\\p{{L}}\\p{{M}}_]+'), lambda x: CASE WHEN regexp_matches(x, '^\\d') THEN replace(x, ',', '.') ELSE CASE x {_NUMBER} END END), lambda x: x IS NOT NULL), '|') AS numbers FROM s""")
def stated_numbers(spark, d):
    return _said(spark, d).select("conv_id", "turn", F.array_join(T.numbers(F.col("t")), "|").alias("numbers"))


_KEY = "trim(regexp_replace(lower(strip_accents({})), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


@query(f"""WITH s AS (SELECT conv_id, turn, {_TEXT} AS t FROM conversations), r AS (SELECT *, {_HEAD.format(6)} AS raw, ['absolute', 'conditional', 'vague', 'relative'][turn % 4 + 1] AS given FROM s), k AS (SELECT *, {_KEY.format("raw")} AS key FROM r)
SELECT conv_id, turn, raw, CASE WHEN raw = '' THEN given WHEN given NOT IN ('recurring', 'conditional') AND {_has("key", T.RECURRING)} THEN 'recurring' WHEN given = 'absolute' AND {_has("key", T.RELATIVE)} AND NOT {_has("key", T.MONTHS)} THEN 'relative' ELSE given END AS kind FROM k""")
def deadline_types(spark, d):
    """The first words of each turn as a deadline of a given type."""
    given = F.get(F.array(*map(F.lit, ("absolute", "conditional", "vague", "relative"))), (F.col("turn") % 4).cast("int"))
    t = _said(spark, d).withColumn("raw", T.head(F.col("t"), 6))
    return t.select("conv_id", "turn", "raw", T.eta_type(given, F.col("raw")).alias("kind"))


def _collapsed() -> str:
    """Units of one to eight words in turn: stretches of words that equal the n-th behind them, cut to their first unit, rows numbered anew."""
    out, last = [], "w0"
    for n in range(1, 9):
        out.append(f"""e{n} AS (SELECT *, coalesce(p = lead(p, {n}) OVER w AND p <> '', false) AS same FROM {last} WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), g{n} AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, same ORDER BY i) AS island FROM e{n}
), r{n} AS (SELECT doc_id, min(i) AS first, count(*) // {n} + 1 AS times FROM g{n} WHERE same GROUP BY doc_id, island HAVING count(*) // {n} + 1 >= {4 if n == 1 else 3}
), d{n} AS (SELECT DISTINCT doc_id, unnest(range(first + {n}, first + times * {n})) AS i FROM r{n}
), w{n} AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, x, p FROM {last} ANTI JOIN d{n} USING (doc_id, i))""")
        last = f"w{n}"
    return ", ".join(out)


@query(f"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0d]+') AS words FROM documents
), w0 AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS x, regexp_replace(lower(unnest(words)), '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS p FROM t
), {_collapsed()}
SELECT doc_id, count(i) AS n_words, md5(coalesce(string_agg(x, ' ' ORDER BY i), '')) AS words_md5, coalesce(count(i) < any_value(len(words)), false) AS repetition FROM t LEFT JOIN w8 USING (doc_id) GROUP BY doc_id""")
def collapsed_repeats(spark, d):
    """All documents with units of up to eight words that are said too often in a row said once."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    out = C.with_collapsed(table(spark, d, "documents").select("doc_id", words.alias("w")), "w")
    return out.select("doc_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ")).alias("words_md5"), "repetition")


@query(f"WITH s AS (SELECT conv_id, turn, {_TEXT} AS t FROM conversations) SELECT conv_id, turn, {_KEY.format('t')} AS norm FROM s")
def error_norms(spark, d):
    """Texts as word error rates compare them."""
    return _said(spark, d).select("conv_id", "turn", T.error_norm(F.col("t")).alias("norm"))
