"""Text rules as column expressions: normal forms, scripts, time codes, lines, numbers, languages.

NFC and NFD have no Spark function; `nfc` and `without_marks` go through pandas UDFs for texts that they can change, everything
else stays in the JVM.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# fixed values: cedilla letters and their comma forms
CEDILLA, COMMA = "şŞţŢ", "șȘțȚ"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(StringType())
def _without_marks(s: pd.Series) -> pd.Series:
    return s.map(lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)), na_action="ignore")


def _where(odd: str, udf, text: Column) -> Column:
    """udf(text) where text has a letter of `odd`; the other rows do not leave the JVM but as nulls."""
    found = text.rlike(odd)
    return F.when(found, udf(F.when(found, text))).otherwise(text)


def nfc(text: Column) -> Column:
    """Below U+0300 there is nothing to compose."""
    return _where("[^\\x{0}-\\x{2FF}]", _nfc, text)


def without_marks(text: Column) -> Column:
    """NFKD without combining marks."""
    return _where("[^\\x{0}-\\x{7F}]", _without_marks, text)


def _put(text: Column, old: str, new: str) -> Column:
    """Each letter of `old` as that of `new`, none of which is in `old`: faster than translate on long texts."""
    for a, b in zip(old, new, strict=True):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def clean(text: Column) -> Column:
    return _put(nfc(text), CEDILLA, COMMA)


def _spaced(text: Column, keep: str = "\\p{L}\\p{M}\\p{N}") -> Column:
    return F.trim(F.regexp_replace(text, f"[^{keep}]+", " "))


def tokens(spaced: Column) -> Column:
    return F.array_remove(F.split(spaced, " "), "")


def norm_text(text: Column) -> Column:
    """Words in lower case, comma letters, ё as е; everything but letters and digits parts words."""
    return tokens(_spaced(_put(F.lower(clean(text)), "ё", "е")))


def raw_tokens(text: Column) -> Column:
    return tokens(_spaced(clean(text)))


def quote_norm(text: Column) -> Column:
    """Lower case (casefold differs only on letters like ß), words of letters, digits and _, one space apart."""
    return _spaced(F.lower(clean(F.coalesce(text, F.lit("")))), "\\p{L}\\p{M}\\p{N}_")


def norm_key(text: Column) -> Column:
    return _spaced(F.lower(without_marks(F.coalesce(text, F.lit("")))), "\\p{L}\\p{N}_")


@F.pandas_udf(StringType())
def _nfd_unmarked(s: pd.Series) -> pd.Series:
    return s.map(lambda x: "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn"), na_action="ignore")


def error_norm(text: Column) -> Column:
    """A text as error rates compare it: lower case, no marks that NFD parts from their letters, everything but letters, digits and _ a space."""
    plain = _where("[^\\x{0}-\\x{7F}]", _nfd_unmarked, F.lower(F.coalesce(text, F.lit(""))))
    return _spaced(plain, "\\p{L}\\p{N}_")


def script_of(word: Column) -> Column:
    latin, cyrillic = word.rlike("\\p{IsLatin}"), word.rlike("\\p{IsCyrillic}")
    return F.when(latin & cyrillic, "mixed").when(cyrillic, "cyrl").when(latin, "latn").otherwise("other")


#: fixed values: endings that `stem` strips, longest first
ENDINGS = ("urilor", "ilor", "elor", "ului", "urile", "iile", "ului", "ele", "ile", "ilor", "uri", "lui", "ul", "ea", "ii", "ei", "le", "a", "e", "i", "ă", "u")


def stem(word: Column, endings: tuple[str, ...] = ENDINGS, least: int = 4) -> Column:
    """The word without its longest listed ending that leaves `least` letters."""
    return F.regexp_replace(word, f"^(.{{{least},}}?)({'|'.join(endings)})$", "$1")


def est_tokens(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up."""
    return F.floor((F.octet_length(text) + 3) / 4).cast("long")


def time_code(seconds: Column) -> Column:
    """[mm:ss]; minutes may pass 59."""
    whole = F.floor(seconds).cast("long")
    minutes = F.floor(whole / 60)
    return F.concat(F.lit("["), F.when(minutes < 10, F.lit("0")).otherwise(F.lit("")), minutes.cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"), F.lit("]"))


def time_seconds(code: Column) -> Column:
    """Seconds of mm:ss or h:mm:ss, brackets allowed; null if it is neither."""
    bare = F.regexp_replace(F.trim(code), "^\\[|\\]$", "")
    parts = F.transform(F.split(bare, ":"), lambda x: x.cast("long"))
    return F.when(bare.rlike("^\\d+:\\d{2}(:\\d{2})?$"), F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 60 + x))


def clock_seconds(text: Column) -> Column:
    """Base-60 fold of a:b:c with a decimal comma or point."""
    return F.aggregate(F.split(F.replace(text, F.lit(","), F.lit(".")), ":"), F.lit(0.0), lambda a, x: a * 60 + x.cast("double"))


_LINE = "(?s)^\\[(\\d+:\\d{2}(?::\\d{2})?)\\]\\s*([^:\\s]+):\\s*(.*)$"


def parsed_line(line: Column) -> Column:
    """(ts, speaker, text, marker) of "[mm:ss] SPK: text [?]"; a line of another form is all text."""
    fits = line.rlike(_LINE)
    body = F.when(fits, F.regexp_extract(line, _LINE, 3)).otherwise(line)
    return F.struct(
        F.when(fits, F.regexp_extract(line, _LINE, 1)).alias("ts"),
        F.when(fits, F.regexp_extract(line, _LINE, 2)).alias("speaker"),
        F.trim(F.regexp_replace(body, "\\s*\\[\\?\\]\\s*$", "")).alias("text"),
        body.rlike("\\[\\?\\]\\s*$").alias("marker"),
    )


def clean_quote(text: Column) -> Column:
    """A quote without time codes, speaker label, marker and quotation marks."""
    bare = F.regexp_replace(F.btrim(text, F.lit(" \"'„”“«»")), "\\[\\d+:\\d{2}(?::\\d{2})?\\]\\s*", "")
    bare = F.regexp_replace(bare, "^\\s*(?:SPEAKER_\\d+|UNK|SPK\\d+):\\s*", "")
    return F.btrim(F.regexp_replace(bare, "\\s*\\[\\?\\]", ""), F.lit(" \"'„”“«»"))


def split_ranges(text: Column) -> Column:
    """[a-b] of two time codes as [a] [b]."""
    return F.regexp_replace(text, "\\[(\\d+:\\d{2}(?::\\d{2})?)\\s*[-–—]\\s*(\\d+:\\d{2}(?::\\d{2})?)\\]", "[$1] [$2]")


#: fixed values: number words that count as digits
NUMBER_WORDS = {"unu": "1", "una": "1", "doi": "2", "două": "2", "trei": "3", "patru": "4", "cinci": "5", "șase": "6", "șapte": "7", "opt": "8", "nouă": "9", "zece": "10"}


def numbers(text: Column) -> Column:
    """Numbers in digits or as words one to ten, in order, decimal point."""
    words = "|".join(NUMBER_WORDS)
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"(?U)\\d+(?:[.,]\\d+)?|\\b(?:{words})\\b"), F.lit(0))
    names = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    return F.transform(found, lambda x: F.coalesce(F.try_element_at(names, x), F.replace(x, F.lit(","), F.lit("."))))


def stems5(text: Column) -> Column:
    return F.array_join(F.transform(tokens(quote_norm(text)), lambda w: F.substring(w, 1, 5)), " ")


def lang_of(text: Column) -> Column:
    return F.when(F.regexp_count(text, F.lit("[а-яА-ЯёЁ]")) > F.regexp_count(text, F.lit("[a-zA-Z]")), "ru").otherwise("ro")


def ref_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "\\[[^\\]]*\\]", " "), "\\s+", " "))


# fixed values: words, without marks, that make a deadline recurring, or relative if no calendar date stands beside them
RECURRING = "zilnic\\w*|la fiecare|de (?:doua|trei|patru) ori|ori pe zi|кажд\\w*|ежедневн\\w*|раз в|every|daily|twice a day"
RELATIVE = "azi|astazi|maine|poimaine|diseara|luni|marti|miercuri|joi|vineri|sambata|duminica|сегодня|завтра|послезавтра|вечером|утром|понедельник\\w*|вторник\\w*|сред\\w*|четверг\\w*|пятниц\\w*|суббот\\w*|воскресень\\w*|today|tomorrow|tonight|monday|tuesday|wednesday|thursday|friday|saturday|sunday"
MONTHS = "ianuarie|februarie|martie|aprilie|mai|iunie|iulie|august|septembrie|octombrie|noiembrie|decembrie|январ\\w*|феврал\\w*|март\\w*|апрел\\w*|ма[яе]|июн\\w*|июл\\w*|август\\w*|сентябр\\w*|октябр\\w*|ноябр\\w*|декабр\\w*|january|february|march|april|june|july|august|september|october|november|december"


def eta_type(kind: Column, raw: Column) -> Column:
    """The type that the words of a deadline decide, else the one given."""
    text = norm_key(raw)
    has = lambda words: text.rlike(f"(?U)\\b(?:{words})\\b")
    # a date in digits has lost its sign in this form: only a month by its name counts as a calendar date
    calendar = has(MONTHS)
    fixed = F.when(~kind.isin("recurring", "conditional") & has(RECURRING), "recurring").when((kind == "absolute") & has(RELATIVE) & ~calendar, "relative")
    return F.coalesce(F.when(F.coalesce(raw, F.lit("")) != "", fixed), kind)


def content_id(name: Column, data: Column) -> Column:
    """First 40 letters of the name with others than [A-Za-z0-9_-] as _, and 8 hex digits of the data."""
    return F.concat(F.substring(F.regexp_replace(name, "[^A-Za-z0-9_-]", "_"), 1, 40), F.lit("-"), F.substring(F.sha2(data, 256), 1, 8))


def compression_ratio_udf():
    import zlib

    @F.pandas_udf(DoubleType())
    def ratio(s: pd.Series) -> pd.Series:
        return s.map(lambda x: len(b := x.encode()) / len(zlib.compress(b)) if x else 0.0)

    return ratio


def uncertain_turn(low_confidence: Column, marker: Column, ratio: Column, overlap: Column) -> Column:
    """Any sign of doubt; an unknown one is none."""
    return F.coalesce(low_confidence, F.lit(False)) | F.coalesce(marker, F.lit(False)) | (F.coalesce(ratio, F.lit(0.0)) > 0.5) | F.coalesce(overlap, F.lit(False))


# fixed values: phrases that recognisers make up in silence
MADE_UP = "субтитр|корректор\\s+[а-я]\\.|продолжение следует|спасибо за просмотр|подписывайтесь на( наш)? канал|thanks? (you )?for watching|please subscribe|like and subscribe|mul[țţt]umesc pentru vizionare|abona[țţt]i-v[ăa]|v[ăa] mul[țţt]umim pentru vizionare|v[ăa] abona[țţt]i|abona[țţt]i-v[ăa] la canal|da[țţt]i (un )?like|l[ăa]sa[țţt]i un comentariu|distribui[țţt]i acest (material|video|clip)|material(ul)? video|re[țţt]ele(le)? sociale|ставьте лайк|подписывайтесь|don'?t forget to (like|subscribe)"


def phrase_verdict(text: Column, phrases: str = MADE_UP, short: int = 12) -> Column:
    """drop: a text of up to `short` words, or with two different phrases; flag: a longer one with a single phrase; null without any."""
    said = F.coalesce(text, F.lit(""))
    hits = F.array_distinct(F.transform(F.regexp_extract_all(said, F.lit(f"(?iu)(?:{phrases})"), F.lit(0)), F.lower))
    words = F.size(F.filter(F.split(said, "\\s+"), lambda w: w != ""))
    return F.when((F.size(hits) > 0) & ((words <= short) | (F.size(hits) >= 2)), "drop").when(F.size(hits) > 0, "flag")


def head(text: Column, n: int) -> Column:
    """The first n words of a text, one space apart; a null text has none."""
    return F.array_join(F.slice(F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), 1, n), " ")


def head_says(text: Column, words: str, n: int) -> Column:
    """Whether one of the words, a pattern, stands among the first n words."""
    return head(text, n).rlike(f"(?iU)\\b(?:{words})\\b")


def context_size(tokens: Column, factor: float, predict: int, base: int, most: int, expand: bool = True) -> Column:
    """The context that a prompt of so many tokens and an answer of `predict` need: base if it does, else if allowed the next 1,024 up to `most`;
    null: it does not fit, and the call is skipped."""
    need = F.floor(tokens * factor).cast("long") + predict
    wide = F.when(need <= most, (F.ceil(need / 1024) * 1024).cast("long")) if expand else F.lit(None).cast("long")
    return F.when(need <= base, F.lit(base).cast("long")).otherwise(wide)


def drop_reason(text: Column, prompt_leak: Column, ratio: Column, no_speech: Column, logprob: Column, phrases: str = MADE_UP, most_ratio: float = 2.4, most_silent: float = 0.6) -> Column:
    """Why a segment is dropped, the first reason that holds, or null: empty, prompt_leak, compression_ratio (of its text), no_speech
    (with a log-probability under -1), hallucination_phrase (a text of up to 12 words, or with two different phrases)."""
    said = F.coalesce(text, F.lit(""))
    silent = (F.coalesce(no_speech, F.lit(0.0)) > most_silent) & (F.coalesce(logprob, F.lit(0.0)) < -1.0)
    return F.when(said == "", "empty").when(F.coalesce(prompt_leak, F.lit(False)), "prompt_leak").when(ratio > most_ratio, "compression_ratio").when(silent, "no_speech").when(phrase_verdict(text, phrases) == "drop", "hallucination_phrase")


def kept(segments, text: str = "text", dropped: str = "dropped"):
    """The segments that stay: no reason to drop them, and some text."""
    return segments.where(F.col(dropped).isNull() & (F.coalesce(text, F.lit("")) != ""))
