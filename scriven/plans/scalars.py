"""Queries of text, language and repair rules, each applied to rows made from keys and texts of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriven.functions import languages as L
from scriven.functions import repairs as R
from scriven.functions import text as T
from scriven.operators import answers as A
from scriven.operators import minutes as M

from .base import query, table, turns

_WORDS = "[\\x20\\x09-\\x0D]+"


def _s(c):
    return F.col(c).cast("string")


def _events(spark, d, text):
    """event_id and a text made by an SQL expression that Spark and DuckDB read alike."""
    return table(spark, d, "events").select("event_id", F.expr(text).alias("t"))


@query("SELECT conv_id, turn, translate(nfc_normalize(replace(coalesce(text, ''), 's', 'ş')), 'şŞţŢ', 'șȘțȚ') AS clean FROM conversations")
def clean_text(spark, d):
    return turns(spark, d).select("conv_id", "turn", T.clean(F.replace(F.coalesce("text", F.lit("")), F.lit("s"), F.lit("ş"))).alias("clean"))


@query("SELECT conv_id, turn, array_to_string(regexp_extract_all(translate(nfc_normalize(coalesce(text, '')), 'şŞţŢ', 'șȘțȚ'), '[\\p{L}\\p{M}\\p{N}]+'), ' ') AS words FROM conversations")
def raw_words(spark, d):
    return turns(spark, d).select("conv_id", "turn", F.array_join(T.raw_tokens(F.coalesce("text", F.lit(""))), " ").alias("words"))


@query("SELECT conv_id, turn, trim(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS key FROM conversations")
def folded_keys(spark, d):
    return turns(spark, d).select("conv_id", "turn", T.norm_key(F.col("text")).alias("key"))


@query("SELECT conv_id, turn, (turn * 3600 + conv_id % 60 * 60 + conv_id % 7 + 0.5)::DOUBLE AS seconds FROM conversations")
def clock_times(spark, d):
    said = F.concat(_s("turn"), F.lit(":"), (F.col("conv_id") % 60).cast("string"), F.lit(":"), (F.col("conv_id") % 7).cast("string"), F.lit(",5"))
    return turns(spark, d).select("conv_id", "turn", T.clock_seconds(said).alias("seconds"))


@query("SELECT conv_id, turn, trim(regexp_replace(replace(coalesce(text, ''), '. ', ' '), '\\s+', ' ', 'g')) AS t FROM conversations")
def without_notes(spark, d):
    return turns(spark, d).select("conv_id", "turn", T.ref_text(F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(" [notă, 1] "))).alias("t"))


@query("SELECT event_id, 'doza ' || event_id || CASE event_id % 3 WHEN 0 THEN ' mg/zi' ELSE '' END || ', 5' || CASE event_id % 2 WHEN 0 THEN ' ml' ELSE '' END AS t FROM events")
def spoken_units(spark, d):
    line = F.concat(F.lit("doza"), F.when(F.col("event_id") % 3 == 0, " în miligrame").otherwise(""), F.when(F.col("event_id") % 2 == 0, " și cinci mililitri").otherwise(", cinci"))
    return _events(spark, d, "'doza ' || event_id || ' mg/zi, 5 ml'").select("event_id", R.strip_unspoken_units(F.col("t"), line).alias("t"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'aprobat' WHEN 1 THEN 'respins' WHEN 2 THEN 'amânat' ELSE 'în discuție' END AS status FROM events")
def closed_words(spark, d):
    said = "element_at(array('APROBAT', 'respins ', 'amânatt', 'cu totul altfel', ''), int(event_id % 5) + 1)"
    return _events(spark, d, said).select("event_id", M.repaired(F.col("t"), M.STATUSES, M.DEFAULT_STATUS).alias("status"))


def _scores(spark, d):
    i = F.col("event_id")
    two = F.create_map(F.lit("ro"), (i % 13).cast("double") / 64, F.lit("ru"), (i % 17).cast("double") / 64)
    return table(spark, d, "events").select(i, F.when(i % 3 > 0, two).alias("scores"), ((i % 8).cast("double") / 8).alias("prob"), F.when(i % 2 == 0, "forced").alias("method"))


@query("SELECT event_id, CASE WHEN event_id % 3 > 0 THEN abs(event_id % 13 - event_id % 17) / 64.0::DOUBLE < 0.1::DOUBLE ELSE event_id % 2 = 1 AND event_id % 8 < 4 END AS uncertain FROM events")
def unsure_languages(spark, d):
    return _scores(spark, d).select("event_id", L.uncertain(F.col("scores"), F.col("prob"), F.col("method")).alias("uncertain"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN true ELSE event_id % 9 > 5 END AS low FROM events")
def low_logprobs(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select(i, L.low_confidence(F.when(i % 4 > 0, -(i % 9) / 5), -1.0).alias("low"))


_BEST = "CASE WHEN event_id % 13 >= event_id % 17 THEN 'ro' ELSE 'ru' END"


@query(f"SELECT event_id, CASE WHEN greatest(event_id % 13, event_id % 17) >= 8 AND {_BEST} <> 'ru' THEN {_BEST} WHEN {_BEST} = 'ro' THEN 'en,ru,ro' ELSE 'en,ru' END AS langs FROM events WHERE event_id % 3 > 0")
def language_candidates(spark, d):
    s = _scores(spark, d).where("scores IS NOT NULL")
    return s.select("event_id", F.array_join(L.candidates(F.col("scores"), ["en", "ru"], ["ru"], 0.125), ",").alias("langs"))


@query(f"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'ro' ELSE {_BEST} || ',' || CASE WHEN event_id % 13 >= event_id % 17 THEN 'ru' ELSE 'ro' END END AS langs FROM events WHERE event_id % 3 > 0")
def restricted_languages(spark, d):
    """Only Romanian allowed for even rows; for the others a language that has no score, so all stay."""
    s = _scores(spark, d).where("scores IS NOT NULL")
    names = lambda allowed: F.array_join(F.transform(L.restricted(F.col("scores"), allowed), lambda e: e.k), ",")
    return s.select("event_id", F.when(F.col("event_id") % 2 == 0, names(["ro"])).otherwise(names(["fr"])).alias("langs"))


@query("SELECT doc_id, length(regexp_replace(t, '[^\\p{Latin}]', '', 'g')) AS latin, length(regexp_replace(t, '[^\\p{Cyrillic}]', '', 'g')) AS cyrillic FROM (SELECT doc_id, replace(coalesce(text, ''), 'the ', 'это ') AS t FROM documents)")
def letters_by_script(spark, d):
    t = F.replace(F.coalesce("text", F.lit("")), F.lit("the "), F.lit("это "))
    count = lambda script: F.regexp_count(t, F.lit(f"\\p{{Is{script}}}")).cast("long")
    return table(spark, d, "documents").select("doc_id", count("Latin").alias("latin"), count("Cyrillic").alias("cyrillic"))


@query("SELECT event_id, 'vizită ' || CASE WHEN event_id % 2 = 0 THEN 'vineri, ' ELSE 'joi, ' END || event_id || CASE WHEN event_id % 2 = 0 THEN '' ELSE ' mg' END || ' [0:' || CASE WHEN event_id % 2 = 0 THEN '10' ELSE '30' END || '] gata' AS t FROM events")
def fixed_clauses(spark, d):
    """A clause on a Friday without units, or on no day with them, in every job."""
    e = table(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("id"), F.expr("'vizită joi, ' || event_id || ' mg [0:' || CASE WHEN event_id % 2 = 0 THEN '10' ELSE '30' END || '] nu s-a discutat restul [0:40] gata'").alias("text"))
    lines = e.select("job").distinct().select("job", F.inline(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("line")) for a, b in ((5.0, "ne vedem vineri,"), (12.0, "bine"), (30.0, "câteva mg"), (50.0, "gata"))])))
    return A.fixed_clauses(e, lines).select(F.col("id").alias("event_id"), F.col("text").alias("t"))


@query("""SELECT user_id AS job, event_id AS win, 'Caz ' || event_type AS case_key, CASE WHEN event_id % 2 = 0 THEN 'vineri' ELSE 'joi' END AS decision, CASE WHEN event_id % 3 = 0 THEN 'aprobat' ELSE 'în discuție' END AS status, 'vineri' || CASE WHEN event_id % 2 = 0 THEN '' ELSE ' sau joi' END AS quote, event_id % 60 + 60 AS "at" FROM events WHERE event_id % 5 > 0""")
def sanitized_answers(spark, d):
    """One answer for each event: some are no JSON, some statuses are unknown, some days differ from the quote's."""
    cases, decisions, _, _ = A.sanitized(_answers(spark, d))
    return decisions.join(cases.select("job", "window", "no", "case_key"), ["job", "window", "no"]).select("job", F.col("window").alias("win"), "case_key", "decision", "status", "quote", "at")


def _answers(spark, d):
    answer = F.expr("""CASE WHEN event_id % 5 = 0 THEN 'nimic' ELSE '{"cases": [{"case_key": " Caz ' || event_type || '", "decisions": [{"decision": "joi", "quote": "„[01:05] vineri' || CASE WHEN event_id % 2 = 0 THEN '' ELSE ' sau joi' END || '”", "status": "' || CASE WHEN event_id % 3 = 0 THEN 'Aprobat' ELSE 'nu se știe' END || '", "timestamp": "[01:' || lpad(string(event_id % 60), 2, '0') || ']"}, {"decision": " "}, 7]}, 8]}' END""")
    return table(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("window"), answer.alias("answer"))


@query("""WITH e AS (SELECT user_id AS job, event_id, 'vineri' || CASE WHEN event_id % 2 = 0 THEN '' ELSE ' sau joi' END AS quote FROM events WHERE event_id % 5 > 0)
SELECT job, event_id AS win, 0::BIGINT AS n, 'quote' AS field, '„[01:05] ' || quote || '”' AS said, quote AS now FROM e
UNION ALL SELECT job, event_id, 0, 'status', CASE WHEN event_id % 3 = 0 THEN 'Aprobat' ELSE 'nu se știe' END, CASE WHEN event_id % 3 = 0 THEN 'aprobat' ELSE 'în discuție' END FROM e
UNION ALL SELECT job, event_id, 0, 'decision', 'joi', 'vineri' FROM e WHERE event_id % 2 = 0
UNION ALL SELECT job, event_id, 1, 'decision', '', NULL FROM e UNION ALL SELECT job, event_id, NULL, 'eta_type', NULL, 'none' FROM e""")
def answer_fixes(spark, d):
    """What was changed in each answer: quotes, statuses, weekdays, decisions that say nothing."""
    return A.fix_log(_answers(spark, d)).select("job", F.col("window").alias("win"), "n", "field", "said", "now")
