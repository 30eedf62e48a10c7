"""Text, turn and window queries over conversations and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriven.functions import text as T
from scriven.operators import answers as A
from scriven.operators import detect as G
from scriven.operators import packing as P

from .base import CLOCK_SQL, query, table, turns

BUDGET, OVERLAP = 220, 3
_CODE_SQL = "'[' || lpad((start_ds // 600)::VARCHAR, greatest(2, length((start_ds // 600)::VARCHAR))::INT, '0') || ':' || lpad((start_ds // 10 % 60)::VARCHAR, 2, '0') || ']'"
JOINED_SQL = f"""{CLOCK_SQL}, marked AS (
  SELECT *, CASE WHEN lag(role) OVER w = role AND role <> 'UNK' THEN 0 ELSE 1 END AS new FROM clock WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), runs AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM marked
), joined AS (
  SELECT conv_id, (run - 1)::BIGINT AS id, min(role) AS speaker, min(start_ds)::BIGINT AS start_ds, max(end_ds)::BIGINT AS end_ds, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS text FROM runs GROUP BY conv_id, run
), lines AS (
  SELECT conv_id, id, speaker, start_ds, end_ds, {_CODE_SQL} || ' ' || speaker || ': ' || text AS line FROM joined
), toks AS (SELECT *, ((strlen(line) + 3) // 4 + 1)::BIGINT AS tokens_est FROM lines)"""


@query(f"WITH {CLOCK_SQL} SELECT conv_id, turn, start_ds::BIGINT AS start_ds, end_ds::BIGINT AS end_ds FROM clock")
def turn_clock(spark, d):
    return P.with_clock(turns(spark, d)).select("conv_id", "turn", "start_ds", "end_ds")


def _joined(spark, d):
    return P.joined_turns(P.with_clock(turns(spark, d)))


@query(f"WITH {JOINED_SQL} SELECT * FROM toks")
def turns_by_speaker(spark, d):
    return _joined(spark, d)


def _windows_sql(budget: int, overlap: int) -> str:
    return f"""WITH RECURSIVE {JOINED_SQL}, pre AS (
  SELECT conv_id, id, line, tokens_est, sum(tokens_est) OVER (PARTITION BY conv_id ORDER BY id) AS upto, max(id) OVER (PARTITION BY conv_id) AS final FROM toks
), stop AS (SELECT a.conv_id, a.id AS i, a.final, max(b.id) AS last FROM pre a JOIN pre b ON a.conv_id = b.conv_id AND b.id >= a.id AND (b.id = a.id OR b.upto - a.upto + a.tokens_est <= {budget}) GROUP BY ALL
), w(conv_id, index, i, last, prev, final) AS (
  SELECT conv_id, 0::BIGINT, i, last, 0::BIGINT, final FROM stop WHERE i = 0
  UNION ALL SELECT s.conv_id, w.index + 1, s.i, s.last, w.last + 1, s.final FROM w JOIN stop s ON s.conv_id = w.conv_id AND w.last < w.final AND s.i = greatest(w.last + 1 - {overlap}, w.i + 1)
)
SELECT w.conv_id, w.index, w.i AS first, w.last, greatest(w.prev - w.i, 0) AS overlap_turns, sum(p.tokens_est)::BIGINT AS tokens_est, string_agg(p.line, chr(10) ORDER BY p.id) AS text
FROM w JOIN pre p ON p.conv_id = w.conv_id AND p.id BETWEEN w.i AND w.last GROUP BY w.conv_id, w.index, w.i, w.last, w.prev"""


@query(_windows_sql(BUDGET, OVERLAP))
def token_windows(spark, d):
    """clock, turns by speaker, lines, greedy windows with overlap: the flagship."""
    return P.token_windows(_joined(spark, d), BUDGET, OVERLAP)


@query(_windows_sql(BUDGET, 0))
def token_chunks(spark, d):
    return P.token_chunks(_joined(spark, d), BUDGET)


@query(f"WITH ch AS ({_windows_sql(BUDGET, 0).replace('WITH RECURSIVE', 'WITH RECURSIVE')}) SELECT ch.conv_id, ch.index, c.id FROM ch JOIN (SELECT conv_id, id FROM (WITH {JOINED_SQL} SELECT conv_id, id FROM toks)) c ON c.conv_id = ch.conv_id AND c.id BETWEEN ch.first - 2 AND ch.first - 1")
def chunk_context(spark, d):
    lines = _joined(spark, d)
    return P.with_context(P.token_chunks(lines, BUDGET), lines, 2)


_JOINS = "(s.role = t.role AND s.role <> 'UNK' AND (strlen(t.text || ' ' || s.text) + 3) // 4 <= 120)"


@query(f"""WITH RECURSIVE s AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
t(conv_id, n, id, role, first, last, text) AS (SELECT conv_id, n, 0::BIGINT, role, turn, turn, text FROM s WHERE n = 1
  UNION ALL SELECT s.conv_id, s.n, t.id + (NOT {_JOINS})::INT, s.role, CASE WHEN {_JOINS} THEN t.first ELSE s.turn END, s.turn, CASE WHEN {_JOINS} THEN t.text || ' ' || s.text ELSE s.text END FROM t JOIN s ON s.conv_id = t.conv_id AND s.n = t.n + 1)
SELECT conv_id, id, role AS speaker, first, last, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, id ORDER BY n DESC) AS k FROM t) WHERE k = 1""")
def capped_turns(spark, d):
    return P.capped_turns(turns(spark, d), 120)


@query(f"WITH {JOINED_SQL} SELECT conv_id, id, {_CODE_SQL} AS ts, start_ds // 10 AS seconds, speaker, trim(regexp_replace(line, '^\\[[0-9:]+\\] [^:\\s]+:\\s*', '')) AS text, false AS marker FROM toks")
def parsed_lines(spark, d):
    p = _joined(spark, d).withColumn("p", T.parsed_line(F.col("line")))
    return p.select("conv_id", "id", F.concat(F.lit("["), "p.ts", F.lit("]")).alias("ts"), T.time_seconds(F.col("p.ts")).alias("seconds"), F.col("p.speaker").alias("speaker"), F.col("p.text").alias("text"), F.col("p.marker").alias("marker"))


@query("""SELECT doc_id, list_aggregate(list_transform(regexp_extract_all(translate(lower(nfc_normalize(coalesce(text, ''))), 'şţё', 'șțе'), '[\\p{L}\\p{M}\\p{N}]+'), lambda w: w), 'count')::BIGINT AS n_words,
  md5(array_to_string(regexp_extract_all(translate(lower(nfc_normalize(coalesce(text, ''))), 'şţё', 'șțе'), '[\\p{L}\\p{M}\\p{N}]+'), ' ')) AS words_md5 FROM documents""")
def normal_words(spark, d):
    words = T.norm_text(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", words.alias("w")).select("doc_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ")).alias("words_md5"))


def _share(col: str, kind: str):
    return F.size(F.filter(col, lambda x: x == kind)).cast("long").alias(kind)


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0d]+')) AS w FROM documents)
SELECT doc_id, count(*) FILTER (WHERE regexp_matches(w, '\\p{Latin}') AND regexp_matches(w, '\\p{Cyrillic}')) AS mixed,
  count(*) FILTER (WHERE NOT regexp_matches(w, '\\p{Latin}') AND regexp_matches(w, '\\p{Cyrillic}')) AS cyrl,
  count(*) FILTER (WHERE regexp_matches(w, '\\p{Latin}') AND NOT regexp_matches(w, '\\p{Cyrillic}')) AS latn FROM w GROUP BY doc_id""")
def script_counts(spark, d):
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    s = table(spark, d, "documents").select("doc_id", F.transform(words, T.script_of).alias("s"))
    return s.where(F.size("s") > 0).select("doc_id", *[_share("s", k) for k in ("mixed", "cyrl", "latn")])


@query("""WITH t AS (SELECT doc_id, text, ((strlen(text) + 3) // 4)::BIGINT AS tokens_est, ((strlen(text) + 3) // 4 * 156 // 100)::BIGINT + 900 AS need FROM documents)
SELECT doc_id, tokens_est, CASE WHEN need <= 1500 THEN 1500 WHEN need <= 4096 THEN (need + 1023) // 1024 * 1024 END AS context, CASE WHEN length(regexp_replace(text, '[^а-яА-ЯёЁ]', '', 'g')) > length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) THEN 'ru' ELSE 'ro' END AS lang_guess FROM t""")
def context_budget(spark, d):
    """The context of a call for each document: 1,500 where that does, up to 4,096, none where it does not fit."""
    est = T.est_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", est.alias("tokens_est"), T.context_size(est, 1.56, 900, 1500, 4096).alias("context"), T.lang_of(F.col("text")).alias("lang_guess"))


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-zăâîșț]+')) AS word FROM documents)
SELECT word, regexp_replace(word, '^(.{4,}?)(urilor|ilor|elor|ului|urile|iile|ului|ele|ile|ilor|uri|lui|ul|ea|ii|ei|le|a|e|i|ă|u)$', '\\1') AS stem FROM w""")
def word_stems(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-zăâîșț]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", T.stem(F.col("word")).alias("stem"))


@query("""WITH u AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents), i AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM u
), t AS (SELECT doc_id, i, w[i] AS x, CASE WHEN w[i] = w[i - 1] AND i > 1 THEN 0 ELSE 1 END AS new FROM i
), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM t
), c AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY doc_id, run)
SELECT doc_id, count(*) FILTER (WHERE n >= 4) AS runs, coalesce(sum(n - 1) FILTER (WHERE n >= 4), 0)::BIGINT AS removed FROM c GROUP BY doc_id""")
def word_runs(spark, d):
    """Repeats of one word, four or more in a row, folded inside the row: no word leaves its document."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))
    start = F.struct(F.lit("").alias("w"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("runs"), F.lit(0).cast("long").alias("removed"))
    step = lambda s, x: F.when(s.w == x, F.struct(x.alias("w"), (s.n + 1).alias("n"), (s.runs + F.when(s.n == 3, 1).otherwise(0)).alias("runs"), (s.removed + F.when(s.n == 3, 3).when(s.n > 3, 1).otherwise(0)).alias("removed"))).otherwise(F.struct(x.alias("w"), F.lit(1).alias("n"), s.runs, s.removed))
    return table(spark, d, "documents").select("doc_id", words.alias("w")).where(F.size("w") > 0).select("doc_id", F.aggregate("w", start, step).alias("s")).select("doc_id", "s.runs", "s.removed")


@query("""WITH g AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}]+') AS w FROM benchmark), grams AS (SELECT DISTINCT w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM g)
), d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{M}\\p{N}]+') AS w FROM documents), t AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), hit AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM t JOIN grams USING (g)), c AS (SELECT doc_id, count(DISTINCT p) AS covered FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(covered, 0) AS covered, len(w) >= 3 AND 2 * coalesce(covered, 0) >= len(w) AS leak FROM d LEFT JOIN c USING (doc_id)""")
def prompt_leak(spark, d):
    """Share of a text's words that lie in word trigrams of the prompts; a leak from one half on."""
    return G.prompt_leak(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("text"), ["doc_id"])


@query("SELECT doc_id, substr(regexp_replace(source || '/' || lang, '[^A-Za-z0-9_-]', '_', 'g'), 1, 40) || '-' || substr(sha256(text), 1, 8) AS job_id FROM documents")
def content_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_id(F.concat("source", F.lit("/"), "lang"), F.col("text")).alias("job_id"))


_PHRASES = "the the|of the|stupid|disgusting"
_SEGMENT_SQL = f"""s AS (SELECT doc_id, text, doc_id % 11 = 0 AS leak, (doc_id % 50) / 10.0 AS ratio, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 10) / 10.0 END AS silent, CASE WHEN doc_id % 4 > 0 THEN -(doc_id % 7) / 4.0 END AS logprob,
  list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '(?i)(?:{_PHRASES})'), lambda x: lower(x))) AS hits, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0d]+')) AS words FROM documents
), r AS (SELECT *, CASE WHEN coalesce(text, '') = '' THEN 'empty' WHEN leak THEN 'prompt_leak' WHEN ratio > 4.2 THEN 'compression_ratio' WHEN silent > 0.6 AND logprob < -1 THEN 'no_speech' WHEN len(hits) > 0 AND (words <= 12 OR len(hits) >= 2) THEN 'hallucination_phrase' END AS dropped FROM s)"""


def _judged(spark, d):
    """documents as transcript segments, with made-up measures, and why each is dropped."""
    i = F.col("doc_id")
    s = table(spark, d, "documents").select(i, "text", (i % 11 == 0).alias("leak"), (i % 50 / 10).alias("ratio"), F.when(i % 3 > 0, i % 10 / 10).alias("silent"), F.when(i % 4 > 0, -(i % 7) / 4).alias("logprob"))
    return s.withColumn("dropped", T.drop_reason(F.col("text"), F.col("leak"), F.col("ratio"), F.col("silent"), F.col("logprob"), _PHRASES, 4.2))


@query(f"WITH {_SEGMENT_SQL} SELECT doc_id, dropped FROM r")
def drop_reasons(spark, d):
    return _judged(spark, d).select("doc_id", "dropped")


@query(f"WITH {_SEGMENT_SQL} SELECT doc_id, text FROM r WHERE dropped IS NULL AND coalesce(text, '') <> ''")
def kept_segments(spark, d):
    return T.kept(_judged(spark, d)).select("doc_id", "text")


@query("""SELECT conv_id, turn, CASE WHEN turn % 5 > 0 THEN turn % 5 = 4 ELSE false END OR coalesce(length(text) % 9 = 0, false) OR coalesce(CASE WHEN turn % 3 > 0 THEN conv_id % 10 / 10.0 END, 0) > 0.5 OR coalesce(CASE WHEN conv_id % 4 > 0 THEN turn = 3 END, false) AS uncertain FROM conversations""")
def uncertain_turns(spark, d):
    c, t = F.col("conv_id"), F.col("turn")
    flag = T.uncertain_turn(F.when(t % 5 > 0, t % 5 == 4), F.length("text") % 9 == 0, F.when(t % 3 > 0, c % 10 / 10), F.when(c % 4 > 0, t == 3))
    return turns(spark, d).select("conv_id", "turn", flag.alias("uncertain"))


@query("""WITH m AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(lower(text), '(the the|disgusting|stupid|of the)'), lambda x: x)) AS hits, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0d]+')) AS n FROM documents)
SELECT doc_id, CASE WHEN n <= 12 OR len(hits) >= 2 THEN 'drop' ELSE 'flag' END AS verdict FROM m WHERE len(hits) > 0""")
def hallucination_filter(spark, d):
    """A listed phrase drops a short text or one with two different phrases, and flags the others."""
    verdict = T.phrase_verdict(F.col("text"), "the the|disgusting|stupid|of the")
    return table(spark, d, "documents").select("doc_id", verdict.alias("verdict")).where("verdict IS NOT NULL")


@query("""SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(lower(nfc_normalize(text)), '[\\p{L}\\p{M}\\p{N}_]+'), lambda w: substr(w, 1, 5)), ' ') AS stems FROM conversations WHERE text IS NOT NULL""")
def word_beginnings(spark, d):
    t = turns(spark, d).where("text IS NOT NULL")
    return t.select("conv_id", "turn", T.stems5(F.col("text")).alias("stems"))


@query("""WITH f AS (SELECT doc_id, unnest(['case_key', 'topic', 'summary']) AS field, unnest([CASE WHEN doc_id % 3 = 0 THEN 'Тема ' || source ELSE source END, lang, replace(replace(text, 'the ', 'то '), ' and', ' и ещё-и')]) AS v FROM documents),
h AS (SELECT doc_id, field, regexp_extract_all(coalesce(v, ''), '[Ѐ-ӿ]+(?:[\\s-]+[Ѐ-ӿ]+)*') AS hits FROM f) SELECT doc_id, field, array_to_string(hits[1:3], '|') AS hits FROM h WHERE len(hits) > 0""")
def foreign_fields(spark, d):
    """documents as cases, some with Cyrillic where Romanian must stand."""
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Тема "), "source")).otherwise(F.col("source")).alias("case_key"), F.col("lang").alias("topic"), F.replace(F.replace("text", F.lit("the "), F.lit("то ")), F.lit(" and"), F.lit(" и ещё-и")).alias("summary"))
    return A.foreign_fields(rows, ["doc_id"], ["case_key", "topic", "summary"]).select("doc_id", "field", F.array_join("hits", "|").alias("hits"))


_HEAD = "' ' || lower(array_to_string(regexp_extract_all(coalesce({}, ''), '[^\\x20\\x09-\\x0d]+')[1:{}], ' ')) || ' '"
_CUES = "'[^\\p{L}\\p{M}\\p{N}_](" + "{}" + ")[^\\p{L}\\p{M}\\p{N}_]'"


@query(f"""WITH c AS (SELECT conv_id, turn, regexp_matches({_HEAD.format("text", 10)}, {_CUES.replace("{}", "the|der|la")}) AS says, regexp_matches({_HEAD.format("text", 4)}, {_CUES.replace("{}", "und|que|of")}) AS topic FROM conversations)
SELECT conv_id, turn, says OR coalesce(lead(says) OVER (PARTITION BY conv_id ORDER BY turn), false) AS cue, topic FROM c""")
def opening_cues(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = turns(spark, d).withColumn("says", T.head_says(F.col("text"), "the|der|la", 10))
    topic = T.head_says(F.col("text"), "und|que|of", 4)
    return t.select("conv_id", "turn", (F.col("says") | F.coalesce(F.lead("says").over(w), F.lit(False))).alias("cue"), topic.alias("topic"))
