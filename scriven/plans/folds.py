"""Queries of ordered folds, matching and scoring; those without a SQL twin are tested by hand-worked cases."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scriven.functions import languages as L
from scriven.functions import similarity as S
from scriven.functions.number_words import normalize_numbers
from scriven.functions.text import compression_ratio_udf, est_tokens
from scriven.operators import evaluation as E
from scriven.operators import minutes as M
from scriven.operators import packing as P
from scriven.operators import segmentation as G
from scriven.operators.patients import cue_fragments

from .base import SEGMENTS_SQL, query, segments, table, turns
from .reports import _CELLS, _DEL, _SUB, _WORDS


def _regions(spark, d):
    return segments(spark, d).select("job", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "speaker")


@query()
def built_segments(spark, d):
    return G.build_segments(_regions(spark, d), 1000, 600, 3600, 60_000, 90_000, 300)


@query(f"""WITH RECURSIVE {SEGMENTS_SQL}, r AS (SELECT row_number() OVER () AS id, job, start::DOUBLE AS a, "end"::DOUBLE AS b FROM seg
), f AS (SELECT job, list({{'at': start::DOUBLE, 'energy': value}}) AS frames FROM seg GROUP BY job
), walk(id, job, a, b, "from", "at", k) AS (
  SELECT id, job, a, b, a, a, 0 FROM r WHERE b - a > 90000
  UNION ALL SELECT id, job, a, b, "at", least(greatest(CASE WHEN len(near) = 0 THEN "at" + 60000 ELSE list_min(list_transform(near, lambda x: {{'e': x.energy, 'at': x."at"}}))."at" END, "at" + 10000), "at" + 90000, b), k + 1
  FROM (SELECT w.*, list_filter(frames, lambda x: abs(x."at" - (w."at" + 60000)) <= 1 AND x."at" >= w.a - 1 AND x."at" <= w.b + 1) AS near FROM walk w JOIN f USING (job) WHERE w.b - w."at" > 90000)
), last AS (SELECT id, job, b, max("at") AS "at" FROM walk GROUP BY ALL)
SELECT job, a AS start, b AS "end" FROM r WHERE b - a <= 90000
UNION ALL SELECT job, "from", "at" FROM walk WHERE k > 0 UNION ALL SELECT job, "at", b FROM last""")
def split_regions(spark, d):
    """Segments over 90,000 seconds cut near every 60,000; the quietest of the events of the job are the levels."""
    frames = segments(spark, d).select("job", F.col("start").cast("double").alias("at"), F.col("value").alias("energy"))
    return G.split_regions(_regions(spark, d), frames, 60_000, 10_000, 90_000)


_CUT = "(s.b - t.a > 300000 OR s.a - t.b > 40000 OR (s.b - t.a > 100000 AND t.speech >= 20000))"


@query(f"""WITH RECURSIVE {SEGMENTS_SQL}, s AS (SELECT job, start::DOUBLE AS a, coalesce("end", start)::DOUBLE AS b, row_number() OVER (PARTITION BY job ORDER BY start, coalesce("end", start)) AS n FROM seg WHERE start IS NOT NULL),
t(job, n, idx, a, b, speech) AS (SELECT job, n, 0::BIGINT, a, b, b - a FROM s WHERE n = 1
  UNION ALL SELECT s.job, s.n, t.idx + {_CUT}::INT, CASE WHEN {_CUT} THEN s.a ELSE t.a END, s.b, CASE WHEN {_CUT} THEN 0 ELSE t.speech END + s.b - s.a FROM t JOIN s ON s.job IS NOT DISTINCT FROM t.job AND s.n = t.n + 1),
c AS (SELECT job, idx, a, b, speech FROM (SELECT *, row_number() OVER (PARTITION BY job, idx ORDER BY n DESC) AS k FROM t) WHERE k = 1),
u(job, idx, k, a, b, speech) AS (SELECT job, idx, 0::BIGINT, a, b, speech FROM c WHERE idx = 0
  UNION ALL SELECT c.job, c.idx, u.k + (NOT (c.b - c.a < 5000 AND c.b - u.a <= 400000))::INT, CASE WHEN c.b - c.a < 5000 AND c.b - u.a <= 400000 THEN u.a ELSE c.a END, c.b, CASE WHEN c.b - c.a < 5000 AND c.b - u.a <= 400000 THEN u.speech ELSE 0 END + c.speech FROM u JOIN c ON c.job IS NOT DISTINCT FROM u.job AND c.idx = u.idx + 1)
SELECT job, k AS index, a AS start, b AS "end", speech FROM (SELECT *, row_number() OVER (PARTITION BY job, k ORDER BY idx DESC) AS z FROM u) WHERE z = 1""")
def packed_chunks(spark, d):
    return P.merged_tiny(P.packed_chunks(_regions(spark, d), 100_000, 20_000, 300_000, 40_000), 5_000, 400_000)


@query(f"""WITH RECURSIVE {SEGMENTS_SQL}, s AS (SELECT job, start::DOUBLE AS "at", speaker AS entity, row_number() OVER (PARTITION BY job ORDER BY start, speaker NULLS FIRST) AS n FROM seg WHERE start IS NOT NULL
), t(job, n, last, entity, kept, "at") AS (SELECT job, n, "at", entity, true, "at" FROM s WHERE n = 1
  UNION ALL SELECT s.job, s.n, CASE WHEN s."at" - t.last >= 40000 AND s.entity IS DISTINCT FROM t.entity THEN s."at" ELSE t.last END,
    CASE WHEN s."at" - t.last >= 40000 AND s.entity IS DISTINCT FROM t.entity THEN s.entity ELSE t.entity END, s."at" - t.last >= 40000 AND s.entity IS DISTINCT FROM t.entity, s."at"
  FROM t JOIN s ON s.job IS NOT DISTINCT FROM t.job AND s.n = t.n + 1)
SELECT job, "at", entity FROM t WHERE kept""")
def thinned_starts(spark, d):
    s = segments(spark, d).select("job", F.col("start").cast("double").alias("at"), F.col("speaker").alias("entity"))
    return P.thinned_starts(s, 40_000)


@query("""WITH t AS (SELECT conv_id, turn, role, trim(regexp_replace(translate(lower(nfc_normalize(coalesce(text, ''))), 'şţ', 'șț'), '[^\\p{L}\\p{M}\\p{N}_]+', ' ', 'g')) AS n FROM conversations)
SELECT q.conv_id AS job, 0::BIGINT AS "window", q.turn AS q_id, min(t.turn) AS turn_id, 100.0::DOUBLE AS score, false AS ts_match FROM t q JOIN t ON t.conv_id = q.conv_id AND length(q.n) >= 12 AND contains(t.n, q.n) WHERE q.role = 'assistant' GROUP BY ALL""")
def resolved_quotes(spark, d):
    """Each whole assistant turn, as a quote without a time, looked for among the turns of its conversation: those found word for word."""
    t = turns(spark, d)
    lines = t.select(F.col("conv_id").alias("job"), F.lit(0).cast("long").alias("window"), F.col("turn").alias("id"), F.lit(None).cast("long").alias("seconds"), F.coalesce("text", F.lit("")).alias("text"))
    quotes = t.where("role = 'assistant'").select(F.col("conv_id").alias("job"), F.lit(0).cast("long").alias("window"), F.col("turn").alias("q_id"), F.coalesce("text", F.lit("")).alias("quote"), F.lit(None).cast("long").alias("at"))
    return M.resolved_quotes(quotes, lines).where("turn_id IS NOT NULL AND score = 100")


@query(f"""WITH t AS (SELECT conv_id, turn, role, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS a, lead(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations
), p AS (SELECT conv_id, turn, a, coalesce(next, []) AS b FROM t WHERE role = 'user'), c AS (SELECT conv_id, turn, a, {_CELLS} AS r FROM p)
SELECT conv_id, turn, r // {_SUB} % 100000 AS "S", r // {_DEL} % 100000 AS "D", r % 100000 AS "I", len(a) AS "N" FROM c""")
def word_errors(spark, d):
    """Each user turn against the assistant turn after it, as reference and hypothesis."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    words = lambda c: F.slice(F.filter(F.split(F.coalesce(c, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda x: x != ""), 1, 2**31 - 1)
    t = turns(spark, d).withColumn("next", F.lead("text").over(w)).where("role = 'user'")
    return E.edit_columns(t.select("conv_id", "turn", words(F.col("text")).alias("ref"), words(F.col("next")).alias("hyp")), "ref", "hyp").select("conv_id", "turn", "S", "D", "I", "N")


def _lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two texts, row by row."""
    return f"list_reduce(string_split({b}, ''), lambda r, y: list_reduce(range(1, length({a}) + 1), lambda acc, i: acc || [CASE WHEN {a}[i] = y THEN r[i] + 1 ELSE greatest(r[i + 1], acc[-1]) END], [0::BIGINT]), list_transform(range(length({a}) + 1), lambda z: 0::BIGINT))[-1]"


_SORTED = "array_to_string(list_sort({}), ' ')"


@query(f"""WITH b AS (SELECT item_id, lower(text) AS text FROM benchmark), p AS (SELECT b.item_id, b.text AS a, coalesce(n.text, b.text) AS b FROM b LEFT JOIN b n ON n.item_id = b.item_id + 1
), w AS (SELECT *, list_filter(regexp_split_to_array(a, '\\s+'), lambda x: x <> '') AS wa, list_filter(regexp_split_to_array(b, '\\s+'), lambda x: x <> '') AS wb FROM p
), s AS (SELECT *, list_intersect(wa, wb) AS shared, list_distinct(wa) AS da, list_distinct(wb) AS db FROM w
), t AS (SELECT *, {_SORTED.format("wa")} AS sa, {_SORTED.format("wb")} AS sb, {_SORTED.format("shared")} AS common, list_filter(da, lambda x: NOT list_contains(wb, x)) AS only_a, list_filter(db, lambda x: NOT list_contains(wa, x)) AS only_b FROM s
), u AS (SELECT *, trim(common || ' ' || {_SORTED.format("only_a")}) AS with_a, trim(common || ' ' || {_SORTED.format("only_b")}) AS with_b FROM t
), r AS (SELECT *, {_lcs("a", "b")} AS l1, {_lcs("sa", "sb")} AS l2, {_lcs("with_a", "with_b")} AS l3 FROM u)
SELECT item_id, 200.0::DOUBLE * l1 / (length(a) + length(b)) AS ratio, 200.0::DOUBLE * l2 / (length(sa) + length(sb)) AS token_sort,
  CASE WHEN len(shared) > 0 AND (len(only_a) = 0 OR len(only_b) = 0) THEN 100.0::DOUBLE ELSE greatest(200.0::DOUBLE * l3 / (length(with_a) + length(with_b)),
    CASE WHEN len(shared) > 0 THEN 200.0::DOUBLE * length(common) / (length(common) + length(with_a)) ELSE 0 END, CASE WHEN len(shared) > 0 THEN 200.0::DOUBLE * length(common) / (length(common) + length(with_b)) ELSE 0 END) END AS token_set FROM r""")
def fuzzy_scores(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.lower("text").alias("text"))
    after = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("next"))
    pairs = b.join(after, "item_id", "left").withColumn("next", F.coalesce("next", "text"))
    return pairs.select("item_id", *[S.as_column(f)(F.col("text"), F.col("next")).alias(n) for n, f in (("ratio", S.ratio), ("token_sort", S.token_sort_ratio), ("token_set", S.token_set_ratio))])


@query("SELECT event_id, CASE WHEN value >= 60 THEN 'ru' WHEN value >= 40 THEN 'ro' ELSE 'en' END AS lang FROM events")
def picked_language(spark, d):
    """Scores made from value; ro is preferred over ru within 20."""
    v = F.col("value")
    scores = F.create_map(F.lit("ru"), v, F.lit("ro"), F.when(v >= 60, v - 30).otherwise(v - 10), F.lit("en"), F.lit(80.0) - v)
    return table(spark, d, "events").select("event_id", F.when(v < 40, "en").otherwise(L.pick_language(F.map_filter(scores, lambda k, _: k != "en"), "ro", "ru", 20.0)).alias("lang"))


@query("SELECT levenshtein(a.source, b.source) AS distance, count(*) AS n FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 GROUP BY 1")
def edit_distance_words(spark, d):
    a = table(spark, d, "documents").select("doc_id", "source")
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("source").alias("next"))
    return a.join(b, "doc_id").groupBy(F.levenshtein("source", "next").cast("long").alias("distance")).agg(F.count("*").alias("n"))


@query()
def compression_ratios(spark, d):
    return table(spark, d, "documents").select("doc_id", compression_ratio_udf()(F.coalesce("text", F.lit(""))).alias("ratio"))


_ONES = ["", "unu", "doi", "trei", "patru", "cinci", "șase", "șapte", "opt", "nouă", "zece", "unsprezece", "doisprezece", "treisprezece", "paisprezece", "cincisprezece", "șaisprezece", "șaptesprezece", "optsprezece", "nouăsprezece"]
_TENS = ["", "", "douăzeci", "treizeci", "patruzeci", "cincizeci", "șaizeci", "șaptezeci", "optzeci", "nouăzeci"]


def _spelled(n):
    """A number from 10 to 999,999 in Romanian words."""
    listed = lambda words, i: F.get(F.array(*map(F.lit, words)), i.cast("int"))
    text = lambda *parts: F.array_join(F.filter(F.array(*parts), lambda x: x != ""), " ")

    def below_1000(v):
        small, hundreds = v % 100, F.floor(v / 100)
        tail = F.when(small < 20, listed(_ONES, small)).when(small % 10 == 0, listed(_TENS, F.floor(small / 10))).otherwise(F.concat(listed(_TENS, F.floor(small / 10)), F.lit(" și "), listed(_ONES, small % 10)))
        head = F.when(hundreds == 0, "").when(hundreds == 1, "o sută").when(hundreds == 2, "două sute").otherwise(F.concat(listed(_ONES, hundreds), F.lit(" sute")))
        return text(head, tail)

    thousands = F.floor(n / 1000)
    head = F.when(thousands == 0, "").when(thousands == 1, "o mie").when(thousands == 2, "două mii").when(thousands < 20, F.concat(below_1000(thousands), F.lit(" mii"))).otherwise(F.concat(below_1000(thousands), F.lit(" de mii")))
    return text(head, below_1000(n % 1000))


@F.pandas_udf(StringType())
def _with_digits(s: pd.Series) -> pd.Series:
    return pd.Series([normalize_numbers(x) for x in s], dtype=object)


@query("""SELECT conv_id, turn, 'total ' || ((conv_id * 7919 + turn * 104729) % 899990 + 10) || '%, doi. ' || coalesce(text, '') AS said FROM conversations""")
def numbers_as_digits(spark, d):
    """Each turn's text after a number in words, made from its keys, and a lone unit, which stays a word."""
    n = (F.col("conv_id") * 7919 + F.col("turn") * 104729) % 899990 + 10
    said = F.concat(F.lit("total "), _spelled(n), F.lit(" la sută, doi. "), F.coalesce("text", F.lit("")))
    return turns(spark, d).select("conv_id", "turn", _with_digits(said).alias("said"))


@query()
def patient_fragments(spark, d):
    """Fragments by cues alone, for meetings without proposed starts."""
    t = P.with_clock(turns(spark, d)).select(F.col("conv_id").alias("job"), F.col("turn").alias("id"), (F.col("start_ds") / 10).alias("at"), F.coalesce("text", F.lit("")).alias("text"))
    return cue_fragments(t.withColumn("tokens_est", est_tokens(F.col("text"))), 15, 220, 3)
