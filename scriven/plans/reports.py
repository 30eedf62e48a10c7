"""Aggregates, rankings, sets and minutes reports over events, conversations and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriven.operators import evaluation as E
from scriven.operators import ranks as N
from scriven.operators import scoring as C

from .base import SEGMENTS_SQL, query, segments, table, turns

W = Window


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def counts_by_type(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS speakers FROM conversations GROUP BY conv_id")
def distinct_speakers(spark, d):
    return turns(spark, d).groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_set("role")), ",").alias("speakers"))


@query("WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY ALL) SELECT conv_id, string_agg(role, ',' ORDER BY t) AS roles FROM f GROUP BY conv_id")
def ordered_distinct(spark, d):
    """Distinct values in order of first appearance; a group's distinct values, not its rows, are collected."""
    first = turns(spark, d).groupBy("conv_id", "role").agg(F.min("turn").alias("t"))
    return first.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "role"))), lambda x: x.role), ",").alias("roles"))


@query(f"""WITH {SEGMENTS_SQL}, s AS (SELECT job, sum("end" - start) AS dur, sum(CASE WHEN value < 20 THEN "end" - start ELSE 0 END) AS low FROM seg GROUP BY job)
SELECT job, CASE WHEN dur > 0 THEN 2 * low >= dur ELSE true END AS low_confidence, CASE WHEN dur > 0 THEN low::DOUBLE / dur ELSE 1.0::DOUBLE END AS ratio FROM s""")
def weighted_confidence(spark, d):
    dur = F.col("end") - F.col("start")
    s = segments(spark, d).groupBy("job").agg(F.sum(dur).alias("dur"), F.sum(F.when(F.col("value") < 20, dur).otherwise(0)).alias("low"))
    return s.select("job", F.when(F.col("dur") > 0, 2 * F.col("low") >= F.col("dur")).otherwise(True).alias("low_confidence"), F.when(F.col("dur") > 0, F.col("low") / F.col("dur")).otherwise(1.0).alias("ratio"))


@query("SELECT conv_id, sum(greatest(turn, 1))::BIGINT AS weight, sum(length(text) * greatest(turn, 1))::DOUBLE / sum(greatest(turn, 1)) AS mean FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def weighted_mean(spark, d):
    w = F.greatest("turn", F.lit(1))
    return turns(spark, d).where("text IS NOT NULL").groupBy("conv_id").agg(F.sum(w).alias("weight"), (F.sum(F.length("text") * w) / F.sum(w)).alias("mean"))


_BINS = (0, 1000, 3000, 10000, 30000, 60000, 100000, 200000)


@query(f"""WITH {SEGMENTS_SQL}, x AS (SELECT "end" - start AS dur FROM seg) SELECT count(*) AS n, min(dur) AS min, floor(quantile_cont(dur, 0.1) * 10 + 0.5)::BIGINT AS p10, floor(quantile_cont(dur, 0.5) * 10 + 0.5)::BIGINT AS p50, floor(quantile_cont(dur, 0.9) * 10 + 0.5)::BIGINT AS p90, max(dur) AS max, sum(dur)::DOUBLE / count(*) AS mean,
{', '.join(f"count(*) FILTER (WHERE dur >= {a}" + (f" AND dur < {b})" if b else ")") + f" AS bin{i}" for i, (a, b) in enumerate(zip(_BINS, (*_BINS[1:], None))))} FROM x""")
def duration_stats(spark, d):
    """Percentiles in tenths, from counts of ranges: no task sees all rows."""
    x = segments(spark, d).select((F.col("end") - F.col("start")).alias("dur"))
    bins = [F.count_if((F.col("dur") >= a) & ((F.col("dur") < b) if b else F.lit(True))).alias(f"bin{i}") for i, (a, b) in enumerate(zip(_BINS, (*_BINS[1:], None)))]
    quantiles = zip((10, 50, 90), N.exact_quantiles(x, "dur", [0.1, 0.5, 0.9]))
    return x.agg(F.count("*").alias("n"), F.min("dur").alias("min"), *[F.floor(F.lit(v).cast("double") * 10 + 0.5).alias(f"p{q}") for q, v in quantiles], F.max("dur").alias("max"), (F.sum("dur") / F.count("*")).alias("mean"), *bins)


@query(f"""WITH {SEGMENTS_SQL}, s AS (SELECT job, speaker, count(*) AS n, sum("end" - start)::BIGINT AS seconds FROM seg GROUP BY ALL)
SELECT *, seconds::DOUBLE / sum(seconds) OVER (PARTITION BY job) AS share FROM s""")
def speaker_share(spark, d):
    s = segments(spark, d).groupBy("job", "speaker").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("seconds"))
    return s.withColumn("share", F.col("seconds") / F.sum("seconds").over(W.partitionBy("job")))


@query(f"""WITH {SEGMENTS_SQL}, l AS (SELECT *, lead(start) OVER (PARTITION BY job ORDER BY start, "end", id) AS next FROM seg)
SELECT job, count(*) FILTER (WHERE next < "end") AS overlaps, count(*) FILTER (WHERE "end" - start < 1000) AS short, count(*) FILTER (WHERE "end" - start > 50000) AS over_soft, count(*) FILTER (WHERE "end" - start > 150000) AS over_hard FROM l GROUP BY job""")
def constraint_counters(spark, d):
    s = segments(spark, d).withColumn("next", F.lead("start").over(W.partitionBy("job").orderBy("start", "end", "id")))
    dur = F.col("end") - F.col("start")
    return s.groupBy("job").agg(F.count_if(F.col("next") < F.col("end")).alias("overlaps"), F.count_if(dur < 1000).alias("short"), F.count_if(dur > 50000).alias("over_soft"), F.count_if(dur > 150000).alias("over_hard"))


_WORDS = "[^\\x20\\x09-\\x0d]+"
#: The edit table of two word lists in SQL, row by row; a cell holds cost, S, D and I in one number and takes the diagonal first, then a deletion.
_COST, _SUB, _DEL, _INS = 10**15, 10**10, 10**5, 1
_CELLS = f"""list_reduce(b, lambda r, y: list_reduce(range(1, len(a) + 1), lambda acc, i: acc || [CASE
  WHEN r[i] // {_COST} + (a[i] <> y)::INT <= least(r[i + 1], acc[-1]) // {_COST} + 1 THEN r[i] + CASE WHEN a[i] <> y THEN {_COST + _SUB}::BIGINT ELSE 0 END
  WHEN acc[-1] // {_COST} <= r[i + 1] // {_COST} THEN acc[-1] + {_COST + _DEL}::BIGINT ELSE r[i + 1] + {_COST + _INS}::BIGINT END], [r[1] + {_COST + _INS}::BIGINT]),
  list_transform(range(len(a) + 1), lambda k: k * {_COST + _DEL}::BIGINT))[-1]"""
#: Each turn's words and the same words misheard: some doubled, some lost, some turned round.
_HEARD_SQL = f"""pairs AS (
  SELECT conv_id, turn, role, w AS a, list_filter(flatten(list_transform(w, lambda x, i: CASE WHEN (i + turn) % 13 = 7 THEN [x, x] WHEN (i + conv_id) % 11 = 6 THEN [] WHEN i % 7 = 4 THEN [reverse(x)] ELSE [x] END)), lambda x: true) AS b
  FROM (SELECT conv_id, turn, role, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM conversations)
), counted AS (SELECT conv_id, turn, role, a, b, {_CELLS} AS r FROM pairs
), errors AS (SELECT conv_id, turn, role, a, b, r // {_SUB} % 100000 AS "S", r // {_DEL} % 100000 AS "D", r % 100000 AS "I", len(a) AS "N" FROM counted)"""


def _ops(spark, d):
    """The words of turns against the same words misheard, as steps of their alignment."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    heard = F.flatten(F.transform("a", lambda x, i: F.when((i + 1 + F.col("turn")) % 13 == 7, F.array(x, x)).when((i + 1 + F.col("conv_id")) % 11 == 6, F.array().cast("array<string>")).when((i + 1) % 7 == 4, F.array(F.reverse(x))).otherwise(F.array(x))))
    pairs = turns(spark, d).select("conv_id", "turn", "role", words.alias("a")).withColumn("b", heard)
    told = F.transform("steps", lambda s: F.struct(s.tag.alias("tag"), F.get("a", s.i).alias("ref"), F.get("b", s.j).alias("hyp")))
    return C.aligned(pairs, "a", "b").select("conv_id", "turn", "role", F.posexplode(told).alias("i", "s")).select("conv_id", "turn", "role", "i", "s.*")


@query(f"""WITH {_HEARD_SQL}, s AS (SELECT conv_id, unnest(['all', 'clean', 'user']) AS slice, unnest([true, turn % 2 = 0, role = 'user']) AS fits, * EXCLUDE (conv_id) FROM errors WHERE len(a) > 0 OR len(b) > 0),
c AS (SELECT conv_id, slice, coalesce(sum("S") FILTER (WHERE fits), 0)::BIGINT AS "S", coalesce(sum("D") FILTER (WHERE fits), 0)::BIGINT AS "D", coalesce(sum("I") FILTER (WHERE fits), 0)::BIGINT AS "I", coalesce(sum("N") FILTER (WHERE fits), 0)::BIGINT AS "N" FROM s GROUP BY ALL)
SELECT *, ("S" + "D" + "I")::DOUBLE / nullif("N", 0) AS rate FROM c""")
def error_rollup(spark, d):
    """Errors of each conversation: of all turns, of every second, of the user's."""
    return E.rollup(_ops(spark, d), ["conv_id"], {"all": F.lit(True), "clean": F.col("turn") % 2 == 0, "user": F.col("role") == "user"})


@query(f"""WITH {_HEARD_SQL} SELECT conv_id, turn, array_to_string(a, ' ') AS ref, array_to_string(b, ' ') AS hyp, "S" + "D" + "I" AS errors, "N", ("S" + "D" + "I")::DOUBLE / nullif("N", 0) AS wer FROM errors WHERE len(a) > 0 OR len(b) > 0""")
def unit_detail(spark, d):
    return E.unit_details(_ops(spark, d), ["conv_id", "turn"])


_TERMS_SQL = "g AS (SELECT source AS job, lang AS category, toxic = 1 AS in_overlap, CASE WHEN quality = 1 THEN doc_id END AS hit FROM documents JOIN labels USING (doc_id)), h AS (SELECT source AS job, doc_id % 3 > 0 AS used FROM documents)"


def _terms(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.col("source").alias("job"))
    gold = docs.join(table(spark, d, "labels"), "doc_id").select("job", F.col("lang").alias("category"), (F.col("toxic") == 1).alias("in_overlap"), F.when(F.col("quality") == 1, F.col("doc_id")).alias("hit"))
    return gold, docs.select("job", (F.col("doc_id") % 3 > 0).alias("used"))


@query(f"""WITH {_TERMS_SQL}, a AS (SELECT job, count(*) AS n_gold, count(hit)::DOUBLE / count(*) AS recall, count(hit) FILTER (WHERE NOT in_overlap)::DOUBLE / nullif(count(*) FILTER (WHERE NOT in_overlap), 0) AS recall_clean, count(hit) FILTER (WHERE in_overlap)::DOUBLE / nullif(count(*) FILTER (WHERE in_overlap), 0) AS recall_overlap FROM g GROUP BY job),
b AS (SELECT job, count(*) AS n_hyp, count(*) FILTER (WHERE used)::DOUBLE / count(*) AS precision FROM h GROUP BY job)
SELECT job, coalesce(n_gold, 0) AS n_gold, coalesce(n_hyp, 0) AS n_hyp, recall, recall_clean, recall_overlap, precision FROM a FULL JOIN b USING (job)""")
def term_scores(spark, d):
    return E.term_scores(*_terms(spark, d), ["job"])


@query(f"WITH {_TERMS_SQL} SELECT job, category, count(*) AS n, count(hit)::DOUBLE / count(*) AS recall FROM g GROUP BY ALL")
def recall_by_category(spark, d):
    return E.recall_by(_terms(spark, d)[0], ["job"])


@query("SELECT quality AS gold, CASE WHEN length(text) > 800 THEN 1 ELSE 0 END AS found, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def confusion_matrix(spark, d):
    j = table(spark, d, "documents").select("doc_id", F.when(F.length("text") > 800, 1).otherwise(0).alias("found")).join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("gold")), "doc_id")
    return j.groupBy("gold", "found").agg(F.count("*").alias("n"))


@query("SELECT user_id AS job, count(DISTINCT event_type) AS kinds, avg(value) FILTER (WHERE value > 10) AS mean_sure, count(*) FILTER (WHERE value > 50) AS sure, count(*) FILTER (WHERE value < 1) AS dropped FROM events GROUP BY user_id")
def run_summary(spark, d):
    v = F.col("value")
    return table(spark, d, "events").groupBy(F.col("user_id").alias("job")).agg(F.countDistinct("event_type").alias("kinds"), F.avg(F.when(v > 10, v)).alias("mean_sure"), F.count_if(v > 50).alias("sure"), F.count_if(v < 1).alias("dropped"))


_CHECK = (("p1", "a", "the"), ("p1", "b", "idiot|moron"), ("p2", "a", "und"), ("p2", "c", "zzzz"))


@query(f"""WITH c(patient, item, re) AS (VALUES {', '.join(str(x) for x in _CHECK)}), k(patient, lang) AS (VALUES ('p1', 'en'), ('p2', 'de'))
SELECT c.patient, item, coalesce(bool_or(d.lang = k.lang), false) AS found, NOT coalesce(bool_or(d.lang = k.lang), false) AND coalesce(bool_or(d.lang <> k.lang), false) AS elsewhere
FROM c JOIN k USING (patient) LEFT JOIN documents d ON regexp_matches(lower(d.text), c.re) GROUP BY c.patient, item""")
def checklist_coverage(spark, d):
    """A few checklist patterns against all texts, all patterns in one pass over the texts."""
    keys = {"p1": "en", "p2": "de"}
    text = F.lower("text")
    sums = [F.max(text.rlike(re) & ((F.col("lang") == keys[p]) if own else (F.col("lang") != keys[p]))).alias(f"{p}_{i}_{own}") for p, i, re in _CHECK for own in (True, False)]
    one = table(spark, d, "documents").agg(*sums)
    rows = F.array(*[F.struct(F.lit(p).alias("patient"), F.lit(i).alias("item"), F.coalesce(F.col(f"{p}_{i}_True"), F.lit(False)).alias("found"), (~F.coalesce(F.col(f"{p}_{i}_True"), F.lit(False)) & F.coalesce(F.col(f"{p}_{i}_False"), F.lit(False))).alias("elsewhere")) for p, i, _ in _CHECK])
    return one.select(F.inline(rows))


@query("""WITH g AS (SELECT event_id // 100 AS grp, CASE WHEN event_id // 100 % 2 = 0 AND event_id % 7 > 0 THEN 'view' ELSE event_type END AS v, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY grp) AS total, row_number() OVER (PARTITION BY grp ORDER BY n DESC, v) AS k FROM g)
SELECT grp, v, n, 5 * n >= 4 * total AS dominant FROM r WHERE k = 1""")
def dominant_value(spark, d):
    g = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 100).alias("grp"), F.when((F.floor(F.col("event_id") / 100) % 2 == 0) & (F.col("event_id") % 7 > 0), "view").otherwise(F.col("event_type")).alias("v")).agg(F.count("*").alias("n"))
    r = g.withColumn("total", F.sum("n").over(W.partitionBy("grp"))).withColumn("k", F.row_number().over(W.partitionBy("grp").orderBy(F.desc("n"), "v")))
    return r.where("k = 1").select("grp", "v", "n", (5 * F.col("n") >= 4 * F.col("total")).alias("dominant"))


@query("""SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running FROM events""")
def running_max(spark, d):
    return table(spark, d, "events").select("event_id", F.max("value").over(W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)).alias("running"))


@query("SELECT user_id AS job, median(value) AS median FROM events GROUP BY user_id")
def median_ratio(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("job")).agg(F.median("value").alias("median"))


@query("""WITH m AS (SELECT user_id, event_id, ts, CASE WHEN value > 90 THEN event_type END AS said FROM events)
SELECT event_id, last_value(said IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS subject FROM m""")
def last_mention_25(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-24, 0)
    return table(spark, d, "events").select("event_id", F.last(F.when(F.col("value") > 90, F.col("event_type")), ignorenulls=True).over(w).alias("subject"))


@query("""WITH m AS (SELECT user_id, event_id, ts, event_type, CASE WHEN value >= 2 OR event_id % 10 >= 5 OR row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 THEN event_type END AS sure FROM events)
SELECT event_id, last_value(sure IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS lang FROM m""")
def language_carry(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    # short (under two seconds) and unsure (probability under a half): the language chosen before; the first keeps its own
    e = table(spark, d, "events").withColumn("duration", F.col("value")).withColumn("prob", F.col("event_id") % 10 / 10)
    sure = F.when((F.col("duration") >= 2) | (F.col("prob") >= 0.5) | (F.row_number().over(w) == 1), F.col("event_type"))
    return e.withColumn("sure", sure).select("event_id", F.last("sure", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("lang"))


@query("""WITH m AS (SELECT *, event_type = 'purchase' AS replaces FROM events)
SELECT event_id, coalesce(max(replaces::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) = 1 AS superseded,
  lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT NULL AS superseded_all FROM m""")
def superseded_flags(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    back = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(W.unboundedPreceding, -1)  # a running value, from the end
    e = table(spark, d, "events").withColumn("replaces", (F.col("event_type") == "purchase").cast("int"))
    return e.select("event_id", (F.coalesce(F.max("replaces").over(back), F.lit(0)) == 1).alias("superseded"), F.lead("event_id").over(w).isNotNull().alias("superseded_all"))


@query("""WITH r AS (SELECT user_id AS job, event_type AS eta, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type <> 'view')
SELECT job, eta, event_id FROM r WHERE k = 1""")
def latest_eta(spark, d):
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    r = table(spark, d, "events").where("event_type <> 'view'").withColumn("k", F.row_number().over(w))
    return r.where("k = 1").select(F.col("user_id").alias("job"), F.col("event_type").alias("eta"), "event_id")


@query("""SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id LIMIT 30""")
def worst_rows(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "value").orderBy(F.desc("value"), "event_id").limit(30)


@query("""SELECT * FROM (SELECT user_id AS job, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5""")
def last_cases(spark, d):
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").select(F.col("user_id").alias("job"), "event_id", "event_type", F.row_number().over(w).cast("long").alias("k")).where("k <= 5")


@query("""WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5(doc_id::VARCHAR), doc_id) AS g FROM documents
), s AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY md5(source), source) AS rn FROM r WHERE g = 1)
SELECT doc_id, lang, rn, row_number() OVER (ORDER BY rn, lang) AS pick FROM s WHERE rn <= 10""")
def stratified_pick(spark, d):
    """Round robin over strata, one document a source, ten a stratum at most."""
    r = table(spark, d, "documents").select("doc_id", "lang", "source", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")).alias("g")).where("g = 1")
    s = r.withColumn("rn", F.row_number().over(W.partitionBy("lang").orderBy(F.md5("source"), "source")).cast("long")).where("rn <= 10")
    return s.select("doc_id", "lang", "rn", F.row_number().over(W.orderBy("rn", "lang")).cast("long").alias("pick"))


@query("SELECT e.event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.event_id)")
def resume_anti_join(spark, d):
    return table(spark, d, "events").select("event_id").join(table(spark, d, "labels").select(F.col("doc_id").alias("event_id")), "event_id", "left_anti")


@query("SELECT d.doc_id, d.lang, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def reference_join(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", "lang", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query(f"""WITH {SEGMENTS_SQL} SELECT job, id, speaker AS lang, 'other' AS other FROM seg WHERE id % 4 = 0""")
def compared_runs(spark, d):
    """Two runs over the segments, every fourth in another language in the second."""
    a = segments(spark, d).select("job", "id", "start", "end", F.col("speaker").alias("lang"), F.lit("a").alias("text"))
    return E.compared_runs(a, a.withColumn("lang", F.when(F.col("id") % 4 == 0, "other").otherwise(F.col("lang")))).select("job", "id", "lang", "other")


@query("""WITH w AS (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0d]+') AS w FROM conversations)
SELECT conv_id, turn, i::BIGINT AS n, word, floor(turn * 1000 + 500 * (2 * i + 1) / len + 0.000001)::DOUBLE AS at FROM (SELECT conv_id, turn, len(w) AS len, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM w)""")
def uniform_words(spark, d):
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    u = turns(spark, d).select(F.col("conv_id").alias("job"), F.col("turn").alias("utt"), (F.col("turn") * 1000).alias("start"), (F.col("turn") * 1000 + 1000).alias("end"), words.alias("words"))
    return E.uniform_words(u).select(F.col("job").alias("conv_id"), F.col("utt").alias("turn"), F.col("n").cast("long").alias("n"), "word", F.floor(F.col("at") + 1e-6).cast("double").alias("at"))


@query("""WITH w AS (SELECT conv_id, turn, turn // 2 AS win FROM conversations)
SELECT conv_id, win AS index, turn AS id, text IS NOT NULL AS present FROM (SELECT conv_id, win, unnest(range(a, b + 2)) AS turn FROM (SELECT conv_id, win, min(turn) AS a, max(turn) AS b FROM w GROUP BY conv_id, win)) LEFT JOIN conversations USING (conv_id, turn)""")
def window_members(spark, d):
    """Windows given by first and last id, expanded; ids without a row stay, marked."""
    w = turns(spark, d).groupBy("conv_id", F.floor(F.col("turn") / 2).alias("index")).agg(F.min("turn").alias("a"), F.max("turn").alias("b"))
    ids = w.select("conv_id", "index", F.explode(F.expr("sequence(a, b + 1)")).alias("id"))
    t = turns(spark, d).select("conv_id", F.col("turn").alias("id"), F.col("text").isNotNull().alias("present"))
    return ids.join(t, ["conv_id", "id"], "left").select("conv_id", "index", "id", F.coalesce("present", F.lit(False)).alias("present"))
