"""Further queries: identifiers, orders, times of words, sections, prompts, gains."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriven.functions import repairs as R
from scriven.operators import evaluation as E
from scriven.operators import frames as FR

from .base import CLOCK_SQL, query, table, turns


@query("""WITH o AS (SELECT event_id, list_distinct(list_filter([event_id % 7, event_id % 5, event_id % 9, 2], lambda i: i < 4)) AS v FROM events),
p AS (SELECT event_id, list_filter([CASE WHEN event_id % 7 < 4 THEN event_id % 7 END, CASE WHEN event_id % 5 < 4 AND event_id % 5 <> event_id % 7 THEN event_id % 5 END, CASE WHEN event_id % 9 < 4 AND event_id % 9 <> event_id % 7 AND event_id % 9 <> event_id % 5 THEN event_id % 9 END, CASE WHEN event_id % 7 <> 2 AND event_id % 5 <> 2 AND event_id % 9 <> 2 THEN 2 END], lambda i: i IS NOT NULL) AS v FROM o JOIN events USING (event_id))
SELECT event_id, array_to_string(list_concat(v, list_filter([0, 1, 2, 3], lambda i: NOT list_contains(v, i))), ',') AS fixed FROM p""")
def permutation_repair(spark, d):
    e = F.col("event_id")
    given = F.array(*[x.cast("int") for x in (e % 7, e % 5, e % 9, F.lit(2))])
    return table(spark, d, "events").select("event_id", F.array_join(R.repaired_order(given, F.lit(4)).cast("array<string>"), ",").alias("fixed"))


@query("SELECT doc_id, regexp_matches(source || '-' || doc_id, '^[A-Za-z0-9_-]{1,60}$') AS ok FROM documents")
def valid_job_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).rlike("^[A-Za-z0-9_-]{1,60}$").alias("ok"))


@query(f"""WITH {CLOCK_SQL}, w AS (SELECT conv_id, turn, start_ds, end_ds, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0d]+') AS w FROM clock),
x AS (SELECT conv_id, turn, start_ds, end_ds, i, length(w[i]) AS n FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w)),
y AS (SELECT *, sum(n + 1) OVER (PARTITION BY conv_id, turn ORDER BY i) AS upto, sum(n + 1) OVER (PARTITION BY conv_id, turn) AS total FROM x)
SELECT conv_id, turn, (i - 1)::BIGINT AS n, floor(start_ds * 100 + (end_ds - start_ds) * 100 * (2 * upto - n - 2) / (2.0 * total) + 0.001)::BIGINT AS at_ms FROM y""")
def timed_words(spark, d):
    from scriven.operators.packing import with_clock

    t = with_clock(turns(spark, d))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    u = t.select(F.col("conv_id").alias("job"), F.col("turn").alias("utt"), (F.col("start_ds") * 100).alias("start"), (F.col("end_ds") * 100).alias("end"), words.alias("words"))
    return E.timed_words(u).select(F.col("job").alias("conv_id"), F.col("utt").alias("turn"), F.col("n").cast("long").alias("n"), F.floor(F.col("at") + 0.001).alias("at_ms"))


@query("""WITH t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN coalesce(text, '') <> '' THEN 0 ELSE 1 END, turn DESC) AS k FROM conversations)
SELECT conv_id, text AS topic FROM t WHERE k = 1""")
def latest_topic(spark, d):
    w = W.partitionBy("conv_id").orderBy(F.when(F.coalesce("text", F.lit("")) != "", 0).otherwise(1), F.desc("turn"))
    return turns(spark, d).withColumn("k", F.row_number().over(w)).where("k = 1").select("conv_id", F.col("text").alias("topic"))


@query("SELECT item_id, 'Text: ' || text || chr(10) || 'Numar: ' || item_id || '.' AS prompt, substr(sha256(text), 1, 8) AS fingerprint FROM benchmark")
def rendered_prompts(spark, d):
    b = table(spark, d, "benchmark")
    return b.select("item_id", R.rendered("Text: {{text}}\nNumar: {{n}}.", {"n": F.col("item_id"), "text": F.col("text")}).alias("prompt"), F.substring(F.sha2("text", 256), 1, 8).alias("fingerprint"))


@query("""WITH s AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) AS k FROM documents) SELECT doc_id, lang FROM s WHERE k <= 15""")
def seeded_sample(spark, d):
    """Fifteen a stratum, in the order of a seeded hash: the sampling operator."""
    w = W.partitionBy("lang").orderBy(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))), "doc_id")
    return table(spark, d, "documents").select("doc_id", "lang", F.row_number().over(w).alias("k")).where("k <= 15").select("doc_id", "lang")


@query("""WITH r AS (SELECT user_id AS job, value, floor(value)::BIGINT + 1 AS energy, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
g AS (SELECT job, sqrt(sum(energy)::DOUBLE / count(*)) AS rms, max(value) / 1000 AS peak FROM r WHERE n <= 200 GROUP BY job)
SELECT job, floor(rms * 1000)::BIGINT AS rms_milli, peak, floor(least(least(greatest(-3.0 - 20 * log10(rms), -20.0), 20.0), 20 * log10(0.99::DOUBLE / peak)) * 1000 + 0.5)::BIGINT AS gain_mdb FROM g""")
def speech_gain(spark, d):
    """rms of the first 200 regions and the gain towards -3 dB, in thousandths."""
    e = table(spark, d, "events").select(F.col("user_id").alias("job"), F.struct("ts", "event_id").alias("at"), (F.floor("value") + 1).alias("energy"), (F.col("value") / 1000).alias("level"))
    g = FR.speech_gain(e, ["job"], "at", "energy", "level", -3.0)
    return g.select("job", F.floor(F.col("rms") * 1000).alias("rms_milli"), "peak", F.floor(F.col("gain_db") * 1000 + 0.5).alias("gain_mdb"))


@query("""WITH s(category, section, n) AS (VALUES ('view', 'Informații', 2), ('click', 'Evoluție', 1), ('purchase', 'Tratament', 0)),
f AS (SELECT user_id AS job, section, n, count(*) AS facts FROM events JOIN s ON event_type = category GROUP BY ALL)
SELECT job, string_agg(section || ': ' || facts, '; ' ORDER BY n) AS minutes FROM f GROUP BY job""")
def facts_by_section(spark, d):
    s = spark.createDataFrame([("view", "Informații", 2), ("click", "Evoluție", 1), ("purchase", "Tratament", 0)], "event_type string, section string, n int")
    f = table(spark, d, "events").join(s, "event_type").groupBy(F.col("user_id").alias("job"), "section", "n").agg(F.count("*").alias("facts"))
    parts = F.array_sort(F.collect_list(F.struct("n", F.concat("section", F.lit(": "), F.col("facts").cast("string")).alias("t"))))
    return f.groupBy("job").agg(F.array_join(F.transform(parts, lambda p: p.t), "; ").alias("minutes"))
