"""Interval queries over events as timed segments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriven.operators import frames as FR
from scriven.operators import intervals as I

from .base import SEGMENTS_SQL, query, segments, table

DAY, HOUR = 86400, 3600


def _union_sql(op: str, gap: int, source: str = "seg", more: str = "") -> str:
    """Islands; both windows read equal rows in one order, numbered beforehand, so that the first of them opens an island in both."""
    return f"""tied AS (SELECT *, row_number() OVER () AS tie FROM {source}{more}
), marked AS (
  SELECT *, CASE WHEN start - max("end") OVER (PARTITION BY job ORDER BY start, "end", tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) {op} {gap} THEN 0 ELSE 1 END AS new FROM tied
), numbered AS (SELECT *, sum(new) OVER (PARTITION BY job ORDER BY start, "end", tie ROWS UNBOUNDED PRECEDING) AS island FROM marked)"""


@query(f"""WITH {SEGMENTS_SQL}, r AS (
  SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY job ORDER BY start, "end", id) = speaker THEN 0 ELSE 1 END AS new FROM seg
), runs AS (SELECT *, sum(new) OVER (PARTITION BY job ORDER BY start, "end", id ROWS UNBOUNDED PRECEDING) AS run FROM r
), p AS (SELECT *, CASE WHEN start - max("end") OVER (PARTITION BY job, run ORDER BY start, "end", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < {HOUR * 6} THEN 0 ELSE 1 END AS cut FROM runs
), parts AS (SELECT *, sum(cut) OVER (PARTITION BY job, run ORDER BY start, "end", id ROWS UNBOUNDED PRECEDING) AS part FROM p)
SELECT job, speaker, min(start) AS start, max("end") AS "end", count(*) AS n FROM parts GROUP BY job, speaker, run, part""")
def merge_gaps(spark, d):
    return I.merge_gaps(segments(spark, d), ["job"], HOUR * 6)


@query(f"""WITH {SEGMENTS_SQL}, {_union_sql('<=', HOUR)}
SELECT job, min(start) AS start, max("end") AS "end", count(*) AS n FROM numbered GROUP BY job, island""")
def interval_union(spark, d):
    return I.union(segments(spark, d), ["job"], HOUR)


@query(f"""WITH {SEGMENTS_SQL}, {_union_sql('<=', 0)}
SELECT job, min(start) AS start, max("end") AS "end", count(*) AS n FROM numbered GROUP BY job, island HAVING max("end") - min(start) >= {HOUR}""")
def gold_union(spark, d):
    return I.union(segments(spark, d), ["job"], 0).where(F.col("end") - F.col("start") >= HOUR)


@query(f"""WITH {SEGMENTS_SQL}, {_union_sql('<', 0).replace('ORDER BY start, "end"', 'ORDER BY start, "end", id').replace(' < 0 ', ' < 0 ')}
SELECT job, id, island::BIGINT AS cluster FROM numbered""")
def utterance_clusters(spark, d):
    return I.clusters(segments(spark, d), ["job"]).select("job", "id", "cluster")


@query(f"""WITH {SEGMENTS_SQL}, n AS (
  SELECT *, lag("end") OVER w AS before, lead(start) OVER w AS after, row_number() OVER w - 1 AS seq,
         min(start) OVER (PARTITION BY job) AS lo, max("end") OVER (PARTITION BY job) AS hi
  FROM seg WINDOW w AS (PARTITION BY job ORDER BY start, "end", id))
SELECT job, id, seq, greatest(start - 600, coalesce((before + start) / 2.0, lo::DOUBLE)) AS start,
       least("end" + 600, coalesce(("end" + after) / 2.0, hi::DOUBLE)) AS "end" FROM n""")
def pad_segments(spark, d):
    w = Window.partitionBy("job")
    s = segments(spark, d).withColumn("lo", F.min("start").over(w).cast("double")).withColumn("hi", F.max("end").over(w).cast("double"))
    out = I.padded(s, ["job"], 600, F.col("lo"), F.col("hi"))
    return out.select("job", "id", F.col("seq").cast("long").alias("seq"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))


@query("""WITH f AS (SELECT user_id AS job, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx, value / 500 AS p FROM events
), r AS (SELECT * FROM f WHERE p >= 0.1
), m AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY job ORDER BY idx) > 1 THEN 1 WHEN lag(idx) OVER (PARTITION BY job ORDER BY idx) IS NULL THEN 1 ELSE 0 END AS new FROM r
), n AS (SELECT *, sum(new) OVER (PARTITION BY job ORDER BY idx ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT job, min(idx) AS first, max(idx) AS last, max(p) AS peak FROM n GROUP BY job, island HAVING max(p) >= 0.25""")
def hysteresis_regions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    f = table(spark, d, "events").select(F.col("user_id").alias("job"), F.row_number().over(w).cast("long").alias("idx"), (F.col("value") / 500).alias("p"))
    return I.hysteresis(f, ["job"], "idx", F.col("p"), 0.25, 0.1)


@query(f"""WITH {SEGMENTS_SQL}, {_union_sql('<=', HOUR, 'seg', f' WHERE "end" - start >= {HOUR}')},
a AS (SELECT job, greatest(min(start) - 1800, 0) AS start, max("end") + 1800 AS "end" FROM numbered GROUP BY job, island
), m2 AS (SELECT *, CASE WHEN start - max("end") OVER (PARTITION BY job ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0 THEN 0 ELSE 1 END AS new FROM a
), n2 AS (SELECT *, sum(new) OVER (PARTITION BY job ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM m2)
SELECT job, min(start) AS start, max("end") AS "end" FROM n2 GROUP BY job, island""")
def speech_regions(spark, d):
    return I.speech_regions(segments(spark, d), ["job"], HOUR, HOUR, 1800, F.lit(0), F.lit(2**62))


@query(f"""WITH {SEGMENTS_SQL}
SELECT a.job, a.id AS a_id, b.id AS b_id, greatest(a.start, b.start) AS start, least(a."end", b."end") AS "end"
FROM seg a JOIN seg b ON a.job = b.job AND a.id < b.id AND a.speaker <> b.speaker AND a.start < b."end" AND b.start < a."end" """)
def overlap_pairs(spark, d):
    return I.speaker_overlaps(segments(spark, d), ["job"], bucket=DAY)


@query(f"""WITH {SEGMENTS_SQL}, gold AS (SELECT * FROM seg WHERE id % 2 = 0), hyp AS (SELECT * FROM seg WHERE id % 2 = 1),
p AS (SELECT h.job, h.id, g.id AS gold_id, g.speaker AS gold, h.speaker AS found, least(h."end", g."end") - greatest(h.start, g.start) AS overlap,
  row_number() OVER (PARTITION BY h.job, h.id ORDER BY least(h."end", g."end") - greatest(h.start, g.start) DESC, g.id) AS n
  FROM hyp h JOIN gold g ON h.job = g.job AND g.speaker <> 'mix' AND h.start < g."end" AND g.start < h."end")
SELECT job, id, gold_id, gold, found, overlap FROM p WHERE n = 1""")
def language_by_overlap(spark, d):
    s = segments(spark, d)
    out = I.best_overlap(s.where("id % 2 = 1"), s.where("id % 2 = 0 AND speaker <> 'mix'"), ["job"], "id", "id", DAY)
    return out.select("a.job", "a.id", F.col("b.id").alias("gold_id"), F.col("b.speaker").alias("gold"), F.col("a.speaker").alias("found"), "overlap")


@query(f"""WITH {SEGMENTS_SQL}, ref AS (SELECT job, id, start - 300 AS start, "end" + 300 AS "end" FROM seg WHERE id % 2 = 0), hyp AS (SELECT * FROM seg WHERE id % 2 = 1),
s AS (SELECT r.job, r.id, h.speaker, sum(least(h."end", r."end") - greatest(h.start, r.start)) AS seconds
  FROM ref r JOIN hyp h ON h.job = r.job AND h.start < r."end" AND r.start < h."end" GROUP BY r.job, r.id, h.speaker)
SELECT job, id, speaker, seconds::BIGINT AS seconds FROM (SELECT *, row_number() OVER (PARTITION BY job, id ORDER BY seconds DESC, speaker) AS n FROM s) WHERE n = 1""")
def language_by_seconds(spark, d):
    s = segments(spark, d)
    ref = s.where("id % 2 = 0").withColumn("start", F.col("start") - 300).withColumn("end", F.col("end") + 300)
    per = I.interval_join(ref, s.where("id % 2 = 1"), ["job"], DAY).groupBy("a.job", "a.id", F.col("b.speaker").alias("speaker")).agg(F.sum("overlap").alias("seconds"))
    w = Window.partitionBy("job", "id").orderBy(F.desc("seconds"), "speaker")
    return per.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


_POINTS = 'points AS (SELECT job, id, start AS "at" FROM seg WHERE id % 5 = 0), line AS (SELECT job, id, start, "end" FROM seg WHERE id % 5 <> 0)'


def _points(spark, d):
    s = segments(spark, d)
    return s.where("id % 5 = 0").select("job", "id", F.col("start").alias("at")), s.where("id % 5 <> 0").select("job", F.col("id").alias("line"), "start", "end")


@query(f"""WITH {SEGMENTS_SQL}, {_POINTS}, nx AS (SELECT job, id AS line, start, lead(id) OVER (PARTITION BY job ORDER BY start, id) AS next_line FROM line
), c AS (SELECT p.job, p.id, p."at", n.line, n.next_line, row_number() OVER (PARTITION BY p.job, p.id ORDER BY n.start <= p."at" + 60 DESC, CASE WHEN n.start <= p."at" + 60 THEN -n.start ELSE n.start END, CASE WHEN n.start <= p."at" + 60 THEN -n.line ELSE n.line END) AS k
  FROM points p LEFT JOIN nx n ON n.job = p.job)
SELECT job, id, "at", line, next_line FROM c WHERE k = 1""")
def asof_line(spark, d):
    p, line = _points(spark, d)
    return I.as_of(p, line, ["job"], "at", "start", "line", slack=60, or_first=True)


@query(f"""WITH {SEGMENTS_SQL}, {_POINTS}, c AS (SELECT p.job, p.id, l.id AS line, abs(l.start - p."at") AS distance, row_number() OVER (PARTITION BY p.job, p.id ORDER BY abs(l.start - p."at"), l.id) AS k FROM points p JOIN line l ON l.job = p.job)
SELECT job, id, line, distance FROM c WHERE k = 1""")
def nearest_turn(spark, d):
    p, line = _points(spark, d)
    return I.nearest(p, line, ["job"], "at", "id", "start", "line").where("line IS NOT NULL")


@query(f"""WITH {SEGMENTS_SQL}, {_POINTS}, c AS (SELECT p.job, p.id, l.id AS line, abs(l.start - p."at") AS distance, row_number() OVER (PARTITION BY p.job, p.id ORDER BY abs(l.start - p."at"), l.id) AS k FROM points p JOIN line l ON l.job = p.job)
SELECT job, coalesce(CASE WHEN distance <= 1800 THEN line END, -1) AS bucket, count(*) AS n FROM c WHERE k = 1 GROUP BY ALL""")
def nearest_within(spark, d):
    p, line = _points(spark, d)
    near = I.nearest(p, line, ["job"], "at", "id", "start", "line", within=1800)
    return near.where("distance IS NOT NULL").groupBy("job", F.coalesce("line", F.lit(-1).cast("long")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""WITH {SEGMENTS_SQL}, {_POINTS}, c AS (SELECT p.job, p.id, p."at", l.id AS line, l."end", row_number() OVER (PARTITION BY p.job, p.id ORDER BY l.start DESC NULLS LAST, l."end" DESC, l.id DESC) AS k FROM points p LEFT JOIN line l ON l.job = p.job AND l.start <= p."at")
SELECT job, id, "at", CASE WHEN "at" < "end" THEN line END AS line FROM c WHERE k = 1""")
def point_in_interval(spark, d):
    p, line = _points(spark, d)
    return I.bucketed_points(p, line, ["job"], "at", "line").select("job", "id", "at", "line")


@query(f"""WITH {SEGMENTS_SQL}, {_POINTS} SELECT p.job, p.id, count(l.id) AS inside FROM points p LEFT JOIN line l ON l.job = p.job AND p."at" BETWEEN l.start AND l."end" GROUP BY p.job, p.id""")
def points_in_regions(spark, d):
    p, line = _points(spark, d)
    return I.points_in(p, line, ["job"], "at", DAY).groupBy("p.job", "p.id").agg(F.count("r.line").alias("inside"))


@query("""WITH h AS (SELECT user_id AS job, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx, round(value * 100)::BIGINT AS energy FROM events)
SELECT job, idx, sqrt(avg(energy) OVER (PARTITION BY job ORDER BY idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) AS rms FROM h""")
def energy_envelope(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    h = table(spark, d, "events").select(F.col("user_id").alias("job"), F.row_number().over(w).cast("long").alias("idx"), F.round(F.col("value") * 100).cast("long").alias("energy"))
    return FR.rms_envelope(h, ["job"], "idx", "energy").select("job", "idx", "rms")


@query("""WITH f AS (SELECT user_id AS job, event_id AS idx, floor(epoch(ts) / 864000)::BIGINT AS block, value AS level FROM events
), b AS (SELECT job, block, quantile_cont(level, 0.1) AS p10, quantile_cont(level, 0.95) AS p95 FROM f GROUP BY ALL), j AS (SELECT job, quantile_cont(level, 0.05) AS p5 FROM f GROUP BY job)
SELECT f.job, idx, level >= greatest(least(p10 + 9, p95 - 10), p5 + 9) AS speech FROM f JOIN b ON f.job = b.job AND f.block = b.block JOIN j ON f.job = j.job""")
def adaptive_speech(spark, d):
    f = table(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("idx"), F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("at"), F.col("value").alias("level"))
    out = FR.adaptive_threshold(f, ["job"], F.floor(F.col("at") / 864000), "level")
    return out.select("job", "idx", (F.col("level") >= F.col("threshold")).alias("speech"))


@query(f"""WITH {SEGMENTS_SQL}, j AS (SELECT job, max("end") - min(start) AS dur FROM seg GROUP BY job)
SELECT job, s AS start, least(s + 600000, dur) AS "end", 'UNK' AS speaker FROM (SELECT job, dur, unnest(range(0, greatest(dur, 1), 600000)) AS s FROM j)""")
def fixed_windows(spark, d):
    jobs = segments(spark, d).groupBy("job").agg((F.max("end") - F.min("start")).alias("dur"))
    return FR.tumbling(jobs, "dur", 600_000).select("job", "start", "end", "speaker")


@query(f"""WITH {SEGMENTS_SQL}, o AS (SELECT job, start, "end" FROM seg WHERE id % 2 = 0 UNION ALL
  SELECT a.job, greatest(a.start, b.start), least(a."end", b."end") FROM seg a JOIN seg b ON a.job = b.job AND a.id < b.id AND a.speaker <> b.speaker AND a.start < b."end" AND b.start < a."end"),
{_union_sql('<=', 0, 'o')} SELECT job, min(start) AS start, max("end") AS "end", count(*) AS n FROM numbered GROUP BY job, island""")
def all_overlaps(spark, d):
    s = segments(spark, d)
    return I.union(s.where("id % 2 = 0").select("job", "start", "end").unionAll(I.speaker_overlaps(s, ["job"], DAY).select("job", "start", "end")), ["job"])


@query(f"""WITH {SEGMENTS_SQL}, o AS (SELECT job, id, "end" - start AS dur, coalesce(sum("end" - start) OVER (PARTITION BY job ORDER BY start, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "at" FROM seg),
c AS (SELECT job, clip, coalesce(sum(len) OVER (PARTITION BY job ORDER BY clip ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM (SELECT job, unnest(range(0, 40)) AS clip FROM (SELECT DISTINCT job FROM seg)), LATERAL (SELECT 20000 + clip * 7919 % 60000 AS len))
SELECT o.job, o.id, max(c.clip)::BIGINT AS clip FROM o JOIN c ON o.job = c.job AND c.begins <= o."at" + o.dur / 2.0 GROUP BY o.job, o.id""")
def clip_by_midpoint(spark, d):
    """Segments laid end to end, each put to the clip that holds its middle; clips of unequal lengths lie end to end too."""
    w = Window.partitionBy("job").orderBy("start", "id").rowsBetween(Window.unboundedPreceding, -1)
    o = segments(spark, d).withColumn("dur", F.col("end") - F.col("start")).withColumn("at", F.coalesce(F.sum("dur").over(w), F.lit(0)))
    clips = o.select("job").distinct().withColumn("clip", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))))
    return I.clip_of(o.select("job", "id", (F.col("at") + F.col("dur") / 2).alias("middle")), clips.withColumn("length", 20000 + F.col("clip") * 7919 % 60000), ["job"])
