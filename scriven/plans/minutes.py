"""Queries of minutes: events as the turns, cases and decisions of meetings, ten turns to a window and two more to overlap."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriven.operators import answers as A
from scriven.operators import minutes as M

from .base import query, table

_BASE_SQL = "e AS (SELECT user_id AS job, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events)"


def _events(spark, d):
    # named before it is dealt by job: what is worked out inside a job later is not dealt again
    w = Window.partitionBy("job").orderBy("ts", "event_id")
    return table(spark, d, "events").withColumnRenamed("user_id", "job").select("job", "event_id", "event_type", (F.row_number().over(w) - 1).cast("long").alias("t"))


def _text(c):
    return c.cast("string")


# --- subjects

_A = "'Pacient ' || (event_id % 5) || CASE WHEN event_id % 7 = 0 THEN ', salon ' || (event_id % 3) ELSE '' END"
_B = "CASE event_id % 4 WHEN 0 THEN 'pacientul nr ' || (event_id % 6) WHEN 1 THEN 'patul ' || (event_id % 3) WHEN 2 THEN 'salonul 2, pacienta 45 de ani' ELSE 'altceva' END"


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 5 = event_id % 6 THEN 'match' ELSE 'mismatch' END
  WHEN 1 THEN CASE WHEN event_id % 7 = 0 THEN 'match' WHEN event_id % 5 <> event_id % 3 THEN 'mismatch' ELSE 'unknown' END
  WHEN 2 THEN CASE WHEN event_id % 7 = 0 THEN CASE WHEN event_id % 3 = 2 THEN 'match' ELSE 'mismatch' END WHEN event_id % 5 <> 2 THEN 'mismatch' ELSE 'unknown' END
  ELSE 'unknown' END AS relation FROM events""")
def shared_identifiers(spark, d):
    """Whether two texts speak of one patient: by patients, else by wards, else by any number."""
    e = table(spark, d, "events").select("event_id", F.expr(_A).alias("a"), F.expr(_B).alias("b"))
    return e.select("event_id", M.relation(M.subject(F.col("a")), M.subject(F.col("b"))).alias("relation"))


_CLAIMS_SQL = f"""{_BASE_SQL}, s AS (SELECT *, last_value(CASE WHEN event_id % 4 = 0 THEN event_id % 5 END IGNORE NULLS) OVER (PARTITION BY job ORDER BY t ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS subject FROM e),
d AS (SELECT job, t // 10 AS win, event_id // 3 % 3 AS "from", t AS n, t AS turn_id, subject FROM s WHERE event_id % 3 = 1 UNION ALL SELECT job, t // 10, (event_id // 3 + 1) % 3, 1000 + t, t, subject FROM s WHERE event_id % 9 = 1),
m AS (SELECT *, CASE WHEN subject IS NULL OR subject = "from" OR subject = 4 THEN "from" WHEN subject = 3 THEN 10000 ELSE subject END AS "no" FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY job, win, turn_id ORDER BY CASE WHEN subject = CASE WHEN "no" = 10000 THEN 3 ELSE "no" END THEN 0 ELSE 1 END, "no", "no" <> "from", "from", n) AS k FROM m)
"""


@query(f"""WITH {_CLAIMS_SQL} SELECT job, win, "no", n, turn_id, 'Pacient ' || CASE WHEN "no" = 10000 THEN 3 ELSE "no" END AS case_key, CASE WHEN "no" <> "from" THEN 'Pacient ' || "from" END AS moved_from FROM k WHERE k = 1""")
def attributed_decisions(spark, d):
    """Three patients a window; each decision goes to the patient named last, a turn claimed twice stays once."""
    e = _events(spark, d)
    win = F.floor(F.col("t") / 10)
    turns = e.select("job", F.col("t").alias("id"), F.col("t").cast("double").alias("start"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Pacientul "), _text(F.col("event_id") % 5))).otherwise(F.concat(F.lit("discutam "), "event_type")).alias("text"))
    cases = e.select("job", win.alias("window")).distinct().withColumn("no", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    cases = cases.select("job", "window", "no", F.concat(F.lit("Pacient "), _text(F.col("no"))).alias("case_key"), F.lit("t").alias("topic"), F.lit("").alias("summary"), F.lit("none").alias("eta_type"), *[F.lit(None).cast("string").alias(x) for x in ("eta_raw", "eta_condition")])
    third = F.floor(F.col("event_id") / 3)
    rows = lambda where, no, n: e.where(where).select("job", win.alias("window"), no.alias("no"), n.alias("n"), F.col("t").alias("turn_id"))
    decisions = rows("event_id % 3 = 1", third % 3, F.col("t")).unionByName(rows("event_id % 9 = 1", (third + 1) % 3, F.col("t") + 1000))
    known = e.select("job").distinct().select("job", F.lit(0).cast("long").alias("key_no"), F.lit("Pacient 3").alias("case_key"))
    out, _ = M.attributed(cases, decisions, turns, known)
    return out.select("job", F.col("window").alias("win"), "no", "n", "turn_id", "case_key", "moved_from")


# --- cases of a meeting

_DECISION = "md5(job || event_type || event_id % 3)"
_MERGED_SQL = f"""{_BASE_SQL}, r AS (SELECT *, CASE WHEN t % 10 < 2 AND t >= 10 THEN t // 10 - 1 ELSE t // 10 END AS win, {_DECISION} AS decision, CASE WHEN event_id % 2 = 0 THEN 'aprobat' ELSE 'respins' END AS status, event_type = 'purchase' AND event_id % 5 = 0 AS replaces FROM e),
c AS (SELECT *, lead(t) OVER w AS nt, lead(decision) OVER w AS nd FROM r WINDOW w AS (PARTITION BY job, event_type ORDER BY t)),
p AS (SELECT *, row_number() OVER (PARTITION BY job, event_type, status, decision ORDER BY t DESC) AS again FROM c WHERE NOT (nd = decision AND nt - t <= 5) OR nt IS NULL),
f AS (SELECT job, 'Tema: ' || event_type AS case_key, t AS turn_id, decision, status, coalesce(max(replaces::INT) OVER (PARTITION BY job, event_type ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) > 0 AS superseded FROM p WHERE again = 1),
cs AS (SELECT DISTINCT job, event_type, w AS win FROM (SELECT job, event_type, unnest(CASE WHEN t % 10 < 2 AND t >= 10 THEN [t // 10 - 1, t // 10] ELSE [t // 10] END) AS w FROM e)),
h AS (SELECT job, 'Tema: ' || event_type AS case_key, coalesce(max_by('T' || win, win) FILTER (WHERE win % 2 = 0), '') AS topic, max_by('relative', win) FILTER (WHERE win % 4 = 1) AS eta_type, max_by('r' || win, win) FILTER (WHERE win % 4 = 1) AS eta_raw FROM cs GROUP BY job, event_type),
sm AS (SELECT job, 'Tema: ' || event_type AS case_key, string_agg(s, ' ' ORDER BY w) AS summary FROM (SELECT job, event_type, 'S' || (win % 3) AS s, min(win) AS w FROM cs GROUP BY ALL) GROUP BY ALL)
"""


def _meeting(spark, d) -> M.Minutes:
    """events as decisions of cases named by type; a window's last two turns are the next one's context."""
    e = _events(spark, d)
    ten = F.floor(F.col("t") / 10)
    seen = (F.col("t") % 10 < 2) & (F.col("t") >= 10)
    rows = e.withColumn("window", F.explode(F.when(seen, F.array(ten - 1, ten)).otherwise(F.array(ten))))
    rows = rows.withColumn("no", F.dense_rank().over(Window.partitionBy("job", "window").orderBy("event_type")).cast("long"))
    decisions = rows.select("job", "window", "no", F.col("t").alias("n"), F.col("t").alias("turn_id"), F.col("t").cast("double").alias("at"), F.md5(F.concat(_text(F.col("job")), "event_type", _text(F.col("event_id") % 3))).alias("decision"), F.when(F.col("event_id") % 2 == 0, "aprobat").otherwise("respins").alias("status"), F.lit("").alias("quote"), ((F.col("event_type") == "purchase") & (F.col("event_id") % 5 == 0)).alias("replaces"))
    w = F.col("window")
    cases = rows.groupBy("job", "window", "no").agg(F.first("event_type").alias("type")).select("job", "window", "no", F.concat(F.lit("Tema: "), "type").alias("case_key"), F.when(w % 2 == 0, F.concat(F.lit("T"), _text(w))).otherwise("").alias("topic"), F.concat(F.lit("S"), _text(w % 3)).alias("summary"), F.when(w % 4 == 1, "relative").otherwise("none").alias("eta_type"), F.when(w % 4 == 1, F.concat(F.lit("r"), _text(w))).alias("eta_raw"), F.lit(None).cast("string").alias("eta_condition"))
    context = e.where(seen).select("job", ten.alias("window"), F.col("t").alias("turn_id"), F.col("t").cast("double").alias("at"))
    facts = rows.where("event_id % 7 = 0").select("job", "window", "no", F.col("t").alias("n"), F.lit("analize").alias("category"), F.md5(F.concat(F.lit("f"), _text(F.col("event_id") % 4))).alias("fact"), F.col("t").cast("double").alias("at"))
    questions = rows.where("event_id % 11 = 0").select("job", "window", "no", F.col("t").alias("n"), F.md5(F.concat(F.lit("q"), _text(F.col("event_id") % 3))).alias("question"))
    return M.merged(cases, decisions, facts, questions, context)


@query(f"WITH {_MERGED_SQL} SELECT * FROM f")
def merged_minutes(spark, d):
    m = _meeting(spark, d)
    return m.decisions.join(m.cases.select("job", "case_no", "case_key"), ["job", "case_no"]).select("job", "case_key", "turn_id", "decision", "status", "superseded")


@query(f"WITH {_MERGED_SQL} SELECT job, case_key, topic, summary, coalesce(eta_type, 'none') AS eta_type, eta_raw FROM h JOIN sm USING (job, case_key)")
def merged_cases(spark, d):
    return _meeting(spark, d).cases.select("job", "case_key", "topic", "summary", "eta_type", "eta_raw")


@query(f"""WITH {_MERGED_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY job, case_key ORDER BY turn_id DESC) AS k FROM f WHERE NOT superseded)
SELECT h.job, h.case_key, coalesce(decision, '—') AS decision, turn_id::DOUBLE AS "at", eta_type, eta_raw FROM h LEFT JOIN l ON h.job = l.job AND h.case_key = l.case_key AND k = 1 WHERE eta_type IS NOT NULL""")
def deadlines(spark, d):
    m = _meeting(spark, d)
    return A.deadlines(m.cases, m.decisions).select("job", "case_key", "decision", "at", "eta_type", "eta_raw")


@query(f"""WITH {_BASE_SQL}, x AS (SELECT DISTINCT job, event_type, md5('f' || event_id % 4) AS fact, min(t) OVER (PARTITION BY job, event_type, event_id % 4) AS t FROM e WHERE event_id % 7 = 0)
SELECT job, 'Tema: ' || event_type AS case_key, fact, t::DOUBLE AS "at" FROM x""")
def merged_facts(spark, d):
    m = _meeting(spark, d)
    return m.facts.join(m.cases.select("job", "case_no", "case_key"), ["job", "case_no"]).select("job", "case_key", "fact", "at")


@query(f"WITH {_BASE_SQL} SELECT DISTINCT job, 'Tema: ' || event_type AS case_key, md5('q' || event_id % 3) AS question FROM e WHERE event_id % 11 = 0")
def open_questions(spark, d):
    m = _meeting(spark, d)
    return m.questions.join(m.cases.select("job", "case_no", "case_key"), ["job", "case_no"]).select("job", "case_key", "question")


@query(f"""WITH {_BASE_SQL} SELECT job, t, CASE WHEN event_id % 5 = 0 THEN 'quote not found' WHEN event_type = 'error' THEN 'uncertain turn' END AS flag FROM e""")
def review_flags(spark, d):
    e = _events(spark, d)
    turns = e.select("job", F.col("t").alias("id"), (F.col("event_type") == "error").alias("uncertain"))
    return A.review_flags(e.select("job", "t", F.when(F.col("event_id") % 5 > 0, F.col("t")).alias("turn_id")), turns).select("job", "t", "flag")


@query(f"WITH {_BASE_SQL} SELECT job, t // 20 AS win, event_type AS case_key, count(*) AS n FROM e GROUP BY ALL HAVING count(*) >= 3")
def repeated_cases(spark, d):
    return A.repeated_keys(_events(spark, d).select("job", F.floor(F.col("t") / 20).alias("window"), F.col("event_type").alias("case_key"))).select("job", F.col("window").alias("win"), "case_key", "n")
