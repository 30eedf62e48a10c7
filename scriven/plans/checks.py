"""Queries of guards and evaluations: setups, contexts, matched terms, broken responses. Their texts are those of the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriven.functions import repairs as R
from scriven.functions import text as T
from scriven.operators import answers as A
from scriven.operators import evaluation as E

from .base import query, said, said_sql, table, turns

_NORM = "trim(regexp_replace(translate(lower(nfc_normalize({})), 'şţ', 'șț'), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', ' ', 'g'))"


@query("SELECT user_id AS job, event_id AS id, 'setup ' || user_id % 3 AS setup FROM events")
def one_setup(spark, d):
    """Events as records of runs; each job has one setup, which the operator guards."""
    e = table(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("id"), F.concat(F.lit("setup "), (F.col("user_id") % 3).cast("string")).alias("setup"))
    return E.single_setup(e, ["job"])


_CODES = [("the", "[00:12]"), ("die", "[1:02]"), ("la", "[0:01:40]"), ("of", "[59:59]"), ("de", "[00:70]")]


@query(f"""WITH s AS (SELECT conv_id, turn, {said_sql("text", _CODES)} AS t FROM conversations), c AS (SELECT *, regexp_extract_all(t, '\\[(\\d+:\\d{{2}}(?::\\d{{2}})?)\\]', 1) AS codes FROM s)
SELECT conv_id, turn, len(codes) > 0 AND len(list_filter(codes, lambda c: list_reduce(list_transform(string_split(c, ':'), lambda x: x::BIGINT), lambda a, b: a * 60 + b) > turn * 20)) = 0 AS seen FROM c""")
def context_only_summaries(spark, d):
    """Whether all time codes of a turn lie before twenty seconds a turn."""
    t = turns(spark, d).select("conv_id", "turn", said(F.col("text"), _CODES).alias("t"))
    return t.select("conv_id", "turn", R.context_only(F.col("t"), F.col("turn") * 20).alias("seen"))


_TERMS = ["the", "of", "and", "to", "die", "der", "la", "que"]


@query(f"""WITH RECURSIVE w AS (
  SELECT conv_id AS job, role, turn, unnest(range(len(n))) AS i, unnest(n) AS concept FROM (SELECT conv_id, role, turn, regexp_extract_all(translate(lower(nfc_normalize(coalesce(text, ''))), 'şţё', 'șțе'), '[\\p{{L}}\\p{{M}}\\p{{N}}]+') AS n FROM conversations)
), t AS (SELECT job, role, concept, (turn // 2 * 40 + i * 0.5)::DOUBLE AS "at" FROM w WHERE concept IN ({", ".join(f"'{x}'" for x in _TERMS)})
), gold AS (SELECT job, concept, "at", row_number() OVER (PARTITION BY job, concept ORDER BY "at") AS k FROM t WHERE role = 'user'
), found AS (SELECT job, concept, list("at" ORDER BY "at") AS free FROM t WHERE role = 'assistant' GROUP BY ALL
), walk(job, concept, k, "at", hit, free) AS (
  SELECT g.job, g.concept, 0::BIGINT, 0.0::DOUBLE, NULL::DOUBLE, coalesce(f.free, []::DOUBLE[]) FROM (SELECT DISTINCT job, concept FROM gold) g LEFT JOIN found f USING (job, concept)
  UNION ALL SELECT job, concept, k, "at", hit, CASE WHEN hit IS NULL THEN free ELSE free[1:list_position(free, hit) - 1] || free[list_position(free, hit) + 1:] END
  FROM (SELECT w.job, w.concept, g.k, g."at", list_filter(w.free, lambda x: abs(x - g."at") <= 2)[1] AS hit, w.free FROM walk w JOIN gold g ON g.job = w.job AND g.concept = w.concept AND g.k = w.k + 1)
)
SELECT job, concept, 'latn' AS script, "at", hit FROM walk WHERE k > 0""")
def matched_terms(spark, d):
    """Frequent words that a user says, each with the first word of the assistant's that is the same and said within two seconds of it."""
    c = F.col
    w = turns(spark, d).select(c("conv_id").alias("job"), "role", "turn", F.posexplode(T.norm_text(F.coalesce("text", F.lit("")))).alias("i", "concept")).where(c("concept").isin(*_TERMS))
    t = w.select("job", "role", "concept", F.lit("latn").alias("script"), (F.floor(c("turn") / 2) * 40 + c("i") * 0.5).cast("double").alias("at"))
    return E.matched_terms(t.where("role = 'user'").drop("role"), t.where("role = 'assistant'").drop("role"))


_STATES = ["aprobat", "respins", "sigur", "amânat"]
_KINDS = ["absolute", "none", "cândva", "conditional"]


@query(f"""WITH t AS (SELECT conv_id AS job, turn, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0d]+') AS w FROM conversations
), l AS (SELECT job, turn // 2 AS win, {_NORM.format("string_agg(text, ' ' ORDER BY turn)")} AS said FROM t GROUP BY ALL
), r AS (SELECT job, turn // 2 AS win, turn % 2 AS "no", turn, CASE WHEN turn % 3 = 0 THEN 'altceva ' ELSE '' END || array_to_string(w[1:4], ' ') AS quote, array_to_string(w[3:4], ' ') AS raw, 'Caz ' || (turn // 2 % 2 * (turn % 2)) AS case_key FROM t
), j AS (SELECT r.*, said, ({_STATES!r})[turn % 4 + 1] AS status, ({_KINDS!r})[(turn + job) % 4 + 1] AS kind, CASE WHEN turn % 4 = 2 THEN 'dacă' END AS condition, count(*) OVER (PARTITION BY job, win, case_key) AS n FROM r JOIN l USING (job, win)
), p AS (
  SELECT job, win, "no", unnest([CASE WHEN status = 'sigur' THEN 'status' END, CASE WHEN quote = '' OR NOT contains(said, {_NORM.format("quote")}) THEN 'quote' END,
    CASE WHEN kind = 'cândva' THEN 'deadline type' END, CASE WHEN raw <> '' AND NOT contains(said, {_NORM.format("raw")}) THEN 'deadline' END, CASE WHEN condition IS NOT NULL AND kind <> 'conditional' THEN 'condition' END, CASE WHEN n > 1 THEN 'case given twice' END]) AS problem FROM j)
SELECT * FROM p WHERE problem IS NOT NULL""")
def broken_responses(spark, d):
    """Each turn as a case with a decision, two to a window: words that are not in the lists or not in the window, conditions, cases given twice."""
    c = F.col
    t = turns(spark, d).select(c("conv_id").alias("job"), "turn", F.coalesce("text", F.lit("")).alias("text"), F.floor(c("turn") / 2).alias("window"), (c("turn") % 2).alias("no"))
    words = lambda text, lo, n: F.array_join(F.slice(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), lo, n), " ")
    pick = lambda names, k: F.get(F.array(*map(F.lit, names)), k.cast("int"))
    decisions = t.select("job", "window", "no", pick(_STATES, c("turn") % 4).alias("status"), F.concat(F.when(c("turn") % 3 == 0, "altceva ").otherwise(""), words("text", 1, 4)).alias("quote"))
    key = F.concat(F.lit("Caz "), (F.floor(c("turn") / 2) % 2 * (c("turn") % 2)).cast("string"))
    cases = t.select("job", "window", "no", key.alias("case_key"), pick(_KINDS, (c("turn") + c("job")) % 4).alias("eta_type"), words("text", 3, 2).alias("eta_raw"), F.when(c("turn") % 4 == 2, "dacă").alias("eta_condition"))
    return A.problems(cases, decisions, t.select("job", "window", c("turn").alias("id"), "text")).select("job", c("window").alias("win"), "no", "problem")
