"""Raw model answers as tables: types, closed words, quotes and clauses put right; what cannot be is dropped or blanked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriven.functions import text as T
from scriven.functions.repairs import fix_bed_numbers, fix_weekday, strip_unspoken_units

from . import intervals as I
from . import minutes as M

# fixed values: how a clause begins that tells what was not said
UNSAID = "(?iU)^\\W*nu s-(?:a|au)\\s+(?:discutat|menționat|vorbit|spus)\\b"
TIME_CODE = "\\[\\d+:\\d{2}(?::\\d{2})?\\]"


def _said(v: Column, path: str) -> Column:
    """A text of the answer, trimmed; empty where there is none or something else."""
    found = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.trim(F.try_variant_get(v, path, "string"))).otherwise(F.lit(""))


def _code(v: Column, path: str) -> Column:
    return T.time_seconds(_said(v, path))


def _items(df: DataFrame, keys: list[str], v: Column, path: str, place: str) -> DataFrame:
    """One row for each object of a list; another type in its place is no list."""
    listed = df.select(*keys, F.posexplode(F.try_variant_get(v, path, "array<variant>")).alias(place, "_v"))
    return listed.where(F.schema_of_variant("_v").startswith("OBJECT")).withColumn(place, F.col(place).cast("long"))


_KEYS = ["job", "window", "no"]


def _parsed(answers: DataFrame) -> dict[str, DataFrame]:
    """The tables of raw answers with each repaired field beside what was said, as `_said_<field>`; empty rows are still there."""
    raw = answers.select("job", "window", F.try_parse_json("answer").alias("_a"))
    c = _items(raw, ["job", "window"], F.col("_a"), "$.cases", "no")
    v = F.col("_v")
    named = F.when(_said(v, "$.case_key") != "", _said(v, "$.case_key")).otherwise(_said(v, "$.topic"))
    c = c.withColumn("_said_case_key", named).withColumn("case_key", fix_bed_numbers(named))
    said_type, eta_raw, condition = (_said(v, f"$.eta.{x}") for x in ("type", "raw", "condition"))
    some = lambda x: F.when(x != "", x)
    c = c.withColumn("_said_eta_type", some(said_type)).withColumn("eta_type", F.coalesce(M.repaired(said_type, M.ETA_TYPES, None), F.when(eta_raw != "", "vague").otherwise("none")))
    c = c.withColumn("_said_eta_raw", some(eta_raw)).withColumn("eta_raw", F.when(F.col("eta_type") != "none", some(eta_raw)))
    c = c.withColumn("_said_eta_condition", some(condition)).withColumn("eta_condition", F.when(F.col("eta_type") == "conditional", some(condition)))
    c = c.withColumn("_said_summary", _said(v, "$.discussion_summary")).withColumn("summary", T.split_ranges(F.col("_said_summary"))).withColumn("topic", _said(v, "$.topic"))
    full = c.where("case_key != ''")
    d = _items(full, _KEYS, v, "$.decisions", "n")
    d = d.select(*_KEYS, "n", _code(v, "$.timestamp").alias("at"), _said(v, "$.decision").alias("_said_decision"), _said(v, "$.quote").alias("_said_quote"), _said(v, "$.status").alias("_said_status"), F.coalesce(F.try_variant_get(v, "$.replaces_previous", "boolean"), F.lit(False)).alias("replaces"))
    d = d.withColumn("quote", T.clean_quote(F.col("_said_quote"))).withColumn("status", M.repaired(F.col("_said_status"), M.STATUSES, M.DEFAULT_STATUS))
    d = d.withColumn("decision", fix_weekday(F.col("_said_decision"), F.col("quote")))
    f = _items(full, _KEYS, v, "$.facts", "n").select(*_KEYS, "n", _said(v, "$.fact").alias("_said_fact"), _said(v, "$.category").alias("_said_category"), _code(v, "$.timestamp").alias("at"))
    f = f.withColumn("fact", T.split_ranges(F.col("_said_fact"))).withColumn("category", M.repaired(F.col("_said_category"), M.FACT_CATEGORIES, M.DEFAULT_CATEGORY))
    q = full.select(*_KEYS, F.posexplode(F.try_variant_get(v, "$.open_questions", "array<variant>")).alias("n", "_v")).select(*_KEYS, F.col("n").cast("long").alias("n"), _said(v, "$").alias("_said_question")).withColumn("question", T.split_ranges(F.col("_said_question")))
    return {"case": c, "decision": d, "fact": f, "question": q}


def sanitized(answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """answers(job, window, answer: JSON text) to cases, decisions, facts and questions as in `minutes`.

    A case without key and topic goes, as do empty decisions, facts and questions; statuses, deadline types and categories are words
    of their lists; quotes lose codes and labels; a weekday that the quote names otherwise is the quote's. `fixed` tells
    whether a decision's status or quote was changed; `fix_log` has all changes. An answer that is not JSON has no rows. `at` is the time code in seconds.
    """
    t = _parsed(answers)
    cases = t["case"].where("case_key != ''").select(*_KEYS, "case_key", "topic", "summary", "eta_type", "eta_raw", "eta_condition")
    fixed = (F.col("status") != F.col("_said_status")) | (F.col("quote") != F.col("_said_quote"))
    decisions = t["decision"].where("_said_decision != '' or quote != ''").select(*_KEYS, "n", "at", "decision", "status", "quote", "replaces", fixed.alias("fixed"))
    facts = t["fact"].where("fact != ''").select(*_KEYS, "n", "category", "fact", "at")
    return cases, decisions, facts, t["question"].where("question != ''").select(*_KEYS, "n", "question")


def fix_log(answers: DataFrame) -> DataFrame:
    """What `sanitized` changes: (job, window, no, n, field, said, now), a row each; n is null for a case.

    A row that goes because nothing stands in it is logged under its kind with null as what it is now; then its fields are not. A field
    that only loses the space around it is unchanged.
    """
    t, c = _parsed(answers), F.col
    fields = {"case": ["case_key", "eta_type", "eta_raw", "eta_condition", "summary"], "decision": ["quote", "status", "decision"], "fact": ["category", "fact"], "question": ["question"]}
    gone = {"case": c("case_key") == "", "decision": (c("_said_decision") == "") & (c("quote") == ""), "fact": c("fact") == "", "question": c("question") == ""}
    out = None
    for kind, names in fields.items():
        text = lambda x: F.coalesce(c(x), F.lit(""))
        changes = F.filter(F.array(*[F.struct(F.lit(x).alias("field"), c(f"_said_{x}").alias("said"), c(x).alias("now"), (text(f"_said_{x}") != text(x)).alias("differs")) for x in names]), lambda x: x.differs)
        empty = F.array(F.struct(F.lit(kind).alias("field"), F.lit("").alias("said"), F.lit(None).cast("string").alias("now"), F.lit(True).alias("differs")))
        n = F.lit(None).cast("long").alias("n") if kind == "case" else c("n")
        rows = t[kind].select(*_KEYS, n, F.explode(F.when(gone[kind], empty).otherwise(changes)).alias("x")).select(*_KEYS, "n", "x.field", "x.said", "x.now")
        out = rows if out is None else out.unionByName(rows)
    return out


def deadline_log(cases: DataFrame, checked: DataFrame) -> DataFrame:
    """What `minutes.checked_deadlines` changed of cases: (job, window, no, event, said, now), the deadline's words and its type a row each."""
    was = cases.select(*_KEYS, F.col("eta_raw").alias("_raw"), F.col("eta_type").alias("_type"))
    both = checked.join(was, _KEYS)
    events = F.array(
        F.struct(F.col("eta_event").alias("event"), F.col("_raw").alias("said"), F.col("eta_raw").alias("now")),
        F.struct(F.when(~F.col("eta_type").eqNullSafe(F.col("_type")), "type").alias("event"), F.col("_type").alias("said"), F.col("eta_type").alias("now")),
    )
    return both.select(*_KEYS, F.explode(F.filter(events, lambda x: x.event.isNotNull())).alias("x")).select(*_KEYS, "x.event", "x.said", "x.now")


def fixed_clauses(texts: DataFrame, lines: DataFrame) -> DataFrame:
    """texts(job, id, text) with each clause, up to the time code that ends it, repaired by what was said then.

    lines(job, start, line): the clause's line is the last one that begins up to a second after its time, or the first, and the one
    after it. Clauses on what was not said go with their codes; what follows the last code stays as it is.
    """
    t = F.coalesce("text", F.lit(""))
    grouped = lambda g: F.regexp_extract_all(t, F.lit(f"(?s)(.*?)({TIME_CODE})"), F.lit(g))
    whole = texts.select("job", "id", "text", F.arrays_zip(grouped(1).alias("clause"), grouped(2).alias("code")).alias("_parts"), F.regexp_replace(t, f"(?s)^.*{TIME_CODE}", "").alias("_rest"))
    parts = whole.select("job", "id", F.posexplode("_parts").alias("_k", "_p")).select("job", "id", "_k", "_p.clause", "_p.code", T.time_seconds(F.col("_p.code")).cast("double").alias("_at"))
    found = I.as_of(parts, lines.select("job", F.col("start").cast("double").alias("start"), "line"), ["job"], "_at", "start", "line", slack=1, or_first=True)
    heard = F.concat_ws(" ", "line", "next_line")
    clause = strip_unspoken_units(fix_weekday(fix_bed_numbers(F.col("clause")), heard), heard)
    kept = found.withColumn("_out", F.when(F.col("clause").rlike(UNSAID), "").otherwise(F.concat(clause, F.col("code"))))
    joined = kept.groupBy("job", "id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_out"))), lambda x: x["_out"]), "").alias("_head"))
    return whole.join(joined, ["job", "id"], "left").select("job", "id", F.when(F.col("text").isNotNull(), F.concat(F.coalesce("_head", F.lit("")), F.when(F.col("_head").isNull(), t).otherwise(F.col("_rest")))).alias("text"))


def deadlines(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """Of each case with a deadline: its number, key, last decision that holds, and when; cases and decisions as `minutes.merged` gives them."""
    last = F.row_number().over(Window.partitionBy("job", "case_no").orderBy(F.desc("place")))
    active = decisions.where(~F.col("superseded")).withColumn("_k", last).where("_k = 1").select("job", "case_no", "decision", "at")
    return cases.where("eta_type != 'none'").join(active, ["job", "case_no"], "left").select("job", "case_no", "case_key", F.coalesce("decision", F.lit("—")).alias("decision"), "at", "eta_type", "eta_raw", "eta_condition")


def review_flags(decisions: DataFrame, turns: DataFrame) -> DataFrame:
    """decisions(job, turn_id, ..) with `flag`: quote not found, or said in an uncertain turn(job, id, uncertain); null where nothing is doubtful."""
    t = turns.select("job", F.col("id").alias("turn_id"), "uncertain")
    out = decisions.join(t, ["job", "turn_id"], "left")
    return out.withColumn("flag", F.when(F.col("turn_id").isNull(), "quote not found").when(F.col("uncertain"), "uncertain turn")).drop("uncertain")


def repeated_keys(cases: DataFrame, times: int = 3) -> DataFrame:
    """Case keys that stand `times` or more often in one response: a model in a loop."""
    return cases.groupBy("job", "window", "case_key").agg(F.count("*").alias("n")).where(F.col("n") >= times)


# fixed values: letters that a Romanian text does not have
CYRILLIC = "[Ѐ-ӿ]+(?:[\\s-]+[Ѐ-ӿ]+)*"


def foreign_fields(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, field and the first three Cyrillic stretches of each field that must be Romanian and has some."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("x")
    found = rows.select(*keys, pairs).select(*keys, "x.field", F.regexp_extract_all(F.coalesce("x.text", F.lit("")), F.lit(CYRILLIC), F.lit(0)).alias("hits"))
    return found.where(F.size("hits") > 0).withColumn("hits", F.slice("hits", 1, 3))


def problems(cases: DataFrame, decisions: DataFrame, lines: DataFrame) -> DataFrame:
    """(job, window, no, problem): where a response breaks its own rules: a status, deadline type outside the lists, a quote or deadline that is
    in no line(job, window, id, text) of the window, a condition on an unconditional deadline, a case given twice."""
    said = lines.groupBy("job", "window").agg(T.quote_norm(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), " ")).alias("_said"))
    there = lambda c: F.coalesce("_said", F.lit("")).contains(T.quote_norm(F.col(c)))
    wrong = lambda *pairs: F.explode(F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in pairs])))
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    d = decisions.join(said, ["job", "window"], "left").select("job", "window", "no", wrong((~F.coalesce("status", F.lit("")).isin(*M.STATUSES), "status"), (~filled("quote") | ~there("quote"), "quote")).alias("problem"))
    twice = F.count("*").over(Window.partitionBy("job", "window", "case_key"))
    c = cases.withColumn("_n", twice).join(said, ["job", "window"], "left")
    c = c.select("job", "window", "no", wrong((~F.coalesce("eta_type", F.lit("")).isin(*M.ETA_TYPES), "deadline type"), (filled("eta_raw") & ~there("eta_raw"), "deadline"), (filled("eta_condition") & (F.col("eta_type") != "conditional"), "condition"), (F.col("_n") > 1, "case given twice")).alias("problem"))
    return d.unionByName(c)
