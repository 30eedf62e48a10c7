"""Sinks: replaced JSON and appended logs through Spark's committers, Markdown and HTML minutes, sheets to check them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# fixed values: sections of the minutes in clinical order, and how a decision's status is called there
SECTIONS = (("Diagnostic și istoric", ("diagnostic", "istoric")), ("Stare clinică", ("evoluție", "monitorizare")), ("Paraclinic", ("analize", "imagistică", "microbiologie")), ("Tratament și proceduri", ("tratament", "procedură")), ("Informații", ("informație",)))
STATUS_NAMES = {"aprobat": "decis", "respins": "respins", "amânat": "amânat", "necesită investigații suplimentare": "după investigații", "în discuție": "propus"}


def write_json(df: DataFrame, path: str) -> None:
    """All of the rows or none: they are written beside `path` and take its place when they are complete, so a failed job leaves what was there."""
    spark = df.sparkSession
    fresh, old = f"{path}.part-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.json(fresh)
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(place(path))
    if had:
        fs.rename(place(path), place(old))
    if not fs.rename(place(fresh), place(path)):
        raise OSError(f"could not put {fresh} in the place of {path}")
    if had:
        fs.delete(place(old), True)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_ledger(df: DataFrame, path: str) -> DataFrame:
    """Appends runs to the ledger and returns all of it."""
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path)


def markdown_table(df: DataFrame) -> DataFrame:
    """(line): header, rule and rows; for tables of a few rows, such as a ledger."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in df.columns]), F.lit(" |"))
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(df.columns) + " |"), (1, "|" + "---|" * len(df.columns))], "n long, line string")
    return head.unionByName(df.select((F.monotonically_increasing_id() + 2).alias("n"), cells.alias("line"))).orderBy("n").select("line")


def html_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _listed(rows: DataFrame, order: str, text: Column, name: str, between: str = "") -> DataFrame:
    """(job, case_no, name): the texts of a case in order."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("k"), text.alias("x"))))
    return rows.groupBy("job", "case_no").agg(F.array_join(F.transform(parts, lambda p: p["x"]), between).alias(name))


def _coded(at: str) -> Column:
    whole = F.floor(F.coalesce(at, F.lit(0.0))).cast("long")
    return F.format_string("[%02d:%02d]", F.floor(whole / 60), whole % 60)


def minutes_html(cases: DataFrame, decisions: DataFrame, facts: DataFrame, questions: DataFrame) -> DataFrame:
    """Tables of `minutes.merged`, decisions with `flag`, to (job, html): of each case its topic and summary, facts by section, decisions
    with their status, those changed later struck out, the deadline under the last that holds, what is doubtful, open questions; doubts again at the end."""
    e = lambda c: html_escaped(F.coalesce(c, F.lit("")))
    join = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    some = lambda c, *x: F.when(F.coalesce(c, F.lit("")) != "", join(*x)).otherwise("")

    section = F.coalesce(*[F.when(F.col("category").isin(*kinds), F.lit(k)) for k, (_, kinds) in enumerate(SECTIONS)])
    told = facts.withColumn("section", section).where("section IS NOT NULL")
    rows = told.groupBy("job", "case_no", "section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", join(e(F.col("fact")), " ", _coded("at")).alias("x")))), lambda p: p["x"]), "<br>").alias("items"))
    name = F.get(F.array(*[F.lit(n) for n, _ in SECTIONS]), F.col("section"))
    told = _listed(rows, "section", join("<tr><th>", name, "</th><td>", F.col("items"), "</td></tr>"), "facts")

    status = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STATUS_NAMES.items() for x in kv]), F.col("status")), F.col("status"))
    last = F.row_number().over(Window.partitionBy("job", "case_no", "superseded").orderBy(F.desc("place")))
    due = F.when((F.col("_last") == 1) & ~F.col("superseded") & ~F.col("eta_type").isin("none", "vague"), join("<div>Termen: ", e(F.col("eta_raw")), some(F.col("eta_condition"), " (", e(F.col("eta_condition")), ")"), "</div>")).otherwise("")
    said = F.when(F.col("superseded"), join("<s>", e(F.col("decision")), "</s>")).otherwise(e(F.col("decision")))
    d = decisions.withColumn("_last", last).join(cases.select("job", "case_no", "eta_type", "eta_raw", "eta_condition"), ["job", "case_no"])
    held = _listed(d, "place", join("<li><em>", e(status), "</em> ", said, " ", _coded("at"), due, some(F.col("quote"), "<q>", e(F.col("quote")), "</q>"), some(F.col("flag"), "<div>⚠ ", e(F.col("flag")), "</div>"), "</li>"), "decisions")
    doubts = _listed(d.where("flag IS NOT NULL"), "place", join("<li>⚠ ", e(F.col("decision")), ": ", e(F.col("flag")), "</li>"), "doubts")
    asked = _listed(questions, "place", join("<li>", e(F.col("question")), "</li>"), "questions")

    whole = cases
    for part in (told, held, asked, doubts):
        whole = whole.join(part, ["job", "case_no"], "left")
    card = join(
        "<section><h2>", (F.col("case_no") + 1).cast("string"), ". ", e(F.col("case_key")), some(F.col("topic"), " — ", e(F.col("topic"))), "</h2>", some(F.col("summary"), "<p>", e(F.col("summary")), "</p>"),
        some(F.col("facts"), "<table>", F.col("facts"), "</table>"), F.when(F.col("decisions").isNotNull(), join("<ul>", F.col("decisions"), "</ul>")).otherwise("<p>Fără decizii noi.</p>"), some(F.col("questions"), "<p>De clarificat:</p><ul>", F.col("questions"), "</ul>"), "</section>",
    )
    parts = F.sort_array(F.collect_list(F.struct("case_no", card.alias("x"), F.coalesce("doubts", F.lit("")).alias("y"))))
    out = whole.groupBy("job").agg(parts.alias("p"))
    both = lambda field: F.array_join(F.transform("p", lambda x: x[field]), "")
    return out.select("job", join('<!doctype html><html lang="ro"><meta charset="utf-8"><h1>Proces-verbal</h1>', both("x"), some(both("y"), "<h2>Note pentru verificare</h2><ul>", both("y"), "</ul>"), "</html>").alias("html"))


def minutes_markdown(cases: DataFrame, decisions: DataFrame, facts: DataFrame, questions: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """The tables of `minutes_html` to (job, markdown), a line an entry; notes(job, n, note), such as `moved_note` and errors of a run, close the page behind
    the doubtful decisions."""
    join = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    some = lambda c, *x: F.when(F.coalesce(c, F.lit("")) != "", join(*x)).otherwise("")
    text = lambda c: F.coalesce(F.regexp_replace(c, "\\s*\\n\\s*", " "), F.lit(""))

    section = F.coalesce(*[F.when(F.col("category").isin(*kinds), F.lit(k)) for k, (_, kinds) in enumerate(SECTIONS)])
    told = facts.withColumn("section", section).where("section IS NOT NULL")
    rows = told.groupBy("job", "case_no", "section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", join("- ", text("fact"), " ", _coded("at"), "\n").alias("x")))), lambda p: p["x"]), "").alias("items"))
    told = _listed(rows, "section", join("**", F.get(F.array(*[F.lit(n) for n, _ in SECTIONS]), F.col("section")), ":**\n", F.col("items"), "\n"), "facts")

    status = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STATUS_NAMES.items() for x in kv]), F.col("status")), F.col("status"))
    last = F.row_number().over(Window.partitionBy("job", "case_no", "superseded").orderBy(F.desc("place")))
    due = F.when((F.col("_last") == 1) & ~F.col("superseded") & ~F.col("eta_type").isin("none", "vague"), some(F.col("eta_raw"), " — termen: ", text("eta_raw"), some(F.col("eta_condition"), " (condiție: ", text("eta_condition"), ")"))).otherwise("")
    said = F.when(F.col("superseded"), join("~~", text("decision"), "~~ (modificată ulterior)")).otherwise(text("decision"))
    d = decisions.withColumn("_last", last).join(cases.select("job", "case_no", "case_key", "eta_type", "eta_raw", "eta_condition"), ["job", "case_no"])
    held = _listed(d, "place", join("- **", status, "**: ", said, due, " ", _coded("at"), some(F.col("flag"), " ⚠"), "\n", some(F.col("quote"), "  - _sursa: „", text("quote"), "”_\n")), "decisions")
    doubts = _listed(d.where("flag IS NOT NULL"), "place", join("- ⚠ Punctul ", (F.col("case_no") + 1).cast("string"), " (", text("case_key"), "), decizia ", _coded("at"), ": ", text("flag"), ".\n"), "doubts")
    asked = _listed(questions, "place", join("- ", text("question"), "\n"), "questions")

    whole = cases
    for part in (told, held, asked, doubts):
        whole = whole.join(part, ["job", "case_no"], "left")
    card = join(
        "### ", (F.col("case_no") + 1).cast("string"), ". ", text("case_key"), some(F.col("topic"), " — ", text("topic")), "\n\n", some(F.col("summary"), "_", text("summary"), "_\n\n"), F.coalesce("facts", F.lit("")),
        "**Plan / decizii:**\n", F.coalesce("decisions", F.lit("- fără decizii noi\n")), some(F.col("questions"), "\n**În așteptare / de clarificat:**\n", F.col("questions")), "\n",
    )
    parts = F.sort_array(F.collect_list(F.struct("case_no", card.alias("x"), F.coalesce("doubts", F.lit("")).alias("y"))))
    out = whole.groupBy("job").agg(parts.alias("p"))
    if notes is not None:
        listed = F.sort_array(F.collect_list(F.struct("n", join("- ⚠ ", text("note"), "\n").alias("x"))))
        out = out.join(notes.groupBy("job").agg(F.array_join(F.transform(listed, lambda x: x["x"]), "").alias("_notes")), "job", "left")
    else:
        out = out.withColumn("_notes", F.lit(""))
    both = lambda field: F.array_join(F.transform("p", lambda x: x[field]), "")
    return out.select("job", join("# Proces-verbal al ședinței\n\n## Puncte discutate\n\n", both("x"), "## Note pentru verificare\n\n", both("y"), F.coalesce("_notes", F.lit(""))).alias("markdown"))


def moved_note(decisions: DataFrame) -> DataFrame:
    """(job, n, note): how many decisions of `minutes.attributed` went to another case; a job without any has no row."""
    moved = decisions.where("moved_from IS NOT NULL").groupBy("job").agg(F.count("*").alias("k"))
    said = F.when(F.col("k") == 1, "1 decizie a fost mutată").otherwise(F.concat(F.col("k").cast("string"), F.lit(" decizii au fost mutate")))
    return moved.select("job", F.lit(0).alias("n"), F.concat(said, F.lit(" automat la pacientul discutat în acel moment.")).alias("note"))


def verification_sheet(cases: DataFrame, decisions: DataFrame, turns: DataFrame) -> DataFrame:
    """(job, sheet): each case and decision with boxes to tick, its quote, and the line that was recognised there: of turns(job, id, start, line)
    the decision's own, or else the one that begins nearest to its time."""
    from scriven.operators import intervals as I

    loose = decisions.where("turn_id IS NULL AND at IS NOT NULL").select("job", F.xxhash64("case_no", "place").alias("ref"), "at").distinct()
    near = I.nearest(loose, turns.select("job", F.col("id").alias("near_id"), F.col("start").cast("double").alias("start")), ["job"], "at", "ref", "start", "near_id")
    d = decisions.withColumn("ref", F.xxhash64("case_no", "place")).join(near.select("job", "ref", "near_id"), ["job", "ref"], "left").withColumn("turn", F.coalesce("turn_id", "near_id"))
    d = d.join(turns.select("job", F.col("id").alias("turn"), "line"), ["job", "turn"], "left")
    text = F.concat(F.lit("\n- "), "decision", F.when(F.col("superseded"), " (înlocuită)").otherwise(""), F.lit(": "), "status", F.lit("\n  „"), F.coalesce("quote", F.lit("")), F.lit("” "), _coded("at"), F.lit("\n  `"), F.coalesce("line", F.lit("—")), F.lit("`\n  [ ] luată  [ ] status corect  [ ] caz corect  [ ] inventată"))
    held = _listed(d, "place", text, "decisions")
    head = F.concat(F.lit("## "), (F.col("case_no") + 1).cast("string"), F.lit(". "), "case_key", F.lit("\n[ ] caz identificat corect"), F.coalesce("decisions", F.lit("")))
    whole = cases.join(held, ["job", "case_no"], "left").select("job", "case_no", head.alias("x"))
    return whole.groupBy("job").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("case_no", "x"))), lambda p: p["x"]), "\n\n").alias("sheet"))
