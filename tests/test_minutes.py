import json

"""Minutes: hand-worked meetings, and the rules on cases and decisions against a plain reading of them."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from scriven.operators import answers as A
from scriven.operators import minutes as M
from scriven.plans.registry import ORACLES, QUERIES

CASES = "job long, window long, no long, case_key string, topic string, summary string, eta_type string, eta_raw string, eta_condition string"
DECISIONS = "job long, window long, no long, n long, turn_id long, at double, decision string, status string, quote string, replaces boolean"
FACTS, QUESTIONS = "job long, window long, no long, n long, category string, fact string, at double", "job long, window long, no long, n long, question string"
TURNS, CONTEXT = "job long, id long, start double, text string", "job long, window long, turn_id long, at double"


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def table(spark, rows, schema):
    return spark.createDataFrame([(1, *r) for r in rows], schema)


def case(window, no, key, topic="", summary="", eta=("none", None, None)):
    return (window, no, key, topic, summary, *eta)


def said(window, no, n, turn, text, at=None, status="aprobat", quote="", replaces=False):
    return (window, no, n, turn, float(turn if at is None else at) if turn is not None or at is not None else None, text, status, quote, replaces)


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_quotes(spark):
    turns = spark.createDataFrame([(1, 0, 0, 5, "Pacientul 21 are tuse seacă"), (1, 0, 1, 9, "Mergem pe amoxicilina trei zile"), (1, 0, 2, 14, "da"), (1, 0, 3, 20, None)], "job long, window long, id long, seconds long, text string")
    asked = [(0, "mergem pe amoxicilina 3 zile", 9), (1, "altceva cu totul diferit de ele", None), (2, "da", 14), (3, "da", None), (4, "", 5), (5, "AMOXICILINA trei", None), (6, None, None)]
    quotes = spark.createDataFrame([(1, 0, *q) for q in asked] + [(2, 0, 9, "orice text fără replici", None)], "job long, window long, q_id long, quote string, at long")
    got = {r.q_id: r for r in M.resolved_quotes(quotes, turns).collect()}
    assert {k: r.turn_id for k, r in got.items()} == {0: 1, 1: None, 2: 2, 3: None, 4: None, 5: 1, 6: None, 9: None}
    assert got[0].ts_match and got[0].score > 80 and got[5].score == 100 and got[4].score == 0 and not got[4].ts_match


def test_quotes_word_for_word_are_not_compared(spark, monkeypatch):
    def compared(*_):
        raise AssertionError("compared")

    monkeypatch.setattr(M, "partial_ratio", compared)
    monkeypatch.setattr(M, "ratio", compared)
    texts = ["pacientul 21 are tuse", "pacientul 21 are tuse seacă", "mergem pe amoxicilina trei zile", "Mergem pe amoxicilina trei zile."]
    turns = spark.createDataFrame([(1, 0, i, None, t) for i, t in enumerate(texts)], "job long, window long, id long, seconds long, text string")
    quotes = spark.createDataFrame([(1, 0, i, t, None) for i, t in enumerate(texts)], "job long, window long, q_id long, quote string, at long")
    # the first turn stands in the second one, and is the earlier of equals
    assert {r.q_id: (r.turn_id, r.score) for r in M.resolved_quotes(quotes, turns).collect()} == {0: (0, 100), 1: (0, 100), 2: (2, 100), 3: (2, 100)}


def test_quotes_against_all_turns(spark):
    rng = random.Random(4)
    said = [" ".join(rng.choices("ana are mere și pere verzi".split(), k=rng.randint(0, 6))) for _ in range(40)]
    times = [rng.choice((None, 1, 2)) for _ in said]
    turns = spark.createDataFrame([(1, 0, i, s, t) for i, (s, t) in enumerate(zip(times, said))], "job long, window long, id long, seconds long, text string")
    asked = [(i, said[rng.randrange(40)][rng.randint(0, 5) :].strip(), rng.choice((None, 1, 2))) for i in range(60)]
    quotes = spark.createDataFrame([(1, 0, *q) for q in asked], "job long, window long, q_id long, quote string, at long")
    got = {r.q_id: r for r in M.resolved_quotes(quotes, turns).collect()}
    for i, q, at in asked:
        rows = []
        for k, (t, s) in enumerate(zip(said, times)):
            same, score = at is not None and at == s, (M.ratio if len(q) > 1.3 * len(t) else M.partial_ratio)(q, t)
            if q and (same and score >= 90 if len(q) < 12 else score >= 80 or same and score >= 65):
                rows.append((-score - 10 * same, k, score, same))
        assert (got[i].turn_id, *((got[i].score, got[i].ts_match) if rows else ())) == (min(rows)[1:] if rows else (None,)), q


def test_subjects(spark):
    subject = lambda t: one(spark, M.subject(F.lit(t)))
    assert subject("Pacient 71 de ani, salonul 3") == ([], ["3"]) and subject("пациентка 45, палата № 2") == (["45"], ["2"])
    relation = lambda a, b: one(spark, M.relation(M.subject(F.lit(a)), M.subject(F.lit(b))))
    assert [relation(*x) for x in (("pacient 21", "pacientul 22"), ("pacient 21", "pacientul 21, salon 9"), ("salon 3", "pacientul 21"), ("salon 3", "pacientul 3"), ("x", "pacient 1"))] == ["mismatch", "match", "mismatch", "unknown", "unknown"]
    turns = table(spark, [(i, float(i), "Pacientul 4" if i == 0 else "bine") for i in range(30)], TURNS)
    named = {r.id: r.subject.patients for r in M.with_subject(turns).collect()}
    assert named[24] == ["4"] and named[25] == []


def test_attribution(spark):
    turns = table(spark, [(0, 0.0, "Pacientul 30 e stabil"), (1, 1.0, "externare, mâine"), (2, 2.0, "Pacientul 21"), (3, 3.0, "control"), (4, 4.0, "pacientul 50"), (5, 5.0, "pacientul 77 acasă")], TURNS)
    cases = table(spark, [case(0, 0, "Pacient 21", "t", eta=("relative", "mâine", None)), case(0, 1, "Pacient 30", "u"), case(0, 2, "Gol")], CASES)
    decisions = table(spark, [said(0, 0, 0, 1, "externare"), said(0, 0, 1, 3, "control"), said(0, 0, 2, 4, "mutare"), said(0, 1, 0, 3, "control"), said(0, 1, 1, 5, "acasă"), said(0, 0, 3, None, "fără replică")], DECISIONS)
    known = table(spark, [(0, "Pacient 9"), (1, "Pacient 50, ATI")], "job long, key_no long, case_key string")
    got, left = M.attributed(cases, decisions, turns, known)
    assert sorted((r.no, r.n, r.case_key, r.moved_from) for r in got.collect()) == [(0, 1, "Pacient 21", None), (0, 3, "Pacient 21", None), (1, 0, "Pacient 30", "Pacient 21"), (1, 1, "Pacient 30", None), (10_001, 2, "Pacient 50, ATI", "Pacient 21")]
    assert {r.case_key: (r.eta_type, r.eta_raw) for r in left.collect()} == {"Pacient 21": ("none", None), "Pacient 30": ("relative", "mâine"), "Pacient 50, ATI": ("none", None)}


def test_deadlines_against_the_lines(spark):
    cases = table(spark, [case(0, i, f"c{i}", eta=e) for i, e in enumerate([("absolute", "mâine dimineață", None), ("vague", "peste un an", None), ("duration", "luna", None), ("conditional", "daca creste febra", "febră"), ("none", None, None)])], CASES)
    lines = table(spark, [(0, 0, "Mâine dimineață, la opt"), (0, 1, "vine la fiecare luna"), (0, 2, "Dacă crește febra, sunați")], "job long, window long, id long, text string")
    got = {r.no: (r.eta_type, r.eta_raw, r.eta_event) for r in M.checked_deadlines(cases, table(spark, [said(0, 3, 0, 2, "x")], DECISIONS), lines).collect()}
    assert got == {0: ("relative", "mâine dimineață", None), 1: ("vague", None, "not in transcript"), 2: ("recurring", "la fiecare luna", "extended"), 3: ("conditional", "Dacă crește febra", "realigned"), 4: ("none", None, None)}


def key_of(spark, *said):
    rows = spark.createDataFrame([(k,) for k in said], "k string").select(M.key_features(F.col("k")).alias("f")).collect()
    return [M.Key(r.f.said, r.f.plain, frozenset(r.f.places), frozenset(r.f.digits), r.f.person, r.f.topic) for r in rows]


def test_key_scores(spark):
    a, b, c, d, e, f, g = key_of(spark, "Pacient 48", "Pacient 84", "Pacienta 45, patul 8", "Pacienta din patul 8", "Logistică: orar cantină", "Dotări: orarul cantinei", "pacient  48!")
    assert M.key_score(a, b) == 0 and M.key_score(c, d) == 100 and M.key_score(e, f) >= 90 and M.key_score(a, g) == 100 and 0 < M.key_score(a, e) < 60


def test_cases_of_a_meeting(spark):
    cases = [case(0, 0, "Pacient 48", "a", "S1 [0:01]"), case(1, 0, "Pacient 48, cardio", "", "S2", ("absolute", "2 mai", None)), case(1, 1, "Pacient 7", "p", "vezi [0:02]"), case(1, 2, "Pacient 8", "q", "vezi [0:30]"), case(2, 0, "pacient 48", "c", "S1 [0:01]")]
    decisions = [said(0, 0, 0, 1, "programare pe 2 mai"), said(0, 0, 1, 3, "programare pe 2 mai, da"), said(1, 0, 0, 3, "programarea"), said(1, 0, 1, 9, "amânăm programarea", replaces=True), said(1, 1, 0, 3, "programare"), said(2, 0, 0, None, "amânăm programarea", at=50)]
    facts = [(0, 0, 0, "analize", "fără febră", 4.0), (1, 0, 0, "analize", "febră", 3.0), (2, 0, 0, "istoric", "fără febră acum", 2.0), (1, 0, 1, "tratament", "amânăm programarea", 1.0)]
    questions = [(0, 0, 0, "Cine semnează?"), (2, 0, 0, "cine semneaza"), (2, 0, 1, "Când?")]
    got = M.merged(table(spark, cases, CASES), table(spark, decisions, DECISIONS), table(spark, facts, FACTS), table(spark, questions, QUESTIONS), table(spark, [(1, 3, 3.0)], CONTEXT))
    heads = {r.case_no: r for r in got.cases.collect()}
    assert [heads[k].case_key for k in sorted(heads)] == ["Pacient 48", "Pacient 8"]
    assert (heads[0].topic, heads[0].summary, heads[0].eta_type, heads[0].eta_raw) == ("c", "S1 [0:01] S2", "absolute", "2 mai")
    assert [(r.turn_id, r.superseded) for r in got.decisions.orderBy("case_no", "place").collect()] == [(3, True), (9, False)]
    assert [(r.fact, r.category) for r in got.facts.orderBy("place").collect()] == [("fără febră acum", "istoric"), ("febră", "analize")]
    assert [r.question for r in got.questions.orderBy("place").collect()] == ["Cine semnează?", "Când?"]
    model = table(spark, [(0, [0, 1])], "job long, case_no long, places array<int>")
    assert [r.superseded for r in M.superseded_by_model(got.decisions, model).orderBy("place").collect()] == [True, False]


def test_a_model_is_asked_about_keys_in_between(spark):
    rows = [case(0, 0, "orar cantină parter"), case(1, 0, "cantina parterului"), case(2, 0, "altă temă")]
    for same, want in ((None, [0, 1, 2]), (True, [0, 0, 1])):
        model = M.ScriptedModel({frozenset(("cantina parterului", "orar cantină parter")): same} if same else {})
        assert [r.case_no for r in M.clustered(table(spark, rows, CASES), model).orderBy("window").collect()] == want


def plain_restated(rows):
    """Identical texts only: (turn, at, text, status) in order to the places that stay."""
    rows = sorted(rows, key=lambda r: r[1])
    first = [r for i, r in enumerate(rows) if r[0] not in {x[0] for x in rows[:i]}]
    calm = [r for i, r in enumerate(first) if not (i + 1 < len(first) and first[i + 1][2] == r[2] and 0 < first[i + 1][0] - r[0] <= 5)]
    return [r[0] for i, r in enumerate(calm) if not any(x[2:] == r[2:] for x in calm[i + 1 :])]


@pytest.mark.parametrize("seed", range(3))
def test_restated_decisions(spark, seed):
    rng, texts = random.Random(seed), ["abcdef 1", "qwrtzp 2", "mnbvcx 3"]
    cases = {k: [(t, t, rng.choice(texts), rng.choice(["aprobat", "respins"])) for t in sorted(rng.sample(range(60), 14))] for k in range(4)}
    df = spark.createDataFrame([(1, k, 0, 0, i, t, float(at), text, status, "", False) for k, rows in cases.items() for i, (t, at, text, status) in enumerate(rows)], "job long, case_no long, window long, no long, n long, turn_id long, at double, decision string, status string, quote string, replaces boolean")
    got = M.restated(df).orderBy("case_no", "place").collect()
    for k, rows in cases.items():
        assert [r.turn_id for r in got if r.case_no == k] == plain_restated(rows)


def test_empty_tables(spark):
    got = M.merged(*(spark.createDataFrame([], s) for s in (CASES, DECISIONS, FACTS, QUESTIONS, CONTEXT)))
    assert got.cases.count() == got.decisions.count() == got.facts.count() == got.questions.count() == 0


def test_sanitized_answers(spark):
    raw = """{"cases": [{"case_key": "patul nou", "topic": "T", "discussion_summary": "x [0:01-0:02]", "eta": {"type": "Absolute", "raw": "joi", "condition": "c"},
      "decisions": [{"decision": "joi", "quote": "„[0:05] vineri”", "status": "APROBAT", "timestamp": "[1:05]", "replaces_previous": true}, {"decision": ""}, 3, {"decision": "da", "status": "respinss", "quote": 7}],
      "facts": [{"category": "istorik", "fact": "tuse"}, {"fact": " "}, {"fact": "f", "category": "?"}], "open_questions": ["q?", "", 4]},
      {"case_key": " "}, 5, {"topic": "doar temă", "eta": {"raw": "curând"}}, {"case_key": "z", "eta": {"type": "none", "raw": "r"}, "decisions": "no"}]}"""
    answers = spark.createDataFrame([(1, 0, raw), (1, 1, "not JSON"), (1, 2, None), (1, 3, "[]")], "job long, window long, answer string")
    cases, decisions, facts, questions = A.sanitized(answers)
    assert [(r.no, r.case_key, r.summary, r.eta_type, r.eta_raw, r.eta_condition) for r in cases.orderBy("no").collect()] == [(0, "patul 9", "x [0:01] [0:02]", "absolute", "joi", None), (3, "doar temă", "", "vague", "curând", None), (4, "z", "", "none", None, None)]
    assert [(r.n, r.decision, r.status, r.quote, r.at, r.replaces, r.fixed) for r in decisions.orderBy("n").collect()] == [(0, "vineri", "aprobat", "vineri", 65, True, True), (3, "da", "respins", "", None, False, True)]
    assert [(r.fact, r.category) for r in facts.orderBy("n").collect()] == [("tuse", "istoric"), ("f", "evoluție")] and [r.question for r in questions.collect()] == ["q?"]


def test_clauses(spark):
    texts = spark.createDataFrame([(1, 0, "externare joi, 500 mg [0:10] nu s-a discutat altul [1:10] gata"), (1, 1, "fără timp"), (1, 2, None)], "job long, id long, text string")
    lines = spark.createDataFrame([(1, 10.0, "vineri externăm,"), (1, 12.0, "cinci sute"), (1, 70.0, "altceva")], "job long, start double, line string")
    assert {r.id: r.text for r in A.fixed_clauses(texts, lines).collect()} == {0: "externare vineri, 500 [0:10] gata", 1: "fără timp", 2: None}


def test_reports(spark):
    cases = spark.createDataFrame([(1, 0, "a", "absolute", "joi", None), (1, 1, "b", "none", None, None), (1, 2, "c", "vague", None, None)], "job long, case_no long, case_key string, eta_type string, eta_raw string, eta_condition string")
    decisions = spark.createDataFrame([(1, 0, 0, 4, 4.0, "x", False), (1, 0, 1, None, 5.0, "y", True), (1, 1, 0, 6, 1.0, "z", False)], "job long, case_no long, place int, turn_id long, at double, decision string, superseded boolean")
    assert sorted((r.case_key, r.decision, r.at) for r in A.deadlines(cases, decisions).collect()) == [("a", "x", 4.0), ("c", "—", None)]
    turns = spark.createDataFrame([(1, 4, True), (1, 6, False)], "job long, id long, uncertain boolean")
    assert {r.decision: r.flag for r in A.review_flags(decisions, turns).collect()} == {"x": "uncertain turn", "y": "quote not found", "z": None}
    loops = table(spark, [case(0, i, "k") for i in range(3)] + [case(1, 0, "k"), case(1, 1, "k")], CASES)
    assert [(r.window, r.n) for r in A.repeated_keys(loops).collect()] == [(0, 3)]
    rows = spark.createDataFrame([(1, "bine", "тест раз и два x три"), (2, None, "ok")], "id long, topic string, summary string")
    assert [tuple(r) for r in A.foreign_fields(rows, ["id"], ["topic", "summary"]).collect()] == [(1, "summary", ["тест раз и два", "три"])]


def test_problems_of_a_response(spark):
    lines = table(spark, [(0, 0, "Mergem pe amoxicilină"), (0, 1, "de joi")], "job long, window long, id long, text string")
    cases = table(spark, [case(0, 0, "a", eta=("relative", "de joi", None)), case(0, 1, "a", eta=("soon", "luni", "dacă"))], CASES)
    decisions = table(spark, [said(0, 0, 0, 0, "x", quote="pe amoxicilină, de joi"), said(0, 1, 0, 0, "y", status="da", quote="altceva"), said(0, 1, 1, 0, "z")], DECISIONS)
    got = sorted((r.no, r.problem) for r in A.problems(cases, decisions, lines).collect())
    assert got == [(0, "case given twice"), (1, "case given twice"), (1, "condition"), (1, "deadline"), (1, "deadline type"), (1, "quote"), (1, "quote"), (1, "status")]


def test_fix_log(spark):
    from scriven.operators import answers as A

    answer = {"cases": [
        {"case_key": "Patul nou", "discussion_summary": "a [0:10–0:20]", "eta": {"type": "relativ", "raw": "mâine", "condition": "dacă"},
         "decisions": [{"decision": "control joi", "quote": "on Friday", "status": "aprobat"}, {"decision": "", "quote": " "}, {"decision": "x", "quote": "„q”", "status": "Respins"}],
         "facts": [{"fact": "", "category": "analize"}, {"fact": "f [1:00-2:00]", "category": "Analize"}], "open_questions": ["", "când?"]},
        {"topic": ""}]}
    df = spark.createDataFrame([(1, 0, json.dumps(answer)), (1, 1, "no json"), (2, 0, None)], "job long, window long, answer string")
    got = sorted(((r.no, r.n, r.field, r.said, r.now) for r in A.fix_log(df).collect()), key=str)
    assert got == sorted([
        (0, None, "case_key", "Patul nou", "Patul 9"), (0, None, "summary", "a [0:10–0:20]", "a [0:10] [0:20]"), (0, None, "eta_type", "relativ", "relative"), (0, None, "eta_condition", "dacă", None),
        (0, 0, "decision", "control joi", "control vineri"), (0, 1, "decision", "", None), (0, 2, "quote", "„q”", "q"), (0, 2, "status", "Respins", "respins"),
        (0, 0, "fact", "", None), (0, 1, "fact", "f [1:00-2:00]", "f [1:00] [2:00]"), (0, 1, "category", "Analize", "analize"), (0, 0, "question", "", None), (1, None, "case", "", None),
    ], key=str)


def test_deadline_log(spark):
    from scriven.operators import answers as A

    cases = table(spark, [case(0, i, f"c{i}", eta=e) for i, e in enumerate([("absolute", "mâine dimineață", None), ("vague", "peste un an", None), ("duration", "luna", None), ("conditional", "daca creste febra", "febră"), ("none", None, None)])], CASES)
    lines = table(spark, [(0, 0, "Mâine dimineață, la opt"), (0, 1, "vine la fiecare luna"), (0, 2, "Dacă crește febra, sunați")], "job long, window long, id long, text string")
    checked = M.checked_deadlines(cases, table(spark, [said(0, 3, 0, 2, "x")], DECISIONS), lines)
    got = {(r.no, r.event): (r.said, r.now) for r in A.deadline_log(cases, checked).collect()}
    assert got == {
        (0, "type"): ("absolute", "relative"), (1, "not in transcript"): ("peste un an", None), (2, "extended"): ("luna", "la fiecare luna"), (2, "type"): ("duration", "recurring"), (3, "realigned"): ("daca creste febra", "Dacă crește febra"),
    }


def test_deadline_fixes_is_the_one_of_the_sql(spark, tmp_path):
    # words that are nearly those of the deadline, and a word of repetition before a turn's own words
    rows = [(2, 0, "am spus una doi"), (3, 1, "each fiecare luna trei"), (3, 0, "vezi каждый месяц aici"), (1, 0, "nimic de spus"), (2, 4, "și the gata"), (6, 0, None)]
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn INT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, 'user', ?)", rows)
    db.execute(f"COPY conversations TO '{tmp_path}/conversations.parquet' (FORMAT parquet)")
    got = {tuple(r) for r in QUERIES["deadline_fixes"](spark, str(tmp_path)).collect()}
    assert got == set(db.execute(ORACLES["deadline_fixes"]).fetchall())
    assert got == {(2, 0, "not in transcript", "luna", None), (3, 0, "extended", "месяц", "каждый месяц"), (1, 0, "not in transcript", "xqzk wvjj yyqx", None), (2, 4, "extended", "luna", "fiecare luna")}
