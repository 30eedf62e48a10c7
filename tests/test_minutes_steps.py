from pyspark.sql import functions as F

from scriven.operators import case_keys as K
from scriven.operators import minutes as M
from scriven.operators.folds import ordered_fold

from test_case_keys import key


def test_a_fold_of_small_rows_has_all_parts_of_a_shuffle(spark):
    rows = spark.range(100).select((F.col("id") % 50).alias("job"), "id")
    assert ordered_fold(rows, ["job"], ["id"], lambda k, g: [(*k, sum(r.id for r in g))], "job long, n long").rdd.getNumPartitions() == 8


def test_few_keys_are_compared_without_arrays(monkeypatch):
    monkeypatch.setattr(K, "_Texts", None)
    index = K.KeyIndex()
    for said in ("Tema: buget", "Pacient 3", "Pacient 4, febră"):
        index.add(key(said))
    assert [n for n, _ in index.near(key("Pacient 3, tuse"), 60)] == [1]


def test_questions_and_cases_ask_for_no_decisions(spark, monkeypatch):
    def never(*_):
        raise AssertionError

    monkeypatch.setattr(M, "restated", never)
    cases = spark.createDataFrame([(1, 0, 0, "Tema: a", "t", "s", "none", None, None)], "job long, window long, no long, case_key string, topic string, summary string, eta_type string, eta_raw string, eta_condition string")
    decisions = spark.createDataFrame([(1, 0, 0, 0, 5, 5.0, "x", "aprobat", "", False)], "job long, window long, no long, n long, turn_id long, at double, decision string, status string, quote string, replaces boolean")
    facts = spark.createDataFrame([], "job long, window long, no long, n long, category string, fact string, at double")
    questions = spark.createDataFrame([(1, 0, 0, 0, "cine?")], "job long, window long, no long, n long, question string")
    context = spark.createDataFrame([], "job long, window long, turn_id long, at double")
    m = M.merged(cases, decisions, facts, questions, context)
    assert [r.question for r in m.questions.collect()] == ["cine?"] and m.cases.count() == 1
