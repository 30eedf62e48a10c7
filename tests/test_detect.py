import random

import duckdb
import pytest
from pyspark.sql import functions as F

from scriven.functions import text as T
from scriven.operators import detect as D
from scriven.operators import frames as FR


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_prompt_leak(spark, monkeypatch, most):
    monkeypatch.setattr(D, "MOST_HELD", most)
    rng = random.Random(1)
    prompts = ["a b c d e f g", "x y", None, "k l m"]
    grams = {("a b c d e f g".split()[i], *"a b c d e f g".split()[i + 1 : i + 3]) for i in range(5)} | {("k", "l", "m")}
    texts = [None, "", "a b", "A, b! c", "k l m k l m z", "q q q"] + [" ".join(rng.choice("abcdklm") for _ in range(rng.randint(0, 30))) for _ in range(60)]
    got = D.prompt_leak(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), spark.createDataFrame([(p,) for p in prompts], "text string"), ["id"]).collect()
    assert len(got) == len(texts)
    for r in got:
        w = "".join(c if c.isalnum() else " " for c in (texts[r.id] or "").lower()).split()
        covered = {i + k for i in range(len(w) - 2) if tuple(w[i : i + 3]) in grams for k in range(3)}
        assert (r.n_words, r.covered, r.leak) == (len(w), len(covered), len(w) >= 3 and 2 * len(covered) >= len(w))


def test_drop_reasons(spark):
    rows = [(0, None, True, 9.0, 1.0, -2.0), (1, "a", True, 9.0, None, None), (2, "a", None, 2.5, None, None), (3, "a", False, 1.0, 0.7, -1.5), (4, "a", False, 1.0, 0.7, None), (5, "Please SUBSCRIBE", False, None, None, None), (6, "mulțumesc pentru vizionare " + "x " * 20, False, 1.0, 0.1, -3.0), (7, "like and subscribe, thanks for watching " + "x " * 20, False, 1.0, None, None)]
    s = spark.createDataFrame(rows, "id int, text string, leak boolean, ratio double, silent double, logprob double")
    c = s.columns
    s = s.withColumn("dropped", T.drop_reason(*(s[x] for x in c[1:])))
    assert [r.dropped for r in s.orderBy("id").collect()] == ["empty", "prompt_leak", "compression_ratio", "no_speech", None, "hallucination_phrase", None, "hallucination_phrase"]
    assert sorted(r.id for r in T.kept(s).collect()) == [4, 6]


def test_threshold_is_the_one_of_the_sql(spark):
    rng = random.Random(5)
    rows = [(j, i, i // 9, None if j == 0 and i < 9 else round(rng.choice((rng.uniform(0, 500), 7.31)), 2)) for j in range(60) for i in range(rng.randint(1, 70))]
    got = FR.adaptive_threshold(spark.createDataFrame(rows, "job long, idx long, at long, level double"), ["job"], F.col("at"), "level")
    db = duckdb.connect()
    db.execute("CREATE TABLE f (job BIGINT, idx BIGINT, block BIGINT, level DOUBLE)")
    db.executemany("INSERT INTO f VALUES (?, ?, ?, ?)", rows)
    want = db.execute("""WITH b AS (SELECT job, block, quantile_cont(level, 0.1) AS p10, quantile_cont(level, 0.95) AS p95 FROM f GROUP BY ALL), j AS (SELECT job, quantile_cont(level, 0.05) AS p5 FROM f GROUP BY job)
        SELECT job, idx, greatest(least(p10 + 9, p95 - 10), p5 + 9) FROM f JOIN b USING (job, block) JOIN j USING (job)""").fetchall()
    # to the last bit: a level may lie on its threshold
    assert {(r.job, r.idx): r.threshold for r in got.collect()} == {(j, i): t for j, i, t in want} and len(want) == len(rows)
