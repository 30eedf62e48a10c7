import math
from collections import Counter

from scriven.llm import quality as Q

ROWS = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "one two"), (None, "x " * 60), (6, "\n\n")]


def texts():
    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    good = [" ".join(f"wo{letters(i * (j + 3) % 9000)}x" for i in range(70 + j)) + "." for j in range(80)]
    junk = [" ".join(f"{letters(i)}$$$ v{letters(i * (j + 2))}***" for i in range(60)) for j in range(9)]
    loud = [" ".join(f"WO{letters(i * (j + 5) % 9000).upper()}" for i in range(80)) for j in range(3)]
    return [*good, *junk, *loud, *junk[:2]]


def plain_em(patterns):
    """patterns: votes to count; (share of good, rates in good, rates in bad)"""
    n_rules = len(Q.RULES)
    prior, in_good, in_bad = Q.GOOD_SHARE, [Q.FALSE_ALARM] * n_rules, [Q.HIT] * n_rules
    for _ in range(Q.STEPS):
        good = {}
        for v, n in patterns.items():
            odds = math.log(prior / (1 - prior))
            for x, g, b in zip(v, in_good, in_bad):
                odds += math.log(g / b) if x < 0 else math.log((1 - g) / (1 - b)) if x > 0 else 0.0
            good[v] = n / (1 + math.exp(-odds))
        total = sum(patterns.values())
        prior = (sum(good.values()) + 10 * Q.GOOD_SHARE) / (total + 10)

        def rate(i, mass, low, high, mean, weight):
            against, cast = sum(m for v, m in mass.items() if v[i] < 0), sum(m for v, m in mass.items() if v[i])
            return max(min((against + mean * weight) / (cast + weight), high), low)

        weight, bad = Q.FALSE_ALARM_WEIGHT * (sum(good.values()) + 1), {v: n - good[v] for v, n in patterns.items()}
        in_good, in_bad = [rate(i, good, 1e-4, 0.5, Q.FALSE_ALARM, weight) for i in range(n_rules)], [rate(i, bad, 0.02, 0.98, Q.HIT, 1.0) for i in range(n_rules)]
    return prior, in_good, in_bad


def test_query_on_texts_without_words_and_repeated_rows(spark, tmp_path):
    rows = [(i, t, "e", 5) for i, t in [*ROWS, *enumerate(texts(), 100), (100, texts()[0])]]
    spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int").write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.op10_quality_rules(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.n_words < 50:
            assert r.base_failed and not r.kept
    assert {(r.doc_id, r.n_words, r.word_chars) for r in got if r.doc_id in (1, 2, 3, 6)} == {(i, 0, 0) for i in (1, 2, 3, 6)}
    kept = {r.doc_id: r.kept for r in got if r.doc_id is not None}
    assert all(kept[100 + i] for i in range(80)) and not any(kept[i] for i in range(180, 189))


def test_model_matches_plain_steps(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    features = Q.with_features(df)
    model = Q.fit(features)
    patterns = Counter(tuple(r.v) for r in features.where(~Q.base_failed()).select(Q.F.array(*Q.votes()).alias("v")).collect())
    prior, in_good, in_bad = plain_em(patterns)
    assert abs(model.prior - prior) < 1e-9
    for name, g, b in zip(Q.RULES, in_good, in_bad):
        assert abs(model.bad_votes[name][0] - g) < 1e-9 and abs(model.bad_votes[name][1] - b) < 1e-9


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert Q.op10_quality_rules(spark, str(tmp_path)).count() == 0
