import random

import numpy as np

from scriven.llm import toxicity as T


def made_up(n=900, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("aeiourstn") for _ in range(rng.randint(2, 4))) for _ in range(rng.randint(5, 200))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(("blorp", "zwick", "grumf", "trabb", "snarl")))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_held_out_accuracy(spark, tmp_path):
    docs, labels = made_up()
    truth = {i: t for i, _, t in labels}
    spark.createDataFrame(docs + [(5000, None, "x"), (None, "", None)], "doc_id long, text string, toxic string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels[:450] + [(3, 1, None), (9999, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in T.op7_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == 902 and not got[5000].toxic and not got[None].toxic
    right = sum(got[i].toxic == bool(truth[i]) for i in range(450, 900))
    assert right >= 0.97 * 450


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, places string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = T.train(docs, T.verdicts(labels), T.CHAIN)
    assert T.scored(docs, chain, T.CHAIN).first()["toxic"] < 1e-6
    assert T.scored(docs.limit(0), chain, T.CHAIN).count() == 0


def test_chain_uses_earlier_categories():
    rng = np.random.default_rng(0)
    lengths = np.full(600, 12)
    flat = np.concatenate([np.sort(rng.choice(400, 12, False)) for _ in range(600)])
    texts = T.Texts(flat, lengths)
    first = texts.dense(np.array([5, 9, 30, 77])).any(1).astype(float)
    chain = T.fit_chain(texts, np.column_stack([first, first]))
    assert chain[1].weights[-2] > 0.3  # the later model leans on the earlier one's probability
    assert ((T.chain_scores(chain, texts)[:, 1] > 0.5) == (first > 0)).mean() > 0.97


def test_repeated_rows_ties_and_a_very_long_text(spark):
    docs, labels = made_up(300)
    d = spark.createDataFrame(docs + docs[:40] + [(900, "blorp " + "filler " * 200_000 + "zwick grumf trabb", "x")], "doc_id long, text string, x string")
    chain = T.train(d, T.verdicts(spark.createDataFrame(labels + labels[:30], "doc_id long, quality int, toxic int")), T.CHAIN)
    got = T.scored(d, chain, T.CHAIN).collect()
    per = {}
    for r in got:
        per.setdefault(r._id, set()).add(r.toxic)
    assert len(got) == 341 and all(len(p) == 1 for p in per.values()) and per[900].pop() > 0.5


def test_held_out_features_do_not_see_their_fold():
    """A place met only in one fold's documents cannot be chosen by the models that score that fold."""
    n = 90
    marks = [np.array([7] if i % T.FOLDS == 0 and i % 2 else [1 + i % 5]) for i in range(n)]
    texts = T.Texts(np.concatenate(marks), np.ones(n, int))
    y = np.array([float(i % T.FOLDS == 0 and i % 2) for i in range(n)])
    assert 7 in texts.telling(y, np.ones(n, bool)) and 7 not in texts.telling(y, np.arange(n) % T.FOLDS != 0)
