import random

import numpy as np
import pytest

from scriven.llm import decontam as D

DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id long, text string, score int"


def made_up():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3)))
    words = lambda n: [word() for _ in range(n)]
    items = [" ".join(words(rng.randint(15, 50))) + rng.choice(["? ", ".\n", ". "]) + " ".join(words(rng.randint(1, 9))) for _ in range(40)]
    docs, want = [], set()
    for i in range(120):
        w = words(rng.randint(0, 400))
        if i % 3 == 0:
            k, at = rng.randrange(40), rng.randint(0, len(w))
            docs.append(" ".join(w[:at]) + " " + items[k].upper().replace(" ", ",  ") + " " + " ".join(w[at:]))
            want.add((i, k))
        else:
            docs.append(" ".join(w))
    return docs, items, want


@pytest.mark.parametrize("part_words", [1_000_000, 300])
def test_planted_items_and_nothing_else(spark, monkeypatch, part_words):
    monkeypatch.setattr(D, "PART_WORDS", part_words)
    docs, items, want = made_up()
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)] + [(500, None, "x"), (501, "", None)], DOCS)
    b = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)] + [(90, None, 1), (91, "", 1), (0, items[0], 1)], ITEMS)
    got = D.contaminated(d, b).collect()
    assert {(r._id, r.item_id) for r in got} == want
    assert all(r.question_overlap == r.answer_overlap == 1 for r in got)


def test_items_without_id_are_items_of_their_own(spark):
    first, second, third = (" ".join(f"{c}{i}" for i in range(12)) + "? yes" for c in "abc")
    d = spark.createDataFrame([(1, f"{first} and {second}", "x"), (2, third, "x"), (3, "none", "x")], DOCS)
    b = spark.createDataFrame([(None, first, 1), (None, second, 1), (None, second, 2), (7, third, 1), (7, third + " no", 1)], ITEMS)
    assert sorted(((r._id, r.item_id) for r in D.contaminated(d, b).collect()), key=str) == [(1, None), (1, None), (2, 7)]


def test_block_bounds_lose_nothing():
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(1, 60, 20).tolist(), rng.integers(1, 60, 4).tolist()) for i in range(50)]
    df = {w: sum(w in (*q, *a) for _, q, a in rows) for w in range(60)}
    index = D.Index.build(rows, df, 50, 24)
    lengths = np.array([300, 0, 25, 7])
    words = rng.integers(1, 60, lengths.sum()).astype(np.uint64)
    got = {(d, at, i): s for d, at, i, s in index.retrieve(words, lengths)}
    dense = np.zeros((50, len(index.vocabulary)))
    for w in range(len(index.vocabulary)):
        for p in range(index.first[w], index.first[w + 1]):
            dense[index.items[p], w] = index.weights[p]
    assert np.allclose(dense.sum(1), 1)
    want, start = {}, 0
    for d, n in enumerate(lengths):
        own = words[start : start + n]
        start += n
        for at in range(0, n // index.span * index.span + 1, index.span):
            there = np.isin(index.vocabulary, own[at : at + 2 * index.span])
            for i in np.flatnonzero(dense[:, there].sum(1) >= D.RETRIEVE):
                want[(d, at, int(i))] = dense[i, there].sum()
    assert want and got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b c", "x")], DOCS), spark.createDataFrame([(1, "a b c", 1)], ITEMS)
    assert D.contaminated(d, b.limit(0)).count() == 0
    assert D.contaminated(d.limit(0), b).count() == 0
    assert D.contaminated(d, b).count() == 1


def test_a_question_without_its_answer_is_no_copy(spark):
    question, answer = " ".join(f"q{i}" for i in range(40)) + "?", "one two three four"
    d = spark.createDataFrame([(1, question, "x"), (2, f"{question} {answer}", "x"), (3, answer, "x"), (4, f"{question} x {answer} y", "x")], DOCS)
    b = spark.createDataFrame([(7, f"{question} {answer}", 1)], ITEMS)
    assert {r._id for r in D.contaminated(d, b).collect()} == {2, 4}


def test_one_very_long_item_and_long_documents(spark):
    rng = random.Random(9)
    long, short = (" ".join(f"{c}{rng.randrange(10**6)}" for _ in range(n)) + "? yes indeed" for c, n in (("l", 5000), ("s", 12)))
    filler = " ".join(f"f{i}" for i in range(60_000))
    d = spark.createDataFrame([(1, f"{filler} {short} {filler}", "x"), (2, f"{filler} {long}", "x"), (3, filler, "x")], DOCS)
    b = spark.createDataFrame([(1, short, 1), (2, long, 1)], ITEMS)
    assert {(r._id, r.item_id) for r in D.contaminated(d, b).collect()} == {(1, 1), (2, 2)}
