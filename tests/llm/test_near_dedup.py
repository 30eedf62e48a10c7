import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from scriven.llm import near_dedup as N
from scriven.llm.common import NULL_ID

SCHEMA = "doc_id long, text string, lang string, _id string, label int"


def shingle_weights(text):
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", (text or "").lower()) if x]
    return Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter()


def prob_jaccard(x, y):
    common = x.keys() & y.keys()
    keys = x.keys() | y.keys()
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in keys) for i in common)


def brute_classes(rows):
    """class by doc_id, over all pairs that share a shingle"""
    weights = {i: shingle_weights(t) for i, t in rows}
    texts, at, parent = defaultdict(list), defaultdict(list), {i: i for i, _ in rows}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def join(a, b):
        a, b = sorted((top(a), top(b)))
        parent[b] = a

    for i, t in rows:
        texts[t or ""].append(i)
        for s in weights[i]:
            at[s].append(i)
    for ids in texts.values():
        for i in ids:
            join(ids[0], i)
    pairs = Counter((a, b) for ids in at.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    for (a, b), n in pairs.items():
        small = min(len(weights[a]), len(weights[b]))
        if n >= 0.5 * small and prob_jaccard(weights[a], weights[b]) >= 0.8:
            join(a, b)
    return {i: top(i) for i, _ in rows}


def made_up(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(3, 150))]
        if rng.random() < 0.4:
            base = base + base[: len(base) // 2]
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            new = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                new[rng.randrange(len(new))] = word()
            rows.append(" ".join(new))
    return list(enumerate(rows + [None, "", " \n", "one two", "One  two", rows[0]]))


@pytest.mark.parametrize("group_docs", [4096, 5])
def test_classes_match_all_pairs(spark, monkeypatch, group_docs):
    monkeypatch.setattr(N, "GROUP_DOCS", group_docs)
    rows = made_up()
    df = spark.createDataFrame([(i, t, "en", "x", 1) for i, t in rows] + [(3, rows[3][1], "en", "x", 1)], SCHEMA)
    got = {r._id: r["class"] for r in N.near_classes(df).collect()}
    assert got == brute_classes(rows)


def test_no_task_takes_a_whole_large_group(spark, monkeypatch):
    """Near copies around 0.8, some linked only through others, in groups over GROUP_DOCS."""
    rng, bound = random.Random(3), 30
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(70):
        new = list(base)
        for k in rng.sample(range(120), rng.choice((1, 2, 3, 4))):
            new[k] = f"n{i}x{k}"
        rows.append((i, " ".join(new)))
    real = {name: getattr(N, name) for name in ("_verify", "_cross") if hasattr(N, name)}

    def held(f):
        def run(pdf):
            if len(pdf) > bound:
                raise AssertionError(f"{len(pdf)} documents in one task")
            return f(pdf)

        return run

    for name, f in real.items():
        monkeypatch.setattr(N, name, held(f))
    monkeypatch.setattr(N, "GROUP_DOCS", 16)
    df = spark.createDataFrame([(i, t, "en", "x", 1) for i, t in rows], SCHEMA)
    got = {r._id: r["class"] for r in N.near_classes(df).collect()}
    assert got == brute_classes(rows) and max(Counter(got.values()).values()) > 16


def test_stage_keeps_one_of_each_class_and_all_columns(spark):
    rows = made_up(9)
    df = spark.createDataFrame([(i, t, None, "x", i) for i, t in rows], SCHEMA)
    out = N.near_stage(spark, df, "")
    assert out.columns == df.columns
    want = brute_classes(rows)
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(want.values()))


def test_texts_of_null_and_repeated_ids_are_documents_of_their_own(spark):
    long = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    near = long(1) + " end"
    rows = [(None, long(0)), (None, long(1)), (None, near), (None, long(2)), (None, long(2)), (None, None), (5, long(3)), (5, long(4)), (6, long(4) + " end"), (7, near)]
    df = spark.createDataFrame([(i, t, "en", "x", 1) for i, t in rows], SCHEMA)
    kept = [(r.doc_id, r.text) for r in N.near_stage(spark, df, "").collect()]
    one_of = [t for i, t in kept if i is None and t in (long(1), near)]
    assert len(one_of) == 1
    assert sorted(kept, key=str) == sorted([(None, long(0)), (None, one_of[0]), (None, long(2)), (None, None), (5, long(3)), (5, long(4))], key=str)
    got = N.near_classes(df).collect()
    assert len(got) == len(rows)
    assert {(r._id, r["class"]) for r in got} == {(NULL_ID, NULL_ID), (5, 5), (6, 5), (7, NULL_ID)}


def test_empty_table(spark):
    assert N.near_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_register_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(1, 2**62, 400).astype(np.uint64)
    words = np.concatenate([a, np.concatenate([a[:380], a[:20] + 1])])
    sig = N.signatures(*N.shingles(words, np.array([400, 400])), 2)
    assert abs((sig[0] == sig[1]).mean() - 376 / 416) < 0.12


def test_weighted_similarity_matches_definition():
    x, y = Counter("aabbbcd"), Counter("abbcccx")
    view = lambda c: (np.array(sorted(map(ord, c)), np.uint64), np.array([c[chr(k)] for k in sorted(map(ord, c))], np.uint32))
    assert abs(N.similarity(view(x), view(y)) - prob_jaccard(x, y)) < 1e-12
