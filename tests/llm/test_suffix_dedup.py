import hashlib
import random

import numpy as np
import pytest

from scriven.llm import suffix_dedup as S


def brute(docs):
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - S.LENGTH + 1):
            w = raw[k : k + S.LENGTH]
            if w in seen:
                gone[k : k + S.LENGTH] = True
            seen.add(w)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def made_up(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    shared = [text(rng.randint(90, 400)) for _ in range(6)] + ["x" * 350, "ab" * 200, "é" * 120]
    docs = []
    for i in range(60):
        parts = [text(rng.randint(0, 150)) if rng.random() < 0.5 else (s := rng.choice(shared))[rng.randint(0, 40) :] for _ in range(rng.randint(0, 6))]
        docs.append((i * 2 - 9, "".join(parts)))
    return docs + [(500, docs[20][1]), (501, docs[20][1]), (502, None), (503, ""), (None, shared[0] * 2)]


@pytest.mark.parametrize("settings", [{}, {"HOT": 3}, {"SHARD_BYTES": 2000, "CHUNK_BYTES": 300}])
def test_matches_brute_force(spark, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(S, k, v)
    docs = made_up(7)
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, start int")
    got = {r._id if r._id != -(2**63) else None: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.without_repeats(df).collect()}
    assert got == brute(docs)


@pytest.mark.parametrize("settings", [{}, {"HOT": 1}])
def test_repeated_ids_are_documents_of_their_own(spark, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(S, k, v)
    rng = random.Random(5)
    a, b, c = ("".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(3))
    rows = [(1, a), (2, b), (2, "pre " + a), (None, c), (None, c + a), (7, c), (7, c), (9, a + b)]
    hashed = {t: h for t, h in spark.createDataFrame([(t,) for _, t in rows], "t string").selectExpr("t", "xxhash64(t)").collect()}
    distinct = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]]))
    want = brute([(i, t) for i, (_, t) in enumerate(distinct)])
    expected = sorted((str(i), *want[distinct.index((i, t))]) for i, t in rows)
    got = S.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r._id if r._id != -(2**63) else None), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == expected


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(4)
    for n, k in ((1, 3), (2, 1), (50, 2), (800, 3), (3000, 250), (400, 1)):
        data = rng.integers(0, k, n).astype(np.uint8)
        raw = data.tobytes()
        sa = S.suffix_array(data)
        deep = [raw[i : i + 128] for i in sa]
        assert sorted(sa) == list(range(n)) and deep == sorted(deep)
        got = S.permuted_common_prefixes(data, sa, 1024)
        for a, b in zip(sa, sa[1:]):
            want = next((j for j in range(n) if a + j >= n or b + j >= n or raw[a + j] != raw[b + j]), n)
            assert min(got[b], 128) == min(want, 128)


def test_empty_table(spark):
    assert S.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_contexts_are_hashed_where_they_begin_and_end(monkeypatch):
    rng = np.random.default_rng(8)
    texts = [rng.integers(97, 123, n).astype(np.uint8) for n in (4000, 99, 100, 0, 900)]
    texts.append(texts[0][1000:1500].copy())
    hashed, mixed = [], S.mixed
    monkeypatch.setattr(S, "mixed", lambda x: hashed.append(x.size) or mixed(x))
    data, lengths = np.concatenate(texts), np.array([len(t) for t in texts])
    found = list(zip(*(c.tolist() for c in S.anchors(data, lengths))))
    assert sum(hashed) < 2 * len(data)  # one hash a place, two and a seed a context
    covered = sorted((d, s + k) for d, s, n, _, _ in found for k in range(n))
    assert covered == [(d, k) for d, n in enumerate(lengths) for k in range(n - S.LENGTH + 1)]
    # equal contexts are equal bytes, and those inside the copy are found
    of = {}
    for d, s, n, anchor, content in found:
        of.setdefault((anchor, content), set()).add(texts[d][s : s + n + S.LENGTH - 1].tobytes())
    assert all(len(x) == 1 for x in of.values()) and len(of) < len(found)


def test_first_of_equal_windows_stays():
    rng = np.random.default_rng(9)
    base = bytes(rng.integers(97, 101, 400).astype(np.uint8))
    cuts = [(int(d), int(sub), int(start), base[a : a + n]) for d, sub, start, a, n in zip(rng.integers(0, 6, 30), rng.integers(-2, 2, 30), rng.permutation(30) * 1000, rng.integers(0, 250, 30), rng.integers(100, 150, 30))]
    got = S.repeats_in_shard([c[3] for c in cuts], *(np.array([c[k] for c in cuts]) for k in range(3)))
    windows = sorted((d, sub, start + k, text[k : k + S.LENGTH]) for d, sub, start, text in cuts for k in range(len(text) - S.LENGTH + 1))
    seen, gone = set(), set()
    for *place, window in windows:
        if window in seen:
            gone.add(tuple(place))
        seen.add(window)
    assert {(d, sub, k) for d, sub, a, b in zip(*(c.tolist() for c in got)) for k in range(a, b - S.LENGTH + 1)} == gone
    assert gone
