import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from scriven.llm import line_dedup as D

SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, pos string"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def brute(rows):
    docs = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                docs[key(line)].add(-(2**63) if i is None else i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        n = -(2**63) if i is None else i
        kept = [x for x in lines if len(docs.get(key(x), ())) < 3 or max(docs[key(x)]) == n]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def made_up(seed=3):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcD éß") for _ in range(rng.randint(10, 40))) for _ in range(30)]
    rows = [(i * 3, "\n".join(rng.choice(["", " \t", "\r"]) + rng.choice(pool).swapcase() * 1 + rng.choice(["", "\x0b "]) if rng.random() < 0.7 else rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(50)]
    return rows + [(1000, None), (1001, ""), (None, pool[0] * 3), (1002, "\n\n")]


def collected(df):
    return {r.i if r.i != -(2**63) else None: (r.n, r.d, r.t) for r in df.selectExpr("_id AS i", "size(_lines) AS n", "_n_dropped AS d", "array_join(_kept, '\n') AS t").collect()}


@pytest.mark.parametrize("probe_rows", [1 << 18, 20])
def test_matches_brute_force(spark, monkeypatch, probe_rows):
    monkeypatch.setattr(D, "PROBE_ROWS", probe_rows)
    rows = made_up()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    assert collected(D.dedup_lines(df)) == brute(rows)


def test_deletion_undoes_insertion(spark):
    rows = made_up()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    first, gone = rows[:25] + rows[50:], rows[25:50]
    part, rest = df.where("doc_id < 75 OR doc_id >= 1000 OR doc_id IS NULL"), df.where("doc_id >= 75 AND doc_id < 1000")
    index = D.LineIndex(spark)
    index.insert(part)
    before = sorted(map(tuple, index.counts.collect()))
    index.insert(rest)
    assert collected(D.without_shared_lines(df, index)) == brute(rows)
    index.delete(rest)
    assert sorted(map(tuple, index.counts.collect())) == before
    assert collected(D.without_shared_lines(part, index)) == brute(first) and len(gone) == 25


def test_filter_holds_forgets_and_grows():
    rng = np.random.default_rng(1)
    h1, h2 = (rng.integers(-(2**63), 2**63 - 1, 20_000) for _ in range(2))
    f = D.CuckooFilter.of(h1, h2)
    assert f.contains(h1, h2).all()
    others = rng.integers(-(2**63), 2**63 - 1, (2, 20_000))
    assert f.contains(*others).mean() < 0.005
    f.delete(h1[:10_000], h2[:10_000])
    assert f.contains(h1[10_000:], h2[10_000:]).all() and f.contains(h1[:10_000], h2[:10_000]).mean() < 0.01
    assert D.CuckooFilter.from_bytes(f.to_bytes()).contains(h1[10_000:], h2[10_000:]).all()
    small = D.CuckooFilter(4)
    assert not small.insert(h1[:40], h2[:40])


def test_query_and_empty(spark, tmp_path):
    rows = made_up(8)
    spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in D.op3_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, (n, d, t) in brute(rows).items()}
    assert D.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
