import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from scriven.llm import prefix_trie as P
from scriven.llm.common import NULL_ID, written

SCHEMA = "conv_id long, turn long, role string, text string, id string, n string, held string, level string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        sha = hashlib.sha256(f"{len(role.encode())}\n{role}\n{text}".encode()).hexdigest()
        own[NULL_ID if conv is None else conv].append((turn is not None, turn or 0, sha, (role, text)))
    own = {c: [x[3] for x in sorted(t)] for c, t in own.items()}
    nodes = defaultdict(list)
    for c, turns in own.items():
        h = 0 if c == NULL_ID else zlib.crc32(str(c).encode()) % 9
        base = own.get(c - int(c - 5 * int(c / 5)), []) if c != NULL_ID else []
        seq = tuple(base[:h] + turns[h:])
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append((c, len(seq) == d))
    name = lambda c: None if c == NULL_ID else c
    children = {k: [x for x in nodes if len(x) == len(k) + 1 and x[: len(k)] == k] for k in nodes}
    sums = {}
    for k in sorted(nodes, key=len, reverse=True):
        low = [sums[x] for x in children[k]]
        size = len(k[-1][1].encode()) if k else 0
        sums[k] = (sum(x[0] for x in low) or 1, sum(x[1] for x in low) + (len(nodes[k]) - 1) * size)
    out = []
    for k, m in nodes.items():
        ends = ",".join("" if c == NULL_ID else str(c) for c in sorted(c for c, e in m if e))
        parent = name(min(nodes[k[:-1]])[0]) if k else None
        out.append((name(min(m)[0]), len(k), parent, len(m), len(children[k]), *sums[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def query(spark, rows, local):
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)
    nodes = P.trie(written(P.distinct_sequences(P.rebuilt(P.sequences(df))), "sequences"), local)
    name = lambda c: None if c == NULL_ID else c
    return sorted(((name(r.conv), r.depth, name(r.parent), r.n, r.children, r.leaves, r.saved, r.ends) for r in nodes.collect()), key=str)


@pytest.mark.parametrize("local", [3, 40, P.LOCAL])
def test_against_all_prefixes(spark, local):
    rng, rows = random.Random(5), []
    for conv in [*range(-7, 60), None, 2**40, 2**40 + 1]:
        for _ in range(rng.choice([1, 2, 3, 6, 12])):
            rows.append((conv, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", None]), rng.choice([None, "", "a", "é", "bc\nd"])))
    rows += [(conv, t, "user", "same") for conv in range(100, 140) for t in range(9)]
    rows += [(conv, t, "user", "same" if t < 11 else str(conv)) for conv in range(200, 230) for t in range(13)] + rows[:20]
    assert query(spark, rows, local) == brute(rows)


def test_edges(spark):
    assert query(spark, [], 3) == []
    one = [(5, 0, "user", "x " * 300_000), (5, 1, None, None)]
    assert query(spark, one, 3) == brute(one)
    turnless = [(4, t, "user", "a") for t in range(2)]  # crc32("4") % 9 turns are taken from conversation 0, which is absent
    assert query(spark, turnless, 3) == brute(turnless)


def test_long_chain(spark):
    rows = [(c, t, "user", str(t)) for c in (0, 1000, 2005) for t in range(2000 - c // 10)]
    assert query(spark, rows, 10) == brute_chain(rows)


def brute_chain(rows):
    return sorted((tuple(x) for x in _chain(rows)), key=str)


def _chain(rows):
    own = defaultdict(list)
    for c, _, _, text in rows:
        own[c].append(text)
    seqs = {c: tuple(own.get(c - c % 5, [])[: zlib.crc32(str(c).encode()) % 9] + t[zlib.crc32(str(c).encode()) % 9 :]) for c, t in own.items()}
    longest = max(map(len, seqs.values()))
    saved = 0
    for d in range(longest, -1, -1):
        m = [c for c, s in seqs.items() if len(s) >= d]
        ends = [c for c, s in seqs.items() if len(s) == d]
        saved += (len(m) - 1) * (len(str(d - 1)) if d else 0)
        parent = min(c for c, s in seqs.items() if len(s) >= d - 1) if d else None
        yield min(m), d, parent, len(m), int(d < longest), 1, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
