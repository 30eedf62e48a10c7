import hashlib
import itertools
import random
import re
import zlib

from scriven.llm import turn_repair as R

SCHEMA = "conv_id long, turn long, role string, text string, kind string, live string, pos string, nth string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        role = "user" if kind == 4 else role
        out += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def cheapest(rows, faults):
    """All edit strings, row by row, with up to two inserted turns at each place."""
    best, todo = None, [(0, "", [], 0)]
    inserts = [[], [""], ["", ""]]
    while todo:
        cost, audit, made, i = todo.pop()
        if best and cost > best[0]:
            continue
        for more in inserts:
            c, a, m = cost + 3 * len(more), audit + "I" * len(more), list(made)
            for _ in more:
                m.append("assistant:" if m and m[-1][:1] == "u" else "user:")
            if i == len(rows):
                if re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in m)) and (not best or (c, a) < best[:2]):
                    best = (c, a, m)
                continue
            _, role, text = rows[i]
            todo.append((c + 4, a + "D", m, i + 1))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 * (faults[i] == "truncated")
                for letter, price, name in (("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant")):
                    grown = m + [f"{name}:{text}"]
                    if re.fullmatch("s?(ua)*u?", "".join(x.split(":")[0][:1] or "-" for x in grown)):
                        todo.append((c + price + extra, a + letter, grown, i + 1))
    return best


def brute(rows):
    rows = damaged(rows)
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    cost, audit, made = cheapest(rows, faults)
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(made)))


def query(spark, rows):
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)
    out = R.repaired(R.with_faults(R.damaged(df)))
    from pyspark.sql import functions as F

    text = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit(":"), t.text)), "\n")
    return {r[0]: tuple(r)[1:] for r in out.withColumn("turns", F.sha2(text, 256)).collect()}


def test_against_all_edit_strings(spark):
    rng, rows = random.Random(4), []
    for conv in [*range(300), None]:
        for _ in range(rng.randint(1, 5)):
            turn = rng.choice([None, *range(8)])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "s", "", None])
            rows.append((conv, turn, role, rng.choice([None, "", "a.", "b", "c! \n", "é?", "d", "e.", "f.", "g."])))
    got = query(spark, rows)
    assert len(got) == 301
    for conv in got:
        assert got[conv] == brute([r for r in rows if r[0] == conv]), [r for r in rows if r[0] == conv]


def test_edges(spark):
    assert query(spark, []) == {}
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    whole = next(c for c in range(1000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 > 4 for t in range(3)))
    apart = next(c for c in range(1000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 > 4 for t in (-(2**63), 2**63 - 1)))
    long = "x " * 500_000
    rows = [(dropped, 0, "user", "a."), (-5, 0, "user", long + "."), (-5, 1, "assistant", long + "!")]
    assert query(spark, rows)[dropped] == (0, 0, 0, 0, 0, 0, "", sha(""))
    assert query(spark, rows)[-5] == brute(rows[1:])
    rows = [(whole, 0, "system", "a."), (whole, 1, "user", "b."), (whole, 2, "assistant", "c.")]
    assert query(spark, rows)[whole] == (0, 0, 0, 0, 0, 0, "KKK", sha("system:a.\nuser:b.\nassistant:c."))
    far = query(spark, [(apart, -(2**63), "user", "a."), (apart, 2**63 - 1, "assistant", "b.")])[apart]
    assert far[0] is None and far[5:7] == (0, "KK")


def test_long_conversation(spark):
    rows = [(0, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(3000)]
    got = query(spark, rows)[0]
    assert got[0] >= 0 and got[5] > 0 and len(got[6]) >= 2900
