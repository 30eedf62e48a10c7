import hashlib
import random

from scriven.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, segments string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_reads_back_hostile_texts(spark):
    rng = random.Random(1)
    bits = [*C.control_strings(C.TEMPLATE), "\\", "\\\\", "<", ">", "[", "]", "/", "s>", "INST]", "\n", " ", "é", "$1", "ok", "SYS>>"]
    rows = []
    for conv in range(150):
        for turn in range(rng.randint(1, 5)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "a]b\\", "[/ROLE]", "", None])
            rows.append((conv, turn, role, rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))]), "x"))
    got = {r.conv_id: r for r in C.read_back(C.formatted(spark.createDataFrame(rows, SCHEMA))).collect()}
    for conv in range(150):
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        loss = "".join(t for r, t in own if r == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)))
        assert (g.loss_chars, g.loss_sha256) == (len(loss), sha(loss))


def test_machine(spark):
    def judged(*roles):
        df = C.formatted(spark.createDataFrame([(1, i, r, "t", "") for i, r in enumerate(roles)], SCHEMA)).first()
        return df.valid, df.breaks_at

    assert judged("user", "assistant") == judged("system", "user", "assistant", "user", "assistant") == (True, None)
    assert judged("assistant") == (False, 0)
    assert judged("user", "user", "assistant") == (False, 1)
    assert judged("user", "assistant", "system") == (False, 2)
    assert judged("user") == (False, 1)
    assert judged("tool", "user") == (False, 0)


def test_segments_and_ties(spark):
    rows = [(None, 1, "assistant", "b", ""), (None, 0, "user", "a", ""), (2, 0, "user", "y", ""), (2, 0, "user", "x", ""), (2, 0, "user", "x", "")]
    got = {r.conv_id: r for r in C.formatted(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [(s.text, s.loss) for s in got[None].segments] == [("<s>[INST] ", False), ("a", False), (" [/INST]", False), ("[OUT] ", False), ("b", True), ("</s>", False)]
    assert got[2].n_turns == 3 and got[2].text.count("x") == 2
    assert C.formatted(spark.createDataFrame([], SCHEMA)).count() == 0
