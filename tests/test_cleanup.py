import tracemalloc

import pyarrow as pa

from scriven.functions import cleanup as C


def test_collapse():
    assert C.collapse_repeats("da da da da bine".split()) == ["da", "bine"]
    assert C.collapse_repeats("da da da bine".split()) == "da da da bine".split()
    assert C.collapse_repeats("a b a b A, b! c".split()) == ["a", "b", "c"]
    assert C.collapse_repeats("- - - - x".split()) == "- - - - x".split() and C.collapse_repeats([]) == []


def test_collapse_column(spark):
    df = spark.createDataFrame([(1, ["x"] * 6), (2, None), (3, ["a"])], "id int, w array<string>")
    assert {r.id: (r.w, r.repetition) for r in C.with_collapsed(df, "w").collect()} == {1: (["x"], True), 2: ([], None), 3: (["a"], False)}


def test_collapse_holds_one_row(spark):
    words = [[f"w{(i + k) % 40 // (1 + k % 3)}" for k in range(100)] + ["da"] * (i % 7) for i in range(2000)]
    rows = pa.array([["not", "read"], *words]).slice(1)
    tracemalloc.start()
    got = C._shortened(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6e6 and got.to_pylist() == [C.collapse_repeats(w) for w in words]


def test_review_sheet(spark):
    d = spark.createDataFrame([(1, "A", "do", 2), (1, "B", "go", None)], "job long, case_key string, decision string, turn_id long")
    lines = spark.createDataFrame([(1, 2, "said")], "job long, id long, line string")
    assert C.review_sheet(d, lines).first().sheet == "- [ ] A: do\n  > said\n- [ ] B: go\n  > (not found)"


def test_cue_fragments(spark):
    from scriven.operators.patients import cue_fragments

    said = [(0, "bună ziua"), (20, "Pacientul din patul 3 are febră"), (25, "patul 3 continuă"), (60, "trecem la patul 5"), (65, "patul 7 pe scurt"), (80, "x " * 40), (90, "y " * 40)]
    lines = spark.createDataFrame([(1, i, float(at), t, 5 + len(t) // 4) for i, (at, t) in enumerate(said)], "job long, id long, at double, text string, tokens_est long")
    got = [tuple(r)[1:] for r in cue_fragments(lines, 15, 40, 2).orderBy("fragment", "chunk").collect()]
    assert got == [(0, 0, 0, 0, None, 0), (1, 0, 1, 2, "patul 3", 0), (2, 0, 3, 4, "patul 5", 1), (2, 1, 5, 5, "patul 5", 3), (2, 2, 6, 6, "patul 5", 4)]
