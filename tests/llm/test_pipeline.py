import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as C
from scriven.llm import quality as Q

WORD = re.compile("[^\x20\x09-\x0d]+")


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows, where = defaultdict(list), set()
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    for at in windows.values():
        if len(at) > 1:
            where.update(p + k for p in at for k in range(3))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(where)


TEXTS = [None, "", " \n\t", "a b c a b c a b c", "x\nx\n x\n\ny", "#a| <b> $ 5%", "w " * 300, "ä é ß\x0bö \x1c u\x85v", "one two three\none two three four", "1 2 3 4 5 6 1 2 3"]


def test_base_counts(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = {r.doc_id: tuple(r[n] for n in names) for r in Q.with_features(df).collect()}
    assert got == {i: base_counts(t) for i, t in enumerate(TEXTS)}


def test_votes_reject_junk_and_keep_the_rest(spark):
    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    good = " ".join(f"wo{letters(i)}x" for i in range(120)) + "."
    junk = " ".join(f"{letters(i)}$$$ v{letters(i)}***" for i in range(80))
    rows = [(i, good.replace("x", chr(97 + i % 20))) for i in range(60)] + [(100 + i, junk + f" z{i}") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = Q.fit(Q.with_features(df))
    kept = {r.doc_id: r.kept for r in Q.score(df, model).collect()}
    assert all(kept[i] for i in range(60)) and not any(kept[100 + i] for i in range(6))
    assert model.accuracy("symbols") > 0.9
    empty = df.limit(0)
    assert Q.score(empty, Q.fit(Q.with_features(empty))).count() == 0


def shingled(text):
    words = WORD.findall((text or "").lower())
    n = max(len(words) - 4, 1) if words else 0
    return Counter(tuple(words[i : i + 5]) for i in range(n))


def probability_jaccard(x, y):
    """By its definition: one sum over the union for each common shingle."""
    if not x or not y:
        return 0.0
    every = set(x) | set(y)
    if max(x.values()) == max(y.values()) == 1:
        return len(set(x) & set(y)) / len(every)
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in every) for i in set(x) & set(y))


def plain_near(docs):
    """All pairs, then components: the smallest id of each."""
    sets, parent = {i: shingled(r.text) for i, r in docs.items()}, {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            common = len(x.keys() & y.keys())
            if docs[a].text == docs[b].text or common > 0.4 * (len(x) + len(y) - common) and probability_jaccard(x, y) >= 0.8:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {root(i) for i in ids}


def plain_contaminated(docs, items):
    """Documents that hold an item: whole texts, every item."""
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}
    wanted = [grams(w) for t in items if (w := words(t))]
    held = {i: grams(words(r.text)) for i, r in docs.items()}
    return {i for i, have in held.items() if any(len(g & have) >= 0.8 * len(g) for g in wanted)}


def test_stages_in_turn(spark):
    """Each stage against what it must keep, on the smallest tables; run() gives the last stage's rows."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    columns = docs.columns
    for name, stage in C.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = C.written(stage(spark, docs, sf), name)
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns and after and after.keys() <= before.keys()
        if name == "quality_rules":
            for i, r in before.items():
                n, _, _, _, again = base_counts(r.text)
                assert i not in after or not (n < 50 or 100 * again > 50 * n)
        elif name == "line_dedup":
            assert after.keys() == before.keys() and all(r.n_chars == len(r.text) for r in after.values())
        else:
            assert all(after[i] == before[i] for i in after)
        if name == "near_dedup":
            assert set(after) == plain_near(before)
        if name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert set(before) - set(after) == plain_contaminated(before, items) != set()
    pieces = C.run(spark, sf).groupBy("doc_id").sum("length").collect()
    assert {r.doc_id for r in pieces} == set(after)


def test_intermediate_tables_go(spark, tmp_path):
    from scriven.llm import common

    before = common.n_written()
    a, b = (common.written(spark.range(3), n) for n in "ab")
    assert a.count() == 3
    common.drop_written(spark, before, before + 1)
    assert b.count() == 3 and common.n_written() == before + 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        a.count()
    common.drop_written(spark, before)
    assert common.n_written() == before


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in C.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.001").count() == 0


def test_extra_columns_and_nulls_pass(spark):
    docs = spark.createDataFrame([(None, None, None, "s", None, "v"), (1, "a b " * 40 + "end of it all here", "en", None, 3, None), (1, "a b " * 40 + "end of it all here", "en", None, 3, None)], "doc_id long, text string, lang string, source string, n_chars long, n_words string")
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns
        out.collect()
