"""Golden cases and boundaries of the operators, hand-worked."""

import random
from itertools import product

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scriven.functions import languages as L
from scriven.functions import similarity as S
from scriven.functions import text as T
from scriven.functions.number_words import normalize_numbers
from scriven.operators import evaluation as E
from scriven.operators import glossary as G
from scriven.operators import intervals as I
from scriven.operators import packing as P
from scriven.operators import segmentation as SG
from scriven.plans.registry import ORACLES, QUERIES


def one(spark, expr, **row):
    return spark.createDataFrame([tuple(row.values())], list(row)).select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    ("src", "want"),
    [
        ("tensiunea șaptezeci și unu", "tensiunea 71"), ("etajul opt spre zece", "etajul 18"), ("etajul un spre zice", "etajul 11"), ("am plătit trei sute patruzeci", "am plătit 340"),
        ("o sută zece din nouăzeci", "110 din 90"), ("două mii șase sute de pagini", "2600 de pagini"), ("cincizeci de mii", "50000"), ("trei mii unu", "3001"),
        ("zero virgulă zero trei", "0,03"), ("patru virgulă șapte grade", "4,7 grade"), ("umiditate optzeci și opt la sută", "umiditate 88%"), ("15 la sută", "15%"),
        ("o carte", "o carte"), ("doi din trei", "doi din trei"), ("șaizeci și ceva", "60 și ceva"), ("etajul vreun spre zece", "etajul vreun spre zece"), ("patruzeci. Și opt", "40. Și opt"),
        ("Nouăzeci și doi, șaizeci", "92, 60"), ("doua sute noua", "209"), ("unșpe, doăzeci și sase", "11, 26"), ("una mii", "una mii"), ("doi virgulă", "doi virgulă"), ("", ""),
        ("o sută nouă spre zece de mii cinci", "119005"), ("zero virgulă zero", "0,0"), ("optzecea", "optzecea"),
    ],
)
def test_number_words(src, want):
    assert normalize_numbers(src) == want


def test_text_rules(spark):
    c = F.col("t")
    assert one(spark, T.norm_text(c), t="Şef_ul  ZIUA, ёж!") == ["șef", "ul", "ziua", "еж"]
    assert one(spark, T.clean(c), t="ş ă") == "ș ă"
    assert one(spark, T.script_of(c), t="пaциент") == "mixed"
    assert one(spark, T.est_tokens(c), t="ăăa") == 2
    assert one(spark, T.time_code(F.lit(3725)), t="") == "[62:05]"
    assert one(spark, T.time_seconds(c), t="[1:02:03]") == 3723 and one(spark, T.time_seconds(c), t="x") is None
    assert one(spark, T.clock_seconds(c), t="1:30,5") == 90.5
    p = one(spark, T.parsed_line(c), t="[01:02] SPEAKER_00: bună ziua [?]")
    assert (p.ts, p.speaker, p.text, p.marker) == ("01:02", "SPEAKER_00", "bună ziua", True)
    assert one(spark, T.clean_quote(c), t="„[01:02] SPEAKER_01: da [?]”") == "da"
    assert one(spark, T.split_ranges(c), t="la [01:02–03:04]") == "la [01:02] [03:04]"
    assert one(spark, T.numbers(c), t="trei zile, 2,5 mg") == ["3", "2.5"]
    assert one(spark, T.stems5(c), t="Continuarea tratamentului") == "conti trata"
    assert one(spark, T.stem(c), t="pacientului") == "pacient"
    assert one(spark, T.lang_of(c), t="да ok и") == "ru"
    assert one(spark, T.eta_type(F.lit("absolute"), c), t="mâine dimineață") == "relative"
    assert one(spark, T.eta_type(F.lit("absolute"), c), t="zilnic") == "recurring"
    assert one(spark, T.norm_key(c), t="Pacienta ȘTEFAN, 45") == "pacienta stefan 45"


def test_interval_bounds(spark):
    df = spark.createDataFrame([(1, 1, "a", 0, 10), (1, 2, "a", 15, 20), (1, 3, "b", 16, 18), (1, 4, "a", 20, 22)], "job int, id int, speaker string, start int, end int")
    assert I.union(df, ["job"], 5).count() == 1 and I.union(df, ["job"], 5, strict=True).count() == 2
    assert sorted((r.speaker, r.start, r.end) for r in I.merge_gaps(df, ["job"], 5).collect()) == [("a", 0, 10), ("a", 15, 20), ("a", 20, 22), ("b", 16, 18)]
    assert [r.cluster for r in I.clusters(df, ["job"]).orderBy("id").collect()] == [1, 2, 2, 3]
    padded = I.padded(df.where("id < 3"), ["job"], 4, F.lit(0.0), F.lit(99.0)).orderBy("id").collect()
    assert [(r.start, r.end) for r in padded] == [(0, 12.5), (12.5, 24)]
    assert {(r.a_id, r.b_id, r.start, r.end) for r in I.speaker_overlaps(df, ["job"], bucket=7).collect()} == {(2, 3, 16, 18)}
    assert I.speaker_overlaps(df.limit(0), ["job"]).count() == 0


def test_all_overlaps_is_the_one_of_the_sql(spark, tmp_path):
    # no two rows of a job share start and end, since the SQL leaves their order open
    rows = [(2, "2024-01-01 00:00:05", 1, "a", 0.002), (4, "2024-01-01 00:00:05", 1, "a", None), (6, "2024-01-01 00:00:09", 1, "a", None), (3, "2024-01-01 00:00:06.5", 1, "b", 0.004), (8, None, 1, "a", 0.01)]
    rows += [(10, "1969-12-31 23:59:50.5", 2, "a", 0.005), (11, "1969-12-31 23:59:53.999999", 2, "b", 0.009), (12, "1970-01-01 00:00:00.5", 2, "b", 0.0), (14, "1969-12-31 23:59:57", 2, "b", 0.001)]
    db = duckdb.connect()
    db.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE)")
    db.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?)", rows)
    db.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = sorted((tuple(r) for r in QUERIES["all_overlaps"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(db.execute(ORACLES["all_overlaps"]).fetchall(), key=str)
    at = 1704067205
    assert {r for r in got if r[0] == 1} == {(1, at, at + 2, 3), (1, at + 4, None, 1), (1, None, None, 1)}


def test_hysteresis(spark):
    f = spark.createDataFrame(list(enumerate([0.0, 0.4, 0.9, 0.4, 0.0, 0.4, 0.42, 0.0])), "i int, p double").withColumn("job", F.lit(1))
    assert [(r.first, r.last) for r in I.hysteresis(f, ["job"], "i", F.col("p"), 0.5).collect()] == [(1, 3)]


def test_as_of_and_nearest(spark):
    p = spark.createDataFrame([(1, i, t) for i, t in enumerate([4, 5, 9, 21])], "job int, id int, at int")
    r = spark.createDataFrame([(1, 10, 5, 8), (1, 11, 10, 12), (1, 12, 20, 30)], "job int, line int, start int, end int")
    got = {x.id: (x.line, x.next_line) for x in I.as_of(p, r, ["job"], "at", "start", "line", slack=1, or_first=True).collect()}
    assert got == {0: (10, 11), 1: (10, 11), 2: (11, 12), 3: (12, None)}
    assert {x.id: x.line for x in I.nearest(p, r, ["job"], "at", "id", "start", "line").collect()} == {0: 10, 1: 10, 2: 11, 3: 12}
    assert {x.id: x.line for x in I.bucketed_points(p, r, ["job"], "at", "line").collect()} == {0: None, 1: 10, 2: None, 3: 12}


def windows_by_hand(tokens, budget, overlap):
    out, i, before = [], 0, 0
    while i < len(tokens):
        j = i + 1
        while j < len(tokens) and sum(tokens[i : j + 1]) <= budget:
            j += 1
        out.append((i, j - 1, max(before - i, 0), sum(tokens[i:j])))
        if j == len(tokens):
            break
        before, i = j, max(j - overlap, i + 1)
    return out


@pytest.mark.parametrize(("budget", "overlap"), list(product((5, 12, 40), (0, 1, 3))))
def test_windows(spark, budget, overlap):
    jobs = {1: [3, 4, 9, 1, 1, 1, 6, 2, 2, 2, 2], 2: [50], 3: [1, 1, 1, 30, 1, 1, 1, 1]}
    lines = spark.createDataFrame([(j, i, f"l{i}", t) for j, ts in jobs.items() for i, t in enumerate(ts)], "conv_id long, id long, line string, tokens_est long")
    got = P.token_windows(lines, budget, overlap).orderBy("conv_id", "index").collect()
    for j, ts in jobs.items():
        own = [(r.first, r.last, r.overlap_turns, r.tokens_est) for r in got if r.conv_id == j]
        assert own == windows_by_hand(ts, budget, overlap)


def test_chunks_keep_speech(spark):
    rows = [(1, 4.0 * i, 4.0 * i + 3) for i in range(30)] + [(2, 0.0, 4.0), (2, 600.0, 604.0)]
    c = P.packed_chunks(spark.createDataFrame(rows, "job long, start double, end double"), 20, 10, 30, 5).orderBy("job", "index").collect()
    assert sum(r.speech for r in c) == 98 and all(r.end - r.start <= 30 for r in c) and [r["index"] for r in c if r.job == 2] == [0, 1]


def test_segments(spark):
    spans = lambda *rows: iter([SG.Span(a, b, s, (i,)) for i, (s, a, b) in enumerate(rows)])
    out = SG.attached(spans(("a", 0, 5), ("b", 5.2, 5.6), ("b", 6, 9)), 1, 1, 20)
    assert [(s.speaker, s.start, s.end, s.members) for s in out] == [("a", 0, 5, (0,)), ("b", 5.2, 9, (1, 2))]
    # the left one of equals; what is still short goes on; too long a span or gap joins nothing
    assert [(s.speaker, s.end) for s in SG.attached(spans(("a", 0, 3), ("c", 3.5, 4), ("b", 4.5, 8)), 1, 1, 20)] == [("a", 4), ("b", 8)]
    assert [(s.speaker, s.start, s.end) for s in SG.attached(spans(("a", 0, 0.2), ("b", 0.3, 0.6), ("c", 0.7, 0.75)), 1, 1, 20)] == [("b", 0, 0.75)]
    assert len(SG.attached(spans(("a", 0, 19.9), ("b", 20, 20.5), ("b", 22, 30)), 1, 1, 20)) == 3
    none = np.zeros((0, 2))
    cut = lambda parts, quiet=none: SG.pieces(np.array(parts, float), 25, 28, 1, quiet)
    assert cut([(0, 10), (10.5, 18), (19.5, 30)]) == [(0, 18), (19.5, 30)] and cut([(0, 24)]) == [(0, 24)] and cut([(0, 27)]) == [(0, 27)]
    assert cut([(0, 40)], np.array([(9, 0.0), (17, 1.0), (18, 2.0)])) == [(0, 17), (17, 40)] and cut([(0, 40)]) == [(0, 20), (20, 40)]
    assert cut([(0, 13), (14, 27), (28, 40)]) == [(0, 13), (14, 27), (28, 40)] or cut([(0, 13), (14, 27), (28, 40)])[0] == (0, 13)
    df = spark.createDataFrame([(1, 0.0, 5.0, "a"), (1, 5.2, 5.6, "b"), (1, 6.0, 9.0, "b"), (2, 0.0, 70.0, "a")], "job long, start double, end double, speaker string")
    frames = spark.createDataFrame([(2, 30.0, 0.1), (2, 40.0, 0.2)], "job long, at double, energy double")
    got = [tuple(r) for r in SG.build_segments(df, 1, 0.1, 1, 45, 50.4, 0.2, frames).orderBy("job", "seq").collect()]
    assert got == [(1, 0, "a", 0.0, 5.1), (1, 1, "b", 5.1, 9.2), (2, 0, "a", 0.0, 30.0), (2, 1, "a", 30.0, 70.2)]


def test_split_regions(spark):
    points = SG.cut_points(0, 70, 20, 10, 30, np.array([(19.5, 3.0), (20.5, 1.0), (22.0, 0.0)]))
    assert points[0] == 20.5 and all(10 <= b - a <= 30 for a, b in zip([0, *points], points)) and 70 - points[-1] <= 30
    df = spark.createDataFrame([(1, 0.0, 70.0), (1, 80.0, 90.0), (2, 0.0, 31.0)], "job long, start double, end double")
    frames = spark.createDataFrame([(1, 20.5, 0.0)], "job long, at double, energy double")
    for levels in (None, frames):
        got = SG.split_regions(df, levels, 20, 10, 30).orderBy("job", "start").collect()
        assert sum(r.end - r.start for r in got) == 111 and all(r.end - r.start <= 30 for r in got) and len(got) == 6
        assert got[0].end == (20.0 if levels is None else 20.5)


def test_similarity():
    assert S.ratio("abcd", "abxd") == 75 and S.partial_ratio("bcd", "xabcdey") == 100
    assert S.token_set_ratio("pacient 48", "pacient 48 cardiologie") == 100 and S.token_sort_ratio("b a", "a b") == 100
    assert S.edit_counts("a b c d".split(), "a x c d e".split()) == (1, 0, 1)
    assert S.best_order([["c"], ["a", "b"]], ["a", "b", "c"]) == (1, 0)
    assert S.partial_span("bcx", "aabcdd") == (200 * 2 / 6, 1, 4) and S.partial_span("aabcdd", "bc") == (100, 0, 2) and S.partial_span("xyab", "abcd") == (200 * 2 / 6, 0, 2)
    for a, b in product(("", "ab", "abcab", "xyz", "xaybzab"), repeat=2):
        for least in (50.0, 80.0, 100.0):
            assert S.partial_ratio(a, b, least) in (S.partial_ratio(a, b), 0.0) and (S.partial_ratio(a, b, least) or S.partial_ratio(a, b) < least or not a or not b)
    for a, b in product(("", "ab", "abcab", "xyz"), repeat=2):
        s, d, i = S.edit_counts(a, b)
        assert len(a) - d + i == len(b) and S.lcs(a, b) == S.lcs(b, a)


def test_partial_ratio_skips_no_stretch(monkeypatch):
    def plain(a, b):
        stretches = [b[max(0, stop - len(a)) : stop] for stop in range(1, len(b) + len(a))]
        return max((S.ratio(a, x) for x in stretches if x), default=0.0)

    rng = random.Random(3)
    for _ in range(300):
        b, a = sorted(("".join(rng.choices("abcde", k=rng.randint(1, n))) for n in (40, 12)), key=len, reverse=True)
        assert S.partial_ratio(a, b) == plain(a, b), (a, b)
    # long texts: few stretches are looked at
    looked, one = [], S._lcs
    monkeypatch.setattr(S, "_lcs", lambda *x: looked.append(1) or one(*x))
    a, b = ("".join(rng.choices("abcdefghijklmnop ", k=n)) for n in (300, 3000))
    assert S.partial_ratio(a, b) > 0 and len(looked) < 1000


def test_languages(spark):
    pick = lambda **s: one(spark, L.pick_language(F.col("m"), "ro", "ru", 0.2), m={k: float(v) for k, v in s.items()})
    assert pick(ro=-0.5, ru=-0.4, en=-2) == "ro" and pick(ro=-0.7, ru=-0.4) == "ru" and pick(ro=-0.5, ru=-0.4, en=-0.45) == "ru" and pick(en=-0.1, ro=-0.2) == "en"
    assert one(spark, L.candidates(F.col("m"), ["ro", "ru"], ["ru"], 0.8), m={"en": 0.9}) == ["en"]
    assert one(spark, L.candidates(F.col("m"), ["ro", "ru"], ["ru"], 0.8), m={"ru": 0.9}) == ["ro", "ru"]
    assert one(spark, L.low_confidence(F.lit(None).cast("double"), -0.5), x="") is True


def test_glossary(tmp_path, spark):
    (tmp_path / "t.tsv").write_text("# note\nid\tcategory\tro\tru\ten\tabbr_ro\tabbr_ru\tabbr_en\thotword\nati\tward\treanimare|terapie intensivă\tреанимация\tintensive care\tATI\t\tICU\tro,en\n", encoding="utf-8")
    terms = G.load_terms(spark, f"{tmp_path}/t.tsv").collect()
    assert {(t.lang, t.text, t.abbr, t.hotword) for t in terms} >= {("ro", "reanimare", False, True), ("ro", "ATI", True, False), ("ru", "реанимация", False, False)}


def test_evaluation(spark):
    rows = [(1, ["a", "b"], ["a", "c", "d"]), (2, None, ["x"])]
    got = E.edit_columns(spark.createDataFrame(rows, "id int, r array<string>, h array<string>"), "r", "h").orderBy("id").collect()
    assert [(r.S, r.D, r.I, r.N) for r in got] == [(1, 0, 1, 2), (0, 0, 1, 0)]
    g = spark.createDataFrame([(1, "t", "latn", 1.0), (1, "t", "latn", 2.0), (1, "u", "latn", 5.0)], "job long, concept string, script string, at double")
    f = spark.createDataFrame([(1, "t", "latn", 2.5), (1, "t", "cyrl", 2.1), (1, "u", "cyrl", 5.0)], "job long, concept string, script string, at double")
    assert sorted((r.at, r.hit) for r in E.matched_terms(g, f).collect() if r.hit == r.hit and r.hit is not None) == [(1.0, 2.5)]
    gold = spark.createDataFrame([(1, 1, 0, ["c"]), (1, 1, 1, ["a", "b"])], "job long, cluster long, utt long, words array<string>")
    hyp = spark.createDataFrame([(1, 1, ["a", "b", "c"])], "job long, cluster long, words array<string>")
    r = E.cluster_errors(gold, hyp).first()
    assert (r.S, r.D, r.I, r.N) == (0, 0, 0, 3)


def test_guards(spark):
    runs = lambda *rows: spark.createDataFrame(rows, "job long, id long, start double, end double, lang string, text string")
    a, b = runs((1, 0, 0.0, 1.0, "ro", "x"), (1, 1, 1.0, 2.0, "ro", "y")), runs((1, 0, 0.0, 1.0, "ro", "x"), (1, 1, 1.0, 2.0, "ru", "z"))
    assert [(r.id, r.lang, r.other) for r in E.compared_runs(a, b).collect()] == [(1, "ro", "ru")]
    for other in (b.limit(1), b.withColumn("end", F.col("end") + 1)):
        with pytest.raises(Exception, match="segmentations differ"):
            E.compared_runs(a, other).collect()
    r = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "job long, setup string")
    assert E.single_setup(r, ["job"]).count() == 3
    with pytest.raises(Exception, match="several setups"):
        E.single_setup(r, []).collect()


def test_uniform_words(spark):
    u = spark.createDataFrame([(1, 0, 2.0, 4.0, ["a", "b"])], "job long, utt long, start double, end double, words array<string>")
    assert [r.at for r in E.uniform_words(u).orderBy("n").collect()] == [2.5, 3.5]
