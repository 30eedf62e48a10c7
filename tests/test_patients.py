from pyspark.sql import functions as F

from scriven.functions import repairs as R
from scriven.operators import packing as K
from scriven.operators import patients as P

TURNS = "job long, id long, start double, end double, line string, tokens_est long"
PROPOSALS = "job long, n long, at double, label string, cue string, not_before double"


def meeting(spark, lines, job=1, tokens=10):
    """lines: (second, text)"""
    return spark.createDataFrame([(job, i, float(s), s + 5.0, f"A: {t}", tokens) for i, (s, t) in enumerate(lines)], TURNS)


def proposed(spark, rows, job=1):
    return spark.createDataFrame([(job, i, float(r[0]), r[1], r[2] if len(r) > 2 else "", r[3] if len(r) > 3 else None) for i, r in enumerate(rows)], PROPOSALS)


def starts(spark, lines, rows, rule=P.Cutting()):
    cued = P.cued_turns(meeting(spark, lines))
    out = P.completed_starts(cued, P.chosen_starts(P.placed_proposals(cued, proposed(spark, rows)), rule), rule)
    return [(r.pos, r.label, r.how) for r in out.orderBy("pos").collect()]


WARD = [(3, "Să începem, patul opt"), (20, "febra a scăzut"), (41, "și tensiunea e bună"), (52, "Următorul, patul 9"), (80, "are tuse"), (100, "facem o radiografie")]


def test_starts_need_a_cue_in_what_was_said(spark):
    rows = [(3, "Pacient patul 8"), (41, "Pacient salonul 4"), (52, "Pacient patul 9")]
    assert starts(spark, WARD, rows) == [(0, "Pacient patul 8", "proposed"), (2, "Pacient salonul 4", "proposed")]  # the next line's words count
    cued = P.cued_turns(meeting(spark, [(s, t) for s, t in WARD if s != 52] + [(152, "Următorul, patul 9")]))
    chosen = P.chosen_starts(P.placed_proposals(cued, proposed(spark, [(3, "Pacient patul 8"), (41, "Pacient cu febră"), (152, "Pacient patul 9")])))
    assert [(r.pos, r.how) for r in chosen.orderBy("pos").collect()] == [(0, "proposed"), (2, "no cue"), (5, "proposed")]
    free = P.chosen_starts(P.placed_proposals(cued, proposed(spark, [(3, "Pacient patul 8"), (41, "Pacient cu febră")])), P.Cutting(cue=False))
    assert [r.how for r in free.collect()] == ["proposed", "proposed"]


def test_topic_after_a_patient_needs_its_own_cue(spark):
    lines = [(0, "Patul 8"), (40, "stentarea a mers bine"), (60, "fără febră"), (80, "punctul patru, gărzile"), (120, "bugetul e gata"), (160, "altceva")]
    rows = [(0, "Patul 8"), (40, "Intervenție: stentare"), (80, "Organizare: gărzi"), (160, "Echipamente: dozatoare")]
    assert [x[:2] for x in starts(spark, lines, rows)] == [(0, "Patul 8"), (3, "Organizare: gărzi"), (5, "Echipamente: dozatoare")]


def test_close_repeated_and_opening_starts(spark):
    lines = [(3, "primul caz"), (9, "patul 8"), (30, "bine"), (60, "tot patul 8"), (95, "următorul pacient, boxa"), (130, "gata")]
    rows = [(3, "Primul pacient"), (9, "Pacient patul 7"), (30, "Patul 8, pneumonie"), (61, "pat 8 – tuse"), (95, "Pacient din boxă"), (500, "Patul 2"), (2, ""), (None, "Patul 3")]
    rows = [r for r in rows if r[0] is not None]
    got = starts(spark, lines, rows)
    # the name within 90 seconds takes the opening over; what follows repeats it; the last is after the meeting
    assert [x[:2] for x in got] == [(0, "Patul 8, pneumonie"), (4, "Pacient din boxă")]


def test_places_announcements_and_what_comes_before(spark):
    lines = [(0, "bună ziua"), (100, "patul 8 acum"), (130, "boxa, da"), (140, "patul 8"), (200, "Punctul patru, puțin administrativ"), (230, "despre buget"), (300, "gata")]
    rows = [(100, "Pacient patul 8"), (230, "Organizare: buget")]
    assert starts(spark, lines, rows) == [
        (0, P.UNNAMED, "opening"), (1, "Pacient patul 8", "proposed"), (2, "Pacient boxă", "place"), (4, "Organizare: buget", "moved"),
    ]
    assert [x[0] for x in starts(spark, lines, rows, P.Cutting(places=False))] == [0, 1, 5]
    near = [(0, "s-a pornit"), (8, "patul 8"), (60, "patul 9")]
    assert [x[0] for x in starts(spark, near, [(8, "Patul 8")])] == [0, 2]
    assert starts(spark, near[:2], [(8, "Patul 8")]) == []


def test_windows_with_context(spark):
    turns, rows = meeting(spark, WARD, tokens=500), proposed(spark, [(3, "Pacient patul 8", "primul"), (52, "Pacient patul 9", "", 60.0), (53, "Pacient patul 9")])
    turns = turns.withColumn("extra", F.lit(1))
    got = [(r["index"], r.label, r.first, r.last, r.overlap_turns, r.start, r.end, r.tokens_est) for r in P.patient_windows(turns, rows).orderBy("index").collect()]
    assert got == [(0, "Pacient patul 8", 0, 1, 0, 3.0, 25.0, 1000), (1, "Pacient patul 8", 2, 2, 2, 41.0, 46.0, 1500), (2, "Pacient patul 9", 3, 4, 2, 52.0, 85.0, 2000), (3, "Pacient patul 9", 5, 5, 2, 100.0, 105.0, 1500)]
    none = spark.createDataFrame([], TURNS)
    assert P.patient_windows(none, rows).count() == 0 and P.patient_windows(turns, spark.createDataFrame([], PROPOSALS)).count() == 0


def test_parts_do_not_reach_back(spark):
    cued = P.cued_turns(meeting(spark, WARD))
    rows = proposed(spark, [(3, "Patul 8"), (20, "Patul 8", "", 50.0), (52, "Patul 9", "", 50.0)])
    assert [r.pos for r in P.placed_proposals(cued, rows).orderBy("pos").collect()] == [0, 3]


def test_places_and_keys(spark):
    texts = ["patru 12", "patologie 3 cazuri", "Patul nr. 9 și patul 9", "rezerva 4", "la boxa, apoi pacienta 31", "box 2, boxa", "салон, бокс", None, "Salonul 3"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(R.patient_ids(F.col("t"))).collect()]
    assert got == [[], [], ["pat:9"], ["rez:4"], ["pac:31", "box:"], ["box:2"], ["box:"], [], ["sal:3"]]
    keys = [("Apătul nou mei", "Patul 9"), ("Patul 9, tuse", "pat 9"), ("x", "în boxă"), ("x", "rezerva 2"), ("x", "pacientul 31"), ("x", "patul 1, salonul 2"), ("x", "gărzi"), ("x", "în boxa mare")]
    got = [r[0] for r in spark.createDataFrame(keys, "k string, l string").select(R.canonical_key(F.col("k"), F.col("l"))).collect()]
    assert got == ["Pacient patul 9", "Patul 9, tuse", "Pacient boxă", "Pacient rezerva 2", "Pacientul 31", "x", "x", "Pacient boxă"]
    pairs = [("Pacient patul 9, pneumonie", "Patul 9 – tuse", "", ""), ("A", "B", "patul 2", "pat 2"), ("Audit de igienă", "audit de igienă: noaptea", "", ""), ("Echipamente: ventilatoare", "Echipamente: dozatoare", "", ""), ("Patul 1", "gărzi", "", "")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string, x string, y string").select(R.same_patient(*map(F.col, "abxy"))).collect()]
    assert got == [True, True, True, False, False]


def test_null_jobs_are_one_job(spark):
    at = spark.createDataFrame([(None, 0.0, "a"), (None, 10.0, "b"), (None, 100000.0, "a"), (2**60 + 1, 1.0, None), (None, None, "c")], "job long, at double, entity string")
    assert sorted(map(tuple, K.thinned_starts(at, 1e6).collect()), key=str) == [(2**60 + 1, 1.0, None), (None, 0.0, "a")]
    regions = spark.createDataFrame([(None, 0.0, 5.0), (None, 6.0, None), (None, 7.0, 9.0), (None, None, 3.0)], "job long, start double, end double")
    assert [tuple(r) for r in K.packed_chunks(regions, 100, 20, 300, 40).collect()] == [(None, 0, 0.0, 9.0, 7.0)]
    lines = spark.createDataFrame([(None, 0, "a", "x"), (None, 1, "a", "y")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in K.capped_turns(lines, 100).collect()] == [(None, 0, "a", 0, 1, "x y")]


def test_null_jobs_in_segments(spark):
    from scriven.operators import segmentation as G

    regions = spark.createDataFrame([(j, a, b, "x") for j in (None, 1) for a, b in ((0.0, 4.0), (4.2, 9.0), (30.0, 31.0))], "job long, start double, end double, speaker string")
    got = sorted((tuple(r) for r in G.build_segments(regions, 1, 0.5, 2, 60, 90, 0.1).collect()), key=str)
    assert [r[1:] for r in got if r[0] is None] == [r[1:] for r in got if r[0] == 1] and len(got) >= 4


def test_error_norm(spark):
    from scriven.functions import text as T

    texts = ["Bună  ziua, 38-40 la 0.22!", "ÎNCEPEM_acum", "й ё é ﬁ", None, ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.error_norm(F.col("t"))).collect()]
    assert got == ["buna ziua 38 40 la 0 22", "incepem_acum", "и е e ﬁ", "", ""]
