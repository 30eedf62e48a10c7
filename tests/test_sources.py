import json

import pytest

from scriven.sources import readers as R
from scriven.sources import sinks
from scriven.streaming import inbox


def test_log_with_torn_tail(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\n{"id": 1, "t": "y"}\n{"id": 2, "t": "z"}\n{"id": 3, "t"')
    assert sorted((r.id, r.t) for r in R.jsonl_log(spark, f"{tmp_path}/a.jsonl", "id long, t string").collect()) == [(1, "y"), (2, "z")]


def test_long_log_is_read_in_parts(spark, tmp_path):
    """Byte ranges of several tasks, a torn line in the middle, an older record of a key, a second log without a fault."""
    rows = [json.dumps({"id": i % 30_000, "t": f"{i} " + "x" * (i % 40)}) for i in range(40_000)]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.jsonl").write_text("\ufeff" + "\n".join(rows[:35_000]) + '\n{"id": 1, "t"\n' + "\n".join(rows[35_000:]))
    (tmp_path / "logs" / "b.jsonl").write_text('{"id": 7, "t": "b"}\r\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        log = R.jsonl_log(spark, f"{tmp_path}/logs", "id long, t string")
        assert spark.read.text(f"{tmp_path}/logs").rdd.getNumPartitions() > 4
        got = sorted((r.id, int(r.t.split()[0])) for r in log.where("t <> 'b'").collect())
        assert got == [(i, i + 30_000 if i < 5000 else i) for i in range(30_000)] and log.count() == 30_001
        back = R.recovered_log(spark, f"{tmp_path}/logs/a.jsonl", "id long, t string", f"{tmp_path}/good")
        assert back.count() == 35_000
        parts = sorted((tmp_path / "good").glob("part-*"))
        assert "".join(p.read_text() for p in parts).splitlines() == rows[:35_000]
        (tmp_path / "l.txt").write_text("\n".join(f"{i}\t{i + 1}\tn{i}" for i in range(60_000)))
        assert [r.text for r in R.labels(spark, f"{tmp_path}/l.txt").orderBy("n").collect()] == [f"n{i}" for i in range(60_000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_labels(spark, tmp_path):
    (tmp_path / "l.txt").write_text("0,5\t1.25\tda\n\\\t100\t200\n# no\n\n2\t3\n")
    assert [(r.start, r.end, r.text) for r in R.labels(spark, f"{tmp_path}/l.txt").orderBy("n").collect()] == [(0.5, 1.25, "da"), (2, 3, "")]
    (tmp_path / "bad.txt").write_text("x\t1\n")
    with pytest.raises(Exception, match="not a label"):
        R.labels(spark, f"{tmp_path}/bad.txt").collect()


def test_reference_and_meeting(spark, tmp_path):
    (tmp_path / "r.txt").write_text("# fragment 0:00-1:32\n[Speaker 1] 0:00 - 0:15,5: bună\n# fragment 2:00-3:00\n[B] 2:01 - 2:02: da\n")
    got = R.reference(spark, f"{tmp_path}/r.txt").orderBy("n").collect()
    assert [(r.speaker, r.start, r.end, r.fragment_start, r.fragment_end) for r in got] == [("Speaker1", 0, 15.5, 0, 92), ("B", 121, 122, 120, 180)]
    (tmp_path / "m.txt").write_text("# date: 2024-01-02\n[00:05] DR: salut [?]\n\nfără etichetă\n")
    got = R.meeting(spark, f"{tmp_path}/m.txt").orderBy("n").collect()
    assert [(r.speaker, r.ts, r.text, r.low, r.pause) for r in got] == [("DR", "00:05", "salut", True, 0.0), ("UNK", None, "fără etichetă", False, 15.0)]
    assert R.settings(spark, f"{tmp_path}/m.txt").first().value == "2024-01-02"


def test_shapes_and_names(spark):
    from pyspark.sql import functions as F

    rows = [('{"turns": []}',), ('[{"line": "x"}]',), ('[{"text": "x"}]',), ("3",)]
    assert [r[0] for r in spark.createDataFrame(rows, "j string").select(R.shape_of(F.col("j"))).collect()] == ["envelope", "turns", "segments", None]
    r = spark.createDataFrame([("class-5__discipline-bio.wav",)], "n string").select(*R.filename_fields(F.col("n"), ["class", "discipline"])).first()
    assert tuple(r) == ("5", "bio")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b|c")], "job long, decision string")
    assert sinks.append_ledger(df, f"{tmp_path}/l").count() == 2 and sinks.append_ledger(df, f"{tmp_path}/l").count() == 4
    assert [r.line for r in sinks.markdown_table(df).collect()] == ["| job | decision |", "|---|---|", "| 1 | a |", "| 2 | b\\|c |"]


def test_replaced_json_keeps_the_old_until_the_new_is_whole(spark, tmp_path):
    path = f"{tmp_path}/out"
    for rows in ([(1,)], [(2,), (3,)]):
        sinks.write_json(spark.createDataFrame(rows, "x long"), path)
        assert sorted(r.x for r in spark.read.json(path).collect()) == [x for (x,) in rows]
    with pytest.raises(Exception, match="no rows today"):
        sinks.write_json(spark.range(1).selectExpr("raise_error('no rows today') AS x"), path)
    assert spark.read.json(path).count() == 2 and len([p for p in tmp_path.iterdir() if ".old" in p.name]) == 0


def test_minutes_pages(spark):
    cases = spark.createDataFrame([(1, 0, "Caz <1>", "temă", "rezumat", "relative", "joi", None), (1, 1, "Gol", "", "", "none", None, None)], "job long, case_no long, case_key string, topic string, summary string, eta_type string, eta_raw string, eta_condition string")
    decisions = spark.createDataFrame([(1, 0, 0, 4, 65.0, "a & b", "aprobat", "q", True, None), (1, 0, 1, None, 70.0, "c", "respins", "", False, "quote not found")], "job long, case_no long, place int, turn_id long, at double, decision string, status string, quote string, superseded boolean, flag string")
    facts = spark.createDataFrame([(1, 0, 0, "analize", "f1", 5.0), (1, 0, 1, "istoric", "f2", None)], "job long, case_no long, place int, category string, fact string, at double")
    questions = spark.createDataFrame([(1, 0, 0, "când?")], "job long, case_no long, place long, question string")
    page = sinks.minutes_html(cases, decisions, facts, questions).first().html
    for part in ("<h2>1. Caz &lt;1&gt; — temă</h2><p>rezumat</p>", "<tr><th>Diagnostic și istoric</th><td>f2 [00:00]</td></tr><tr><th>Paraclinic</th><td>f1 [00:05]</td></tr>", "<li><em>decis</em> <s>a &amp; b</s> [01:05]<q>q</q></li>", "<li><em>respins</em> c [01:10]<div>Termen: joi</div><div>⚠ quote not found</div></li>", "<li>când?</li>", "<h2>2. Gol</h2><p>Fără decizii noi.</p>", "<h2>Note pentru verificare</h2><ul><li>⚠ c: quote not found</li></ul>"):
        assert part in page
    moved = sinks.moved_note(spark.createDataFrame([(1, "x"), (1, "y"), (1, None), (2, None)], "job long, moved_from string"))
    got = sinks.minutes_markdown(cases, decisions, facts, questions, moved).first().markdown
    assert got == """# Proces-verbal al ședinței

## Puncte discutate

### 1. Caz <1> — temă

_rezumat_

**Diagnostic și istoric:**
- f2 [00:00]

**Paraclinic:**
- f1 [00:05]

**Plan / decizii:**
- **decis**: ~~a & b~~ (modificată ulterior) [01:05]
  - _sursa: „q”_
- **respins**: c — termen: joi [01:10] ⚠

**În așteptare / de clarificat:**
- când?

### 2. Gol

**Plan / decizii:**
- fără decizii noi

## Note pentru verificare

- ⚠ Punctul 1 (Caz <1>), decizia [01:10]: quote not found.
- ⚠ 2 decizii au fost mutate automat la pacientul discutat în acel moment.
"""
    assert sinks.minutes_markdown(cases, decisions, facts, questions).first().markdown.endswith("quote not found.\n")
    turns = spark.createDataFrame([(1, 4, 65.0, "linia 4"), (1, 5, 71.0, "linia 5")], "job long, id long, start double, line string")
    sheet = sinks.verification_sheet(cases, decisions, turns).first().sheet
    assert "`linia 4`" in sheet and sheet.index("`linia 5`") > sheet.index("- c: respins") and sheet.endswith("## 2. Gol\n[ ] caz identificat corect") and "a & b (înlocuită): aprobat" in sheet


def test_stages_run_once(spark, tmp_path):
    from scriven.streaming.stages import Stages

    runs = []
    make = lambda n: lambda: (runs.append(n), spark.range(n))[1]
    s = Stages(spark, f"{tmp_path}/a")
    assert s.run("one", make(2)).count() == 2 and s.run("one", make(9)).count() == 2 and runs == [2]
    with pytest.raises(Exception, match="boom"):
        s.run("two", lambda: spark.range(1).selectExpr("raise_error('boom') AS x"))
    assert not s.done("two") and s.run("two", make(3)).count() == 3
    assert {(r.stage, r.status) for r in s.ledger().collect()} == {("one", "done"), ("two", "done")}
    v = s.variant(f"{tmp_path}/b", ["one"])
    assert v.run("one", make(7)).count() == 2 and v.run("two", make(5)).count() == 5 and s.run("two", make(1)).count() == 3


def test_inbox_takes_each_record_once(spark, tmp_path):
    for p in ("in", "seen"):
        (tmp_path / p).mkdir()
    seen = []
    put = lambda n, rows: (tmp_path / "in" / f"{n}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    go = lambda: inbox.watch(spark, f"{tmp_path}/in", "job long, id long", f"{tmp_path}/state", f"{tmp_path}/ck", lambda b: seen.extend((r.job, r.id) for r in b.collect())).awaitTermination(120)
    put(1, [{"job": 1, "id": 1}, {"job": 1, "id": 1}, {"job": 2, "id": 1}])
    go()
    put(2, [{"job": 1, "id": 1}, {"job": 1, "id": 2}])
    go()
    assert sorted(seen) == [(1, 1), (1, 2), (2, 1)]
    assert {(r.job, r.status) for r in inbox.current_states(spark, f"{tmp_path}/state").collect()} == {(1, "done"), (2, "done")}


def test_a_failed_batch_comes_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put = lambda n, rows: (tmp_path / "in" / f"{n}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    seen, broken = [], [True]

    def process(batch):
        seen.append(sorted((r.job, r.id) for r in batch.collect()))
        if broken[0]:
            raise ValueError("boom")

    def go():
        inbox.watch(spark, f"{tmp_path}/in", "job long, id long", f"{tmp_path}/state", f"{tmp_path}/ck", process).awaitTermination(120)

    put(1, [{"job": 1, "id": 1}, {"job": 2, "id": 1}])
    with pytest.raises(Exception, match="boom"):
        go()
    assert {(r.job, r.status) for r in inbox.current_states(spark, f"{tmp_path}/state").collect()} == {(1, "failed"), (2, "failed")}
    broken[0] = False
    put(2, [{"job": 1, "id": 1}, {"job": 3, "id": 1}])
    go()
    go()
    assert seen == [[(1, 1), (2, 1)], [(1, 1), (2, 1)], [(3, 1)]]
    assert {(r.job, r.batch) for r in spark.read.parquet(f"{tmp_path}/state").where("status = 'failed'").collect()} == {(1, 0), (2, 0)}
    assert {(r.job, r.status) for r in inbox.current_states(spark, f"{tmp_path}/state").collect()} == {(1, "done"), (2, "done"), (3, "done")}
