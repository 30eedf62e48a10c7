import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from scriven.llm import packing as P


def held(rows, docs):
    """The contract, row by row, against direct encoding."""
    tok = Tokenizer.from_file(P.word_vocabulary())
    tok.encode_special_tokens = True
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in docs}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert by_doc.keys() == ids.keys()
    for i, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.length > 0
            at += p.length
        assert at == len(ids[i])
    padding = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= P.WINDOW
        padding += 0 if at & (at - 1) == 0 else P.WINDOW - at
    return padding, by_seq


@pytest.mark.parametrize(("n", "most"), [(1, 10), (300, 900), (60, 9000), (200, 3), (400, 3000)])
def test_each_id_once_and_no_padding(spark, tmp_path, n, most):
    rng = random.Random(n)
    docs = [(i, " ".join("w%d" % rng.randrange(9) for _ in range(int(most * rng.random() ** 2)))) for i in range(n)] + [(-1, None), (None, "x")]
    spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, start int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    padding, _ = held(P.op6_packing(spark, str(tmp_path)).collect(), docs)
    assert padding == 0


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert P.op6_packing(spark, str(tmp_path)).count() == 0


def test_least_squares_meets_its_conditions():
    rng = np.random.default_rng(0)
    a, b = rng.random((12, 30)), rng.random(12) * 5 - 1
    x = P.nonnegative_least_squares(a, b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and (slope < 1e-7).all() and np.abs(slope[x > 0]).max() < 1e-7


def test_plan_uses_counts_and_leaves_room_fillable():
    counts = np.random.default_rng(1).integers(0, 5000, P.BINS)
    chosen, ways, shortest = P.plan(counts), P.fillings(), np.arange(P.BINS) * P.UNIT + 1
    left = counts - ways @ chosen.repeats
    assert (left >= 0).all() and left @ shortest >= (P.WINDOW - shortest @ ways) @ chosen.repeats
    assert (ways @ chosen.repeats).sum() > 0.6 * counts.sum()
