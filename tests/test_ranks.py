import random
from collections import Counter

import numpy as np

from scriven.operators import packing as K
from scriven.operators import ranks as N


def test_quantiles_against_numpy(spark):
    rng = random.Random(1)
    for values in ([5.0], [1.0, 1.0, 1.0], [rng.gauss(0, 1) ** 9 for _ in range(3000)], [float(rng.randint(0, 9)) for _ in range(500)], [1e-300, 1.0, 1e300, -1e300, 2.0]):
        df = spark.createDataFrame([(v,) for v in [*values, None, float("nan"), float("inf")]], "v double")
        shares = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]
        assert np.allclose(N.exact_quantiles(df, "v", shares), np.quantile(values, shares), rtol=1e-12)
    assert N.exact_quantiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]


def test_hash_ranks(spark):
    rows = [(k, i) for k, n in (("a", 3000), ("b", 7), (None, 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i long").withColumn("h", N.hashed("s", "k", "i"))
    got = N.hash_ranked(df, ["k"], "h", ["i"], "r").collect()
    for key in ("a", "b", None):
        own = sorted((r for r in got if r.k == key), key=lambda r: (r.h, r.i))
        assert [r.r for r in own] == list(range(len(own)))


def test_blocks(spark):
    rows = [("ro", i) for i in range(1234)] + [("ru", i) for i in range(57)] + [("en", 1), (None, 3), (None, 4)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "lang string, id long, block string").drop("block")
    got = sorted(N.block_shuffled(df, "lang", "id").collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(rows))) and len({(r.lang, r.id) for r in got}) == len(rows)
    runs = Counter((r.lang, r.block) for r in got)
    assert set(runs.values()) <= {1, 2, 3, 4} and len(set(runs.values())) == 4
    for a, b in zip(got, got[1:]):  # a block stands together, its rows in order
        assert (a.lang, a.block) != (b.lang, b.block) or b.place == a.place + 1
    assert [r.id for r in N.block_shuffled(df, "lang", "id", "8").orderBy("position").limit(20).collect()] != [r.id for r in got[:20]]


def test_given_times(spark):
    rows = [(1, 0, "x" * 13, None, 500, None), (1, 1, "y" * 130, None, None, None), (1, 2, "z", 20_000, 9000, 3000), (1, 3, "z", 21_000, None, None), (1, 4, None, 20_950, None, 0), (None, 0, "a", None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, at_ms long, pause_ms long, dur_ms long")
    got = [(r.conv_id, r.turn, r.start_ds, r.end_ds) for r in K.with_given_clock(df).orderBy("conv_id", "turn").collect()]
    # the second end would pass the third start's 0.2 s only if closer; the third and fourth are cut, half a second at least is left
    assert got == [(None, 0, 10, 30), (1, 0, 15, 35), (1, 1, 43, 143), (1, 2, 200, 208), (1, 3, 210, 215), (1, 4, 210, 230)]
