import numpy as np
import pytest

from scriven.llm import flat_graph as FG
from scriven.llm import graph_shard as G
from scriven.llm.common import NULL_ID

SCHEMA = "vec_id long, embedding array<double>, label int, key string, held string, node string, top string"


def clustered(rng, n, dim, groups, spread):
    """n random directions and groups of near copies of some of them."""
    x = rng.normal(size=(n, dim))
    for size in groups:
        x = np.vstack([x, x[rng.integers(n)] + spread * rng.normal(size=(size, dim))])
    return x[rng.permutation(len(x))]


def brute(rows):
    """(n_links, component) of each row, by all pairs."""
    usable = [lab is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v or []) for _, v, lab in rows]
    unit = [np.asarray(v) / np.linalg.norm(np.asarray(v) / np.abs(v).max()) / np.abs(v).max() if u else None for (_, v, _), u in zip(rows, usable)]
    keys = [NULL_ID if r[0] is None else r[0] for r in rows]
    links, comp = [0] * len(rows), list(keys)
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.93]
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    while True:
        before = list(comp)
        for i, j in pairs:
            comp[i] = comp[j] = min(comp[i], comp[j])
        if comp == before:
            return sorted(zip(keys, links, comp))


def query(spark, rows, cap):
    df = spark.createDataFrame([(i, v, lab, "x", "x", "x", "x") for i, v, lab in rows], SCHEMA)
    return sorted((r.key, r.n_links, r.component) for r in FG.near_duplicates(df, cap).collect())


@pytest.mark.parametrize("cap", [48, FG.CAP])
def test_against_all_pairs(spark, cap):
    rng = np.random.default_rng(3)
    x = clustered(rng, 500, 24, [60, 2, 2, 3, 5, 120, 2], 0.12)
    rows = [(int(i) * 7, [float(c) for c in v], int(i) % 3 if i % 11 else 1) for i, v in enumerate(x)]
    rows += [(100_000 + k, rows[5][1], rows[5][2]) for k in range(150)] + rows[:3]
    got, true = query(spark, rows, cap), brute(rows)
    assert sum(r[1] for r in got) >= 0.97 * sum(r[1] for r in true)
    assert all(g[1] <= t[1] for g, t in zip(got, true))
    if cap == FG.CAP:
        assert got == true
    else:
        assert sum(g != t for g, t in zip(got, true)) < 0.03 * len(true)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    a, big = [1.0, 0.0, 0.1], [1e200, 0.0, 1e199]
    rows = [(1, a, None), (2, None, 1), (3, [], 1), (4, [0.0, 0.0, 0.0], 1), (5, [1.0, None, 0.0], 1), (6, [nan, 1.0, 0.0], 1), (7, [inf, 1.0, 0.0], 1)]
    rows += [(8, a, 1), (9, big, 1), (10, [1.0, 0.0], 1), (11, [-1.0, 0.0, 0.0], 1), (8, a, 1), (None, [1.0, 0.0, 0.05], 2), (None, [0.0, 1.0, 0.0], 2), (50, [1.0, 0.0, 0.0], 2), (12, a, 3)]
    assert query(spark, rows, FG.CAP) == brute(rows)
    assert query(spark, [], FG.CAP) == []


def test_dense_group_larger_than_the_beam():
    rng = np.random.default_rng(1)
    x = clustered(rng, 900, 64, [400], 0.01)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = G.built(x.astype(np.float32))
    assert (graph[:-1] != np.arange(len(x))[:, None]).all()
    own = np.arange(len(x))
    q, v = G.in_range(x.astype(np.float32), x, graph, G.both_ways(graph), x, np.column_stack([np.full(len(x), G.medoid(x)), own]), 0.93)
    true = np.argwhere(x @ x.T >= 0.93)
    assert len({*zip(q.tolist(), v.tolist())} & {*map(tuple, true.tolist())}) >= 0.99 * len(true)
    assert ((x[q] * x[v]).sum(1) >= 0.93).all()


def test_pruning_keeps_the_nearest_and_drops_what_it_covers():
    angles = np.radians([0, 1, 2, 3, 180])
    x = np.column_stack([np.cos(angles), np.sin(angles)]).astype(np.float32)
    out = G.pruned(x, np.array([0]), np.array([[1, 2, 3, 4, 5]]), degree=3, alpha=1.0)
    assert out[0].tolist() == [1, 4, 5] or out[0].tolist() == [1, 5, 5]
