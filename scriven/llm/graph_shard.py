"""One shard of a robust-pruned flat graph, in numpy: building it, and searching many queries of it side by side.

Vectors are rows of unit length. A search keeps the best `beam` vectors seen for each query, expands the best few that are
not expanded yet, and ends when all of the beam is. Range search then goes on from all vectors within the range to their
neighbours, until no new vector is within it: a group that is larger than the beam is found whole.
"""

from __future__ import annotations

import numpy as np

#: Out-neighbours kept by pruning; vectors kept in a search; how many of them are expanded in one step.
DEGREE, BEAM, STRIDE = 24, 48, 4
#: A neighbour is dropped if a kept one is closer to it by this factor than the vector itself.
ALPHA = 1.2
#: Slack of single precision in a search; what is found is verified in double precision.
SLACK = 1e-4
#: Components of the queries searched side by side (1,024 queries of 64), and pairs looked up at once.
BLOCK_CELLS, PAIRS = 1 << 16, 1 << 19


def block(x: np.ndarray) -> int:
    """How many queries are searched side by side."""
    return max(16, min(1024, BLOCK_CELLS // max(x.shape[1], 1)))


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def medoid(x: np.ndarray) -> int:
    """The vector closest to the mean of all."""
    return int(np.argmax(x @ x.mean(0)))


def searched(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int = BEAM, least: float = 2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Greedy search from entries (query x some): the ids in each query's beam, which vectors it has seen, and (query, vector) with a cosine of least."""
    n_q, n, near = len(queries), len(x), []
    seen = np.zeros((n_q, n + 1), bool)
    seen[:, n] = True  # stands for no neighbour
    ids = np.full((n_q, beam), n, np.int64)
    cos = np.full((n_q, beam), -np.inf, np.float32)
    done = np.ones((n_q, beam), bool)

    def merged(active, new):
        """New vectors of the active queries join their beams."""
        nonlocal ids, cos, done
        at = active[:, None]
        new = np.where(seen[at, new], n, new)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = n
        seen[at, new] = True
        some = new < n
        c = np.full(new.shape, -np.inf, np.float32)
        i, j = np.nonzero(some)
        c[i, j] = found = np.einsum("pd,pd->p", x[new[i, j]], queries[active[i]])
        near.append(np.column_stack([active[i], new[i, j]])[found >= least])
        all_ids, all_cos, all_done = np.hstack([ids[active], new]), np.hstack([cos[active], c]), np.hstack([done[active], ~some])
        best = np.argpartition(-all_cos, beam - 1, axis=1)[:, :beam]
        ids[active], cos[active], done[active] = (np.take_along_axis(a, best, 1) for a in (all_ids, all_cos, all_done))

    merged(np.arange(n_q), entries.copy())
    active = np.arange(n_q)
    while len(active):
        open_cos = np.where(done[active], -np.inf, cos[active])
        best = np.argpartition(-open_cos, STRIDE - 1, axis=1)[:, :STRIDE]
        some = np.take_along_axis(open_cos, best, 1) > -np.inf
        has = some.any(1)
        active, best, some = active[has], best[has], some[has]
        if not len(active):
            break
        chosen = np.where(some, ids[active[:, None], best], n)
        done[active[:, None], best] = True
        merged(active, graph[chosen].reshape(len(active), -1))
    return ids, seen, *np.concatenate(near).T


def pruned(x: np.ndarray, of: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning: the closest candidate of each vector is kept, those much closer to it than to the vector are dropped, and so on.

    candidates: (vectors x some) ids, len(x) for none, repeats allowed; returns (vectors x degree).
    """
    n = len(x)
    candidates = np.sort(candidates, axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = n
    candidates[candidates == of[:, None]] = n
    padded = np.vstack([x, np.zeros((1, x.shape[1]), x.dtype)])
    own = padded[candidates]
    cos = np.where(candidates < n, np.einsum("vcd,vd->vc", own, x[of]), -np.inf)
    order = np.argsort(-cos, axis=1)
    candidates, cos, own = np.take_along_axis(candidates, order, 1), np.take_along_axis(cos, order, 1), np.take_along_axis(own, order[:, :, None], 1)
    to_vector = _distance(np.where(candidates < n, cos, -1))
    between = _distance(own @ own.transpose(0, 2, 1))
    alive, out, row = candidates < n, np.full((len(of), degree), n, np.int64), np.arange(len(of))
    for k in range(degree):
        pick = np.argmax(alive, axis=1)
        some = alive[row, pick]
        if not some.any():
            break
        out[:, k] = np.where(some, candidates[row, pick], n)
        alive &= ~((alpha * between[row, pick] <= to_vector) & some[:, None])
        alive[row, pick] = False
    return out


def built(x: np.ndarray, seed: int = 1) -> np.ndarray:
    """The graph of x: (len(x) + 1) x DEGREE ids, len(x) for none. Two passes over batches, from a random graph."""
    n, rng = len(x), np.random.default_rng(seed)
    graph = np.full((n + 1, DEGREE), n, np.int64)
    if n <= DEGREE + 1:
        for i in range(n):
            graph[i, : n - 1] = [j for j in range(n) if j != i]
        return graph
    graph[:n, : DEGREE // 2] = rng.integers(0, n, (n, DEGREE // 2))
    start = medoid(x)
    for alpha in (1.0, ALPHA):
        for batch in np.array_split(rng.permutation(n), max(2, -(-n // block(x)))):
            ids, *_ = searched(x, graph, x[batch], np.column_stack([np.full(len(batch), start), batch]))
            graph[batch] = pruned(x, batch, np.hstack([ids, graph[batch]]), alpha=alpha)
            # each new edge also leads back; where there is no room the neighbours are pruned again
            to, back = graph[batch].ravel(), np.repeat(batch, DEGREE)
            to, back = to[to < n], back[to < n]
            order = np.argsort(to, kind="stable")
            to, back = to[order], back[order]
            nodes, first, count = np.unique(to, return_index=True, return_counts=True)
            place = np.arange(len(to)) - np.repeat(first, count)
            for lo in range(0, len(nodes), block(x)):
                some = slice(lo, lo + block(x))
                width = min(int(count[some].max()), 2 * DEGREE)  # a vector that many point to keeps the nearest of as many
                wide = np.full((len(nodes[some]), width), n, np.int64)
                own = (np.searchsorted(nodes, to) >= lo) & (np.searchsorted(nodes, to) < lo + block(x)) & (place < width)
                wide[np.searchsorted(nodes[some], to[own]), place[own]] = back[own]
                graph[nodes[some]] = pruned(x, nodes[some], np.hstack([graph[nodes[some]], wide]), alpha=alpha)
    return graph


def both_ways(graph: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges in either direction: (offsets, neighbours). Pruning leaves a dense group's edges at its centre, which has few of its own."""
    n = len(graph) - 1
    edges = np.column_stack([np.repeat(np.arange(n), graph.shape[1]), graph[:n].ravel()])
    edges = edges[edges[:, 1] < n]
    key = np.unique(np.concatenate([edges[:, 0] * n + edges[:, 1], edges[:, 1] * n + edges[:, 0]]))
    return np.searchsorted(key, np.arange(n + 1) * n), key % max(n, 1)


def in_range(x: np.ndarray, exact: np.ndarray, graph: np.ndarray, ways: tuple[np.ndarray, np.ndarray], queries: np.ndarray, entries: np.ndarray, least: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) for all vectors found with a cosine of least or more; x is exact, and queries are, in single precision for the search."""
    n, (offsets, targets), single = len(x), ways, queries.astype(np.float32)
    _, seen, q, at = searched(x, graph, single, entries, beam, least - SLACK)
    pairs_q, pairs_v = [q], [at]
    while len(q):
        new_q, new_v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        degree = offsets[at + 1] - offsets[at]
        part = np.cumsum(degree) // PAIRS
        for k in np.unique(part):
            lo, hi = np.searchsorted(part, [k, k + 1])
            d = degree[lo:hi]
            place = np.arange(d.sum()) - np.repeat(np.cumsum(d) - d, d)
            key = np.repeat(q[lo:hi], d) * (n + 1) + targets[np.repeat(offsets[at[lo:hi]], d) + place]
            key = np.unique(key[~seen.ravel()[key]])
            seen.ravel()[key] = True
            a, b = key // (n + 1), key % (n + 1)
            near = np.einsum("pd,pd->p", x[b], single[a]) >= least - SLACK
            new_q.append(a[near])
            new_v.append(b[near])
        q, at = np.concatenate(new_q), np.concatenate(new_v)
        pairs_q.append(q)
        pairs_v.append(at)
    q, at = np.concatenate(pairs_q), np.concatenate(pairs_v)
    right = [np.einsum("pd,pd->p", exact[at[lo : lo + PAIRS]], queries[q[lo : lo + PAIRS]]) >= least for lo in range(0, len(q), PAIRS)]
    right = np.concatenate(right) if right else np.zeros(0, bool)
    return q[right], at[right]
