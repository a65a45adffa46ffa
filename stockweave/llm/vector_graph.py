"""A flat proximity graph: robust pruning to build it, range-expanding search.

Everything here works on the vectors of one shard: unit rows in double precision.
Searches of many queries advance together, one expansion each at a time.
"""

from __future__ import annotations

import numpy as np

DEGREE, LIST, ALPHA, BATCH = 24, 48, 1.2, 256


def medoid(x: np.ndarray) -> int:
    """The vector nearest to the mean of all."""
    return int(np.argmax(x @ x.mean(axis=0)))


def greedy(x, graph, queries, starts, size: int, steps: int | None = None):
    """Best-first search of each query; ids and similarities of the ``size`` best seen.

    ``graph`` has a row of neighbours per vector, -1 where there is none;
    ``starts`` a row of places per query.
    """
    n, m = len(queries), len(x)
    seen = np.zeros((n, m + 1), bool)
    rows = np.arange(n)
    ids = np.full((n, size), -1)
    sims = np.full((n, size), -np.inf)
    done = np.ones((n, size), bool)

    def add(new):
        nonlocal ids, sims, done
        fresh = (new >= 0) & ~np.take_along_axis(seen, new, 1)
        # Of equal places in a row, the first counts.
        order = np.argsort(new, axis=1, kind="stable")
        ranked = np.take_along_axis(new, order, 1)
        again = np.zeros_like(fresh)
        again[:, 1:] = ranked[:, 1:] == ranked[:, :-1]
        np.put_along_axis(fresh, order, np.take_along_axis(fresh, order, 1) & ~again, 1)
        b, k = np.nonzero(fresh)
        node = new[b, k]
        seen[b, node] = True
        value = np.full(new.shape, -np.inf)
        value[b, k] = np.einsum("ij,ij->i", queries[b], x[node])
        all_ids = np.concatenate([ids, np.where(fresh, new, -1)], axis=1)
        all_sims = np.concatenate([sims, value], axis=1)
        all_done = np.concatenate([done, ~fresh], axis=1)
        best = np.argsort(-all_sims, axis=1, kind="stable")[:, :size]
        ids, sims, done = (np.take_along_axis(a, best, 1) for a in (all_ids, all_sims, all_done))

    add(starts)
    for _ in range(steps or 4 * size):
        open_ = ~done
        if not open_.any():
            break
        pick = np.argmax(open_, axis=1)  # lists are sorted: the best open one
        active = open_[rows, pick]
        done[rows, pick] = True
        node = np.where(active, ids[rows, pick], -1)
        add(np.where(active[:, None], graph[node], -1))
    return ids, sims


def prune(x, nodes, candidates, degree: int, alpha: float):
    """For each node, neighbours such that none lies much nearer to a nearer one."""
    n, width = candidates.shape
    valid = (candidates >= 0) & (candidates != nodes[:, None])
    vectors = x[candidates]
    to_node = np.where(valid, 2 - 2 * np.einsum("ij,ikj->ik", x[nodes], vectors), np.inf)
    between = 2 - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    out = np.full((n, degree), -1)
    rows = np.arange(n)
    for k in range(degree):
        best = np.argmin(to_node, axis=1)
        there = np.isfinite(to_node[rows, best])
        if not there.any():
            break
        out[:, k] = np.where(there, candidates[rows, best], -1)
        # Squared distances; a candidate goes if the one taken is alpha times nearer.
        drop = alpha * between[rows, best] <= to_node
        drop |= candidates == candidates[rows, best][:, None]
        to_node = np.where(drop & there[:, None], np.inf, to_node)
    return out


def build(x: np.ndarray, seed: int = 0, degree=DEGREE, size=LIST, alpha=ALPHA) -> np.ndarray:
    """Neighbours of each vector of a shard."""
    m = len(x)
    rng = np.random.default_rng(seed)
    if m == 1:
        return np.full((1, degree), -1)
    graph = rng.integers(0, m, (m, degree))
    graph[graph == np.arange(m)[:, None]] = -1
    graph = np.concatenate([graph, np.full((1, degree), -1)])  # the row of no vector
    start = medoid(x)
    for slack in (1.0, alpha):
        order = rng.permutation(m)
        for k in range(0, m, BATCH):
            nodes = order[k : k + BATCH]
            found, _ = greedy(x, graph, x[nodes], np.full((len(nodes), 1), start), size)
            graph[nodes] = prune(
                x, nodes, np.concatenate([found, graph[nodes]], axis=1), degree, slack
            )
            _link_back(x, graph, nodes, degree, slack)
    return graph[:-1]


def _link_back(x, graph, nodes, degree: int, alpha: float) -> None:
    """Give the neighbours of ``nodes`` an edge back, pruning where lists are full."""
    to = graph[nodes].reshape(-1)
    of = np.repeat(nodes, degree)
    of, to = of[to >= 0], to[to >= 0]
    order = np.argsort(to, kind="stable")
    of, to = of[order], to[order]
    targets, first, counts = np.unique(to, return_index=True, return_counts=True)
    for k in range(0, len(targets), BATCH):
        part = slice(k, k + BATCH)
        width = int(counts[part].max())
        extra = np.full((len(targets[part]), width), -1)
        for i, (a, c) in enumerate(zip(first[part], counts[part], strict=True)):
            extra[i, :c] = of[a : a + c]
        graph[targets[part]] = prune(
            x, targets[part], np.concatenate([graph[targets[part]], extra], axis=1)[:, : 4 * degree],
            degree, alpha,
        )


def range_links(x: np.ndarray, neighbours: list[np.ndarray], least: float, size: int = LIST):
    """Pairs (i < j) of a shard with similarity >= ``least``.

    Every vector asks: a greedy search from the medoid, then all neighbours of what
    lies in range are looked at, until nothing new is in range. Each vector also
    starts from its own place. Pruning leaves the copies of a vector with an edge to
    it, but few edges back, so in range edges are followed both ways. A pair is found
    if either side finds it.
    """
    m = len(x)
    of = np.repeat(np.arange(m), [len(n) for n in neighbours])
    to = np.concatenate(neighbours).astype(int) if m else np.zeros(0, int)
    edges = np.unique(np.concatenate([of * m + to, to * m + of]))
    ends = edges % m
    begin = np.searchsorted(edges, np.arange(m + 1) * m)
    width = max([1, *map(len, neighbours)])
    graph = np.full((m + 1, width), -1)
    for i, n in enumerate(neighbours):
        graph[i, : len(n)] = n
    start = medoid(x)
    left, right = [], []
    for k in range(0, m, BATCH):
        nodes = np.arange(k, min(m, k + BATCH))
        starts = np.stack([np.full(len(nodes), start), nodes], axis=1)
        ids, sims = greedy(x, graph, x[nodes], starts, size)
        known = np.zeros((len(nodes), m + 1), bool)
        known[np.repeat(np.arange(len(nodes)), size), ids.reshape(-1)] = True
        near = (sims >= least - 1e-9) & (ids >= 0)
        b, at = np.nonzero(near)
        b, node = b, ids[b, at]
        while len(b):
            left.append(nodes[b])
            right.append(node)
            # The neighbours of what was found, each once per query.
            n_edges = begin[node + 1] - begin[node]
            bb = np.repeat(b, n_edges)
            skip = np.repeat(begin[node] - np.cumsum(n_edges) + n_edges, n_edges)
            nn = ends[np.arange(n_edges.sum()) + skip]
            new = ~known[bb, nn]
            code = np.unique(bb[new] * m + nn[new])
            b, node = code // m, code % m
            known[b, node] = True
            inside = np.einsum("ij,ij->i", x[nodes[b]], x[node]) >= least - 1e-9
            b, node = b[inside], node[inside]
    i, j = (np.concatenate(a) if a else np.zeros(0, int) for a in (left, right))
    code = np.unique((np.minimum(i, j) * m + np.maximum(i, j))[i != j])
    return code // m, code % m
