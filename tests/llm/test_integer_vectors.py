"""Centroid clustering and vector codes against plain versions."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from stockweave.llm import dual_tree, product_codes
from stockweave.llm.centroids import OutwardSearch, cluster_vectors
from stockweave.llm.dual_tree import BoxTree
from stockweave.llm.product_codes import compress_vectors

SCHEMA = (
    "vec_id long, embedding array<float>, label int, id string, codes int, cluster string, "
    "error int, `odd.name` int"
)
MORE = ("x", 1, "y", 2, 3)


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, *MORE) for r in rows], schema)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 0.2, (6, 64))
    x = centres[rng.integers(0, 6, 300)] + rng.normal(0, 0.05, (300, 64))
    rows = [(1000 - i, [float(c) for c in v], int(i % 4)) for i, v in enumerate(x)]
    rows += [rows[5], rows[5], (7, rows[9][1], None), (8, rows[9][1], None)]
    rows += [(None, rows[11][1], 2), (None, rows[12][1], None), (9, [0.0] * 64, 1)]
    rows += [(10, None, 1), (11, [], 1), (12, [1.0] * 63, 1), (13, [None] + [0.0] * 63, 1)]
    rows += [(14, [float("nan")] + [0.0] * 63, 1), (15, [float("inf")] + [0.0] * 63, None)]
    return rows


def integers(rows):
    out = []
    for i, v, label in rows:
        if v is None or len(v) != 64 or any(c is None or not np.isfinite(c) for c in v):
            continue
        x = np.floor(np.array(v, np.float32).astype(np.float64) * 256).astype(np.int64)
        out.append((i, label, x))
    return out


def nearest(x, entries):
    return ((x[:, None] - entries[None]) ** 2).sum(-1)


def lloyd(x, start, rounds):
    for _ in range(rounds):
        which = nearest(x, start).argmin(1)
        start = np.array(
            [x[which == c].sum(0) // (which == c).sum() if (which == c).any() else start[c]
             for c in range(len(start))]
        )
    distance = nearest(x, start)
    return start, distance.argmin(1), distance.min(1)


def plain_clusters(rows, k, rounds):
    kept = integers(rows)
    named = [
        (hashlib.sha256(f"2:{i}".encode()).hexdigest(), x.tolist())
        for i, _, x in kept if i is not None
    ]
    start = np.array([x for _, x in sorted(named)[:k]])
    x = np.array([r[2] for r in kept])
    centres, which, distance = lloyd(x, start, rounds)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    return sorted(
        [(i or -1, int(c), int(d), int(distance[which == c].sum()), int(distance.sum()), sha[c])
         for (i, _, _), c, d in zip(kept, which, distance, strict=True)]
    )


def plain_codes(rows, parts, entries, rounds):
    kept = integers(rows)
    first = sorted((i, x.tolist()) for i, _, x in kept if i is not None)[:entries]
    x = np.array([r[2] for r in kept])
    width = 64 // parts
    codes, errors, books = [], np.zeros(len(x), np.int64), []
    for p in range(parts):
        cut = slice(p * width, (p + 1) * width)
        start = np.array([v[cut] for _, v in first])
        book, which, distance = lloyd(x[:, cut], start, rounds)
        codes.append(which)
        errors += distance
        books += book.ravel().tolist()
    by_label = defaultdict(int)
    for (_, label, _), e in zip(kept, errors, strict=True):
        by_label[label] += int(e)
    sha = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    return sorted(
        (i or -1, "".join(f"{c[n]:02x}" for c in codes), int(errors[n]), by_label[label], sha)
        for n, (i, label, _) in enumerate(kept)
    )


def got(df):
    return sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in df.collect())


@pytest.mark.parametrize(("k", "rounds"), [(40, 5), (3, 2), (1000, 2), (5, 0)])
def test_clusters(spark, vectors, k, rounds):
    out = cluster_vectors(table(spark, vectors), k=k, rounds=rounds)
    assert out.columns[:3] == ["vec_id", "cluster", "distance"]
    assert got(out) == plain_clusters(vectors, k, rounds)


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(16, 64, 2), (8, 200, 1), (64, 3, 2)])
def test_codes(spark, vectors, monkeypatch, parts, entries, rounds):
    monkeypatch.setattr(product_codes, "SLICE", 90)  # tasks with several slices
    out = compress_vectors(table(spark, vectors), parts=parts, entries=entries, rounds=rounds)
    assert got(out) == plain_codes(vectors, parts, entries, rounds)


def test_codes_when_labels_are_too_many_to_broadcast(spark, vectors, monkeypatch):
    monkeypatch.setattr(product_codes, "BROADCAST_ROWS", 0)
    out = compress_vectors(table(spark, vectors), label="id")
    plain = plain_codes([(i, v, "x") for i, v, _ in vectors], 16, 64, 2)
    assert got(out) == plain


def test_nothing_to_cluster(spark, vectors):
    for rows in ([], vectors[-6:], [(None, None, None)]):
        assert cluster_vectors(table(spark, rows)).collect() == []
        assert compress_vectors(table(spark, rows)).collect() == []
    # Vectors without an id start nothing, so there is nothing to be nearest to.
    only = [(None, [0.5] * 64, 1)]
    assert cluster_vectors(table(spark, only)).collect() == []
    assert compress_vectors(table(spark, only)).collect() == []


def test_components_too_large_fail(spark):
    rows = table(spark, [(1, [70_000.0] + [0.0] * 63, 1)])
    with pytest.raises(Exception, match="a component times 256"):
        cluster_vectors(rows).collect()


def test_outward_search_is_exact_and_skips():
    rng = np.random.default_rng(1)
    centres = rng.integers(-300, 300, (50, 1)) + rng.integers(-20, 20, (50, 64))
    centres[9] = centres[4]  # a tie: the smaller number wins
    x = centres[rng.integers(0, 50, 2000)] + rng.integers(-30, 30, (2000, 64))
    search = OutwardSearch(centres)
    number, distance = search.nearest(x)
    want = nearest(x, centres)
    assert (number == want.argmin(1)).all() and (distance == want.min(1)).all()
    assert 9 not in number
    assert search.measured < 0.3 * want.size


@pytest.mark.parametrize(
    ("n", "entries", "width", "spread"),
    [(1, 1, 4, 50), (3, 64, 4, 3), (900, 64, 4, 60), (700, 50, 2, 2), (17, 5, 1, 90)],
)
def test_dual_trees_assign_like_brute_force(n, entries, width, spread):
    rng = np.random.default_rng(n)
    x = rng.integers(-spread, spread + 1, (5, n, width))
    e = rng.integers(-spread, spread + 1, (5, entries, width))
    points, tree = BoxTree(x, dual_tree.LEAF), BoxTree(e, 1)
    found = dual_tree.assign(points, tree, entries)
    want = np.array([nearest(a, b).argmin(1) for a, b in zip(x, e, strict=True)])
    assert (dual_tree.codes_of(points, found, n) == want).all()
    counts, sums = dual_tree.sums_of(points, found, entries)
    for g in range(5):
        for k in range(entries):
            mine = x[g][want[g] == k]
            assert counts[g, k] == len(mine) and (sums[g, k] == mine.sum(0)).all()


def test_whole_nodes_are_assigned_by_their_sums():
    rng = np.random.default_rng(2)
    centres = rng.integers(-1000, 1000, (1, 20, 4))
    x = centres[:, rng.integers(0, 20, 4000)] + rng.integers(-3, 4, (1, 4000, 4))
    points, tree = BoxTree(x, dual_tree.LEAF), BoxTree(centres, 1)
    found = dual_tree.assign(points, tree, 20)
    assert found.measured < 0.1 * 4000 * 20
    assert found.whole
