"""The best rows of each request: single precision first, sparse vectors, blocks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockweave.functions.vectors import round_half_up
from stockweave.operators import score as score_module
from stockweave.operators.score import candidates, ranked


def unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def made(kind, rng, n):
    if kind == "sparse":
        x = np.zeros((n, 64))
        for low, high in ((0, 3), (3, 12), (12, 64)):
            x[np.arange(n), rng.integers(low, high, n)] += 1
        return unit(x)
    x = rng.standard_normal((n, 64))
    if kind == "near":  # scores that differ by less than single precision shows
        x = x[:1] + 1e-6 * x
    return unit(x)


def brute(vectors, asked, ids, k, floor):
    scores = round_half_up(asked @ vectors.T, 6)
    best = []
    for q, row in enumerate(scores):
        order = sorted(range(len(ids)), key=lambda i: (-row[i], ids[i]))
        best += [(q, ids[i], row[i]) for i in order[: k[q]] if not row[i] < floor]
    return best, (scores >= floor).sum(axis=1)


@pytest.mark.parametrize("kind", ["sparse", "dense", "near"])
@pytest.mark.parametrize("counts", [False, True])
def test_best_rows_are_exact(kind, counts):
    rng = np.random.default_rng(5)
    vectors, asked = made(kind, rng, 900), made(kind, rng, 70)
    vectors[::50] = vectors[3]  # ties go by id
    ids, k = np.array([f"v{i}" for i in rng.permutation(900)], object), rng.integers(1, 9, 70)
    state = score_module._Best(k, 0.2, counts)
    state.limit = 300
    for at in range(0, 900, 128):
        state.add(ids[at : at + 128], vectors[at : at + 128], asked)
    got = state.batch(np.arange(70).astype(str), counts).to_pylist()
    want, passing = brute(vectors, asked, ids, k, 0.2)
    found = sorted((int(r["query_id"]), r["id"], r["score"]) for r in got if r["id"] is not None)
    assert [f[:2] for f in found] == sorted(w[:2] for w in want)
    assert np.allclose([f[2] for f in found], [w[2] for w in sorted(want)], atol=2e-6)
    if counts:
        rows = {int(r["query_id"]): r["passing"] for r in got if r["id"] is None}
        assert [rows[q] for q in range(70)] == passing.tolist()


def test_sparse_vectors_are_looked_up():
    """A request that has found its equal is compared with few rows only."""
    rng = np.random.default_rng(6)
    vectors = made("sparse", rng, 4000).astype(np.float32)
    found = score_module._Postings.of(vectors)
    few, pieces = found.candidates(vectors[:500], np.full(500, 0.9999), 1.0)
    assert few.all()
    assert sum(len(which) for which, _ in pieces) < 500 * 4000 / 20
    assert score_module._Postings.of(np.ones((10, 64), np.float32)) is None


def test_first_rows_show_what_others_must_reach(monkeypatch):
    """Of dense vectors only few are put in order before a score is known, and ids are
    compared only where scores are equal."""
    rng = np.random.default_rng(7)
    vectors, asked = made("dense", rng, 16000), made("dense", rng, 40)
    ids = np.array([f"v{i}" for i in rng.permutation(16000)], object)
    cells, compared = [], []
    partition, unique = np.partition, np.unique
    monkeypatch.setattr(np, "partition", lambda x, *a, **k: cells.append(x.size)
                        or partition(x, *a, **k))
    monkeypatch.setattr(np, "unique", lambda x, *a, **k: compared.append(x.size * (x.dtype.kind == "U"))
                        or unique(x, *a, **k))
    state = score_module._Best(np.full(40, 5), -1.0, False)
    state.add(ids, vectors, asked)
    got = state.batch(np.arange(40).astype(str), False).to_pylist()
    want, _ = brute(vectors, asked, ids, [5] * 40, -1.0)
    assert sorted((int(r["query_id"]), r["id"]) for r in got) == sorted(w[:2] for w in want)
    assert sum(cells) < vectors.shape[0] * 40 / 4
    assert sum(compared) < 100


def test_places_of_few_and_many():
    rng = np.random.default_rng(8)
    for shape in ((3, 5), (16, 24), (200, 64)):
        for share in (0.0, 0.005, 0.5, 1.0):
            keep = rng.random(shape) < share
            for got, want in zip(score_module._places(keep), np.nonzero(keep), strict=True):
                assert (got == want).all()


def test_many_blocks_send_each_row_once(spark):
    """rows were sent, and candidates kept, once per block of the other side."""
    rng = np.random.default_rng(7)
    rows = [(str(i), v.tolist()) for i, v in enumerate(made("dense", rng, 600))]
    vectors = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(3)
    asked = vectors.limit(200).withColumnRenamed("id", "query_id")
    sizes = {"broadcast_bytes": 0, "block_bytes": 8 * 64 * 5}
    found = candidates(vectors, asked, 2, None, **sizes)
    plan = found.rows._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan
    # Three parts of the vectors at most, not 120 blocks of them.
    assert found.rows.count() <= 200 * 2 * 3
    got = ranked(found.rows, 2).select("query_id", "id", "rank").collect()
    plain = ranked(candidates(vectors, asked, 2, None).rows, 2)
    assert sorted(got) == sorted(plain.select("query_id", "id", "rank").collect())


@pytest.mark.parametrize("counts", [False, True])
def test_equal_scores_and_equal_requests_stay_few(counts):
    """every row with the k-th score was kept, and equal requests were scored each."""
    rng = np.random.default_rng(8)
    kinds, asked = made("sparse", rng, 10), made("sparse", rng, 10)
    asked[:5] = kinds[:5]
    of = np.concatenate([np.arange(10), rng.integers(0, 10, 290)])
    k = rng.integers(1, 6, len(of))
    ids = np.array([f"v{i}" for i in rng.permutation(4000)], object)
    vectors = kinds[rng.integers(0, 10, len(ids))]
    state, most = score_module._Best(k, 0.2, counts), 0
    for at in range(0, len(ids), 200):
        state.add(ids[at : at + 200], vectors[at : at + 200], asked[of])
        most = max(most, state.size)
    assert len(state.k) == 10 and most < 100_000
    got = state.batch(np.arange(len(of)).astype(str), counts).to_pylist()
    want, passing = brute(vectors, asked[of], ids, k, 0.2)
    found = [(int(r["query_id"]), r["id"]) for r in got if r["id"] is not None]
    assert found == [w[:2] for w in want]
    assert all(r["items"] == k[int(r["query_id"])] for r in got)
    if counts:
        rows = {int(r["query_id"]): r["passing"] for r in got if r["id"] is None}
        assert [rows[q] for q in range(len(of))] == passing.tolist()


def test_vectors_without_components_and_requests_without_rows():
    state = score_module._Best(np.array([2, 2]), None, True)
    assert state.batch(np.array(["a", "b"], object), True).num_rows == 2
    state.add(np.array(["x"], object), np.zeros((1, 0)), np.zeros((2, 0)))
    assert state.batch(np.array(["a", "b"], object), True).num_rows == 4


def test_many_sparse_rows_are_looked_up_from_the_start():
    """The first rows of a task are scored in full only until good ones are known."""
    rng = np.random.default_rng(9)
    vectors = made("sparse", rng, 6 * score_module.FIRST_ROWS)
    ids = np.array([f"v{i}" for i in rng.permutation(len(vectors))], object)
    k, full = np.full(50, 2), []
    state = score_module._Best(k, 0.2, False)
    tile = state._add_tile

    def seen(ids, vectors, single, slack, cols):
        full.append(len(vectors) * len(cols))
        tile(ids, vectors, single, slack, cols)

    state._add_tile = seen
    state.add(ids, vectors, vectors[:50])
    assert sum(full) < 50 * len(vectors) / 2
    got = state.batch(np.arange(50).astype(str), False).to_pylist()
    want, _ = brute(vectors, vectors[:50], ids, k, 0.2)
    assert [(int(r["query_id"]), r["id"]) for r in got] == [w[:2] for w in want]


def test_a_large_block_of_vectors_is_a_file_of_its_own(spark, monkeypatch):
    """a file of many blocks was read whole, thousands of rows at a time."""
    monkeypatch.setattr(score_module, "BLOCK_BYTES", 8 * 64 * 5)
    rng = np.random.default_rng(10)
    rows = [(str(i), v.tolist()) for i, v in enumerate(made("dense", rng, 60))]
    vectors = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(2)
    asked = vectors.withColumnRenamed("id", "query_id")
    found = candidates(vectors, asked, 2, None, broadcast_bytes=0, block_bytes=8 * 64 * 5)
    files = [f for f in found.rows.inputFiles() if "vector-blocks" in f]
    assert len(files) >= 12
    assert all(spark.read.parquet(f).count() == 1 for f in files)


def test_requests_go_to_a_task_once(spark):
    """F8: each block of vectors took a copy of its whole block of requests along, and
    blocks were stored as wide as they are in memory."""
    rng = np.random.default_rng(11)
    rows = [(str(i), v.tolist()) for i, v in enumerate(made("sparse", rng, 400))]
    vectors = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(2)
    asked = vectors.limit(60).withColumnRenamed("id", "query_id")
    met = score_module._grid(vectors, asked, 40, 40)
    seen = met.select(
        "block", "requests", F.length("vectors").alias("n"), F.spark_partition_id().alias("task")
    ).collect()
    assert len(seen) >= 20 and all(r.n < 40 * 64 * 4 / 2 for r in seen)
    tasks = {(r.task, r.block) for r in seen}
    assert len(tasks) < len(seen) / 2
    assert {(r.task, r.block) for r in seen if r.requests is not None} == tasks
    assert sum(r.requests is not None for r in seen) == len(tasks)


@pytest.mark.parametrize("counts", [False, True])
def test_equal_requests_are_searched_once(spark, counts):
    """equal requests met every vector once per block of requests they were in."""
    rng = np.random.default_rng(12)
    rows = [(str(i), v.tolist()) for i, v in enumerate(made("sparse", rng, 120))]
    vectors = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(2)
    # Ids that are null or come twice; requests that share a vector want different numbers.
    asked = [(None if i % 17 == 0 else str(i // 2), rows[i % 7][1] if i % 13 else None,
              "" if i % 3 else "{}", i % 4 + 1) for i in range(150)]
    asked = spark.createDataFrame(
        asked, "query_id string, embedding array<float>, filters string, items bigint"
    ).repartition(3)
    grid = {"broadcast_bytes": 0, "block_bytes": 8 * 64 * 16}
    different, members = score_module._different(asked, 10, None)
    assert different.count() == 14 and members.count() == 138

    def found(**sizes):
        rows = candidates(vectors, asked, 10, 0.2, counts=counts, **sizes).rows
        totals = rows.groupBy("query_id").agg(F.sum("passing")).collect()
        best = ranked(rows.where("id IS NOT NULL"), None)
        return sorted(map(str, totals)), sorted(map(str, best.drop("id").collect()))

    assert found(**grid) == found()
    few = score_module._different(asked.where("items = 1").limit(1), 10, None)
    assert few[1] is None


def test_few_scores_above_the_floor_are_looked_at_alone(monkeypatch):
    """with counts, every score was compared three times, however few reach the floor."""
    rng = np.random.default_rng(13)
    vectors, asked = made("dense", rng, 1500), made("dense", rng, 90)
    vectors[::50] = asked[rng.integers(0, 90, 30)]
    # Scores at the floor within single precision: a little above and below it.
    vectors[1::50] = asked[:30] * (0.4 + np.tile([4e-7, -6e-7], 15))[:, None]
    ids = np.array([f"v{i}" for i in rng.permutation(len(vectors))], object)
    k = rng.integers(1, 6, len(asked))
    state = score_module._Best(k, 0.4, True)
    monkeypatch.setattr(state, "_exact", None)
    for at in range(0, len(ids), 600):
        state.add(ids[at : at + 600], vectors[at : at + 600], asked)
    got = state.batch(np.arange(len(k)).astype(str), True).to_pylist()
    want, passing = brute(vectors, asked, ids, k, 0.4)
    assert [(int(r["query_id"]), r["id"]) for r in got if r["id"] is not None] == [
        w[:2] for w in want]
    assert [r["passing"] for r in got if r["id"] is None] == passing.tolist()
