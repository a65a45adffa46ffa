"""Search in cells against the full scan."""

from __future__ import annotations

import numpy as np
import pytest

from stockweave.operators import cells as cells_module
from stockweave.operators.cells import publish_cells, search_cells
from stockweave.operators.score import search_vectors

VECTORS = "id string, embedding array<float>, kind string"
REQUESTS = "query_id string, embedding array<double>"


def ranks(df):
    return sorted(str(tuple(r[c] for c in ("query_id", "rank", "id", "score"))) for r in df.collect())


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 3
    x = centres[rng.integers(0, 12, 1500)] + rng.normal(0, 0.1, (1500, 16))
    x[:40] = x[0]  # ties across the cut
    rows = [(f"v{i:04}", [float(c) for c in v], "k") for i, v in enumerate(x)]
    rows += [("nan", [float("nan")] + [0.0] * 15, "k"), ("inf", [float("inf")] * 16, "k"),
             ("null", None, "k"), ("zero", [0.0] * 16, None)]
    vectors = spark.createDataFrame(rows, VECTORS).repartition(4)
    asked = [(f"q{i}", (centres[i % 12] + rng.normal(0, 0.1, 16)).tolist()) for i in range(4)]
    requests = spark.createDataFrame([*asked, ("same", [float(c) for c in x[0]])], REQUESTS)
    root = str(tmp_path_factory.mktemp("cells"))
    publish_cells(vectors, root, cells=12)
    return vectors, requests, root


@pytest.mark.parametrize("k", [1, 7, 25, 400, 5000])
@pytest.mark.parametrize("floor", [None, 0.2])
def test_cells_give_the_ranks_of_a_full_scan(spark, clustered, k, floor):
    vectors, requests, root = clustered
    found = search_cells(spark, root, requests, k, floor)
    assert ranks(found.rows) == ranks(search_vectors(vectors, requests, k, floor))


def test_cells_that_cannot_matter_are_not_read(spark, clustered):
    vectors, requests, root = clustered
    one = requests.where("query_id = 'q1'")
    found = search_cells(spark, root, one, 10, 0.2)
    assert len(found.read) <= 0.5 * found.n_cells
    # Many requests of all kinds may need everything, and requests far from all nothing.
    far = spark.createDataFrame([("far", [0.0] * 16)], REQUESTS)
    assert search_cells(spark, root, far, 10, 0.5).rows.where("NOT isnan(score)").count() == 0


def test_requests_too_many_to_send_scan_all_cells(spark, clustered):
    vectors, requests, root = clustered
    found = search_cells(spark, root, requests, 5, broadcast_bytes=0)
    assert ranks(found.rows) == ranks(search_vectors(vectors, requests, 5))
    assert len(found.read) == found.n_cells


def test_small_and_empty_stores(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells_module, "ROWS_PER_FILE", 2)
    requests = spark.createDataFrame([("q", [1.0, 0.5])], REQUESTS)
    few = spark.createDataFrame([(f"v{i}", [float(i), 1.0], "k") for i in range(5)], VECTORS)
    publish_cells(few, f"{tmp_path}/few", cells=3)
    assert ranks(search_cells(spark, f"{tmp_path}/few", requests, 3).rows) == ranks(
        search_vectors(few, requests, 3))
    odd = spark.createDataFrame([("n", [float("nan"), 1.0], "k")], VECTORS)
    publish_cells(odd, f"{tmp_path}/odd")
    assert [r["id"] for r in search_cells(spark, f"{tmp_path}/odd", requests, 3).rows.collect()] == ["n"]
    none = search_cells(spark, f"{tmp_path}/few", requests.limit(0), 3)
    assert none.rows.count() == 0
    with pytest.raises(ValueError, match="at least 1"):
        search_cells(spark, f"{tmp_path}/few", requests, 0)
