"""Exact search that skips: vectors stored in cells, cells with a bound.

Vectors are published by their nearest of a few centres, one folder per cell, with the
centre and the radius of each. No vector of a cell has a larger dot product with a request
q than q . centre + |q| radius. A search reads the cells with the best bounds first, and
then only those that can still hold a row as good as the k-th found so far. The result is
that of a full scan, ties included; what is read depends on how well vectors gather.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockweave.constants import MAX_ITEMS, MIN_SCORE
from stockweave.mapping import user_col
from stockweave.operators.score import (
    BROADCAST_BYTES,
    DIGITS,
    candidates,
    dense,
    gather_requests,
    ranked,
    search_vectors,
)
from stockweave.session import written

CELLS = 256
# Vectors that the centres are fitted on, at most, and rounds of that fit.
SAMPLE, ROUNDS = 20_000, 5
ROWS_PER_FILE = 500_000
# The cell of vectors with a null or non-finite component: no bound holds for them.
ODD = -1


def _fit(x: np.ndarray, cells: int) -> np.ndarray:
    """Centres of a sample, by a few rounds of k-means from evenly drawn rows."""
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)].copy()
    for _ in range(ROUNDS):
        which = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
        counts = np.bincount(which, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, which, x)
        there = counts > 0
        centres[there] = sums[there] / counts[there, None]
    return centres


def publish_cells(vectors: DataFrame, root: str, cells: int = CELLS) -> None:
    """Write ``vectors`` (``id, embedding``, and any other columns) by cells.

    ``root`` gets ``vectors/cell=<n>/`` and ``cells``, a row per cell. The centres are
    fitted on at most ``SAMPLE`` vectors drawn by hash; all vectors are placed, and the
    radius of a cell is that of all its vectors. A large cell is written by several tasks.
    """
    columns = ["id", "embedding", *[c for c in vectors.columns if c not in ("id", "embedding")]]
    vectors = vectors.where(F.col("embedding").isNotNull()).select(*map(user_col, columns))
    drawn = vectors.select("id", "embedding").orderBy(F.xxhash64("id"), "id", "embedding")
    sample = dense(drawn.limit(SAMPLE).toArrow().column("embedding"))
    sample = sample[np.isfinite(sample).all(axis=1)]
    centres = _fit(sample, cells) if len(sample) else np.zeros((0, sample.shape[1]))
    norms = 0.5 * (centres**2).sum(axis=1)
    schema = T.StructType([
        *vectors.schema.fields, T.StructField("_distance", T.DoubleType()),
        T.StructField("cell", T.IntegerType()),
    ])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = dense(batch.column("embedding"))
            cell, distance = np.full(len(x), ODD), np.full(len(x), np.inf)
            fine = np.isfinite(x).all(axis=1)
            if len(centres) and fine.any():
                cell[fine] = np.argmax(x[fine] @ centres.T - norms, axis=1)
                apart = x[fine] - centres[cell[fine]]
                distance[fine] = np.sqrt(np.einsum("ij,ij->i", apart, apart))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(distance), pa.array(cell, pa.int32())],
                names=schema.names,
            )

    placed = written(vectors.mapInArrow(place, schema), "placed-vectors")
    sizes = written(
        placed.groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"), F.max("_distance").alias("radius")
        ),
        "cell-sizes",
    )
    slices = F.ceil(F.col("n") / ROWS_PER_FILE)
    dealt = placed.join(F.broadcast(sizes.select("cell", "n")), "cell")  # a row per cell
    (
        dealt.repartition("cell", F.pmod(F.xxhash64("id"), slices))
        .drop("n", "_distance")
        .write.partitionBy("cell")
        .parquet(f"{root}/vectors")
    )
    known = vectors.sparkSession.createDataFrame(
        [(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>"
    )
    sizes.join(known, "cell", "left").write.parquet(f"{root}/cells")


@dataclass
class CellSearch:
    """A result, and the cells that were read for it, out of how many."""

    rows: DataFrame
    read: list[int]
    n_cells: int


def _bounds(cells: pa.Table, requests: np.ndarray) -> np.ndarray:
    """What no score of a request in a cell is above, with room for rounding."""
    out = np.full((len(requests), cells.num_rows), np.inf)
    ids = cells.column("cell").to_numpy()
    fine = np.flatnonzero(ids != ODD)
    if len(fine):
        centres = np.array(cells.column("centre").take(pa.array(fine)).to_pylist(), float)
        radius = cells.column("radius").to_numpy()[fine]
        length = np.linalg.norm(requests, axis=1)[:, None]
        reach = length * radius
        bound = requests @ centres.T + reach
        slack = 1e-9 * (np.abs(requests) @ np.abs(centres).T + reach) + 10.0**-DIGITS
        out[:, fine] = bound + slack
    return np.where(np.isnan(out), np.inf, out)


def search_cells(
    spark: SparkSession,
    root: str,
    requests: DataFrame,
    k: int = MAX_ITEMS,
    floor: float | None = MIN_SCORE,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> CellSearch:
    """(query_id, id, score, rank) as `search_vectors` gives them, from fewer cells.

    Cells are rows of a bounded table that the driver holds; requests too many to
    broadcast are answered by a scan of all cells.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    vectors = spark.read.parquet(f"{root}/vectors")
    cells = spark.read.parquet(f"{root}/cells").orderBy("cell").toArrow()
    ids, n = cells.column("cell").to_numpy(), cells.column("n").to_numpy()
    asked = requests.select("query_id", "embedding")
    matrix, _, asked = gather_requests(asked, None, k, broadcast_bytes)
    if not matrix:
        return CellSearch(search_vectors(vectors, asked, k, floor), ids.tolist(), len(ids))
    names, queries, _ = matrix[None]
    bound = _bounds(cells, queries)
    least = -np.inf if floor is None else floor
    # First, for each request, its best cells until they hold k rows.
    order = np.argsort(-bound, axis=1, kind="stable")
    before = np.cumsum(n[order], axis=1) - n[order]
    first = np.unique(order[(before < k) & (np.take_along_axis(bound, order, 1) >= least)])

    def scan(chosen: np.ndarray) -> DataFrame:
        own = vectors.where(F.col("cell").isin([int(c) for c in ids[chosen]]))
        return written(
            candidates(own, asked, k, floor, broadcast_bytes=broadcast_bytes).rows, "cell-scores"
        )

    found = scan(first)
    kth = np.full(len(names), least)
    at = {q: i for i, q in enumerate(names.tolist())}
    for r in ranked(found, k).where(F.col("rank") == k).select("query_id", "score").collect():
        kth[at[r.query_id]] = np.inf if np.isnan(r.score) else r.score
    # Then those that may hold a row as good as the k-th; an equal one may have a
    # smaller id. NaN ranks first, and is found in the cell that has no bound.
    rest = np.flatnonzero((bound >= kth[:, None]).any(axis=0))
    rest = np.setdiff1d(rest, first)
    if len(rest):
        found = found.union(scan(rest))
    read = np.union1d(first, rest)
    return CellSearch(ranked(found, k), ids[read].tolist(), len(ids))
