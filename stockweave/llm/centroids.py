"""Centroid clustering with exact nearest-centroid search by means and deviations.

Lloyd's rounds over integer vectors. Each vector looks for its nearest centroid by
the equal-average equal-variance method: centroids are sorted by the mean of their
components, the search starts at the vector's own mean and goes outward on both
sides. For vectors x and c of d components, with means m and deviations v from the
mean (as lengths),

    |x - c|^2  >=  d (m(x) - m(c))^2 + (v(x) - v(c))^2,

so the search ends when the first term alone is above the best distance so far, and
a centroid is skipped when both terms are. Distances are integers, and the first
term is compared in integers too; the second is a float with slack, which can only
let a centroid through.

A round sends the sums of each task (one row per centroid) to a partial aggregate,
and only the new centroids reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockweave.llm.integer_vectors import integer_table, matrix, summed
from stockweave.session import written

CLUSTERS = 40
ROUNDS = 5
DIM = 64


def deviation(x: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Length of each row less its mean; the radicand is an exact integer."""
    d = x.shape[1]
    return np.sqrt((d * np.einsum("ij,ij->i", x, x) - sums * sums) / d)


class OutwardSearch:
    """Nearest centroids; equal distances go to the smaller number."""

    def __init__(self, centroids: np.ndarray):
        sums = centroids.sum(axis=1)
        self.number = np.argsort(sums, kind="stable")
        self.centroids = centroids[self.number]
        self.sums = sums[self.number]
        self.deviation = deviation(self.centroids, self.sums)
        # Distances that were computed, for tests of the inequalities.
        self.measured = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each row."""
        n, d = x.shape
        last = len(self.sums) - 1
        sums = x.sum(axis=1)
        lengths = deviation(x, sums)
        best = np.full(n, -1, np.int64)  # -1: nothing measured yet
        number = np.full(n, -1, np.int64)
        up = np.searchsorted(self.sums, sums)
        down = up - 1
        rows = np.arange(n)
        while len(rows):
            lo, hi = down[rows], up[rows]
            s = sums[rows]
            far = np.iinfo(np.int64).max
            below = np.where(lo >= 0, s - self.sums[np.maximum(lo, 0)], far)
            above = np.where(hi <= last, self.sums[np.minimum(hi, last)] - s, far)
            gap = np.minimum(below, above)
            # What lies further out has a larger gap, so these rows are done.
            more = (gap < far) & ((best[rows] < 0) | (gap * gap <= d * best[rows]))
            more[gap == far] = False
            rows, gap = rows[more], gap[more]
            if not len(rows):
                break
            downward = (below <= above)[more]
            at = np.where(downward, lo[more], hi[more])
            down[rows] -= downward
            up[rows] += ~downward

            limit = best[rows]
            v, w = lengths[rows], self.deviation[at]
            slack = 1 + 1e-9 * (v + w) ** 2
            near = (limit < 0) | (gap * gap / d + (v - w) ** 2 <= limit + slack)
            tried, at = rows[near], at[near]
            self.measured += len(tried)
            apart = x[tried] - self.centroids[at]
            distance = np.einsum("ij,ij->i", apart, apart)
            name = self.number[at]
            old = best[tried]
            better = (old < 0) | (distance < old) | ((distance == old) & (name < number[tried]))
            best[tried[better]] = distance[better]
            number[tried[better]] = name[better]
        return number, best


def _first_centroids(kept: DataFrame, k: int, prefix: str) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``prefix`` and id."""
    text = F.concat(F.lit(prefix), F.col("id").cast("string"))
    rows = (
        kept.where(F.col("id").isNotNull())
        .select(F.sha2(text, 256).alias("h"), "codes")
        .orderBy("h", "codes")
        .limit(k)
        .collect()
    )
    return np.array([r.codes for r in rows], np.int64)


def _moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the means, empty ones as they were."""
    search = OutwardSearch(centroids)
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for batch in batches:
            x = matrix(batch.column("codes"), d)
            n, s = summed(x, search.nearest(x)[0], k)
            counts += n
            sums += s
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a) for a in (there, counts[there], *sums[there].T)], names=names
        )

    names = ["cluster", "n", *[f"s{j}" for j in range(d)]]
    partial = kept.select("codes").mapInArrow(run, ", ".join(f"{c} long" for c in names))
    rows = partial.groupBy("cluster").agg(*[F.sum(c).alias(c) for c in names[1:]]).collect()
    out = centroids.copy()
    for r in rows:
        out[r.cluster] = [r[f"s{j}"] // r.n for j in range(d)]
    return out


def cluster_vectors(
    vectors: DataFrame,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    dim: int = DIM,
    prefix: str = "2:",
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """The cluster of each vector, after ``rounds`` rounds of exact integer k-means.

    Returns the id, ``cluster``, ``distance`` (squared), ``cluster_inertia`` and
    ``inertia`` (distances summed over the cluster and over all vectors) and
    ``centroid_sha256`` of the final centroid's components, one row per row that
    was kept. Vectors become floor(256 x) per component; centroids start as the
    ``k`` vectors with the smallest sha256 of ``prefix`` and id, and ties of
    distance go to the smaller number.

    A null vector, one whose length is not ``dim`` and one with a null or
    non-finite component are left out. A component of 65,536 or more (for 64 of
    them) fails the job, as an overflow does. A repeated id counts once per row; a
    null id is clustered but starts no centroid. With fewer than ``k`` vectors
    there are fewer centroids; an empty table, or one without any id, gives an empty
    one. Other columns of ``vectors`` are not read, whatever their names.
    """
    kept = integer_table(vectors, {"id": F.col(f"`{vec_id}`")}, embedding, dim)
    id_type = kept.schema["id"].dataType
    centroids = _first_centroids(kept, k, prefix).reshape(-1, dim)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(kept, centroids)
    search = OutwardSearch(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, distance = search.nearest(matrix(batch.column("codes"), dim))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(number, pa.int32()), pa.array(distance)],
                names=["id", "cluster", "distance"],
            )

    schema = T.StructType(
        [
            T.StructField("id", id_type),
            T.StructField("cluster", T.IntegerType()),
            T.StructField("distance", T.LongType()),
        ]
    )
    placed = kept if len(centroids) else kept.limit(0)
    placed = written(placed.select("id", "codes").mapInArrow(assign, schema), "clusters")
    sums = placed.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()
    inertia = sum(r.n for r in sums)
    facts = [
        (r.cluster, r.n, inertia, _digest(centroids[r.cluster])) for r in sums
    ]  # at most k rows
    facts = vectors.sparkSession.createDataFrame(
        facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return placed.join(F.broadcast(facts), "cluster").select(
        F.col("id").alias(vec_id), "cluster", "distance", "cluster_inertia", "inertia",
        "centroid_sha256",
    )


def _digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()
