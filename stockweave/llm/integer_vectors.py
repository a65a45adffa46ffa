"""Vectors as integers: the rows that can be used, and floor(256 x) of their components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockweave.session import written

# A component's integer is below 2**30 / (number of components) in magnitude, so
# that squares of distances and of sums stay exact in 64 bits.
RANGE_BITS = 30


def usable(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows with ``dim`` finite components, and their integers."""
    sized = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    places = np.flatnonzero(sized.to_numpy(zero_copy_only=False))
    flat = column.filter(sized).flatten().to_numpy(zero_copy_only=False)
    x = flat.astype(np.float64).reshape(-1, dim)
    finite = np.isfinite(x).all(axis=1)
    x = np.floor(x[finite] * scale)
    if len(x) and np.abs(x).max() >= 2**RANGE_BITS // dim:
        raise OverflowError(f"a component times {scale} is {2**RANGE_BITS // dim} or more")
    return places[finite], x.astype(np.int64)


def integer_table(
    vectors: DataFrame, columns: dict[str, Column], embedding: str, dim: int, scale: int = 256
) -> DataFrame:
    """``columns`` and ``codes array<int>`` of the usable rows, as a written table.

    A null vector, one of another length and one with a null or non-finite
    component are left out. The table is read once per round, and integers of a
    few bits pack better than the floats they come from.
    """
    slim = vectors.select(
        *[c.alias(n) for n, c in columns.items()], F.col(f"`{embedding}`").alias("codes")
    )
    fields = [f for f in slim.schema if f.name != "codes"]
    schema = T.StructType([*fields, T.StructField("codes", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, x = usable(batch.column("codes"), dim, scale)
            offsets = np.arange(len(x) + 1, dtype=np.int32) * dim
            codes = pa.ListArray.from_arrays(
                pa.array(offsets), pa.array(x.ravel(), pa.int32())
            )
            kept = [batch.column(f.name).take(pa.array(places)) for f in fields]
            yield pa.RecordBatch.from_arrays(
                [*kept, codes], names=[*[f.name for f in fields], "codes"]
            )

    return written(slim.mapInArrow(run, schema), "integers")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A column of integer vectors, all of ``dim`` components, as one array."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def summed(x: np.ndarray, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many rows of ``x`` belong to each of ``n`` classes, and their sums."""
    counts = np.bincount(which, minlength=n)
    sums = np.zeros((n, x.shape[1]), np.int64)
    if len(x):
        order = np.argsort(which, kind="stable")
        there = np.flatnonzero(counts)
        starts = (np.cumsum(counts) - counts)[there]
        sums[there] = np.add.reduceat(x[order], starts, axis=0)
    return counts, sums
