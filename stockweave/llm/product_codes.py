"""Vector codes: each part of a vector becomes the index of its nearest codebook entry.

Codebooks are fitted by Lloyd rounds over integers. A task takes slices of bounded
size, builds a tree over the parts of each position and walks it against the tree of
the codebook's entries (`dual_tree`), so most parts are assigned as whole nodes, by
sums that the tree holds. Trees are built anew in each round: they live as long as
their slice, and a task that runs again on another executor needs nothing but its
rows. Sums go to a partial aggregate, one row per entry and task; the driver sees the
codebooks only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockweave.llm import dual_tree
from stockweave.llm.dual_tree import BoxTree
from stockweave.llm.integer_vectors import integer_table, matrix
from stockweave.session import BROADCAST_ROWS, written, written_and_counted

PARTS = 16
ENTRIES = 64
ROUNDS = 2
DIM = 64
# Rows of a task that are in trees at a time.
SLICE = 1 << 14


def _in_parts(x: np.ndarray, parts: int) -> np.ndarray:
    """Rows of integers as (parts, rows, components)."""
    return x.reshape(len(x), parts, x.shape[1] // parts).swapaxes(0, 1)


def _slices(batch: pa.RecordBatch, parts: int, dim: int) -> Iterator[tuple[int, np.ndarray]]:
    """Start and parts of each slice of a batch."""
    x = matrix(batch.column("codes"), dim)
    for start in range(0, len(x), SLICE):
        yield start, _in_parts(x[start : start + SLICE], parts)


def first_codebooks(kept: DataFrame, entries: int, parts: int, dim: int) -> np.ndarray:
    """Codebooks (parts, entries, components) from the smallest ids, ascending."""
    rows = (
        kept.where(F.col("id").isNotNull())
        .select("id", "codes")
        .orderBy("id", "codes")
        .limit(entries)
        .collect()
    )
    return _in_parts(np.array([r.codes for r in rows], np.int64).reshape(-1, dim), parts)


def _moved(kept: DataFrame, books: np.ndarray, dim: int) -> np.ndarray:
    """The codebooks after one round: floors of the means, unused entries as they were."""
    parts, n_entries, width = books.shape
    names = ["part", "entry", "n", *[f"s{j}" for j in range(width)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = BoxTree(books, 1)
        counts = np.zeros((parts, n_entries), np.int64)
        sums = np.zeros(books.shape, np.int64)
        for batch in batches:
            for _, x in _slices(batch, parts, dim):
                points = BoxTree(x, dual_tree.LEAF)
                found = dual_tree.assign(points, entries, n_entries)
                n, s = dual_tree.sums_of(points, found, n_entries)
                counts += n
                sums += s
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a) for a in (part, entry, counts[part, entry], *sums[part, entry].T)],
            names=names,
        )

    partial = kept.select("codes").mapInArrow(run, ", ".join(f"{c} long" for c in names))
    totals = partial.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names[2:]])
    out = books.copy()
    for r in totals.collect():  # at most parts x entries rows
        out[r.part, r.entry] = [r[f"s{j}"] // r.n for j in range(width)]
    return out


def compress_vectors(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    dim: int = DIM,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """Each vector as one index per part, and the error that this makes.

    Vectors become floor(256 x) per component and are cut into ``parts`` equal
    parts. Each position's codebook starts as that part of the ``entries`` vectors
    with the smallest ids; ``rounds`` Lloyd rounds follow, then the final
    assignment. Returns the id, ``code`` (two hex digits per part), ``error``
    (squared distances summed over parts), ``label_error`` (errors summed over
    equal labels, nulls together) and ``codebooks_sha256``, a row per row kept.

    A null vector, one whose length is not ``dim`` and one with a null or
    non-finite component are left out. A component of 65,536 or more (for 64 of
    them) fails the job, as an overflow does. A repeated id counts once per row; a
    null id is coded but starts no entry. Ties go to the lower index. With fewer
    vectors than entries the codebooks are shorter; an empty table, or one without
    any id, gives an empty one. Other columns of ``vectors`` are not read, whatever their names.
    """
    if dim % parts or not 0 < entries <= 256:
        raise ValueError("parts must divide dim, and two hex digits name 256 entries at most")
    columns = {"id": F.col(f"`{vec_id}`"), "label": F.col(f"`{label}`")}
    kept = integer_table(vectors, columns, embedding, dim)
    books = first_codebooks(kept, entries, parts, dim)
    n_entries = books.shape[1]
    for _ in range(rounds if n_entries else 0):
        books = _moved(kept, books, dim)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = BoxTree(books, 1)
        at = np.arange(parts)[:, None]
        for batch in batches:
            texts, errors = [], []
            for _, x in _slices(batch, parts, dim):
                points = BoxTree(x, dual_tree.LEAF)
                found = dual_tree.assign(points, tree, n_entries)
                codes = dual_tree.codes_of(points, found, x.shape[1])
                apart = x - books[at, codes]
                errors.append(np.einsum("pnw,pnw->n", apart, apart))
                raw = codes.T.astype(np.uint8).tobytes().hex()
                texts += [raw[i : i + 2 * parts] for i in range(0, len(raw), 2 * parts)]
            error = np.concatenate(errors) if errors else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(texts, pa.string()),
                 pa.array(error, pa.int64())],
                names=["id", "label", "code", "error"],
            )

    schema = T.StructType(
        [
            kept.schema["id"],
            kept.schema["label"],
            T.StructField("code", T.StringType()),
            T.StructField("error", T.LongType()),
        ]
    )
    coded = (kept if n_entries else kept.limit(0)).mapInArrow(code, schema)
    coded = written(coded, "codes")
    # One row per label: written, so that a join that shuffles can split a hot label.
    sums, n_labels = written_and_counted(
        coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors"
    )
    sums = sums.withColumnRenamed("label", "_label")
    sums = F.broadcast(sums) if n_labels <= BROADCAST_ROWS else sums
    text = ",".join(map(str, books.ravel().tolist()))
    digest = hashlib.sha256(text.encode()).hexdigest()
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(
        F.col("id").alias(vec_id), "code", "error", "label_error",
        F.lit(digest).alias("codebooks_sha256"),
    )
