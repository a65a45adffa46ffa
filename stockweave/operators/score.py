"""Exact dot-product search: every vector against every request.

Vectors stay where they are. The request matrix goes to the tasks, each task
multiplies its Arrow batches with numpy and keeps only the best ``k`` rows per
request, and one window over those few candidates gives the final ranks.

The request matrix is broadcast only up to ``BROADCAST_BYTES``. A larger
request table is never gathered: vectors and requests are then packed into blocks
that meet in a grid of tasks (`_grid`), with the same exact result; each side is
written or shuffled once.

Scores are double precision, rounded to ``DIGITS``, and ranks are by
(score descending, id ascending), so ties have one order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockweave.constants import MAX_ITEMS, MIN_SCORE
from stockweave.functions.ranking import positions
from stockweave.functions.vectors import round_half_up
from stockweave.operators.request_index import RequestIndex, index_columns, parsed_filters
from stockweave.session import written, written_and_counted

DIGITS = 6
BROADCAST_BYTES = 16 << 20
BLOCK_BYTES = 32 << 20
TILE_CELLS = 1 << 20
PROBE_ROWS = 4096
SALTS = 64
MERGED_ROWS = 10_000
SALT_ABOVE = 20

# Columns of requests: filter text, and how many rows a request wants.
FILTERS, ITEMS = "filters", "items"
SLICE_ROWS = 1 << 14
# Rows of a tile of scores where there are many requests: products of two sides of about
# the same length are the fastest.
TILE_ROWS = 1 << 10
# Vectors up to this norm are scored in single precision first, and pairs that count
# in double, so many at a time; vectors are sparse if one in ``SPARSE`` is not zero, and
# scores that reach the floor are few if one in ``FEW_ABOVE`` does.
SINGLE_NORM = 1e15
EXACT_PAIRS = 1 << 11
FEW_ABOVE = 16
SPARSE = 8
# Rows that are kept before they are cut to the best; vectors that a task scores first,
# while it knows no score that others must reach.
KEPT_PAIRS, FIRST_ROWS = 1 << 16, 1 << 10
# Blocks of a side beyond which blocks grow, up to BLOCK_BYTES; tasks of a grid; the bits
# of Spark's row numbers that count inside a partition.
MANY_BLOCKS = 64
GRID_TASKS = 256
ROW_BITS = (1 << 33) - 1
SCORES = "query_id string, id string, score double"
_SCORE_SCHEMA = pa.schema(
    [("query_id", pa.string()), ("id", pa.string()), ("score", pa.float64())]
)
CANDIDATES = "query_id string, id string, score double, passing bigint, items bigint"
_CANDIDATE_SCHEMA = pa.schema(
    [("query_id", pa.string()), ("id", pa.string()),
     ("score", pa.float64()), ("passing", pa.int64()), ("items", pa.int64())]
)


# Key of requests that see the same rows (None if all do) to their ids, vectors and
# numbers of rows wanted. The key is a group, a filter text, or both.
RequestMatrix = dict[object, tuple[np.ndarray, np.ndarray, np.ndarray]]


def request_matrix(table: pa.Table, group: str | None, k: int) -> RequestMatrix:
    if not table.num_rows:
        return {}
    ids = table.column("query_id").to_numpy(zero_copy_only=False).astype(object)
    matrix = dense(table.column("embedding"))
    items = np.full(len(ids), k, np.int64)
    if ITEMS in table.column_names:
        items = table.column(ITEMS).to_numpy(zero_copy_only=False).astype(np.int64)
    named = [table.column(c).to_pylist() for c in (group, FILTERS) if c in table.column_names]
    if not named:
        return {None: (ids, matrix, items)}
    # By key in one pass: there may be as many keys as requests.
    places: dict[object, list[int]] = {}
    for i, key in enumerate(zip(*named, strict=True) if len(named) > 1 else named[0]):
        places.setdefault(key, []).append(i)
    return {key: (ids[at], matrix[at], items[at]) for key, at in places.items()}


def dense(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column as a 2-D float64 array, without a Python object per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    n = len(column)
    if column.null_count:
        raise ValueError("vector column holds nulls")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if n == 0:
        return flat.reshape(0, 0)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes != sizes[0]).any():
        raise ValueError("vectors differ in length")
    return flat.reshape(n, int(sizes[0]))


def _down(x: np.ndarray) -> np.ndarray:
    """Single precision, never above ``x``."""
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _places(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of a matrix; over one dimension numpy is many times faster, and
    where few are set, so is a look at eight places at a time first."""
    flat = keep.ravel()
    if flat.size % 8 or np.count_nonzero(flat) * 64 > flat.size:
        return np.divmod(np.flatnonzero(flat), keep.shape[1])
    eights = np.flatnonzero(flat.view(np.uint64))
    which, place = np.nonzero(flat.reshape(-1, 8)[eights])
    return np.divmod(eights[which] * 8 + place, keep.shape[1])


def _set_per_row(keep: np.ndarray) -> np.ndarray:
    """``np.count_nonzero`` of each row, eight places at a time where that is possible."""
    if keep.shape[1] % 8:
        return np.count_nonzero(keep, axis=1)
    return np.bitwise_count(keep.view(np.uint64)).sum(axis=1, dtype=np.int64)


class _Postings:
    """For sparse vectors, the rows that have each component.

    A row without the first components of a request scores at most the norm of the
    others times its own (Cauchy-Schwarz). So for a request that already knows good
    rows, only rows that share one of a few components can matter.
    """

    def __init__(self, single: np.ndarray, n: np.ndarray):
        self.single, self.n = single, n
        self.order = np.argsort(n, kind="stable")

    @classmethod
    def of(cls, single: np.ndarray) -> _Postings | None:
        n = np.count_nonzero(single, axis=0)
        return cls(single, n) if n.sum() * SPARSE <= single.size else None

    def candidates(self, asked: np.ndarray, low: np.ndarray, norm: float):
        """Which requests need few rows, and pieces of (request, row) that reach ``low``."""
        ordered = asked[:, self.order]
        # What the components from each place on can add, with room for rounding.
        squares = np.square(ordered, dtype=np.float64)[:, ::-1]
        rest = np.sqrt(np.cumsum(squares, axis=1)[:, ::-1]) * (norm * (1 + 1e-6)) + 1e-30
        first = (rest >= low[:, None]) & (ordered != 0)
        few = (first @ self.n[self.order].astype(np.float64)) * 4 < len(self.single)
        return few, self._pieces(asked, low, first & few[:, None])

    def _pieces(self, asked: np.ndarray, low: np.ndarray, first: np.ndarray):
        found, width = [], len(self.single)
        for place in np.flatnonzero(first.any(axis=0)):
            at = np.flatnonzero(first[:, place])
            rows = np.flatnonzero(self.single[:, self.order[place]])
            if not len(rows):
                continue
            step = max(1, TILE_CELLS // len(rows))
            for i in range(0, len(at), step):
                some = at[i : i + step]
                which, row = _places(
                    asked[some] @ self.single[rows].T >= _down(low[some])[:, None])
                found.append(some[which] * width + rows[row])
        if found:
            pairs = np.unique(np.concatenate(found))
            yield pairs // width, pairs % width


class _Best:
    """The best rows per request seen so far by one task, ``k`` of each request's own.

    Products are first taken in single precision, whose error has a bound; only what
    could count within that bound is scored in double precision. Requests with the same
    vector are one request here that wants as many rows as any of them.
    """

    def __init__(self, k: np.ndarray, floor: float | None, counts: bool = True):
        self.k = self.wants = k
        self.floor = -np.inf if floor is None else floor
        self.counts = counts
        self.limit = max(2 * int(k.sum()), 1 << 18)
        self.size = 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.given: np.ndarray | None = None
        self.room = np.empty(0, np.float32)

    def _share(self, requests: np.ndarray) -> None:
        self.given = requests
        self.asked, self.member = requests, np.arange(len(requests))
        if requests.size:
            rows = np.ascontiguousarray(requests)
            rows = rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel()
            _, first, member = np.unique(rows, return_index=True, return_inverse=True)
            if len(first) < len(rows):
                self.asked, self.member = requests[first], member
                self.k = np.zeros(len(first), np.int64)
                np.maximum.at(self.k, member, self.wants)
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.asked, self.asked))
        self.single = self.asked.astype(np.float32)
        self.kth = np.full(len(self.k), -np.inf)
        self.passing = np.zeros(len(self.k), dtype=np.int64)
        # The last row kept of a request that has all it wants: what comes after it in
        # the final order is left out, so that very many equal scores are not kept.
        self.last = np.full(len(self.k), -np.inf), np.full(len(self.k), "", object)

    def add(self, ids: np.ndarray, vectors: np.ndarray, requests: np.ndarray) -> None:
        if vectors.shape[1] != requests.shape[1]:
            raise ValueError(
                f"request vectors have {requests.shape[1]} components, "
                f"catalogue vectors {vectors.shape[1]}"
            )
        if self.given is None:
            self._share(requests)
        norm = float(np.sqrt(np.einsum("ij,ij->i", vectors, vectors)).max())
        if not (norm < SINGLE_NORM and (self.norms < SINGLE_NORM).all()):
            self._add_double(ids, vectors, self.asked)
        else:
            # Both roundings and the sum; twice the bound of either order of adding.
            slack = 2.0**-22 * (vectors.shape[1] + 4) * norm * self.norms + 1e-30
            self._add_single(ids, vectors, vectors.astype(np.float32), norm, slack)
        self._cut()

    def _cut(self) -> None:
        """Cut what is kept to the best, once that halves it at least."""
        if self.size > min(self.limit, max(2 * int(self.k.sum()), KEPT_PAIRS)):
            self._prune()

    def _add_single(self, ids: np.ndarray, vectors: np.ndarray, single: np.ndarray,
                    norm: float, slack: np.ndarray) -> None:
        half, n = 0.5 * 10.0**-DIGITS, len(vectors)
        shared = None if self.counts else _Postings.of(single)
        if shared is None:
            self._add_dense(ids, vectors, single, slack)
            return
        if n > FIRST_ROWS and (self.kth == -np.inf).all():
            at, size = 0, FIRST_ROWS
            while at < n:
                end = min(n, at + size)
                self._add_single(ids[at:end], vectors[at:end], single[at:end], norm, slack)
                self._cut()
                at, size = end, 4 * size
            return
        step = max(1, TILE_CELLS // n)
        stretch = max(step, SLICE_ROWS)
        for start in range(0, len(self.k), stretch):
            cols = np.arange(start, min(len(self.k), start + stretch))
            # Requests that few rows can still matter to.
            low = np.fmax(self.floor - half, self.kth[cols] - 2 * half) - slack[cols]
            few, pairs = shared.candidates(self.single[cols], low, norm)
            for which, row in pairs:
                self._put(ids, vectors, cols[which], row)
            cols = cols[~few]
            for at in range(0, len(cols), step):
                self._add_tile(ids, vectors, single, slack, cols[at : at + step])

    def _add_dense(self, ids: np.ndarray, vectors: np.ndarray, single: np.ndarray,
                   slack: np.ndarray) -> None:
        """All products. The first rows are few and show what others must reach, so that
        of those only few are looked at again."""
        n, n_asked = len(vectors), len(self.k)
        if not n_asked:
            return
        most = max(TILE_ROWS, TILE_CELLS // n_asked)
        growing = bool((self.kth == -np.inf).all())
        size = min(most, max(FIRST_ROWS, 4 * int(self.k.max()))) if growing else most
        at = 0
        while at < n:
            end = min(n, at + size)
            step = max(1, TILE_CELLS // (end - at))
            for start in range(0, n_asked, step):
                cols = np.arange(start, min(n_asked, start + step))
                self._add_tile(ids[at:end], vectors[at:end], single[at:end], slack, cols)
            if growing:
                self._prune()
            else:
                self._cut()
            at = end
            growing, size = growing and at < most, min(most, at) if growing else most

    def _add_tile(self, ids: np.ndarray, vectors: np.ndarray, single: np.ndarray,
                  slack: np.ndarray, cols: np.ndarray) -> None:
        half, own = 0.5 * 10.0**-DIGITS, slack[cols]
        asked = self.single[cols[0] : cols[-1] + 1] if len(cols) == cols[-1] - cols[0] + 1 \
            else self.single[cols]
        size = len(asked) * len(single)
        if len(self.room) < size:
            self.room = np.empty(size, np.float32)
        scores = np.matmul(asked, single.T, out=self.room[:size].reshape(len(asked), -1))
        if self.counts:
            # Rows that reach the floor once rounded; those near it are scored exactly.
            level = self.floor - half
            above = scores >= _down(level - own)[:, None]
            self.passing[cols] += _set_per_row(above)
            if np.count_nonzero(above) * FEW_ABOVE < above.size:
                self._add_few(ids, vectors, cols, scores, above, own)
                return
            above ^= scores > _up(level + own)[:, None]
            for which, row, exact in self._exact(vectors, cols, above):
                np.subtract.at(self.passing, cols[which[exact < level]], 1)

        def kept():
            low = np.fmax(self.floor - half, self.kth[cols] - 2 * half) - own
            return scores >= _down(low)[:, None]

        keep, k = kept(), int(self.k[cols].max())
        if len(vectors) > k and np.count_nonzero(keep) > 2 * k * len(cols):
            nth = np.partition(scores, len(vectors) - k, axis=1)[:, len(vectors) - k]
            self.kth[cols] = np.fmax(self.kth[cols], nth.astype(np.float64) - own)
            keep = kept()
        for which, row, exact in self._exact(vectors, cols, keep):
            self._put(ids, vectors, cols[which], row, exact)

    def _add_few(self, ids: np.ndarray, vectors: np.ndarray, cols: np.ndarray,
                 scores: np.ndarray, above: np.ndarray, own: np.ndarray) -> None:
        """What a tile adds where few scores reach the floor: only those are looked at."""
        half = 0.5 * 10.0**-DIGITS
        level = self.floor - half
        which, row = _places(above)
        found = scores[which, row]
        near = np.flatnonzero(found <= _up(level + own)[which])
        for at in range(0, len(near), EXACT_PAIRS):
            w, r = which[near[at : at + EXACT_PAIRS]], row[near[at : at + EXACT_PAIRS]]
            exact = np.einsum("ij,ij->i", self.asked[cols[w]], vectors[r])
            np.subtract.at(self.passing, cols[w[exact < level]], 1)
        low = np.fmax(level, self.kth[cols] - 2 * half) - own
        keep = found >= _down(low)[which]
        self._put(ids, vectors, cols[which[keep]], row[keep])

    def _exact(self, vectors: np.ndarray, cols: np.ndarray, keep: np.ndarray):
        """The places that are kept, with their scores in double precision."""
        n = np.count_nonzero(keep)
        if not n:
            return
        which, row = _places(keep)
        if n > keep.size // 8:
            yield which, row, (self.asked[cols] @ vectors.T)[which, row]
            return
        for at in range(0, n, EXACT_PAIRS):
            w, r = which[at : at + EXACT_PAIRS], row[at : at + EXACT_PAIRS]
            yield w, r, np.einsum("ij,ij->i", self.asked[cols[w]], vectors[r])

    def _put(self, ids: np.ndarray, vectors: np.ndarray, which: np.ndarray, row: np.ndarray,
             exact: np.ndarray | None = None) -> None:
        half = 0.5 * 10.0**-DIGITS
        if exact is None:
            for at in range(0, len(row), EXACT_PAIRS):
                w, r = which[at : at + EXACT_PAIRS], row[at : at + EXACT_PAIRS]
                self._put(ids, vectors, w, r, np.einsum("ij,ij->i", self.asked[w], vectors[r]))
            return
        fine = exact >= np.fmax(self.floor - half, self.kth[which] - 2 * half)
        which, row, score = which[fine], row[fine], round_half_up(exact[fine], DIGITS)
        level, last = self.last[0][which], self.last[1]
        fine = ~(score < level)
        tied = np.flatnonzero(score == level)
        fine[tied] = ids[row[tied]].astype(str) <= last[which[tied]].astype(str)
        if fine.any():
            self.parts.append((which[fine], ids[row[fine]], score[fine]))
            self.size += np.count_nonzero(fine)

    def _add_double(self, ids: np.ndarray, vectors: np.ndarray, requests: np.ndarray) -> None:
        half = 0.5 * 10.0**-DIGITS
        step = max(1, TILE_CELLS // len(vectors))
        for start in range(0, len(requests), step):
            cols = slice(start, start + step)
            scores = requests[cols] @ vectors.T
            # Rows that reach the floor once rounded; NaN is not below it.
            above = ~(scores < self.floor - half)
            self.passing[cols] += above.sum(axis=1)
            # One rounding unit of slack keeps rows that tie after rounding.
            keep = above & ~(scores < (self.kth[cols] - 2 * half)[:, None])
            k = int(self.k[cols].max())
            if len(vectors) > k and keep.sum() > 2 * k * len(scores):
                nth = np.partition(scores, len(vectors) - k, axis=1)
                self.kth[cols] = np.fmax(self.kth[cols], nth[:, len(vectors) - k])
                keep &= ~(scores < (self.kth[cols] - 2 * half)[:, None])
            which, row = np.nonzero(keep)
            if len(which):
                picked = round_half_up(scores[which, row], DIGITS)
                self.parts.append((which + start, ids[row], picked))
                self.size += len(which)

    def _prune(self) -> None:
        if not self.parts:
            return
        which = np.concatenate([p[0] for p in self.parts])
        ids = np.concatenate([p[1] for p in self.parts])
        scores = np.concatenate([p[2] for p in self.parts])
        down = -np.where(np.isnan(scores), np.inf, scores)
        order = np.lexsort((down, which))
        which, down = which[order], down[order]
        # Ids are looked at only where scores are equal.
        same = (which[1:] == which[:-1]) & (down[1:] == down[:-1])
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
        if len(tied):
            run = np.append(0, np.cumsum(~same))[tied]
            _, id_rank = np.unique(ids[order[tied]].astype(str), return_inverse=True)
            order[tied] = order[tied][np.lexsort((id_rank, run))]
        ids, scores = ids[order], scores[order]
        first = np.searchsorted(which, which, side="left")
        kept = np.arange(len(which)) - first < self.k[which]
        which, ids, scores = which[kept], ids[kept], scores[kept]
        self.parts, self.size = [(which, ids, scores)], len(which)
        last = np.append(which[1:] != which[:-1], True)
        full = last & (np.bincount(which, minlength=len(self.kth)) >= self.k)[which]
        known = np.where(np.isnan(scores[full]), np.inf, scores[full])
        self.kth[which[full]] = self.last[0][which[full]] = known
        self.last[1][which[full]] = ids[full]

    def _each(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is kept, for each of the requests with the same vector."""
        if not self.parts:
            return np.zeros(0, dtype=np.int64), np.zeros(0, object), np.zeros(0)
        which, ids, scores = self.parts[0]
        if len(self.k) == len(self.wants):
            return which, ids, scores
        n = np.bincount(which, minlength=len(self.k))
        start = (np.cumsum(n) - n)[self.member]
        n = np.minimum(n[self.member], self.wants)
        row = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
        return np.repeat(np.arange(len(n)), n), ids[row], scores[row]

    def batch(self, query_ids: np.ndarray, counts: bool) -> pa.RecordBatch:
        self._prune()
        which, ids, scores = self._each()
        q = query_ids[which]
        passing = np.zeros(len(q), dtype=np.int64)
        ids = list(ids)
        items = self.wants[which]
        if counts:
            # One row per request that only carries the count.
            q = np.concatenate([q, query_ids])
            ids += [None] * len(query_ids)
            items = np.concatenate([items, self.wants])
            own = self.passing[self.member] if self.given is not None \
                else np.zeros(len(query_ids), np.int64)
            passing = np.concatenate([passing, own])
        score = pa.array(scores, pa.float64(), from_pandas=False)
        if counts:
            score = pa.concat_arrays([score, pa.nulls(len(query_ids), pa.float64())])
        return pa.RecordBatch.from_arrays(
            [pa.array(q, pa.string()), pa.array(ids, pa.string()), score,
             pa.array(passing, pa.int64()), pa.array(items, pa.int64())],
            schema=_CANDIDATE_SCHEMA,
        )


def _by_group(rows: pa.RecordBatch | pa.Table, group: str) -> Iterator[tuple[object, np.ndarray]]:
    """The places of each value of a column that is not null."""
    column = rows.column(group)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    coded = column.dictionary_encode()
    codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    keys = coded.dictionary.to_pylist()
    ends = np.searchsorted(codes[order], np.arange(len(keys) + 1))
    for key, i, j in zip(keys, ends, ends[1:], strict=False):
        if key is not None:
            yield key, order[i:j]


def _visible(
    batch: pa.RecordBatch, matrix: RequestMatrix, group: str | None, index: RequestIndex | None
) -> Iterator[tuple[object, np.ndarray | slice]]:
    """Request keys with the rows of a batch that their requests may see."""
    if index is not None:
        yield from index.rows(batch)
    elif group is None:
        yield None, slice(None)
    else:
        for key, rows in _by_group(batch, group):
            if key in matrix:
                yield key, rows


def _scan(
    batches: Iterator[pa.RecordBatch],
    requests: Broadcast,
    floor: float | None,
    group: str | None,
    index: RequestIndex | None,
    counts: bool,
) -> Iterator[pa.RecordBatch]:
    matrix: RequestMatrix = requests.value
    best: dict[object, _Best] = {}
    for batch in map(with_vectors, batches):
        if not batch.num_rows or not matrix:
            continue
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        vectors = dense(batch.column("embedding"))
        for key, rows in _visible(batch, matrix, group, index):
            if not len(ids[rows]):
                continue
            _, queries, items = matrix[key]
            if key not in best:
                best[key] = _Best(items, floor, counts)
            best[key].add(ids[rows], vectors[rows], queries)
    for key, state in best.items():
        yield state.batch(matrix[key][0], counts)


def _only(df: DataFrame, key: str, group: str | None) -> DataFrame:
    """The columns of a scan. Null vectors are skipped inside the tasks: a filter
    on a column that an encoder makes would run the encoder once more."""
    more = [c for c in (FILTERS, ITEMS) if key == "query_id" and c in df.columns]
    if group is None:
        return df.select(key, "embedding", *more)
    return df.select(key, "embedding", group, *more).where(F.col(group).isNotNull())


def with_vectors(rows):
    """The rows of a table or batch that have a vector."""
    if rows.column("embedding").null_count:
        return rows.filter(rows.column("embedding").is_valid())
    return rows


@dataclass
class Candidates:
    """Candidate rows, and how many rows all requests want if they were few enough to know."""

    rows: DataFrame
    n_items: int | None


def gather_requests(
    requests: DataFrame, group: str | None, k: int, max_bytes: int
) -> tuple[RequestMatrix | None, int, DataFrame]:
    """The request matrix (None if the requests do not fit ``max_bytes``), the vector
    length, and the requests.

    A first look shows the vector length and so how many rows fit; at most one
    row more than that is ever asked for, never the whole table. Requests that one
    look does not show, or that do not fit, are written, so that an encoder in front of
    them runs once.
    """
    table = requests.limit(PROBE_ROWS + 1).toArrow()
    known = with_vectors(table)
    if not table.num_rows:
        return {}, 0, requests
    dim = len(known.column("embedding")[0]) if known.num_rows else 0
    fits = max(1, max_bytes // (8 * max(1, dim)))
    if table.num_rows > min(fits, PROBE_ROWS):
        requests = written(requests, "requests")
        if PROBE_ROWS < min(fits, table.num_rows):
            table = requests.limit(fits + 1).toArrow()
    if table.num_rows > fits:
        return None, dim, requests
    return request_matrix(with_vectors(table), group, k), dim, requests


def candidates(
    vectors: DataFrame,
    requests: DataFrame,
    k: int,
    floor: float | None,
    group: str | None = None,
    counts: bool = False,
    pool: Callable[[set[str] | None], tuple[DataFrame, Mapping[str, str]]] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> Candidates:
    """Candidates for the ranks of each request, at most as many per task as it wants.

    A request wants ``k`` rows, or those of its column ``items``. ``group`` is a
    column of both sides that must agree. Requests with a column ``filters`` bring
    JSON filters of their own; ``pool`` then gives the vectors with the columns for
    the filter keys in use (None: any of them), and a map from keys to columns.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    filtered = FILTERS in requests.columns
    requests = _only(requests, "query_id", group)
    matrix, dim, requests = gather_requests(requests, group, k, broadcast_bytes)
    index = columns = None
    if filtered:
        texts = [key if group is None else key[1] for key in matrix or ()]
        keys = {name for text in set(texts) for name in parsed_filters(text)}
        vectors, known = pool(None if matrix is None else keys) if pool else (vectors, {})
        columns = index_columns(vectors, known)
        if matrix is not None:
            index = RequestIndex(list(matrix), columns, group)
            common = index.common(vectors)
            carried = vectors if common is None else vectors.where(common)
            vectors = carried.select("id", "embedding", *index.expressions())
        else:
            carried = [e for at in columns.values() for e in at.expressions()]
            vectors = vectors.select(
                "id", "embedding", *([group] if group else []), *carried
            )
    else:
        vectors = _only(vectors, "id", group)
    if matrix is None:
        rows, most = (max(1, n // (8 * max(1, dim))) for n in (block_bytes, BLOCK_BYTES))
        asked, members = _different(requests, k, group)
        grid = _grid_candidates(vectors, asked, k, floor, group, columns, counts, rows, most)
        return Candidates(grid if members is None else _of_members(grid, members), None)
    shipped = vectors.sparkSession.sparkContext.broadcast(matrix)
    if group is not None and not filtered:
        # Only partitions some request asks for are read.
        vectors = vectors.where(F.col(group).isin(list(matrix)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _scan(batches, shipped, floor, group, index, counts)

    n_items = sum(int(items.sum()) for _, _, items in matrix.values())
    return Candidates(vectors.mapInArrow(scan, CANDIDATES), n_items)


def _different(
    requests: DataFrame, k: int, group: str | None
) -> tuple[DataFrame, DataFrame | None]:
    """Requests that differ in vector, group or filters, and which requests each stands
    for; the requests as they are (and None) if that would not halve them.

    One that stands for others wants as many rows as any of them. A key is 128 bits of
    hash of the vector next to the group and filters; a vector with null components, which
    the hash passes over, is spelt out.
    """
    shared = [c for c in (group, FILTERS) if c is not None and c in requests.columns]
    vector = F.col("embedding")
    key = F.concat_ws(
        "|", F.xxhash64(vector), F.xxhash64(F.lit(1), vector),
        F.to_json(F.struct(*shared)) if shared else F.lit(""),
        F.when(F.exists(vector, F.isnull), vector.cast("string")),
    )
    items = F.col(ITEMS) if ITEMS in requests.columns else F.lit(k).cast("bigint")
    keyed = requests.where("embedding IS NOT NULL").withColumn("_key", key)
    first = [F.any_value(c).alias(c) for c in ("embedding", *shared)]
    different, n = written_and_counted(
        keyed.groupBy("_key").agg(*first, F.max(items).alias(ITEMS))
        .withColumnRenamed("_key", "query_id"),
        "different-requests",
    )
    if 2 * n > requests.count():
        return requests, None
    return different, keyed.select("_key", "query_id", items.alias("_own"))


def _of_members(found: DataFrame, members: DataFrame) -> DataFrame:
    """Candidates of each request out of those of the requests that stand for them.

    They are first cut to what is wanted, and counts summed up, so that a vector that
    very many requests share brings each of them no more rows than it wants. Neither side
    is broadcast: both may be long, however small their compressed files are.
    """
    counted = F.col("id").isNull()
    best = Window.partitionBy("query_id", counted).orderBy(*_order())
    kept = (
        thinned(found, None)
        .withColumn("passing", F.sum("passing").over(Window.partitionBy("query_id")))
        .withColumn("_n", F.row_number().over(best))
        .where(F.when(counted, F.col("_n") == 1).otherwise(F.col("_n") <= F.col(ITEMS)))
        .select(F.col("query_id").alias("_key"), "id", "score", "_n",
                F.when(counted, F.col("passing")).otherwise(0).alias("passing"))
    )
    return kept.hint("merge").join(members, "_key").where(counted | (F.col("_n") <= F.col("_own"))).select(
        "query_id", "id", "score", "passing", F.col("_own").alias(ITEMS)
    )


def _packed(df: DataFrame, rows: int) -> DataFrame:
    """The rows that have a vector as blocks of at most ``rows``, in Arrow's own format,
    compressed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        n = 0
        for batch in map(with_vectors, batches):
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                if n + part.num_rows > rows:
                    yield block(waiting)
                    waiting, n = [], 0
                waiting.append(part)
                n += part.num_rows
        if n:
            yield block(waiting)

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        how = pa.ipc.IpcWriteOptions(compression="lz4")
        with pa.ipc.new_stream(sink, parts[0].schema, options=how) as out:
            for part in parts:
                out.write_batch(part)
        name, data = uuid.uuid4().hex, sink.getvalue().to_pybytes()
        return pa.RecordBatch.from_arrays(
            [pa.array([name], pa.string()), pa.array([data], pa.binary())], ["block", "data"]
        )

    return df.mapInArrow(pack, "block string, data binary")


def _grid(vectors: DataFrame, requests: DataFrame, rows: int, most: int) -> DataFrame:
    """Blocks of vectors next to blocks of requests, each pair once.

    Vectors are written once and requests shuffled once, however many blocks there are:
    a task reads a part of the vectors, block after block, and one block of requests.
    Blocks have ``rows`` rows, or more (up to ``most``) where that makes very many. The
    requests themselves stand next to the first block of a task only (else null), so
    that what a task passes on at a time is one block of vectors.
    """

    def size(n: int) -> int:
        return max(rows, min(most, -(-n // MANY_BLOCKS)))

    n = requests.count()
    deal = F.xxhash64(requests.columns[0], "embedding")
    n_parts = max(1, -(-n // size(n)))
    right = _packed(requests.repartition(n_parts, deal), size(n))
    n_left = size(vectors.count())
    # A file is read thousands of rows at a time, so it has no more than a large block.
    left = written(_packed(vectors, n_left), "vector-blocks", max(1, most // n_left))
    left = left.coalesce(max(1, -(-GRID_TASKS // n_parts)))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS))
    left = left.select(F.col("data").alias("vectors"), (place == 0).alias("first"))
    met = left.hint("shuffle_replicate_nl").crossJoin(right)
    return met.select("block", "vectors", F.when(F.col("first"), F.col("data")).alias("requests"))


class _Asked:
    """A block of requests that a task of the grid answers: per group, what it keeps."""

    def __init__(self, asked: pa.Table, k: int, floor: float | None, group: str | None,
                 columns: Mapping | None, counts: bool):
        self.group = group
        parts = [(None, asked)] if group is None else [
            (key, asked.take(pa.array(rows)).drop_columns([group]))
            for key, rows in _by_group(asked, group)
        ]
        self.groups = {}
        for key, part in parts:
            matrix = request_matrix(part, None, k)
            index = None if columns is None else RequestIndex(list(matrix), columns)
            best = {f: _Best(items, floor, counts) for f, (_, _, items) in matrix.items()}
            self.groups[key] = matrix, index, best

    def meet(self, block: pa.Table) -> None:
        for part in block.to_batches(max_chunksize=SLICE_ROWS):
            stretches = [(None, part)] if self.group is None else (
                (key, part.take(pa.array(rows))) for key, rows in _by_group(part, self.group)
                if key in self.groups)
            for key, seen in stretches:
                self._add(seen, *self.groups[key])

    def _add(self, part: pa.RecordBatch, matrix: RequestMatrix, index: RequestIndex | None,
             best: dict) -> None:
        ids = part.column("id").to_numpy(zero_copy_only=False)
        vectors = dense(part.column("embedding"))
        for key, rows in _visible(part, matrix, None, index):
            if len(ids[rows]):
                best[key].add(ids[rows], vectors[rows], matrix[key][1])

    def batches(self, counts: bool) -> Iterator[pa.RecordBatch]:
        for matrix, _, best in self.groups.values():
            for key, state in best.items():
                yield state.batch(matrix[key][0], counts)


def _grid_candidates(
    vectors: DataFrame,
    requests: DataFrame,
    k: int,
    floor: float | None,
    group: str | None,
    columns: Mapping | None,
    counts: bool,
    rows: int,
    most: int,
) -> DataFrame:
    """Candidates per block of requests and part of the vectors, for requests too many
    to broadcast. What a task keeps goes from one block of vectors to the next, so the
    rows sent on are at most ``GRID_TASKS`` times those that a block of requests wants."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[str, _Asked] = {}
        for batch in batches:
            for name, left, right in zip(*map(batch.column, ("block", "vectors", "requests"))):
                name = name.as_py()
                if right.is_valid:
                    asked[name] = _Asked(_unpacked(right), k, floor, group, columns, counts)
                asked[name].meet(_unpacked(left))
        for state in asked.values():
            yield from state.batches(counts)

    return _grid(vectors, requests, rows, most).mapInArrow(meet, CANDIDATES)


def _unpacked(data: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all().combine_chunks()


def _order():
    return F.col("id").isNull(), F.desc("score"), F.asc("id")


def thinned(found: DataFrame, k: int | None) -> DataFrame:
    """Cut the candidates of each request in ``SALTS`` parts to what it wants.

    For requests that want many rows (``k`` at most; None if that is not known), so
    that the final window of a request does not have to sort the rows of every task
    at once. Rows that only carry a count all stay.
    """
    if k is not None and k <= SALT_ABOVE:
        return found
    part = Window.partitionBy("query_id", "_salt").orderBy(*_order())
    return (
        found.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
        .withColumn("_n", F.row_number().over(part))
        .where((F.col("_n") <= F.col("items")) | F.col("id").isNull())
        .drop("_salt", "_n")
    )


def ranked(found: DataFrame, k: int | None) -> DataFrame:
    """Final ranks 1..m per request out of the candidates of all tasks.

    Without a column ``items``, every request wants ``k`` rows.
    """
    if ITEMS not in found.columns:
        found = found.withColumn(ITEMS, F.lit(k).cast("bigint"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return (
        thinned(found.select("query_id", "id", "score", "items"), k)
        .withColumn("_n", F.row_number().over(best))
        .where(F.col("_n") <= F.col("items"))
        .select("query_id", "id", "score", F.col("_n").cast("bigint").alias("rank"))
    )


def search_vectors(
    vectors: DataFrame,
    requests: DataFrame,
    k: int = MAX_ITEMS,
    floor: float | None = MIN_SCORE,
    group: str | None = None,
    **sizes: int,
) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` best rows of each request.

    The floor is applied inside the scan. It cuts by score alone, so this gives
    the same rows as cutting to ``k`` first. With ``group``, a request only
    sees the vectors that share its value of that column.
    """
    found = candidates(vectors, requests, k, floor, group, **sizes)
    return ranked(found.rows, k)


def pair_scores(
    pairs: DataFrame, vectors: DataFrame, requests: DataFrame,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(query_id, id, score) of the given pairs of a request and a vector.

    The result is as long as ``pairs``; pairs whose request or vector is missing or
    null are left out. Request vectors are sent to the tasks if they are few, else
    joined; which side of a join is small is left to the optimiser. Products are taken
    for a batch of pairs at a time.
    """
    known = vectors.select("id", F.col("embedding").alias("_v")).where(F.col("_v").isNotNull())
    asked = requests.select("query_id", "embedding")
    matrix, _, asked = gather_requests(asked, None, 1, broadcast_bytes)
    pairs = pairs.select("query_id", "id")
    table = None if matrix is None else matrix.get(None)
    if table is not None and len(set(table[0])) == len(table[0]):
        place = {q: i for i, q in enumerate(table[0].tolist())}
        shipped = asked.sparkSession.sparkContext.broadcast((place, table[1]))
        rows = pairs.join(known, "id").select("query_id", "id", "_v")
    else:
        shipped = None
        own = asked.select("query_id", F.col("embedding").alias("_q")).where("_q IS NOT NULL")
        rows = pairs.join(known, "id").join(own, "query_id").select("query_id", "id", "_v", "_q")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shipped is not None:
                place, requests = shipped.value
                at = np.array([place.get(q, -1) for q in batch.column(0).to_pylist()], int)
                there = np.flatnonzero(at >= 0)
                batch = batch.take(pa.array(there))
            if not batch.num_rows:
                continue
            v = dense(batch.column(2))
            q = dense(batch.column(3)) if shipped is None else requests[at[there]]
            if q.shape != v.shape:
                raise ValueError(
                    f"request vectors have {q.shape[1]} components, catalogue vectors {v.shape[1]}"
                )
            score = round_half_up(np.einsum("ij,ij->i", q, v), DIGITS) + 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score, from_pandas=False)],
                schema=_SCORE_SCHEMA,
            )

    return rows.mapInArrow(multiply, SCORES)


def top_k(scored: DataFrame, k: int = MAX_ITEMS) -> DataFrame:
    """The ``k`` best rows of one request's scores.

    Beyond ``MERGED_ROWS`` they are ranked by tasks instead of merged at the driver.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if k > MERGED_ROWS:
        placed = positions(scored, [F.desc("score"), F.asc("id")], name="_place")
        return placed.where(F.col("_place") <= k).drop("_place")
    return scored.orderBy(F.desc("score"), F.asc("id")).limit(k)


def top_k_per_query(scored: DataFrame, k: int = MAX_ITEMS) -> DataFrame:
    """The ``k`` best rows of every request in a table of scores."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return ranked(scored, k)
