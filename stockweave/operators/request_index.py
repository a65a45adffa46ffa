"""Which rows each request may see: an index over the filters of many requests.

Requests come with filters of their own. Equal values and ranges of all of them go
into an index, by column: values in a hash table, ranges as pairs of bounds. For a
batch of rows, each column is put in order once; a value or a range is then one
stretch of that order, found by binary search, and a filter set starts from its
shortest stretch and checks its other conditions on those rows alone. Thousands of
different filter sets so cost one scan, and a set costs what it matches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockweave.mapping import user_col
from stockweave.operators.filters import (
    ALIASES,
    active_filters,
    bounds,
    predicate,
    whole_number,
)

TEXT, WHOLE, NUMBER, FLAG = "text", "whole", "number", "flag"
# Conditions of a column that are worth telling the file scan.
PUSHED = 100


def kind_of(kind: T.DataType) -> str:
    if isinstance(kind, T.IntegralType):
        return WHOLE
    if isinstance(kind, T.NumericType):
        return NUMBER
    return FLAG if isinstance(kind, T.BooleanType) else TEXT


@dataclass(frozen=True)
class Indexed:
    """A filter column: where its values are in a scan, and how they compare."""

    column: str
    kind: str
    single: bool  # single precision: compare with the value as the column holds it
    place: int

    @property
    def text(self) -> str:
        return f"_t{self.place}"

    @property
    def number(self) -> str:
        return f"_n{self.place}"

    def expressions(self) -> list[Column]:
        """The column as text for equality and as a number for ranges."""
        c = user_col(self.column)
        number = c.try_cast("double") if self.kind == TEXT else c.cast("double")
        if self.kind == NUMBER:
            return [number.alias(self.number)]
        if self.kind == FLAG:
            return [c.cast("string").alias(self.text)]
        return [c.cast("string").alias(self.text), number.alias(self.number)]


def index_columns(df: DataFrame, known: Mapping[str, str]) -> dict[str, Indexed]:
    """Filter keys to the columns of ``df`` that ``known`` names for them."""
    out = {}
    for place, (key, column) in enumerate(known.items()):
        kind = df.schema[column].dataType
        out[key] = Indexed(column, kind_of(kind), isinstance(kind, T.FloatType), place)
    return out


@dataclass(frozen=True)
class _Test:
    """One condition: equal to a text, or within bounds."""

    at: Indexed
    equals: str | None = None
    low: float = 0.0
    high: float = 0.0


def _test(at: Indexed, value: object) -> _Test | None:
    """The condition for a filter value; None if no row can meet it."""
    if isinstance(value, list | tuple):
        low, high = bounds(value)
        return _Test(at, None, low, high) if at.kind != FLAG else None
    if at.kind == NUMBER:
        try:
            number = float(np.float32(value)) if at.single else float(value)
        except (TypeError, ValueError):
            return None
        return _Test(at, None, number, number)
    text = str(value)
    if at.kind == WHOLE:
        text = whole_number(value)
    elif at.kind == FLAG:
        text = {"true": "true", "false": "false"}.get(text.strip().lower())
    return None if text is None else _Test(at, text)


def parsed_filters(text: str | None) -> dict[str, object]:
    """The active filters of a JSON text; absent or blank means none."""
    given = json.loads(text) if text and text.strip() else {}
    if not isinstance(given, dict):
        raise ValueError(f"filters must be a JSON object: {text[:200]}")
    return active_filters(given)


class RequestIndex:
    """Filter sets, by the key under which requests name them.

    A key is a filter text, or a pair of a group (a model path, say) and a filter
    text; ``group`` is then the column of the rows that must equal it.
    """

    def __init__(self, keys: list, columns: Mapping[str, Indexed], group: str | None = None):
        self.group = group
        self.sets: dict = {}
        self.everything: list = []
        self.nothing: list = []
        for key in dict.fromkeys(keys):
            named, text = key if group is not None else (None, key)
            tests = [] if group is None else [_Test(GROUP, named)]
            for name, value in parsed_filters(text).items():
                at = columns.get(name) or columns.get(ALIASES.get(name, name))
                if at is None:
                    raise ValueError(f"unknown filter column: {name}")
                tests.append(_test(at, value))
            if None in tests or (group is not None and named is None):
                self.nothing.append(key)
            elif tests:
                self.sets[key] = tests
            else:
                self.everything.append(key)
        tests = [t for ts in self.sets.values() for t in ts]
        self.columns = list(dict.fromkeys(t.at for t in tests if t.at is not GROUP))

    def expressions(self) -> list[Column]:
        """What a scan must carry for :meth:`rows`."""
        own = [e for at in self.columns for e in at.expressions()]
        return own + ([user_col(self.group).cast("string").alias(GROUP.text)]
                      if self.group is not None else [])

    def common(self, df: DataFrame) -> Column | None:
        """A condition that every set implies, for the file scan to skip by."""
        if self.everything or not self.sets:
            return None
        out = []
        for at in [*self.columns, *([GROUP] if self.group is not None else [])]:
            own = [{t for t in tests if t.at is at} for tests in self.sets.values()]
            different = set().union(*own)
            if all(own) and len(different) <= PUSHED:
                column = self.group if at is GROUP else at.column
                tests = sorted(different, key=str)
                out.append(reduce(or_, [
                    predicate(df, column, [t.low, t.high] if t.equals is None else t.equals)
                    for t in tests
                ]))
        return reduce(lambda a, b: a & b, out) if out else None

    def rows(self, batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[object, np.ndarray | slice]]:
        """Each key that rows of the batch pass, with the places of those rows."""
        for key in self.everything:
            yield key, slice(None)
        orders: dict[tuple[str, bool], _Order] = {}

        def order(test: _Test) -> _Order:
            ranged = test.equals is None
            name = test.at.number if ranged else test.at.text
            if (name, ranged) not in orders:
                orders[name, ranged] = (_Numbers if ranged else _Texts)(batch.column(name))
            return orders[name, ranged]

        for key, tests in self.sets.items():
            stretches = [order(t).stretch(t) for t in tests]
            shortest = min(range(len(tests)), key=lambda i: stretches[i][1] - stretches[i][0])
            rows = order(tests[shortest]).order[slice(*stretches[shortest])]
            for i, t in enumerate(tests):
                if len(rows) and i != shortest:
                    rows = rows[order(t).holds(t, rows)]
            if len(rows):
                yield key, np.sort(rows)


GROUP = Indexed("", TEXT, False, -1)


class _Texts:
    """Rows of a batch in the order of a text column's dictionary."""

    def __init__(self, column):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
            if isinstance(column, pa.ChunkedArray):
                column = pa.concat_arrays(column.chunks)
        coded = column.dictionary_encode()
        self.codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        self.code = {v: i for i, v in enumerate(coded.dictionary.to_pylist())}
        self.order = np.argsort(self.codes, kind="stable")
        self.starts = np.searchsorted(
            self.codes[self.order], np.arange(len(self.code) + 1)
        )

    def stretch(self, test: _Test) -> tuple[int, int]:
        at = self.code.get(test.equals)
        return (0, 0) if at is None else (self.starts[at], self.starts[at + 1])

    def holds(self, test: _Test, rows: np.ndarray) -> np.ndarray:
        return self.codes[rows] == self.code.get(test.equals, -2)


class _Numbers:
    """Rows of a batch in the order of a number column; null and NaN are in no range."""

    def __init__(self, column):
        self.values = column.to_numpy(zero_copy_only=False) if isinstance(
            column, pa.Array) else column.to_numpy()
        self.values = self.values.astype(np.float64)
        known = np.flatnonzero(~np.isnan(self.values))
        self.order = known[np.argsort(self.values[known], kind="stable")]
        self.ordered = self.values[self.order]

    def stretch(self, test: _Test) -> tuple[int, int]:
        start = np.searchsorted(self.ordered, test.low, side="left")
        return start, max(start, np.searchsorted(self.ordered, test.high, side="right"))

    def holds(self, test: _Test, rows: np.ndarray) -> np.ndarray:
        values = self.values[rows]
        return (values >= test.low) & (values <= test.high)


_Order = _Texts | _Numbers
