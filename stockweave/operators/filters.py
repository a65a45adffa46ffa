"""Search filters as plain predicates that reach the file scan."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal, InvalidOperation
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockweave.constants import PRICE_MAX
from stockweave.mapping import SchemaMapping, user_col

ALIASES = {"price_range": "price"}


def active_filters(filters: Mapping[str, object]) -> dict[str, object]:
    """The filters that have a value."""

    def empty(value: object) -> bool:
        return value is None or (
            isinstance(value, str | list | tuple | dict) and not value
        )

    return {k: v for k, v in filters.items() if not empty(v)}


def covers(known: Mapping[str, str], filters: Mapping[str, object]) -> bool:
    """Whether the columns ``known`` are enough for all active filters."""
    return all(k in known or ALIASES.get(k, k) in known for k in active_filters(filters))


def bounds(value: object) -> tuple[float, float]:
    low, high = value
    return (
        0.0 if low in (None, "") else float(low),
        float(PRICE_MAX) if high in (None, "") else float(high),
    )


def predicate(df: DataFrame, column: str, value: object) -> Column:
    """``[min, max]`` is an inclusive numeric range, any other value equality.

    A numeric column is compared as it is, so the bounds can be pushed down; a
    text column goes through ``try_cast`` and non-numbers never match. Equality
    is by the type of the column.
    """
    kind = df.schema[column].dataType
    c = user_col(column)
    if isinstance(value, list | tuple):
        low, high = bounds(value)
        number = c if isinstance(kind, T.NumericType) else c.try_cast("double")
        return number.between(F.lit(low), F.lit(high))
    if isinstance(kind, T.StringType):
        return c == F.lit(str(value))
    return c == _typed(value, kind)


def _typed(value: object, kind: T.DataType) -> Column:
    """The value as a literal of the column's type, so that it can be pushed down.

    A value that the type cannot hold is a null literal and equals nothing.
    """
    if isinstance(kind, T.IntegralType):
        return F.lit(whole_number(value)).try_cast(kind)
    return F.lit(str(value)).try_cast(kind)


def whole_number(value: object) -> str | None:
    """The digits of a whole number, however it is written; None for anything else."""
    try:
        number = Decimal(str(value).strip())
        return str(int(number)) if number == number.to_integral_value() else None
    except (InvalidOperation, OverflowError, ValueError):
        return None


def filter_columns(df: DataFrame, mapping: SchemaMapping | None) -> dict[str, str]:
    """Filter key to column of ``df``: by mapping if given, else same name."""
    if mapping is None:
        return {c: c for c in df.columns}
    keys = {c.standard_column: c.user_column for c in mapping.custom_columns}
    if mapping.category_column:
        keys["category"] = mapping.category_column
    return {k: u for k, u in keys.items() if u in df.columns}


def filter_condition(
    df: DataFrame, filters: Mapping[str, object], mapping: SchemaMapping | None = None
) -> Column | None:
    """All given filters as one condition on ``df``; None if none is active.

    Filters name standard columns. With a mapping they are applied to the raw
    user columns, so nothing stands between the predicate and the scan.
    """
    known = filter_columns(df, mapping)
    parts = []
    for key, value in active_filters(filters).items():
        column = known.get(key) or known.get(ALIASES.get(key, key))
        if column is None:
            raise ValueError(f"unknown filter column: {key}")
        parts.append(predicate(df, column, value))
    return reduce(and_, parts) if parts else None


def apply_filters(
    df: DataFrame, filters: Mapping[str, object], mapping: SchemaMapping | None = None
) -> DataFrame:
    """Rows that pass all given filters; empty filter values are ignored."""
    condition = filter_condition(df, filters, mapping)
    return df if condition is None else df.where(condition)


def min_score(df: DataFrame, floor: float, score: str = "score") -> DataFrame:
    """Drop scores under the floor; NaN is not under it and stays."""
    return df.where(~(F.col(score) < F.lit(floor)))
