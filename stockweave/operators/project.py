"""Schema mapping as projections: narrow selects, never a shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.constants import ALL_ROLES, STANDARD_FIELDS, TRAINING_FIELDS
from stockweave.functions.text import or_text
from stockweave.mapping import (
    SchemaMapping,
    missing_columns,
    present_customs,
    require_columns,
    text_col,
    user_col,
)


def standard_columns(
    df: DataFrame, mapping: SchemaMapping, roles: Iterable[str] = ALL_ROLES
) -> dict[str, Column]:
    """Standard name to text expression, in mapping order.

    A custom column named like an earlier one (also like name, description or
    category) takes its place. Unmapped standard fields become null.
    """
    out: dict[str, Column] = {}
    for f in STANDARD_FIELDS:
        user = mapping.user_column(f)
        out[f] = text_col(user) if user in df.columns else F.lit(None).cast("string")
    for c in present_customs(df, mapping, roles):
        out[c.standard_column] = text_col(c.user_column)
    return out


def apply_schema_mapping(
    df: DataFrame,
    mapping: SchemaMapping,
    roles: Iterable[str] = ALL_ROLES,
    keep: Sequence[str] = (),
) -> DataFrame:
    """User columns to the standard record, all as text, plus ``keep`` as is."""
    require_columns(df, mapping, ["id", "name"])
    cols = standard_columns(df, mapping, roles)
    return df.select(
        *[expr.alias(name) for name, expr in cols.items()],
        *[user_col(k) for k in keep if k not in cols],
    )


def metadata_column(df: DataFrame, mapping: SchemaMapping, null_text: str = "") -> Column:
    """Custom columns of role ``metadata`` as ``map<string,string>``.

    With an empty ``null_text`` a missing cell leaves no entry, else it is kept
    as that text. A mapped column the data does not have is skipped.
    """
    entries = {
        c.standard_column: text_col(c.user_column)
        for c in present_customs(df, mapping, ["metadata"])
    }
    if not entries:
        return F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")
    pairs: list[Column] = []
    for key, value in entries.items():
        pairs += [F.lit(key), or_text(value, null_text) if null_text else value]
    made = F.create_map(*pairs)
    return made if null_text else F.map_filter(made, lambda _, v: v.isNotNull())


def metadata_map(df: DataFrame, mapping: SchemaMapping, null_text: str = "") -> DataFrame:
    require_columns(df, mapping, ["id"])
    return df.select(
        text_col(mapping.id_column).alias("id"),
        metadata_column(df, mapping, null_text).alias("metadata"),
    )


def product_records(
    df: DataFrame, mapping: SchemaMapping, null_text: str = "", keep: Sequence[Column] = ()
) -> DataFrame:
    """The standard result record: id, name, description, category, metadata."""
    require_columns(df, mapping, ["id", "name"])
    base = standard_columns(df, mapping, roles=[])
    return df.select(
        *[
            (or_text(expr, null_text) if null_text and name != "id" else expr).alias(name)
            for name, expr in base.items()
        ],
        metadata_column(df, mapping, null_text).alias("metadata"),
        *keep,
    )


def check_required_columns(
    df: DataFrame, mapping: SchemaMapping, fields: Sequence[str] = TRAINING_FIELDS
) -> DataFrame:
    """One row per required column: is it there, and how many rows fill it.

    A single aggregate over the required columns only; rows with
    ``is_present = false`` are the missing ones.
    """
    missing = missing_columns(df, mapping, fields)
    named = [mapping.user_column(f) for f in fields]
    named += [c.user_column for c in mapping.custom_columns if c.required]
    named += list(mapping.required_columns)
    present = [c for c in dict.fromkeys(named) if c and c not in missing]
    counts = df.agg(
        *[F.count(user_col(c)).alias(f"_{i}") for i, c in enumerate(present)],
        F.count(F.lit(1)).alias("_rows"),
    )
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(True).alias("is_present"),
            F.col(f"_{i}").alias("rows_filled"),
        )
        for i, c in enumerate(present)
    ] + [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(False).alias("is_present"),
            F.lit(0).cast("bigint").alias("rows_filled"),
        )
        for c in missing
    ]
    return counts.select(F.inline(F.array(*rows)))


def fill_missing_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cast the chosen columns to text and turn null into the empty text."""
    return df.withColumns({c: or_text(user_col(c), "") for c in cols})


def preview(df: DataFrame, mapping: SchemaMapping, n: int = 10) -> DataFrame:
    """The first ``n`` rows by id, mapped columns only, empty cells as ``-``."""
    require_columns(df, mapping, ["id"])
    cols = [c for c in mapping.mapped_user_columns() if c in df.columns]
    first = df.select(*[text_col(c).alias(c) for c in cols]).orderBy(
        user_col(mapping.id_column), *[user_col(c) for c in cols]
    ).limit(n)
    return first.select(
        *[F.coalesce(F.nullif(user_col(c), F.lit("")), F.lit("-")).alias(c) for c in cols]
    )
