"""Column expressions on text. All of them run inside the JVM."""

from __future__ import annotations

import string
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as `strip()` sees it: Spark's own trim only removes blanks.
_SPACE = r"[\s\u001c-\u001f\u0085\ufeff\p{Z}]+"


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^{_SPACE}", ""), f"{_SPACE}$", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def or_text(c: Column, null_text: str) -> Column:
    """The cell as text, a missing cell as ``null_text``."""
    return F.coalesce(c.cast("string"), F.lit(null_text))


def join_filled(sep: str, parts: list[Column]) -> Column:
    """Join the parts that hold text; null and empty ones leave no separator."""
    return F.concat_ws(sep, *[F.nullif(p, F.lit("")) for p in parts])


def render(template: str, values: Mapping[str, Column]) -> Column:
    """Fill ``{field}`` marks of a template with columns."""
    pieces = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name:
            pieces.append(values[name])
    return F.concat(*pieces)


def field_label(key: str) -> str:
    """``list_price`` becomes ``List Price``."""
    return string.capwords(key, "_").replace("_", " ")


def words(c: Column) -> Column:
    """Lower-case words of the whole text; an empty text has none."""
    return F.array_remove(F.split(F.lower(c), r"\s+"), "")
