"""The schema mapping: which user column plays which standard part.

A mapping is plain driver-side configuration. It is resolved to column
expressions while the plan is built, so a catalogue with any columns
becomes one ``select`` that Catalyst can prune down to the file scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.constants import ALL_ROLES, STANDARD_FIELDS


@dataclass(frozen=True)
class CustomColumn:
    user_column: str
    standard_column: str
    role: str = "metadata"
    required: bool = False


@dataclass(frozen=True)
class SchemaMapping:
    id_column: str | None = None
    name_column: str | None = None
    description_column: str | None = None
    category_column: str | None = None
    custom_columns: tuple[CustomColumn, ...] = field(default_factory=tuple)
    required_columns: tuple[str, ...] = field(default_factory=tuple)

    @classmethod
    def from_dict(cls, raw: Mapping) -> SchemaMapping:
        return cls(
            id_column=raw.get("id_column") or None,
            name_column=raw.get("name_column") or None,
            description_column=raw.get("description_column") or None,
            category_column=raw.get("category_column") or None,
            custom_columns=tuple(
                CustomColumn(
                    c["user_column"],
                    c["standard_column"],
                    c.get("role", "metadata"),
                    bool(c.get("required", False)),
                )
                for c in raw.get("custom_columns") or ()
            ),
            required_columns=tuple(raw.get("required_columns") or ()),
        )

    def to_dict(self) -> dict:
        return asdict(self)

    def user_column(self, standard: str) -> str | None:
        """User column behind one of the four standard fields."""
        return getattr(self, f"{standard}_column")

    def customs(self, roles: Iterable[str] = ALL_ROLES) -> list[CustomColumn]:
        wanted = set(roles)
        return [c for c in self.custom_columns if c.role in wanted]

    def mapped_user_columns(self) -> list[str]:
        """Every mapped user column once, standard fields first."""
        base = [self.user_column(f) for f in STANDARD_FIELDS]
        custom = [c.user_column for c in self.custom_columns]
        return list(dict.fromkeys(c for c in base + custom if c))


def user_col(name: str) -> Column:
    """Reference a user column by its literal name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_col(name: str) -> Column:
    return user_col(name).cast("string")


def present_customs(
    df: DataFrame, mapping: SchemaMapping, roles: Iterable[str] = ALL_ROLES
) -> list[CustomColumn]:
    """Custom columns of the given roles that the data really has."""
    have = set(df.columns)
    return [c for c in mapping.customs(roles) if c.user_column in have]


def missing_fields(
    df: DataFrame, mapping: SchemaMapping, fields: Iterable[str]
) -> list[str]:
    """Of the standard ``fields``, those unmapped or absent from the data."""
    have = set(df.columns)
    users = {f: mapping.user_column(f) for f in fields}
    return [user or f"{f}_column" for f, user in users.items() if user not in have]


def missing_columns(
    df: DataFrame, mapping: SchemaMapping, fields: Iterable[str]
) -> list[str]:
    """All required columns that are not there: the standard ``fields``, custom
    columns marked required, and the mapping's own ``required_columns``."""
    named = [c.user_column for c in mapping.custom_columns if c.required]
    named += mapping.required_columns
    absent = [c for c in named if c not in df.columns]
    return list(dict.fromkeys(missing_fields(df, mapping, fields) + absent))


def require_columns(
    df: DataFrame, mapping: SchemaMapping, fields: Iterable[str], declared: bool = False
) -> None:
    """Raise if ``fields`` are missing, or with ``declared`` any required column."""
    find = missing_columns if declared else missing_fields
    missing = find(df, mapping, fields)
    if missing:
        raise ValueError(f"Missing required column: {', '.join(missing)}")
