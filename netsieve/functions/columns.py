"""Schema-level helpers: name cleaning and typed column lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
FRACTIONAL_TYPES = (T.FloatType, T.DoubleType)


def strip_column_names(df: DataFrame) -> DataFrame:
    """Strip surrounding whitespace from every column name; a collision raises."""
    stripped = [c.strip() for c in df.columns]
    seen = {}
    for orig, new in zip(df.columns, stripped):
        if new in seen:
            raise ValueError(f"columns {seen[new]!r} and {orig!r} collide as {new!r}")
        seen[new] = orig
    return df.toDF(*stripped)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """C14: columns of a numeric type (``select_dtypes(include=number)``)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def fractional_columns(df: DataFrame, exclude=()) -> list[str]:
    """Columns that can hold NaN / infinity."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, FRACTIONAL_TYPES) and f.name not in exclude]


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    """C14: columns of string type (``select_dtypes(include=object)``)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def feature_columns(df: DataFrame, exclude) -> list[str]:
    """C4: every column except the listed ones, in table order."""
    ex = set(exclude)
    return [c for c in df.columns if c not in ex]


def columns_containing(columns, needle: str, limit: int | None = None,
                       case_sensitive: bool = False) -> list[str]:
    """Column names containing a substring, first ``limit`` of them."""
    if case_sensitive:
        out = [c for c in columns if needle in c]
    else:
        out = [c for c in columns if needle.lower() in c.lower()]
    return out[:limit] if limit is not None else out


# The feature groups the profile lists.
FEATURE_GROUPS = ["Packet", "Flag", "IAT"]


def feature_groups(columns, limit: int | None = None) -> list[tuple[str, str]]:
    """(group, feature) pairs for the packet, flag and timing groups; ``limit`` shows only the first of each."""
    return [(group, c) for group in FEATURE_GROUPS for c in columns_containing(columns, group, limit)]
