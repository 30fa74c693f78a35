"""Scalar expressions used across operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_inf(c) -> Column:
    """True for +/-infinity."""
    c = col(c)
    return c.isin(F.lit(INF), F.lit(-INF))


def is_missing(c, fractional: bool = True) -> Column:
    """NULL, or NaN for fractional columns (pandas ``isnull`` semantics)."""
    c = col(c)
    return (c.isNull() | F.isnan(c)) if fractional else c.isNull()


def nan_to_null(c, inf_too: bool = False) -> Column:
    """NaN -> NULL (and optionally +/-inf -> NULL); keeps the column type."""
    c = col(c)
    bad = F.isnan(c) | is_inf(c) if inf_too else F.isnan(c)
    return F.when(bad, F.lit(None)).otherwise(c)


def clip(c, lo: float, hi: float) -> Column:
    """Clamp to [lo, hi]; NULL stays NULL."""
    c = col(c)
    return F.when(c.isNull(), F.lit(None)).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def safe_div(num, den) -> Column:
    """division that yields NULL instead of raising on a zero denominator."""
    return F.try_divide(col(num), col(den))


def eps_div(num, den, eps: float = 1e-8) -> Column:
    """``num / (den + eps)`` as in the std/mean ratio."""
    return F.try_divide(col(num), col(den) + F.lit(eps))


def is_attack(label_col="label", benign: str = "BENIGN") -> Column:
    """C11: 0 for the benign class, 1 otherwise; a NULL label counts as attack."""
    return F.when(F.coalesce(col(label_col) == F.lit(benign), F.lit(False)), 0).otherwise(1)


def argmax(arr) -> Column:
    """0-based position of the largest element of an array column."""
    a = col(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def sigmoid(c) -> Column:
    """logistic function."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(c)))


def severity(prediction) -> Column:
    """1 -> high, anything else -> low."""
    return F.when(col(prediction) == 1, F.lit("high")).otherwise(F.lit("low"))


def flag(prediction) -> Column:
    """1 -> MALICIOUS, anything else -> ACK."""
    return F.when(col(prediction) == 1, F.lit("MALICIOUS")).otherwise(F.lit("ACK"))


def day_from_file(file_name) -> Column:
    """base name up to the first '-', trimmed."""
    return F.trim(F.split(col(file_name), "-").getItem(0))


def run_stamp() -> Column:
    """current time as yyyyMMdd_HHmmss."""
    return F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")


def rounded(c, digits: int = 6) -> Column:
    """Round a double and fold -0.0 into 0.0 (stable across engines)."""
    return F.round(col(c).cast("double"), digits) + F.lit(0.0)
