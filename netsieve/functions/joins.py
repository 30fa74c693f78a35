"""Joins against a side whose size must be proven before it is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side is broadcast up to this many estimated bytes (rows x width of its columns).
MAX_BROADCAST_BYTES = 64 << 20
DEFAULT_SALT = 32


def _row_bytes(df: DataFrame) -> int:
    """Bytes of a row in memory: fixed types plus an allowance for strings and nested columns."""
    return 16 + sum(8 if t in ("int", "bigint", "double", "float", "boolean", "date", "timestamp", "smallint", "tinyint")
                    else 64 for _, t in df.dtypes)


def fits_broadcast(df: DataFrame, max_rows: int | None = None) -> bool:
    """Whether a counted side is within the bound."""
    limit = MAX_BROADCAST_BYTES // _row_bytes(df) if max_rows is None else max_rows
    return df.limit(limit + 1).count() <= limit


def small_side(df: DataFrame) -> DataFrame:
    """Broadcast hint for a side proven small; otherwise the side as it is (a shuffle join)."""
    return F.broadcast(df) if fits_broadcast(df) else df


def join_bounded(big: DataFrame, small: DataFrame, on, how: str = "inner",
                 max_rows: int | None = None, salt: int = DEFAULT_SALT) -> DataFrame:
    """Equi-join that broadcasts ``small`` only after counting it against the bound.

    Beyond the bound the join is a shuffle join with the keys salted: the rows of ``big``
    are dealt over ``salt`` sub-keys in turn (so even equal rows spread) and the
    small side is replicated per sub-key; a key holding a third of the big side becomes
    ``salt`` tasks.  Right and full joins, whose unmatched small rows must not
    repeat, join unsalted and rely on adaptive skew splitting.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if fits_broadcast(small, max_rows):
        return big.join(F.broadcast(small), keys, how)
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti") or salt <= 1:
        return big.join(small, keys, how)
    salted_big = big.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salt)))
    salted_small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salt - 1).cast("bigint"))))
    return salted_big.join(salted_small, keys + ["_salt"], how).drop("_salt")
