"""Deterministic, engine-portable hash keys for sampling and splitting.

md5 over ``cast(id as string) || ':' || seed`` is identical in Spark and in
ANSI-SQL engines, so every split/sample built on it can be checked by an oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SEED = 42


def hash_key(id_col, seed: int = DEFAULT_SEED) -> Column:
    """Hex md5 of the id and seed; sorts uniformly at random.  A NULL id hashes as empty."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.coalesce(c.cast("string"), F.lit("")), F.lit(f":{seed}")))


def hash_bucket(key: Column, hex_digits: int = 4) -> Column:
    """Leading hex digits of a hash key as an int bucket (order-preserving)."""
    return F.conv(F.substring(key, 1, hex_digits), 16, 10).cast("int")


def hash_uniform(key: Column) -> Column:
    """A uniform double in [0, 1) from the first 13 hex digits of a hash key."""
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))
