"""Cleaning: drops, absolute value, missing/infinite handling, fills, clip, casts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsieve.functions.columns import fractional_columns, numeric_columns
from netsieve.functions.expressions import clip, is_inf
from netsieve.operators import quantiles as Q


def drop_columns(df: DataFrame, cols, required: bool = False) -> DataFrame:
    """Drop listed columns; ``required=True`` fails when one is absent."""
    if required:
        missing = [c for c in cols if c not in df.columns]
        if missing:
            raise ValueError(f"cannot drop absent column(s) {missing}")
    return df.drop(*cols)


def normalize_missing(df: DataFrame, cols=None, inf_to_null: bool = False) -> DataFrame:
    """C6 + NaN rule: NaN -> NULL (and +/-inf -> NULL when asked) in one projection.

    Applied at the entry of every statistic, because Spark treats NaN as a
    value (in distinct counts, max, median) while pandas treats it as missing.
    """
    frac = set(fractional_columns(df))
    targets = [c for c in (cols if cols is not None else df.columns) if c in frac]
    if not targets:
        return df
    out = []
    for c in df.columns:
        if c in targets:
            bad = F.isnan(c) | is_inf(c) if inf_to_null else F.isnan(c)
            out.append(F.when(bad, F.lit(None)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def abs_columns(df: DataFrame, cols) -> DataFrame:
    """Absolute value in place."""
    return df.withColumns({c: F.abs(c) for c in cols})


def fill_median(df: DataFrame, cols=None, fit_on: DataFrame | None = None,
                **qkw) -> tuple[DataFrame, dict[str, float]]:
    """Fill missing numeric values with the column median (exact, interpolated).

    Medians are fitted on ``fit_on`` (default: ``df`` itself) with the bounded
    exact quantile operator and applied with one ``fillna``-style projection.
    One counting pass finds the columns that miss a value at all: only those
    are fitted, and only those become double (a median may be x.5).  Columns
    without a gap keep their type and values, all-missing ones stay as they are.
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    src = fit_on if fit_on is not None else df
    frac = set(fractional_columns(df))

    def miss(c):
        return F.col(c).isNull() | F.isnan(c) if c in frac else F.col(c).isNull()
    gaps = df.agg(*[F.count_if(miss(c)).alias(f"g{i}") for i, c in enumerate(cols)]).first() if cols else []
    meds = Q.medians(src, [c for c, n in zip(cols, gaps) if n], **qkw)
    return df.withColumns({c: F.when(miss(c), F.lit(float(m))).otherwise(F.col(c).cast("double"))
                           for c, m in meds.items() if m is not None}), meds


def fill_zero(df: DataFrame, cols=None) -> DataFrame:
    """Missing (NULL and NaN) -> 0 in numeric columns."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    frac = set(fractional_columns(df))
    return df.withColumns({
        c: F.when(F.col(c).isNull() | (F.isnan(c) if c in frac else F.lit(False)), F.lit(0))
        .otherwise(F.col(c)) for c in cols})


def clip_columns(df: DataFrame, cols, lo: float = -1e6, hi: float = 1e6) -> DataFrame:
    """Clamp values to [lo, hi] (after C6/C8)."""
    return df.withColumns({c: clip(c, lo, hi) for c in cols})


def cast_columns(df: DataFrame, cols, to: str) -> DataFrame:
    """Cast columns (``float``, ``int``, ``string``, ...)."""
    return df.withColumns({c: F.col(c).cast(to) for c in cols})


def where_equal(df: DataFrame, col: str, value, negate: bool = False) -> DataFrame:
    """Rows equal (or not equal) to a value; NULL is never equal."""
    cond = F.coalesce(F.col(col) == F.lit(value), F.lit(False))
    return df.where(~cond if negate else cond)


def where_in(df: DataFrame, col: str, values, negate: bool = False) -> DataFrame:
    """Membership filter and its complement (NULL falls in the complement)."""
    cond = F.coalesce(F.col(col).isin(list(values)), F.lit(False))
    return df.where(~cond if negate else cond)
