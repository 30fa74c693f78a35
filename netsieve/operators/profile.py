"""Profiling: distributions, ranges, anomaly counts, redundancy.

Per-column statistics are fused into one aggregation pass and then unpivoted
into a (feature, ...) table, instead of one job per column.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsieve.functions.columns import fractional_columns
from netsieve.functions.expressions import eps_div, is_attack, is_inf, is_missing, rounded
from netsieve.operators import quantiles as Q


def _unpivot(row_df: DataFrame, value_names: list[str], out: str) -> DataFrame:
    return row_df.unpivot([], value_names, "feature", out)


def frequency(df: DataFrame, col: str, pct_digits: int = 2) -> DataFrame:
    """A1 + A2 + T3: value counts with percentage share, most frequent first (ties by value).

    The total is a scalar subquery over the counts, so a column with very many
    values (files, addresses) is never gathered into one task.
    """
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return (counts.withColumn("pct", F.round(F.col("n") * 100.0 / total, pct_digits))
            .orderBy(F.desc("n"), F.asc_nulls_last(col)))


def load_summary(df: DataFrame, file_col: str = "source_file") -> DataFrame:
    """S3: rows per source file plus a grand total row (file = NULL), and the width."""
    return (df.rollup(file_col).agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn("n_cols", F.lit(len(df.columns)).cast("bigint")))


def value_ranges(df: DataFrame, cols) -> DataFrame:
    """A3: (feature, min_value, max_value) in one pass."""
    aggs, frac = [], set(fractional_columns(df))
    for c in cols:
        x = F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c)) if c in frac else F.col(c)
        aggs += [F.min(x).cast("double").alias(f"{c}__min"), F.max(x).cast("double").alias(f"{c}__max")]
    row = df.agg(*aggs)
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"{c}__min").alias("min_value"),
                 F.col(f"{c}__max").alias("max_value")) for c in cols])).alias("s")).select("s.*")


def negative_counts(df: DataFrame, cols) -> DataFrame:
    """A4: (feature, n_negative)."""
    row = df.agg(*[F.count_if(F.col(c) < 0).alias(c) for c in cols])
    return _unpivot(row, list(cols), "n_negative")


def inf_counts(df: DataFrame, cols=None) -> DataFrame:
    """A5: (feature, n_inf) for columns holding at least one +/-infinity."""
    cols = list(cols) if cols is not None else fractional_columns(df)
    row = df.agg(*[F.count_if(is_inf(c)).alias(c) for c in cols])
    return _unpivot(row, cols, "n_inf").where(F.col("n_inf") > 0)


def missing_counts(df: DataFrame, cols) -> DataFrame:
    """(feature, n_missing), NULL or NaN, largest first."""
    frac = set(fractional_columns(df))
    row = df.agg(*[F.count_if(is_missing(c, c in frac)).alias(c) for c in cols])
    return _unpivot(row, list(cols), "n_missing").orderBy(F.desc("n_missing"), "feature")


def missing_pct_by_group(df: DataFrame, group_col: str, cols, digits: int = 4) -> DataFrame:
    """(group, feature, missing_pct) for columns with any missing value."""
    frac = set(fractional_columns(df))
    per = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("__n"),
                                    *[F.count_if(is_missing(c, c in frac)).alias(c) for c in cols])
    long = per.unpivot([group_col, "__n"], list(cols), "feature", "n_missing")
    return (long.where(F.col("n_missing") > 0)
            .select(group_col, "feature",
                    F.round(F.col("n_missing") * 100.0 / F.col("__n"), digits).alias("missing_pct")))


def distinct_counts(df: DataFrame, cols, exact: bool = True) -> DataFrame:
    """(feature, n_distinct) ignoring missing values (NaN is missing).

    ``exact=False`` uses HyperLogLog++ sketches (bounded state) for profiling.
    """
    frac = set(fractional_columns(df))

    def norm(c):
        return F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c)) if c in frac else F.col(c)
    if exact:
        aggs = [F.count_distinct(norm(c)).alias(c) for c in cols]
    else:
        aggs = [F.approx_count_distinct(norm(c)).alias(c) for c in cols]
    return _unpivot(df.agg(*aggs), list(cols), "n_distinct")


def column_extremes(df: DataFrame, cols) -> dict[str, tuple]:
    """One pass: {col: (non-missing count, min, max)} with NaN treated as missing."""
    frac = set(fractional_columns(df))
    aggs = []
    for i, c in enumerate(cols):
        x = F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c)) if c in frac else F.col(c)
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    row = df.agg(*aggs).collect()[0]
    return {c: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(cols)}


def _extremes_df(df: DataFrame, cols) -> DataFrame:
    frac = set(fractional_columns(df))
    structs = []
    for c in cols:
        x = F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c)) if c in frac else F.col(c)
        structs.append(F.struct(F.lit(c).alias("feature"), F.count(x).alias("n"),
                                F.min(x).cast("double").alias("lo"),
                                F.max(x).cast("double").alias("hi")))
    return df.agg(F.array(*structs).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def zero_variance_columns(df: DataFrame, cols) -> DataFrame:
    """Columns with exactly one distinct non-missing value: (feature, value).

    min = max on NaN-free data, in one aggregation (no per-column distinct).
    A constant-plus-missing column is included, an all-missing one is not.
    """
    ex = _extremes_df(df, cols)
    return ex.where((F.col("n") > 0) & (F.col("lo") == F.col("hi"))) \
             .select("feature", (F.col("lo") + F.lit(0.0)).alias("value"))


def constant_columns(df: DataFrame, cols) -> DataFrame:
    """C17: columns with at most one distinct non-missing value (all-missing included)."""
    ex = _extremes_df(df, cols)
    return ex.where((F.col("n") == 0) | (F.col("lo") == F.col("hi"))).select("feature")


def drop_zero_variance(df: DataFrame, cols) -> tuple[DataFrame, list[str]]:
    """C2 applied: drop the columns that hold a single distinct value."""
    ext = column_extremes(df, cols)
    drop = [c for c, (n, lo, hi) in ext.items() if n > 0 and lo == hi]
    return df.drop(*drop), drop


def attack_ratio(df: DataFrame, label_col: str = "label", digits: int = 6) -> DataFrame:
    """A9 + C11: rows, attack rows and attack share."""
    a = is_attack(label_col)
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.sum(a).cast("bigint").alias("n_attack"),
                  rounded(F.avg(a), digits).alias("attack_ratio"))


def describe(df: DataFrame, cols, digits: int = 6, accuracy: int = Q.ACCURACY,
             max_band_rows: int = Q.MAX_BAND_ROWS) -> DataFrame:
    """A10: count, mean, sample std, min, quartiles, max and std/(mean+1e-8) per feature.

    Moments come from one wide aggregation per group of columns, quartiles
    from the bounded exact quantile passes; missing values (NULL/NaN) are left out.
    """
    cols, moments = list(cols), {}
    for at in range(0, len(cols), Q.COLUMNS_PER_PASS):
        part, aggs = cols[at:at + Q.COLUMNS_PER_PASS], []
        for i, c in enumerate(part):
            v = Q._value(df, c)
            aggs += [F.count(v).alias(f"count{i}"), F.avg(v).alias(f"mean{i}"), F.stddev_samp(v).alias(f"std{i}"),
                     F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}")]
        row = df.agg(*aggs).first()
        moments |= {c: {k: row[f"{k}{i}"] for k in ("count", "mean", "std", "min", "max")}
                    for i, c in enumerate(part) if row[f"count{i}"]}
    qs, _ = Q.quantiles(df, cols, [0.25, 0.5, 0.75], accuracy, max_band_rows)
    rows = []
    for c in cols:
        m = moments.get(c)
        rows.append((c, m["count"] if m else 0, m["mean"] if m else None,
                     m["std"] if m else None, m["min"] if m else None,
                     qs[c][0.25], qs[c][0.5], qs[c][0.75], m["max"] if m else None))
    out = df.sparkSession.createDataFrame(
        rows, "feature string, count bigint, mean double, std double, min double, "
              "p25 double, p50 double, p75 double, max double")
    return out.select(
        "feature", "count",
        rounded("mean", digits).alias("mean"), rounded("std", digits).alias("std"),
        rounded("min", digits).alias("min"), rounded("p25", digits).alias("p25"),
        rounded("p50", digits).alias("p50"), rounded("p75", digits).alias("p75"),
        rounded("max", digits).alias("max"),
        rounded(eps_div("std", "mean"), digits).alias("cv"))


def _pair_corr(x: str, y: str):
    """Pearson r over pairwise-complete rows; NULL (not an error) for zero variance.

    Built as one SQL expression (a single JVM call per pair).
    """
    both = f"`{x}` IS NOT NULL AND `{y}` IS NOT NULL"
    xs = f"CASE WHEN {both} THEN CAST(`{x}` AS DOUBLE) END"
    ys = f"CASE WHEN {both} THEN CAST(`{y}` AS DOUBLE) END"
    return F.expr(f"try_divide(covar_samp({xs}, {ys}), stddev_samp({xs}) * stddev_samp({ys}))")


def _pair_sums(cols, means):
    """Per task: the sums of every column pair over the rows where both are present, as matrix products."""
    import numpy as np
    import pyarrow as pa
    d = len(cols)
    upper = np.triu_indices(d, 1)
    names = ("n", "sx", "sy", "sxx", "syy", "sxy")

    def run(batches):
        sums = np.zeros((6, d, d))
        for batch in batches:
            x = np.column_stack([np.asarray(batch.column(i).fill_null(np.nan)) for i in range(d)]) - means
            m = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            sums += np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
        yield pa.RecordBatch.from_arrays(
            [pa.array(upper[0]), pa.array(upper[1]), *(pa.array(s[upper]) for s in sums)], names=["i", "j", *names])
    return run


def correlation_pairs(df: DataFrame, cols) -> DataFrame:
    """(feature_a, feature_b, corr) for every unordered pair, pairwise-complete like pandas.

    One small pass gives the column means; then each task turns its batches
    into column-by-column matrix products (six sums per pair) and one grouped
    sum of those small matrices yields every r.  Work per row is a matrix
    product, the shuffle holds one row per pair and task.  Missing values and
    NaN are left out; constant columns yield NULL.
    """
    import numpy as np
    cols = list(cols)
    values = df.select(*[Q._value(df, c).alias(f"c{i}") for i, c in enumerate(cols)])
    row = values.agg(*[F.avg(f"c{i}").alias(f"c{i}") for i in range(len(cols))]).first()
    means = np.array([row[i] if row[i] is not None and np.isfinite(row[i]) else 0.0 for i in range(len(cols))])
    sums = values.mapInArrow(_pair_sums(cols, means), "i long, j long, n double, sx double, sy double, "
                                                      "sxx double, syy double, sxy double")
    s = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    vx = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), F.col("n"))
    vy = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), F.col("n"))
    cov = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n"))
    tiny = (vx <= F.col("sxx") * 1e-14) | (vy <= F.col("syy") * 1e-14)
    name = lambda c: F.element_at(F.array(*[F.lit(x) for x in cols]), (F.col(c) + 1).cast("int"))
    return s.select(name("i").alias("feature_a"), name("j").alias("feature_b"),
                    F.when(tiny, F.lit(None)).otherwise(F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy))).alias("corr"))


def high_corr_pairs(df: DataFrame, cols, lo: float = 0.95, hi: float = 1.0 - 1e-9,
                    digits: int = 6) -> DataFrame:
    """Pairs with lo < |r| < hi, listed in both orders (as a symmetric matrix)."""
    pc = correlation_pairs(df, cols).withColumn("abs_corr", F.abs("corr"))
    hit = pc.where((F.col("abs_corr") > lo) & (F.col("abs_corr") < hi))
    r = rounded("abs_corr", digits)
    both = F.explode(F.array(
        F.struct(F.col("feature_a").alias("feature_a"), F.col("feature_b").alias("feature_b"),
                 r.alias("abs_corr")),
        F.struct(F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"),
                 r.alias("abs_corr"))))
    return hit.select(both.alias("s")).select("s.*")


def target_correlation(df: DataFrame, cols, target: str, top: int = 20,
                       digits: int = 6) -> DataFrame:
    """A12 + T2: |corr(feature, target)| per feature, top ``top``, NULLs (constant) last."""
    row = df.agg(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.abs(_pair_corr(c, target)).alias("r"))
        for c in cols]).alias("a"))
    long = row.select(F.explode("a").alias("s")).select("s.*")
    return (long.orderBy(F.desc_nulls_last("r"), "feature").limit(top)
            .select("feature", rounded("r", digits).alias("abs_corr")))


def duplicate_columns(df: DataFrame, cols, order_col: str = "row_id") -> DataFrame:
    """(feature, duplicate_of) for columns equal, row by row, to an earlier column.

    One pass computes an order-insensitive fingerprint per column
    (xor of xxhash64(row key, value)); only columns with equal fingerprints are
    then verified exactly with a null-safe equality aggregate.
    """
    frac, kinds = set(fractional_columns(df)), dict(df.dtypes)

    def val(c):
        """Whole numbers compare exactly, as long; fractional ones as double, NaN as missing."""
        if c not in frac and not kinds[c].startswith("decimal"):
            return F.col(c).cast("long")
        x = F.col(c).cast("double")
        return F.when(F.isnan(x), F.lit(None)).otherwise(x + F.lit(0.0))

    def same(a, b):
        return val(a).eqNullSafe(val(b))
    fp = df.agg(*[F.bit_xor(F.xxhash64(F.col(order_col), val(c).cast("double"))).alias(f"f{i}")
                  for i, c in enumerate(cols)]).collect()[0]
    groups: dict[int, list[str]] = {}
    for i, c in enumerate(cols):
        groups.setdefault(fp[f"f{i}"], []).append(c)
    cands = [(a, b) for g in groups.values() if len(g) > 1 for a, b in combinations(g, 2)]
    spark = df.sparkSession
    if not cands:
        return spark.createDataFrame([], "feature string, duplicate_of string")
    row = df.agg(*[F.bool_and(same(a, b)).alias(f"p{i}")
                   for i, (a, b) in enumerate(cands)]).collect()[0]
    found = {}
    for i, (a, b) in enumerate(cands):
        if row[f"p{i}"] and b not in found:
            found[b] = a
    return spark.createDataFrame(sorted(found.items()), "feature string, duplicate_of string")


def first_row_per_label(df: DataFrame, label_col: str, order_col: str, cols,
                        n_labels: int | None = None) -> DataFrame:
    """The first row of each label, in order; ``n_labels`` optionally shows only the first ones.

    The smallest order key per label is a primitive hash aggregate (partial per
    task, no sort of the rows); one row per label then picks its columns up.
    """
    first = df.groupBy(label_col).agg(F.min(order_col).alias(order_col),
                                      *[F.min_by(c, order_col).alias(c) for c in cols])
    out = first.select(label_col, order_col, *cols).orderBy(order_col)
    return out.limit(n_labels) if n_labels is not None else out


def preview(df: DataFrame, order_cols, n: int = 3) -> DataFrame:
    """C16 + T4: the first ``n`` rows in a defined order (a bounded top-k, not a scan)."""
    return df.orderBy(*order_cols).limit(n)


def shape(df: DataFrame) -> tuple[int, int]:
    """(rows, columns)."""
    return df.count(), len(df.columns)


def feature_group_counts(df: DataFrame, cols=None) -> DataFrame:
    """(group, feature, n_values) for the packet / flag / timing feature groups."""
    from netsieve.functions.columns import feature_groups
    pairs = feature_groups(cols if cols is not None else df.columns)
    if not pairs:
        return df.sparkSession.createDataFrame([], "group string, feature string, n_values bigint")
    row = df.agg(F.array(*[
        F.struct(F.lit(g).alias("group"), F.lit(c).alias("feature"),
                 F.count(c).alias("n_values")) for g, c in pairs]).alias("a"))
    return row.select(F.explode("a").alias("s")).select("s.*")
