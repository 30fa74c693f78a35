"""Feature preparation: encoding, scaling, vectors, class weights.

Scalers are fitted with one aggregation (a single statistics row) and applied
as a plain projection, so fit-on-train / apply-to-all costs one extra pass and
no shuffle.  Standard scaling uses the *population* std (MLlib's scaler uses
the sample std), a zero std or range divides by 1 as in the reference.
"""

from __future__ import annotations

from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsieve.functions.joins import small_side


def label_index(df: DataFrame, label_col: str = "label", out_col: str = "label_idx",
                fit_on: DataFrame | None = None, handle_invalid: str = "error"):
    """Class index in lexicographic order of the label strings.

    Returns (indexed df, fitted StringIndexerModel); ``model.labels`` is the vocabulary.
    """
    src = fit_on if fit_on is not None else df
    model = StringIndexer(inputCol=label_col, outputCol=out_col,
                          stringOrderType="alphabetAsc", handleInvalid=handle_invalid).fit(src)
    out = model.transform(df).withColumn(out_col, F.col(out_col).cast("int"))
    return out, model


def index_to_label(df: DataFrame, labels, index_col: str, out_col: str) -> DataFrame:
    """Class index -> class name (vocabulary shipped in the plan, not joined)."""
    t = IndexToString(inputCol=index_col, outputCol=out_col, labels=list(labels))
    return t.transform(df.withColumn(index_col, F.col(index_col).cast("double")))


def vocabulary(*dfs: DataFrame, label_col: str = "label") -> DataFrame:
    """Distinct labels over several tables (for a shared encoder)."""
    out = None
    for d in dfs:
        part = d.select(F.col(label_col).cast("string").alias(label_col))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def one_hot(df: DataFrame, cols, drop_first: bool = True, exclude=(),
            categories: dict | None = None) -> DataFrame:
    """0/1 columns ``<col>_<value>`` per category, the alphabetically first dropped.

    The category list comes from one distinct-values aggregation per call (a
    statistics row) unless ``categories`` ({col: [values]}) fixes it -- e.g. the
    list fitted on train, or a fixed schema for a stream.  The indicator
    columns are plain ``when`` projections.
    """
    cols = [c for c in cols if c not in set(exclude)]
    if not cols:
        return df
    cats: dict[str, list] = {c: list((categories or {}).get(c, [])) for c in cols}
    todo = [c for c in cols if not (categories and c in categories)]
    if todo:
        # Distinct (column, value) pairs: a distributed distinct; only categories reach the driver.
        pairs = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in todo]))
            .alias("p")).select("p.*").where(F.col("v").isNotNull()).distinct().collect()
        for r in pairs:
            cats[r["c"]].append(r["v"])
    exprs = {}
    for c in cols:
        values = sorted(cats[c])
        if drop_first:
            values = values[1:]
        for v in values:
            exprs[f"{c}_{v}"] = F.when(F.col(c) == F.lit(v), 1).otherwise(0)
    return df.withColumns(exprs).drop(*cols)


def _number(c: str):
    """The column as double; NaN is missing and takes no part in a fit."""
    x = F.col(c).cast("double")
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def fit_standard(fit_on: DataFrame, cols) -> dict[str, tuple[float, float]]:
    """(mean, population std) per column from one aggregation."""
    row = fit_on.agg(*[x for c in cols for x in (
        F.avg(_number(c)).alias(f"m_{c}"), F.stddev_pop(_number(c)).alias(f"s_{c}"))]).collect()[0]
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in cols}


def standard_scale(df: DataFrame, cols, fit_on: DataFrame | None = None,
                   params: dict | None = None) -> tuple[DataFrame, dict]:
    """(x - mean) / std, fitted on ``fit_on`` (train) or on ``df`` itself."""
    params = params or fit_standard(fit_on if fit_on is not None else df, cols)
    exprs = {}
    for c in cols:
        m, s = params[c]
        s = s if s not in (None, 0.0) else 1.0
        exprs[c] = (F.col(c).cast("double") - F.lit(m if m is not None else 0.0)) / F.lit(s)
    return df.withColumns(exprs), params


def fit_minmax(fit_on: DataFrame, cols) -> dict[str, tuple[float, float]]:
    row = fit_on.agg(*[x for c in cols for x in (
        F.min(_number(c)).alias(f"lo_{c}"), F.max(_number(c)).alias(f"hi_{c}"))]).collect()[0]
    return {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in cols}


def minmax_scale(df: DataFrame, cols, fit_on: DataFrame | None = None,
                 params: dict | None = None) -> tuple[DataFrame, dict]:
    """(x - min) / (max - min), fitted on train; test rows may leave [0, 1]."""
    params = params or fit_minmax(fit_on if fit_on is not None else df, cols)
    exprs = {}
    for c in cols:
        lo, hi = params[c]
        lo = lo if lo is not None else 0.0
        rng = (hi - lo) if hi is not None and hi != lo else 1.0
        exprs[c] = (F.col(c).cast("double") - F.lit(lo)) / F.lit(rng)
    return df.withColumns(exprs), params


def assemble(df: DataFrame, cols, out_col: str = "features",
             handle_invalid: str = "error") -> DataFrame:
    """Numeric columns -> one ML vector."""
    return VectorAssembler(inputCols=list(cols), outputCol=out_col,
                           handleInvalid=handle_invalid).transform(df)


def class_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Balanced weight n / (k * n_c) per class (totals are scalar subqueries, NULL is a class)."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    k = counts.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("weight", total.cast("double") / (k * F.col("n")))


def pos_weight(df: DataFrame, y_col: str) -> DataFrame:
    """Negatives / positives for a 0/1 target (NULL when there is no positive)."""
    return df.agg(F.count_if(F.col(y_col) == 0).alias("n_neg"),
                  F.count_if(F.col(y_col) == 1).alias("n_pos")) \
             .withColumn("pos_weight", F.try_divide(F.col("n_neg").cast("double"), F.col("n_pos")))


def attach_class_weights(df: DataFrame, label_col: str = "label",
                         weight_col: str = "weight") -> DataFrame:
    """Per-row class weight.  The class table (one row per class) is
    broadcast after its size is checked; a hot class never meets a shuffle."""
    w = class_weights(df, label_col).select(F.col(label_col).alias("_l"), F.col("weight").alias(weight_col))
    return df.join(small_side(w), F.col(label_col).eqNullSafe(F.col("_l"))).drop("_l")
