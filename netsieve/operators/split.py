"""Reproducible splits and samples.

All random choices come from md5(id || seed), so a split is a pure function
of the data: re-running it (or re-running a lost task) gives the same rows,
and a SQL engine can reproduce it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsieve.functions.joins import small_side
from netsieve.functions.hashing import DEFAULT_SEED, hash_key, hash_uniform
from netsieve.operators.ranking import (RANK, SIZE, ceil_frac, cut_keys, floor_frac, hash_rank, round_frac,
                                         with_cuts)


#: Copies of one row that one task makes.
COPY_RUN = 100_000


def stratified_split(df: DataFrame, label_col: str, id_col: str, cuts=(("test", 0.2),),
                     rest: str = "train", seed: int = DEFAULT_SEED,
                     split_col: str = "split") -> DataFrame:
    """M1/M2/M3: exact per-class split.

    ``cuts`` are applied in order, each to what the earlier ones left:
    ``(("holdout", .1), ("test", .2))`` takes ceil(10 %) of every class for
    holdout, then ceil(20 %) of the remainder for test, the rest is ``rest``.
    """
    def upper(i):
        """Rows up to and including the i-th cut, as a function of the class size."""
        def rows(n):
            taken = F.lit(0).cast("bigint")
            for _, frac in cuts[:i + 1]:
                taken = taken + ceil_frac(n - taken, frac)
            return taken
        return rows
    t = with_cuts(df, id_col, {str(i): upper(i) for i in range(len(cuts))}, [label_col], seed)
    expr = F.lit(rest)
    for i, (name, _) in reversed(list(enumerate(cuts))):
        expr = F.when(F.col(f"_below_{i}"), F.lit(name)).otherwise(expr)
    return t.withColumn(split_col, expr).drop(*[f"_below_{i}" for i in range(len(cuts))])


def kfold(df: DataFrame, label_col: str, id_col: str, k: int = 3,
          seed: int = DEFAULT_SEED, fold_col: str = "fold") -> DataFrame:
    """M7: stratified k folds -- the class's hash order dealt round-robin."""
    ranked = hash_rank(df, id_col, [label_col], seed)
    return ranked.withColumn(fold_col, (F.col(RANK) % k).cast("int")).drop(RANK, SIZE)


def random_split(df: DataFrame, id_col: str, frac: float = 0.1, name: str = "val",
                 rest: str = "train", seed: int = DEFAULT_SEED,
                 split_col: str = "split") -> DataFrame:
    """M4: unstratified; the first int(n * frac) rows in hash order form ``name``."""
    t = with_cuts(df, id_col, {"0": lambda n: floor_frac(n, frac)}, (), seed)
    return t.withColumn(split_col, F.when(F.col("_below_0"), F.lit(name)).otherwise(F.lit(rest))).drop("_below_0")


def group_split(df: DataFrame, group_col: str, frac: float = 0.2, name: str = "test",
                rest: str = "train", seed: int = DEFAULT_SEED,
                split_col: str = "split") -> DataFrame:
    """M5 + J2: ceil(frac) of the distinct groups go to ``name``; groups never straddle."""
    groups = df.select(group_col).distinct()
    cut = cut_keys(groups, group_col, {"0": lambda n: ceil_frac(n, frac)}, (), seed).first()
    # One key decides for every group, so the split is a projection over the rows (no join).
    key = cut["_cut_0"] if cut else None
    inside = F.lit(True) if key is None else hash_key(group_col, seed) < F.lit(key)
    return df.withColumn(split_col, F.when(inside, F.lit(name)).otherwise(F.lit(rest)))


def rows_in_groups(df: DataFrame, groups: DataFrame, group_col: str,
                   keep: bool = True) -> DataFrame:
    """Rows whose group is (or is not) in a group list (semi / anti join).

    The list is reduced to its distinct groups and broadcast if it is proven small;
    a larger one is a shuffle join, in which adaptive skew splitting divides a hot group.
    """
    listed = small_side(groups.select(group_col).distinct())
    return df.join(listed, group_col, "left_semi" if keep else "left_anti")


def split_by_values(df: DataFrame, col: str, train_values, train: str = "train",
                    test: str = "test", split_col: str = "split") -> DataFrame:
    """M6: rows whose ``col`` is listed go to train, all others (NULL too) to test."""
    cond = F.coalesce(F.col(col).isin(list(train_values)), F.lit(False))
    return df.withColumn(split_col, F.when(cond, F.lit(train)).otherwise(F.lit(test)))


def sample_n(df: DataFrame, id_col: str, n: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """M8: min(n, rows) rows without replacement (the first n in hash order)."""
    return with_cuts(df, id_col, {"0": lambda size: F.least(size, F.lit(n))}, (), seed) \
        .where("_below_0").drop("_below_0")


def downsample_class(df: DataFrame, label_col: str, id_col: str, cls: str, frac: float,
                     seed: int = DEFAULT_SEED) -> DataFrame:
    """M9 + U3: keep round(frac * n) rows of ``cls`` (hash order) and every other row."""
    is_cls = F.coalesce(F.col(label_col) == F.lit(cls), F.lit(False))
    major = with_cuts(df.where(is_cls), id_col, {"0": lambda n: round_frac(n, frac)}, (), seed)
    return major.where("_below_0").drop("_below_0").unionByName(df.where(~is_cls))


def oversample_balanced(df: DataFrame, label_col: str, id_col: str,
                        seed: int = DEFAULT_SEED, copy_col: str = "copy") -> DataFrame:
    """Resample with replacement so each class weighs the same.

    A row of class c is drawn on average w_c = n / (k * n_c) times (the
    'balanced' class weight); it is emitted floor(w_c) times plus once more
    with probability frac(w_c), decided by its own hash -- no global sampler,
    no driver loop, and the expected total stays n.
    """
    from netsieve.operators.features import class_weights
    w = class_weights(df, label_col).select(F.col(label_col).alias("_l"), "weight")
    u = hash_uniform(hash_key(id_col, seed))
    base = F.floor("weight")
    copies = (base + F.when(u < F.col("weight") - base, 1).otherwise(0)).cast("bigint")
    with_w = df.join(small_side(w), F.col(label_col).eqNullSafe(F.col("_l"))).drop("_l")
    return _repeated(with_w.withColumn("_copies", copies).drop("weight"), id_col, copy_col,
                     (df.count() // max(w.count(), 1)) > COPY_RUN)


def _repeated(df: DataFrame, id_col: str, copy_col: str, spread: bool) -> DataFrame:
    """Each row ``_copies`` times, numbered from 1.

    A rare row may get very many copies: runs of at most COPY_RUN are made
    first and dealt out, then each run is expanded in its own task.
    """
    runs = F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("_copies") / COPY_RUN) - 1)
    dealt = df.where(F.col("_copies") > 0).withColumn("_run", F.explode(runs))
    if spread:
        dealt = dealt.repartition(id_col, "_run")
    first = F.col("_run") * COPY_RUN + 1
    return (dealt.withColumn(copy_col, F.explode(F.sequence(first, F.least(F.col("_copies"), first + (COPY_RUN - 1)))))
            .withColumn(copy_col, F.col(copy_col).cast("int")).drop("_copies", "_run"))


def weighted_resample(df: DataFrame, label_col: str, id_col: str, n: int | None = None,
                      seed: int = DEFAULT_SEED, copy_col: str = "copy") -> DataFrame:
    """Exactly ``n`` rows (default: as many as ``df`` has), drawn with replacement, classes weighing the same.

    Systematic draws: the rows lie on a line of length n, class after class in
    label order (NULL last) and in hash order inside a class, each as long as
    its share of n; a row is drawn once for every point j + 1/2 it covers.
    Its place follows from the class's number, size and the row's rank, so no
    running sum crosses classes; all arithmetic is in integers.
    """
    every = Window.partitionBy()
    classes = (df.groupBy(F.col(label_col).alias("_l")).agg(F.count(F.lit(1)).alias("_size"))      # one row per class
               .select("_l", (F.row_number().over(Window.orderBy(F.asc_nulls_last("_l"))) - 1).alias("_class"),
                       F.count(F.lit(1)).over(every).alias("_k"), F.sum("_size").over(every).alias("_total")))
    ranked = hash_rank(df, id_col, [label_col], seed)
    t = ranked.join(small_side(classes), F.col(label_col).eqNullSafe(F.col("_l")))
    t = t.withColumn("_draws", F.col("_total") if n is None else F.lit(n).cast("bigint"))

    def points_before(rank: str) -> str:
        at = f"cast(_draws as decimal(38, 0)) * (cast(_class as decimal(20, 0)) * {SIZE} + {rank})"
        cell = f"cast(_k as decimal(20, 0)) * {SIZE}"
        return f"((2 * {at} + {cell} - 1) div (2 * {cell}))"
    copies = F.expr(f"{points_before(f'{RANK} + 1')} - {points_before(RANK)}")
    return _repeated(t.withColumn("_copies", copies).drop("_l", "_class", "_k", "_total", "_draws", RANK, SIZE), id_col, copy_col,
                     (n or df.count()) // max(classes.count(), 1) > COPY_RUN)


def split_class_counts(df: DataFrame, label_col: str, split_col: str,
                       splits=("train", "test")) -> DataFrame:
    """Class x split counts (explicit pivot values: no extra distinct job)."""
    out = df.groupBy(label_col).pivot(split_col, list(splits)).count()
    return out.select(label_col, *[F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias(f"n_{s}")
                                   for s in splits])


def labels_missing(train: DataFrame, other: DataFrame, label_col: str) -> DataFrame:
    """Labels present in ``train`` but absent from ``other`` (NULL is a label).

    Both sides are reduced to their distinct labels first, so the join is of one row per label.
    """
    mark = F.max(F.when(F.col("_in"), 1).otherwise(0))
    both = (train.select(label_col).distinct().withColumn("_in", F.lit(False))
            .unionByName(other.select(label_col).distinct().withColumn("_in", F.lit(True))))
    return both.groupBy(label_col).agg(mark.alias("_m"), F.count_if(~F.col("_in")).alias("_t")) \
        .where("_m = 0 and _t > 0").select(label_col)
