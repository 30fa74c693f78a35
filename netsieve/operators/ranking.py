"""Exact per-class cuts and ranks in hash order without a per-class window (core of every split/sample).

``row_number() over (partition by class order by md5(id||seed))`` is exact but
sends a whole class to one task, and one class (benign traffic) can hold a
third of all rows.  Here the md5 key's leading hex digits cut each class into
``16**digits`` buckets that sort in the same order as the key:

* a partial aggregation counts rows per (class, bucket) -- at most
  ``classes x 16**digits`` rows, however large the table;
* a running sum over that small table gives each bucket's starting rank;
* a window partitioned by (class, bucket) ranks rows inside their bucket, so
  the hottest class is spread over thousands of independent window groups;
* rank = bucket start + rank inside the bucket (identical to the global window).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsieve.functions.hashing import DEFAULT_SEED, hash_bucket, hash_key
from netsieve.functions.joins import join_bounded, small_side
from netsieve.sources.sinks import materialize

RANK = "_rank"
SIZE = "_n"


def hash_rank(df: DataFrame, id_col: str, class_cols=(), seed: int = DEFAULT_SEED,
              digits: int = 4) -> DataFrame:
    """Add ``_rank`` (0-based position inside its class in md5 order) and ``_n``.

    The class is carried as non-null key columns (value as string + null flag)
    so the window, the bucket counts and the join all use the same
    hash-partitioning expressions: the large ranked side is shuffled once (by
    the window) and the join reuses that partitioning, while the small count
    table moves (or is broadcast by AQE once measured).
    """
    t, keys = _class_keys(df, class_cols)
    t = (t.withColumn("_h", hash_key(id_col, seed))
          .withColumn("_b", hash_bucket(F.col("_h"), digits)))
    counts = t.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    cum = Window.partitionBy(*keys).orderBy("_b")
    counts = (counts
              .withColumn("_start", F.coalesce(
                  F.sum("_cnt").over(cum.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .withColumn(SIZE, F.sum("_cnt").over(Window.partitionBy(*keys)))
              .drop("_cnt"))
    inner = Window.partitionBy(*keys, "_b").orderBy("_h", id_col)
    ranked = t.withColumn("_in", F.row_number().over(inner) - 1)
    joined = ranked.join(counts, keys + ["_b"])
    return (joined.withColumn(RANK, (F.col("_start") + F.col("_in")).cast("bigint"))
            .withColumn(SIZE, F.col(SIZE).cast("bigint"))
            .drop("_h", "_b", "_in", "_start", *keys))


def _class_keys(df: DataFrame, class_cols) -> tuple[DataFrame, list[str]]:
    """Non-null key columns (value as string + null flag), so a NULL class is a class."""
    keys, t = [], df
    for i, c in enumerate(class_cols):
        t = (t.withColumn(f"_c{i}", F.coalesce(F.col(c).cast("string"), F.lit("")))
              .withColumn(f"_z{i}", F.col(c).isNull()))
        keys += [f"_c{i}", f"_z{i}"]
    return t, keys


#: Rows of a crossing bucket that one task may rank; a larger bucket is counted at a finer prefix first.
FINISH_ROWS = 100_000
PREFIX_DIGITS = 4


def cut_keys(df: DataFrame, id_col: str, cuts: dict, class_cols=(), seed: int = DEFAULT_SEED) -> DataFrame:
    """One row per class: for each cut the hash key below which exactly that many rows of the class lie.

    ``cuts`` maps a name to a function of the class size (a column) giving the
    number of rows.  The rows are only counted, by class and leading hash
    digits (partial aggregation of two narrow columns); the bucket the cut
    falls into is counted again at a longer prefix until it is small, and then
    ranked.  A cut at or beyond the class size gives a NULL key (all rows lie below).
    """
    t, keys = _class_keys(df, class_cols)
    base = t.select(*keys, hash_key(id_col, seed).alias("_h")).withColumn("_all", F.lit(0))
    keys = [*keys, "_all"]
    by_class = Window.partitionBy(*keys)
    counts = base.groupBy(*keys, F.substring("_h", 1, PREFIX_DIGITS).alias("_p")).agg(F.count(F.lit(1)).alias("_cnt"))
    counts = counts.withColumn("_n", F.sum("_cnt").over(by_class)).withColumn(
        "_start", F.sum("_cnt").over(by_class.orderBy("_p")) - F.col("_cnt"))
    want = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), f(F.col("_n")).cast("bigint").alias("at"))
                               for k, f in cuts.items()]))
    cross = (counts.withColumn("_w", want)
             .where((F.col("_start") <= F.col("_w.at")) & (F.col("_w.at") < F.col("_start") + F.col("_cnt")))
             .select(*keys, "_p", "_cnt", F.col("_w.name").alias("_name"), (F.col("_w.at") - F.col("_start")).alias("_skip")))
    digits = PREFIX_DIGITS
    while digits + PREFIX_DIGITS <= 32:
        cross = materialize(cross, "cut-buckets")
        if (cross.agg(F.max("_cnt")).first()[0] or 0) <= FINISH_ROWS:
            break
        inside = Window.partitionBy(*keys, "_name")
        finer = (base.withColumn("_p", F.substring("_h", 1, digits)).join(small_side(cross.drop("_cnt")), [*keys, "_p"])
                 .groupBy(*keys, "_name", "_skip", F.substring("_h", 1, digits + PREFIX_DIGITS).alias("_q"))
                 .agg(F.count(F.lit(1)).alias("_cnt"))
                 .withColumn("_start", F.sum("_cnt").over(inside.orderBy("_q")) - F.col("_cnt")))
        cross = (finer.where((F.col("_start") <= F.col("_skip")) & (F.col("_skip") < F.col("_start") + F.col("_cnt")))
                 .select(*keys, F.col("_q").alias("_p"), "_cnt", "_name", (F.col("_skip") - F.col("_start")).alias("_skip")))
        digits += PREFIX_DIGITS
    order = Window.partitionBy(*keys, "_name").orderBy("_h")
    found = (base.withColumn("_p", F.substring("_h", 1, digits)).join(small_side(cross.drop("_cnt")), [*keys, "_p"])
             .withColumn("_r", F.row_number().over(order) - 1).where(F.col("_r") == F.col("_skip")))
    picked = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == k, F.col("_h"))).alias(f"_cut_{k}") for k in cuts])
    sizes = counts.groupBy(*keys).agg(F.max("_n").alias(SIZE))
    return sizes.join(picked, keys, "left")


def below(cut: str, id_col: str, seed: int = DEFAULT_SEED) -> Column:
    """The row lies below its class's cut key."""
    return F.col(cut).isNull() | (hash_key(id_col, seed) < F.col(cut))


def with_cuts(df: DataFrame, id_col: str, cuts: dict, class_cols=(), seed: int = DEFAULT_SEED) -> DataFrame:
    """``df`` plus ``_below_<name>`` per cut: a projection over a join with one row per class.

    The rows are neither shuffled nor ranked; the class table is broadcast after it is counted.
    """
    table = materialize(cut_keys(df, id_col, cuts, class_cols, seed), "class-cuts")
    t, keys = _class_keys(df, class_cols)
    t = t.withColumn("_all", F.lit(0))
    joined = join_bounded(t, table.drop(SIZE), [*keys, "_all"])
    return (joined.withColumns({f"_below_{k}": below(f"_cut_{k}", id_col, seed) for k in cuts})
            .drop(*keys, "_all", *[f"_cut_{k}" for k in cuts]))


def dec(x: float) -> Column:
    """An exact decimal literal (so ceil(n * 0.2) is not thrown off by binary floats)."""
    return F.lit(Decimal(str(x)))


def ceil_frac(n, frac: float) -> Column:
    """ceil(n * frac) in exact decimal arithmetic, as bigint."""
    n = F.col(n) if isinstance(n, str) else n
    return F.ceil(n * dec(frac)).cast("bigint")


def floor_frac(n, frac: float) -> Column:
    n = F.col(n) if isinstance(n, str) else n
    return F.floor(n * dec(frac)).cast("bigint")


def round_frac(n, frac: float) -> Column:
    """round(n * frac), half away from zero, exact."""
    n = F.col(n) if isinstance(n, str) else n
    return F.round(n * dec(frac), 0).cast("bigint")
