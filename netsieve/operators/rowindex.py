"""Global 0-based row index in a given order (W1), without a single-partition window.

``row_number() over (order by k)`` with no partition moves every row into one
task.  Instead:

1. range-partition by the order key and sort inside partitions;
2. tag rows with (partition id, position in partition) from
   ``monotonically_increasing_id`` (upper 31 bits = partition, lower 33 = position);
3. materialise that table (parquet in the shared checkpoint folder, so a
   recomputation cannot move partition borders and a lost executor is
   recovered from files);
4. count rows per partition -- one row per partition, a bounded broadcast --
   and add the exclusive prefix sum to every position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsieve.session import checkpoint_dir
from netsieve.sources.sinks import materialize

_LOW = (1 << 33) - 1


def with_row_index(df: DataFrame, order_cols, out_col: str = "row_id",
                   num_partitions: int | None = None) -> DataFrame:
    """Add a dense index following ``order_cols`` (which should be unique)."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = list(order_cols)
    sorted_df = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    mid = F.monotonically_increasing_id()
    tagged = sorted_df.withColumn("_mid", mid).select(
        "*", F.shiftright("_mid", 33).cast("int").alias("_pid"),
        F.col("_mid").bitwiseAND(F.lit(_LOW)).alias("_pos")).drop("_mid")
    # Materialise as a parquet table in the shared folder (columnar, compressed); the
    # (partition, position) tags are data, so a re-read cannot move them.
    tagged = materialize(tagged, "row-index")
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_cnt")
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(out_col, (F.col("_off") + F.col("_pos")).cast("bigint"))
            .drop("_pid", "_pos", "_off"))
