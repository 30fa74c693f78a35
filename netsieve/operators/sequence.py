"""Flow sequences: tumbling and sliding count windows, event-time windows.

Neither count window uses a window function over one global order, so no
step needs all rows in one task: a tumbling window is
``groupBy(floor(row_id / L))`` (groups of at most L rows); a sliding window
runs a bounded frame inside fixed-size blocks of the index, each block
extended by the L - 1 rows that follow it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsieve.functions.expressions import is_attack
from netsieve.operators.rowindex import with_row_index


def _features_array(cols):
    return F.array(*[F.col(c).cast("double") for c in cols])


def _numbered(df: DataFrame, order_col: str, out_col: str) -> DataFrame:
    """``out_col``: 0-based position; the order column itself unless it has gaps (a filtered table)."""
    span = df.agg(F.min(order_col).alias("lo"), F.max(order_col).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if span["n"] and (span["lo"] != 0 or span["hi"] != span["n"] - 1):
        return with_row_index(df, [order_col], out_col)
    return df.withColumn(out_col, F.col(order_col))


def sequence_ids(df: DataFrame, order_col: str, length: int = 10,
                 out_col: str = "sequence_id") -> DataFrame:
    """``sequence_id = floor(row_id / length)``."""
    return df.withColumn(out_col, F.floor(F.col(order_col) / length).cast("bigint"))


def tumbling_sequences(df: DataFrame, order_col: str, feature_cols, label_col: str,
                       length: int = 10) -> DataFrame:
    """W3 + A16 + A18 + G2: full windows of ``length`` rows, ordered features, majority label.

    Output: sequence_id, first_row, n_rows, seq (array<array<double>>), label.
    The majority label breaks ties toward the smallest label (smallest class index).
    """
    s = sequence_ids(_numbered(df, order_col, "_at"), "_at", length)
    g = s.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col(order_col).alias("o"),
                                             _features_array(feature_cols).alias("x"))))
        .alias("rows"),
        F.mode(label_col, True).alias("label"),
        F.count(F.lit(1)).alias("n_rows"))
    return (g.where(F.col("n_rows") == length)
            .select("sequence_id", F.col("rows")[0]["o"].alias("first_row"), "n_rows",
                    F.transform("rows", lambda r: r["x"]).alias("seq"), "label"))


def sliding_sequences(df: DataFrame, order_col: str, feature_cols, label_col: str,
                      length: int = 5, benign: str = "BENIGN",
                      block_rows: int = 1 << 13) -> DataFrame:
    """W4 + A17 + G3: windows of ``length`` consecutive rows, stride 1, label = any attack.

    Rows follow one another in ``order_col``; on an index with gaps (a filtered
    table) the rows are first numbered anew (see ``with_row_index``), as a check of
    min, max and count decides, so the result never depends on ``block_rows``.
    ``start`` is the first row's ``order_col``.  n rows give n - length + 1 windows.  Like the reference, windows run across day and file borders.

    Plan: the index is cut into blocks of ``block_rows``; the first
    ``length - 1`` rows of each block are copied into the previous block (a
    halo), and a frame ``rows between current row and length-1 following``
    runs per block.  The shuffle moves about n rows (not length x n), and no
    window partition holds more than ``block_rows + length - 1`` rows.
    """
    base = df.select(F.col(order_col).cast("bigint").alias("s"),
                     _features_array(feature_cols).alias("x"),
                     is_attack(label_col, benign).alias("y"))
    base = _numbered(base, "s", "o")
    o = F.col("o")
    blk = F.floor(o / block_rows).cast("bigint")
    own = base.withColumn("blk", blk).withColumn("halo", F.lit(False))
    halo = (base.where(((o % block_rows) < (length - 1)) & (o >= block_rows))
            .withColumn("blk", blk - 1).withColumn("halo", F.lit(True)))
    w = Window.partitionBy("blk").orderBy("o").rowsBetween(0, length - 1)
    framed = own.unionByName(halo).select(
        F.col("s").alias("start"), "halo",
        F.count(F.lit(1)).over(w).alias("n_rows"),
        F.collect_list("x").over(w).alias("seq"),
        F.max("y").over(w).alias("is_attack"))
    return (framed.where(~F.col("halo") & (F.col("n_rows") == length))
            .select("start", "n_rows", "seq", "is_attack"))


def sliding_sequences_by(df: DataFrame, partition_cols, order_col: str, feature_cols,
                         label_col: str, length: int = 5, benign: str = "BENIGN") -> DataFrame:
    """W4 per entity (D14 option): windows never cross ``partition_cols`` borders.

    Uses a frame ``rows between current row and length-1 following``; an
    entity's rows share one window partition, so use it for many entities of
    bounded size (use ``sliding_sequences`` on a per-entity dense index otherwise).
    """
    w = Window.partitionBy(*partition_cols).orderBy(order_col).rowsBetween(0, length - 1)
    out = df.select(*partition_cols, F.col(order_col).alias("start"),
                    F.collect_list(_features_array(feature_cols)).over(w).alias("seq"),
                    F.max(is_attack(label_col, benign)).over(w).alias("is_attack"),
                    F.count(F.lit(1)).over(w).alias("n_rows"))
    return out.where(F.col("n_rows") == length)


def event_time_sequences(df: DataFrame, key_cols, ts_col: str, feature_cols, label_col: str,
                         window: str = "1 minute", benign: str = "BENIGN",
                         order_col: str | None = None) -> DataFrame:
    """Flows grouped by entity (e.g. IP pair) and a tumbling event-time window.

    Works on batch and streaming frames; on a stream, cast ``ts_col`` to
    TIMESTAMP and add a watermark first (a watermark needs TIMESTAMP, not
    TIMESTAMP_NTZ).  Rows inside a sequence are ordered by time, then
    ``order_col``.  A sequence holds all flows of one entity in one window.
    """
    ts = F.col(ts_col)
    tie = [F.col(order_col).alias("o")] if order_col else []
    return (df.groupBy(*key_cols, F.window(ts, window).alias("w"))
            .agg(F.sort_array(F.collect_list(F.struct(ts.alias("t"), *tie,
                                                      _features_array(feature_cols).alias("x"))))
                 .alias("rows"),
                 F.max(is_attack(label_col, benign)).alias("is_attack"),
                 F.count(F.lit(1)).alias("n_rows"))
            .select(*key_cols, F.col("w.start").alias("window_start"),
                    F.col("w.end").alias("window_end"), "n_rows",
                    F.transform("rows", lambda r: r["x"]).alias("seq"), "is_attack"))


def event_time_chunks(df: DataFrame, key_cols, ts_col: str, feature_cols, label_col: str, order_col: str,
                      window: str = "1 minute", max_rows: int = 1000, benign: str = "BENIGN") -> DataFrame:
    """W7 with bounded sequences: an entity's window is cut into chunks of at most ``max_rows`` flows by position.

    The rows are numbered once in (key, window, time, order) order by the
    two-pass index; the smallest number of each key and window is a partial
    aggregate, and position // max_rows is the chunk.  No task ever holds more than
    one chunk of an entity, however many flows it has in a window.
    """
    t = df.withColumn("_w", F.window(F.col(ts_col), window)["start"])
    t = with_row_index(t, [*key_cols, "_w", ts_col, order_col], "_idx")
    first = t.groupBy(*key_cols, "_w").agg(F.min("_idx").alias("_first"))
    t = t.join(first, [*key_cols, "_w"]).withColumn("chunk", F.floor((F.col("_idx") - F.col("_first")) / max_rows).cast("bigint"))
    return (t.groupBy(*key_cols, F.col("_w").alias("window_start"), "chunk")
            .agg(F.sort_array(F.collect_list(F.struct(F.col("_idx").alias("o"), _features_array(feature_cols).alias("x"))))
                 .alias("rows"),
                 F.max(is_attack(label_col, benign)).alias("is_attack"), F.count(F.lit(1)).alias("n_rows"))
            .select(*key_cols, "window_start", "chunk", "n_rows", F.transform("rows", lambda r: r["x"]).alias("seq"), "is_attack"))


def summary(flows_df: DataFrame, sequences: DataFrame, feature_cols, label_col: str,
            length: int) -> DataFrame:
    """X11: one-row data summary -- rows, features, classes, sequence length and count."""
    stats = flows_df.agg(F.count(F.lit(1)).alias("n_rows"),
                         F.count_distinct(label_col).alias("n_classes")).first()
    n_seq = sequences.count()
    return flows_df.sparkSession.createDataFrame(
        [(stats["n_rows"], len(list(feature_cols)), stats["n_classes"], length, n_seq)],
        "n_rows bigint, n_features bigint, n_classes bigint, seq_length bigint, "
        "n_sequences bigint")
