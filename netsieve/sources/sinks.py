"""Sinks: versioned table writes (K2, K3, K4) -- never overwrite an input."""

from __future__ import annotations

from pyspark.sql import DataFrame

from netsieve.session import scratch_path


def write_versioned(df: DataFrame, name: str, partition_by=(), root: str | None = None,
                    fmt: str = "parquet") -> str:
    """Write ``df`` to a fresh version folder and return its path.

    With ``partition_by=("split",)`` readers that filter on the split only
    list and scan that split's folder (partition pruning).
    """
    spark = df.sparkSession
    path = f"{root.rstrip('/')}/{name}" if root else scratch_path(spark, name)
    w = df.write.mode("errorifexists").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def materialize(df: DataFrame, name: str, partition_by=()) -> DataFrame:
    """K2 + S5 + J1: write a reused intermediate (e.g. the split table) once and read it back.

    Features, label and split live in ONE table keyed by ``row_id`` (no
    positional pairing of feature and label files); readers select a split with
    ``where(split = ...)``, which prunes to that partition folder.

    Later statistics passes then scan files instead of recomputing the
    lineage (shuffles included), and a lost executor costs a file re-read.
    """
    path = write_versioned(df, name, partition_by)
    return df.sparkSession.read.parquet(path)
